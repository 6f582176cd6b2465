"""Classifiers by held-out accuracy, the language model by counts and normalisation."""

import math
import re
import string
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from marketloom.llm import hmm, quality, toxicity
from marketloom.llm.frames import split_rule

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def examples(spark, n=400):
    """Junk repeats words and signs; toxic texts carry insults near second persons."""
    rng, rows = np.random.default_rng(3), []
    for i in range(n):
        w = [f"w{rng.integers(60)}" for _ in range(40)]
        junk, toxic = i % 4 == 0, i % 5 == 0
        if junk:
            w = [x + "!!" for x in w[:8] for _ in range(4)]
        if toxic:
            w[5:5] = ["you", "utter", ["blorg", "snarfish", "grubber"][rng.integers(3)], "blorgling"]
        rows.append((i, " ".join(w), int(not junk), int(toxic)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int").cache()
    return frame.select("doc_id", "text"), frame.select("doc_id", "quality", "toxic")


def test_quality(spark):
    docs, labels = examples(spark)
    model = quality.learn(docs, labels, split_rule("doc_id", 5) != 0)
    got = quality.score(docs, model).join(labels, "doc_id").where(split_rule("doc_id", 5) == 0).collect()
    assert len(got) > 40 and np.mean([(r.score >= 0.3) == r.quality for r in got]) > 0.97


def test_quality_awkward(spark, docs, empty, labels):
    for sample in (labels, labels.where("false")):
        model = quality.learn(docs, sample, F.lit(True))
        got = quality.score(docs.drop("score"), model).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id == 8}) == 1
    assert quality.score(empty.drop("score"), model).count() == 0


def test_toxicity(spark):
    docs, labels = examples(spark)
    model = toxicity.learn(docs, labels, split_rule("doc_id", 4) != 2, trees=8)
    got = model.score(docs).join(labels, "doc_id").where(split_rule("doc_id", 4) == 2).collect()
    assert len(got) > 40 and np.mean([(r.score >= 0.3) == r.toxic for r in got]) > 0.95


def test_toxicity_awkward(spark, docs, empty, labels):
    model = toxicity.learn(docs, labels, F.lit(True))
    got = model.score(docs.drop("score")).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    d, lab = examples(spark)
    fitted = toxicity.learn(d, lab, F.lit(True), trees=3)
    got = fitted.score(docs.drop("score"))
    assert got.count() == docs.count() and "probability" in got.columns
    assert fitted.score(empty.drop("score")).count() == 0


def test_toxicity_of_few_labels(spark):
    """Any labelled table gives scores, however few rows of each kind it has."""
    docs, labels = examples(spark, 120)
    kinds = {k: [r.doc_id for r in labels.where(f"toxic = {k}").orderBy("doc_id").collect()] for k in (0, 1)}
    for few, many in ((0, 4), (1, 30), (5, 5), (6, 6), (7, 40)):
        ids = kinds[1][:few] + kinds[0][:many]
        model = toxicity.learn(docs, labels.where(F.col("doc_id").isin(ids)), F.lit(True), trees=2)
        scores = [r.score for r in model.score(docs).collect()]
        assert len(scores) == 120 and all(0 <= s <= 1 for s in scores)
        assert (model.trees is None) == (few < 6)
        if few < 6:
            assert set(scores) == {few / (few + many)}


def test_sample_counts_rows(spark):
    """The bound holds for rows: an id with more rows than the bound is no example."""
    from marketloom.llm.labelled import sample

    docs = spark.createDataFrame([(1, f"t{i}") for i in range(50)] + [(i, "x") for i in range(2, 30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(1, 30)], "doc_id long, quality int")
    got = sample(docs, labels, "quality", F.lit(True), 20).collect()
    assert 19 <= len(got) <= 20 and all(r.doc_id > 1 for r in got)
    assert sample(docs, labels, "quality", F.lit(True), 100).count() == 78


def test_dense_features(spark):
    """The vectorised features against one document after another."""
    texts = ["You utter blorgling! blorg", "", "plain words here", "b1org you YOU!! are a-b", "no second person blorg x x x x x x x x you"]
    lexicon = toxicity.Lexicon(toxicity._hashes(["blorg"]), np.array([2.0]))
    raw = [t.encode() for t in texts]
    x = toxicity.dense(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]), lexicon, toxicity._hashes(toxicity.SECOND_PERSON))
    for t, row in zip(texts, x, strict=True):
        got = dict(zip(toxicity.FEATURES, row.tolist(), strict=True))
        w = re.findall(r"[0-9a-z]+", t.lower())
        hits, you = [i for i, a in enumerate(w) if a == "blorg"], [i for i, a in enumerate(w) if a == "you"]
        near = [i for i in hits if any(abs(i - j) <= toxicity.NEAR for j in you)]
        inner = [i for i in range(1, len(t) - 1) if not t[i].isalpha() and t[i] != " " and t[i - 1].isalpha() and t[i + 1].isalpha()]
        n, size = max(1, len(w)), max(1, len(t))
        want = {"lexicon_density": len(hits) / n, "lexicon_weight": 2 * len(hits) / n, "heaviest": 2.0 * bool(hits), "log_hits": math.log1p(len(hits)), "second_person": len(you) / n, "near_share": len(near) / max(1, len(hits)), "capitals": sum(c.isupper() for c in t) / size, "punctuation": sum(not c.isalnum() and c != " " for c in t) / size, "exclamations": t.count("!") / size, "obfuscation": len(inner) / size, "log_words": math.log1p(len(w))}
        assert all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want), (t, got, want)


def test_ftrl_against_a_plain_loop():
    rng = np.random.default_rng(2)
    examples_ = []
    for _ in range(30):
        slots = np.unique(rng.integers(0, 50, 6))
        examples_.append((slots, rng.random(len(slots)), int(rng.integers(2))))
    rule = quality.Ftrl(epochs=2)
    z, n = Counter(), Counter()

    def weight(i):
        return 0.0 if abs(z[i]) <= rule.l1 else -(z[i] - math.copysign(rule.l1, z[i])) / ((rule.beta + math.sqrt(n[i])) / rule.alpha + rule.l2)

    for _ in range(2):
        for slots, vals, y in examples_:
            x = {**dict(zip(slots.tolist(), vals.tolist(), strict=True)), 1 << quality.BITS: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / rule.alpha
                z[i] += g - s * w[i]
                n[i] += g * g
    got = rule.fit(examples_)
    assert all(math.isclose(got[i], weight(i), rel_tol=1e-9, abs_tol=1e-12) for i in [*range(50), 1 << quality.BITS])


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None]


def test_hmm_base(spark, docs, empty):
    sizes = hmm.Sizes(states=3, alphabet=16, known=40, rounds=2, run=7)
    rows = [r for r in docs.select("doc_id", "text").collect()]
    fold = lambda i: -1 if i is None else zlib.crc32(str(i).encode()) % 10
    c = Counter(w for r in rows if fold(r.doc_id) for w in tokens(r.text))
    n, v = sum(c.values()), len(c)
    got = hmm.run(docs, split_rule("doc_id", 10) != 0, sizes).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    for r, g in zip(sorted(rows, key=key), sorted(got, key=key), strict=True):
        t = tokens(r.text)
        assert math.isclose(g.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel_tol=1e-9)
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert g.score < 0
    assert hmm.run(empty, F.lit(True), sizes).count() == 0
    assert all(math.isfinite(r.score) for r in hmm.run(docs, F.lit(False), sizes).collect())


def test_hmm_recursions():
    """Forward values and expected counts against the sum over all state paths."""
    from itertools import product

    rng = np.random.default_rng(1)
    m = hmm.Hmm.maximise(rng.random(3), rng.random((3, 3)), rng.random((5, 3)), np.full(5, 0.2), 0.1)
    assert np.allclose(m.emit.sum(axis=0), 1) and np.allclose(m.move.sum(axis=1), 1)
    seqs = [np.array([0, 3, 1, 4]), np.array([4]), np.array([2, 2, 4])]
    symbols, first = np.concatenate(seqs), np.array([0, 4, 5, 8])
    logs = m.forward(symbols, first)
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for s, log in zip(seqs, logs, strict=True):
        total, parts = 0.0, []
        for path in product(range(3), repeat=len(s)):
            p = m.start[path[0]] * m.emit[s[0], path[0]]
            for i in range(1, len(s)):
                p *= m.move[path[i - 1], path[i]] * m.emit[s[i], path[i]]
            total += p
            parts.append((path, p))
        assert math.isclose(log, math.log(total), rel_tol=1e-9)
        for path, p in parts:
            start[path[0]] += p / total
            for i, x in enumerate(path):
                emit[s[i], x] += p / total
                if i:
                    move[path[i - 1], x] += p / total
    a, b, c = m.expect(symbols, first)
    assert np.allclose(a, start) and np.allclose(b, move) and np.allclose(c, emit)


def test_vocabulary_is_a_distribution():
    voc = hmm.Vocabulary(1000, 50, np.array([5, int(hmm.END), 9, 11], dtype=np.uint64), np.array([400, 100, 50, 20]), hmm.Sizes(alphabet=3))
    assert math.isclose(voc.unigram.sum(), 1)
    assert voc.tail_total == 1000 - 400 - 100 - 50 and voc.tail_types == 50 - 2 - 1
