"""Decontamination, licenses, SentencePiece and line dedup against plain versions."""

import random
import re
import string

import pytest
from pyspark.sql import functions as F

from marketloom.llm import decontaminate, licenses, lines, pieces
from marketloom.llm.queries import tokenizer

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(text, items, n=13):
    w, hit, ids = words(text), set(), set()
    for i, t in items:
        x = words(t)
        k = min(n, len(x))
        for j in range(len(x) - k + 1 if k else 0):
            for at in range(len(w) - k + 1):
                if w[at : at + k] == x[j : j + k]:
                    hit |= set(range(at, at + k))
                    ids |= {str(i)} if i is not None else set()
    return len(w), len(hit), sorted(ids)


@pytest.mark.parametrize("block", [8 << 20, 40])
def test_decontaminate(spark, docs, empty, block):
    base = docs.where("doc_id = 1").first().text
    items = [(1, " ".join(base.split()[10:40])), (2, "A LINE that repeats"), (3, ""), (4, None), (None, "without an id"), (5, "nowhere " * 14)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    some = docs.where("doc_id is null or doc_id <> 9")
    got = decontaminate.scan(some, bench, block_bytes=block)
    for r in got.collect():
        c = r.contamination
        assert (c["n_words"], c["n_hit"], c["items"]) == brute(r.text, items), r.doc_id
    assert set(docs.columns) <= set(got.columns)
    left = decontaminate.remove_documents(got)
    assert 1 not in {r.doc_id for r in left.collect()} and left.columns == docs.columns
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(got).collect()}
    assert cut[5] is None and cut[3] == "short" and "a line that repeats" not in cut[8]
    assert decontaminate.scan(empty, bench).count() == 0
    assert decontaminate.scan(docs, bench.where("false")).where("contamination.n_hit > 0").count() == 0


@pytest.mark.parametrize(("items", "block"), [(57, 4000), (400, 1000), (30, 40)])
def test_blocks_are_few_and_bounded(spark, items, block):
    texts = [(k, " ".join(f"w{k}x{j}" for j in range(3 + k % 60))) for k in range(items)]
    bench = spark.createDataFrame(texts, "item_id long, text string")
    blocks = list(decontaminate._blocks(bench, "item_id", "text", 13, block))
    size = sum(len(t.encode()) for b in blocks for _, t in b)
    window = max(len(" ".join(t.split()[:13]).encode()) + 20 for _, t in texts)
    assert len(blocks) <= 2 * size / block + 1 and all(blocks)
    assert all(sum(len(t.encode()) for _, t in b) <= block + window for b in blocks)
    have = {" ".join(w[i : i + 13]) for b in blocks for _, t in b for w in [t.split()] for i in range(max(1, len(w) - 12))}
    assert have >= {" ".join(w[i : i + 13]) for _, t in texts for w in [t.split()] for i in range(max(1, len(w) - 12))}


def test_licenses(spark, docs, empty):
    got = {r.doc_id: r.licenses for r in licenses.scan(docs).collect()}
    for r in docs.select("doc_id", "text").collect():
        w = words(r.text)
        places = sorted((i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert [(x["word"], x["label"]) for x in got[r.doc_id]["places"]] == places
        assert got[r.doc_id]["n_words"] == len(w)
    fuzzy = got[11]["notices"]
    assert [x["label"] for x in fuzzy] == ["apache-2"] and fuzzy[0]["first_word"] == 0 and 0 < fuzzy[0]["edits"] <= 4
    assert got[1]["notices"] == []
    assert licenses.scan(empty).count() == 0


def test_every_notice_within_its_errors():
    """Pigeonhole: a notice with as many errors as allowed is found."""
    import pyarrow as pa

    from marketloom.llm.words import buffers
    from marketloom.llm.words import words as split

    scanner = licenses.Scanner(licenses.PHRASES, licenses.NOTICES)
    for label, text, k in licenses.NOTICES:
        step = len(text) // k
        broken = "".join("q" if i % step == step // 2 and i // step < k and c != " " else c for i, c in enumerate(text))
        w = split(*buffers(pa.array(["before it " + broken + " and after"])), licenses.KEEP)
        assert label in {hit[1] for hit in scanner.fuzzy(w)}, text


def test_sentencepiece(spark, docs, empty):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=tokenizer())
    for r in pieces.encode(docs.drop("ids"), tokenizer()).collect():
        assert r.ids == library.encode(r.text or "", add_eos=True)
        assert r.decoded == library.decode(r.ids)
    assert pieces.encode(empty.drop("ids"), tokenizer()).count() == 0


def test_agendas_agree():
    """Rows of pair ranks and the heap give the same merges, and a small memory gives the same ids."""
    v = pieces.Vocabulary(tokenizer())
    segments = ["▁the", "▁internationalisation", "▁▁▁x", "▁1234.5", "▁ééé", "▁" + "ab" * 40, "▁", "▁\n\n", "▁日本"]
    assert v.encode_segments(segments) == [v.encode_segment(s) for s in segments]
    texts = ["a bb ccc dddd", "eeeee a bb", "a", "zz yy xx ww"]
    assert pieces.Encoder(tokenizer(), memory=3).encode(texts) == pieces.Encoder(tokenizer()).encode(texts)


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def _norm(line):
    return " ".join("".join(c if c.isalpha() else "0" if c.isdigit() else " " for c in line.lower()).split())


def _alike(a, b):
    wa, wb = set(a.split()), set(b.split())
    return 2 * len(wa & wb) >= max(len(wa), len(wb)) and _edits(a, b) <= 0.2 * max(len(a), len(b))


def _kept(rows):
    """Texts after line dedup over (doc_id, text) with every pair of lines compared: no SimHash, no buckets."""
    lines_ = [(i, k, _norm(x)) for i, t in rows for k, x in enumerate((t or "").split("\n")) if _norm(x)]
    nodes = sorted({n for _, _, n in lines_})
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for x, a in enumerate(nodes):
        for b in nodes[:x]:
            if _alike(a, b):
                parent[root(a)] = root(b)
    stays = {}
    for i, k, n in lines_:
        stays[root(n)] = min(stays.get(root(n), (i, k)), (i, k))
    gone = {(i, k) for i, k, n in lines_ if stays[root(n)] != (i, k)}
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}


def test_line_dedup(spark):
    long = [f"token{chr(97 + i % 26)}{i // 26 * 'x'} other{chr(97 + i % 5)}" for i in range(90)]
    texts = {
        1: "Shared line, number 7 here\n" + " ".join(long),
        2: "shared LINE number 8 here!\nown words of the second text",
        3: " ".join([*long[:60], "changed", *long[61:]]) + "\n\n---\nown words of the third text",
        4: "shared line number 1 here",
        5: "",
        6: None,
        7: " ".join(f"very{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)),
        8: " ".join(f"very{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)) + " more",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("emptied", F.lit("x"))
    want = _kept(list(texts.items()))
    got = {r.doc_id: r for r in lines.dedup(docs).collect()}
    assert {k: r.text for k, r in got.items()} == want
    assert got[4].emptied and not got[5].emptied and not got[2].emptied
    assert "key" in docs.columns and lines.dedup(docs.where("false")).count() == 0


def test_recall_of_changed_words(spark):
    """Against plain edit similarity of all pairs: at least nine in ten links of one and two changed words, and no other line leaves."""
    rng = random.Random(3)
    words_ = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    rows, groups_ = [], []
    for size in (8, 10, 20, 40, 130):
        for changes in (1, 2):
            for _ in range(20):
                line = [rng.choice(words_) for _ in range(size)]
                other = list(line)
                for at in rng.sample(range(size), changes):
                    other[at] = rng.choice(words_)
                rows += [(len(rows), " ".join(line)), (len(rows) + 1, " ".join(other))]
                if _alike(*[r[1] for r in rows[-2:]]):
                    groups_.append(rows[-1][0])
    out = {r.doc_id: r.emptied for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(groups_) > 120 and sum(out[i] for i in groups_) >= 0.9 * len(groups_)
    assert {i for i, e in out.items() if e} <= set(groups_)


def test_buckets_of_several_groups(spark):
    """Lines that share half of their words but fall into many groups: buckets are split, and every group is found."""
    rng = random.Random(8)
    common = [f"com{c}" for c in "abcdefghijkl"]
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5))
    rows = []
    for _ in range(12):
        own = [word() for _ in range(10)]
        for _ in range(3):
            line = [*common, *own]
            line[rng.randrange(len(line))] = word()
            rows.append((len(rows), " ".join(line)))
    out = {r.doc_id: r.emptied for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: e for i, e in out.items()} == {i: t == "" for i, t in _kept(rows).items()}


def test_very_long_lines(spark):
    """Lines above LONG are compared by their words, in bounded time."""
    base = [f"word{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i // 100 % 10]}{'abcdefghij'[i // 1000 % 10]}" for i in range(9000)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:4000], "another", *base[4001:]])), (3, " ".join(base[::2]))]
    out = {r.doc_id: r.emptied for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: False, 2: True, 3: False}


def test_simhash_counts(spark):
    """Bits against a plain count, below and above the chunk size."""
    text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i * i // 26 % 26)}{'q' * (i // 200)}" for i in range(700)) + "\nfew words only few"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    hashes = {r.w: r.h & (1 << 64) - 1 for r in docs.select(F.explode(F.array_distinct(F.split(F.translate("text", "\n", " "), " "))).alias("w")).select("w", F.xxhash64(F.lit(0), "w").alias("h")).collect()}
    assert len(hashes) > lines.CHUNK
    for r in lines.occurrences(docs).collect():
        blocks = [[] for _ in range(lines.BLOCKS)]
        for w in set(text.split("\n")[r.pos].split()):
            blocks[(hashes[w] >> 32) % lines.BLOCKS].append(hashes[w])
        for half, bits in enumerate((r.bits_a, r.bits_b)):
            want = 0
            for b, ws in enumerate(blocks[3 * half : 3 * half + 3]):
                want |= (len(ws) if len(ws) < 4 else 4 + len(ws) % 4) << 3 * lines.WIDTH + 3 * b
                want |= sum(1 << lines.WIDTH * b + k for k in range(lines.WIDTH) if 2 * sum(h >> k & 1 for h in ws) > len(ws))
            assert bits == want


def test_awkward_rows(spark, docs):
    out = lines.dedup(docs)
    assert out.count() == docs.count() and set(docs.columns) < set(out.columns)


def test_repeated_rows_keep_their_simhash(spark):
    """A row stored several times gives the bits of one copy, and its near-copies still go."""
    base = [f"token{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    near = " ".join([*base[:77], "changed", *base[78:]])
    once = [(1, " ".join(base)), (2, near + "\nten short words that nobody else has in a line"), (None, "a text without an id")]
    one = spark.createDataFrame(once, "doc_id long, text string")
    many = spark.createDataFrame([r for r in once for _ in range(1 if r[0] == 1 else 3)], "doc_id long, text string")
    bits = lambda d: {(r.key, r.pos, r.n1, r.n2, r.bits_a, r.bits_b) for r in lines.occurrences(d).collect()}
    assert bits(many) == bits(one)
    got = lines.dedup(many).collect()
    assert len(got) == len(once) * 3 - 2
    assert {r.text for r in got if r.doc_id == 2} == {"ten short words that nobody else has in a line"}


def test_lines_equal_but_for_signs_and_numbers(spark):
    """Signs and white space beyond ASCII separate words, and numbers of any length are one."""
    pairs = [("\u00abLe monde\u00bb \u2014 voil\u00e0\u2026", "le monde, voil\u00e0!"), ("see\u00a0page\u202f9 \u2013 of \u201cthe\u201d book", "see page 10 of the book"), ("im Jahr \u0663\u0664", "im jahr 2024")]
    for a, b in pairs:
        got = {r.doc_id: r for r in lines.dedup(spark.createDataFrame([(1, a), (2, b + "\n\u2014 \u2026")], "doc_id long, text string")).collect()}
        assert got[1].text == a and got[2].text == "\u2014 \u2026" and got[2].emptied, a


def test_edits_of_a_line_count_characters(spark):
    """One letter of a short line is one edit, and a whole word is as many as it is long."""
    rows = [((1, 1), "subscribe to our newslettr"), ((2, 2), "subscribe to our newsletter"), ((3, 3), "one two three internationalisation four"), ((4, 4), "one two three supercalifragilistic four")]
    texts = spark.createDataFrame(rows, "node struct<n1: long, n2: long>, norm string")
    pairs = spark.createDataFrame([((1, 1), (2, 2)), ((3, 3), (4, 4))], "a struct<n1: long, n2: long>, b struct<n1: long, n2: long>")
    assert [(r.a.n1, r.b.n1) for r in lines._links(pairs, texts, 0.8).collect()] == [(1, 2)]


def _notices(text):
    import pyarrow as pa

    from marketloom.llm.words import buffers
    from marketloom.llm.words import words as split

    scanner = licenses.Scanner(licenses.PHRASES, licenses.NOTICES)
    return [hit[1:5] for hit in scanner.fuzzy(split(*buffers(pa.array([text])), licenses.KEEP))]


def test_other_licenses_get_no_label():
    """Names and versions stand exactly, whatever errors the wording around them may have."""
    other = ("released under the bsd license", "released under the gpl license", "released under the commit license", "licensed under cc by sa 4 0", "licensed under cc by nd 4 0", "licensed under the gnu general public license version 2", "licensed under the apache license version 1 1", "licensed under the apple license version 2 0", "subject to the terms of the mozilla public license v 1 1")
    for text in other:
        assert _notices("before it " + text + " and after") == [], text


def test_neighbouring_notices():
    """An inexact notice before an exact one is reported too, and one after another licence's."""
    assert _notices("released under the mit licence released under the mit license") == [("mit", 0, 4, 1), ("mit", 5, 9, 0)]
    assert _notices("released under the bsd license relaesed undr the mit license") == [("mit", 5, 9, 3)]


def test_no_pair_of_a_bucket_is_lost(spark):
    """Lines that are like a member of their bucket and not like its centre: all pairs meet, in a bucket of several slices too."""
    rng = random.Random(21)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    common, texts = [word(4) for _ in range(12)], []
    for _ in range(30):
        own = [word(30) for _ in range(3)]
        texts += [" ".join([*common, *[w + "z" * k for w in own]]) for k in range(2)]
    texts += [" ".join(word(9) for _ in range(13)) for _ in range(5)]
    rows = spark.createDataFrame([(1, len(texts), (i, i), i // 4, t) for i, t in enumerate(texts)], "bucket long, m long, node struct<n1: long, n2: long>, root long, text string")
    words = F.split("text", " ")
    own = rows.select("bucket", "m", "node", "root", F.length("text").alias("length"), F.size(words).alias("size"), *lines.signature(words))
    before, lines.SLICE = lines.SLICE, 7
    try:
        met = [(r.a.n1, r.b.n1) for r in lines._meeting(own, 0.8).collect()]
    finally:
        lines.SLICE = before
    alike = {(a, b) for b, y in enumerate(texts) for a, x in enumerate(texts[:b]) if 2 * len(set(x.split()) & set(y.split())) >= 15 and abs(len(x) - len(y)) <= 0.2 * max(len(x), len(y)) and a // 4 != b // 4}
    assert len(met) == len(set(met)) and alike and alike <= set(met) and all(a // 4 != b // 4 and b < 60 for a, b in met)


def test_long_lines_are_compared_by_edits(spark):
    """A line of thousands of characters is compared by its characters as a short one is: small edits in many words are few edits."""
    base = [f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(600)]
    typos = [w if i % 5 else w + "q" for i, w in enumerate(base)]
    cut = ["internationalisationofwords" if i % 5 == 0 else w for i, w in enumerate(base)]
    texts = spark.createDataFrame([((k, k), " ".join(w)) for k, w in enumerate((base, typos, cut))], "node struct<n1: long, n2: long>, norm string")
    pairs = spark.createDataFrame([((0, 0), (1, 1)), ((0, 0), (2, 2))], "a struct<n1: long, n2: long>, b struct<n1: long, n2: long>")
    long = [" ".join(f"{'x' * 30}{i} {w}" if i % 4 == 0 else w for i, w in enumerate(base)), " ".join(f"{'x' * 29}y{i} {w}" if i % 4 == 0 else w for i, w in enumerate(base))]
    texts = texts.unionAll(spark.createDataFrame([((k + 5, k + 5), t) for k, t in enumerate(long)], texts.schema))
    pairs = pairs.unionAll(spark.createDataFrame([((5, 5), (6, 6))], pairs.schema))
    assert min(len(t) for t in long) > 2000 and sum(x != y for x, y in zip(*long)) <= 150
    assert sorted(r.b.n1 for r in lines._links(pairs, texts, 0.8).collect()) == [1, 6]
