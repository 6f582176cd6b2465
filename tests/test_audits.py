"""Censuses, strata, dense neighbours, the stored index and the log of sources, against plain loops."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.functions.persian import ZWNJ
from marketloom.operators import census, dense, fetching, index, postedit, studio
from marketloom.plans import audits

# ---- aligned changes


def matching(a, b):
    """Equal stretches by the longest common run, the first one of equals, and the same on either side."""
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            if k > best[0]:
                best = (k, i, j)
    k, i, j = best
    if not k:
        return []
    left = matching(a[:i], b[:j])
    right = [(x + i + k, y + j + k, n) for x, y, n in matching(a[i + k :], b[j + k :])]
    return [*left, (i, j, k), *right]


def plain_changes(before, after):
    a, b = re.findall(r"\S+|\s+", before), re.findall(r"\S+|\s+", after)
    out, i, j = [], 0, 0
    for x, y, n in [*matching(a, b), (len(a), len(b), 0)]:
        old, new = "".join(a[i:x]).strip(), "".join(b[j:y]).strip()
        if old and new and old != new:
            out.append((old, new))
        i, j = x + n, y + n
    return out


def test_alignment(spark):
    draw = random.Random(1)
    words = ["a", "b", "cc", "d", "e", "ff"]
    pairs = []
    for k in range(200):
        a = [draw.choice(words) for _ in range(draw.randint(0, 8))]
        b = [w if draw.random() < 0.7 else draw.choice([*words, "new", ""]) for w in a] + draw.choice([[], ["end"]])
        pairs.append((k, " ".join(a), " ".join(x for x in b if x)))
    want = Counter(c for _, a, b in pairs if a != b for c in plain_changes(a, b))
    frame = spark.createDataFrame([*pairs, (900, None, None), (901, None, "x"), (902, "", "")], "id long, x string, y string").withColumn("n", F.lit(1))
    got = {(r.old, r.new): r.n for r in census.aligned_changes(frame, "x", "y").collect()}
    assert got == want
    assert census.changes_of("One two. Three four.", "One 2. Three and four.") == [{"old": "two.", "new": "2."}]


def test_rule_classes(spark):
    lexicon = postedit.lexicon(spark.createDataFrame([("gold", "طلا", 0.9, True), ("x", f"بیت{ZWNJ}کوین", 0.9, False)], "en string, fa string, confidence double, entity boolean"))
    rows = [("12", "۱۲", "digits"), ("(12)", "(۱۲)", "digits"), ("كي", "کی", "letters"), ("Gold", "طلا", "entity"), ("Gold's", "طلا", "entity"), ("(gold)", "(طلا)", "entity"), ("می رود", f"می{ZWNJ}رود", "verb_joiner"), ("کتاب ها.", f"کتاب{ZWNJ}ها.", "plural_joiner"), ("بلند تر", f"بلند{ZWNJ}تر", "comparative_joiner"), ("بی کار", f"بی{ZWNJ}کار", "joiner"), ("ي 1", f"ی{ZWNJ}۱", "combined"), ("بیتکویین", f"بیت{ZWNJ}کوین", "spelling"), ("one", "two", "other")]
    frame = spark.createDataFrame([(a, b, 1) for a, b, _ in rows], "old string, new string, n long")
    assert {(r.old, r.new): r.rule for r in census.rule_classes(frame, lexicon).collect()} == {(a, b): c for a, b, c in rows}


def test_aligned_census_query(spark, data):
    rows = audits.aligned_census(spark, data).collect()
    assert rows and {"entity", "other"} & {r.rule for r in rows} and all(r.n > 0 for r in rows)


# ---- strata


def test_claims_are_disjoint(spark):
    frame = spark.createDataFrame([(k, k % 3, None if k % 5 == 0 else k % 2) for k in range(60)] + [(None, 1, 1), (1, 1, 1)], "key long, x long, y long")
    rows = studio.claim_strata(frame, "key", [("a", F.col("x") == 0, 8), ("b", F.col("y") == 1, 100), ("c", F.lit(True), 5)]).collect()
    by = {s: {r.key for r in rows if r.stratum == s} for s in "abc"}
    assert len(by["a"]) == 8 and len(by["c"]) == 5 and not (by["a"] & by["b"] or by["b"] & by["c"])
    assert by["b"] == {k for k in range(60) if k % 5 and k % 2} - by["a"] and len(rows) == sum(map(len, by.values()))


# ---- dense vectors


@pytest.mark.parametrize("block", [3, 2048])
def test_neighbours(spark, block):
    draw = np.random.default_rng(3)
    v = draw.normal(size=(120, 8))
    v[7] = v[9] = v[11] = v[0]
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(200, None), (201, [0.0] * 8), (202, [1.0])]
    frame = spark.createDataFrame([*rows, (None, [1.0] * 8)], "id long, e array<double>").withColumn("key", F.lit(1)).repartition(3)
    got = {}
    for r in dense.neighbours(frame, frame.where("id % 10 = 0 and id < 120"), "id", "e", 4, block).collect():
        got.setdefault(r["query"], []).append((r["rank"], r.neighbour))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    cosine = np.round(u @ u.T, 9)
    assert len(got) == 12
    for q, found in got.items():
        order = sorted((-cosine[q, k], k) for k in range(120) if k != q)[:4]
        assert [n for _, n in sorted(found)] == [k for _, k in order]
    assert dense.neighbours(frame, frame.where("false"), "id", "e").count() == 0


# ---- the stored index


def test_batches_equal_one_rebuild(spark, tmp_path):
    draw = random.Random(5)
    rows = [(draw.choice("abcdefg") * draw.randint(1, 2), draw.randint(0, 30), float(draw.randint(1, 3)), 0) for _ in range(400)]
    rows = [(t, k, w, 1000 + k) for t, k, w, _ in rows]
    frame = spark.createDataFrame([*rows, (None, 1, 1.0, 1)], "term string, key long, w double, ts long")
    one, two = index.TermIndex(spark, str(tmp_path / "one"), 4, 12), index.TermIndex(spark, str(tmp_path / "two"), 4, 12)
    assert one.read().count() == 0
    one.merge(frame)
    for part in range(4):
        two.merge(frame.where(F.pmod("key", F.lit(4)) == part))
    two.merge(frame.where("false"))
    as_set = lambda x: {(r.term, r.key, r.w, r.ts) for r in x.read().collect()}
    want = {}
    for t, k, w, ts in rows:
        want[t, k] = (max(w, want.get((t, k), (0, 0))[0]), ts)
    by_term = {}
    for (t, k), (w, ts) in want.items():
        by_term.setdefault(t, []).append((-ts, k, w))
    plain = {(t, k, w, -ts) for t, found in by_term.items() for ts, k, w in sorted(found)[:12]}
    assert as_set(one) == as_set(two) == plain
    assert {r.term: r.df for r in one.read().select("term", "df").distinct().collect()} == {t: len(v) for t, v in by_term.items()}
    two.prune(frame.select("key", "ts").distinct(), now=1030 + 21 * 86400 - 5 * 86400, days=21, most_documents=7)
    assert {r.key for r in two.read().collect()} <= set(range(24, 31))


# ---- sources


def plain_cycle(rows):
    failures, until = {}, {}
    for r in sorted(rows, key=lambda r: r.ts):
        s = r.source
        if until.get(s, 0) > r.ts:
            yield s, r.ts, "circuit_open", "", None, failures[s], until[s]
            continue
        e = (r.error or "").lower()
        if r.error is not None:
            why = next((n for n, p in (("ssl_error", "ssl|cert"), ("timeout", "timeout|timed out"), ("dns_or_network", "connection|resolve"), ("redirect_loop", "too many redirects")) if re.search(p, e)), "exception")
        else:
            why = {200: None, 401: "auth_required", 403: "bot_blocked", 404: "not_found", 429: "rate_limited", 503: "server_error", 500: "server_error"}.get(r.http, "http_error") or (None if r.entries else "empty_feed")
        if why is None:
            failures[s] = until[s] = 0
            yield s, r.ts, None, "", None, 0, 0
            continue
        steps = []
        if r.http in (415, 429, 503) or why == "rate_limited":
            steps += ["backoff-3s", "feedfetcher", "telegrambot"]
        if r.http in (401, 403, 418) or why in ("bot_blocked", "auth_required"):
            steps += ["feedreader", "inoreader"]
        if why == "ssl_error":
            steps += ["ssl-lenient"]
        if why in ("not_found", "empty_feed", "bot_blocked", "auth_required") or why == "http_error" and r.http in (401, 403, 415, 418):
            steps += ["gn-mirror"]
        steps += ["googlebot-UA"]
        tried, won = [], None
        for x in steps:
            tried.append(x)
            if x in (r.works or []):
                won = x
                break
        failures.setdefault(s, 0)
        until.setdefault(s, 0)
        if not won:
            failures[s] += 1
            if failures[s] >= 4:
                until[s] = r.ts + min(6 * 3600, 900 * 2 ** (failures[s] - 4))
        yield s, r.ts, why, ",".join(tried), won, failures[s], until[s]


def test_source_ladder(spark, data):
    want = sorted(plain_cycle(audits.source_log(spark, data).collect()), key=str)
    got = sorted(map(tuple, audits.source_ladder(spark, data).collect()), key=str)
    assert got == want and {"circuit_open", "ssl_error", "empty_feed"} <= {r[2] for r in got} and any(r[4] for r in got)
    empty = spark.createDataFrame([], "source string, ts long, http int, error string, entries int, works array<string>")
    assert fetching.cycles(empty).count() == 0
