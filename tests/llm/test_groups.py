"""MinHash groups, components, archives and the pipeline against plain versions."""

import hashlib
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from marketloom.llm import graph, minhash, warc

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(t, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(rows, width, num, den):
    sets = [(i, shingles(t, width)) for i, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[root(x)] = root(y)
    best = {}
    for x, (i, s) in enumerate(sets):
        if i is not None:
            best[root(x)] = min(best.get(root(x), i), i)
    return [(i, len(s), best.get(root(x)) if s else i) for x, (i, s) in enumerate(sets)]


def near_copies(seed=5, groups=6, copies=30):
    """Groups of copies with few to many edits, so that similarities lie on both sides of the threshold."""
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.choice([8, 40, 120]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 12))):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10_000)}"
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("width,num", [(3, 85), (5, 80)])
def test_minhash(spark, docs, width, num):
    rows = near_copies() + [(1000 + i, r.text) if r.doc_id is not None else (None, r.text) for i, r in enumerate(docs.select("doc_id", "text").collect())]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("x"))
    got = minhash.link(frame, minhash.Rule(width=width, num=num)).collect()
    want = brute(rows, width, num, 100)
    order = lambda r: (r[0] is None, r[0] or 0)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=order) == sorted(want, key=order)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)


def test_empty_and_keep_one(spark, docs, empty):
    assert minhash.link(empty).count() == 0
    left = minhash.keep_one(docs)
    ids = sorted(r.doc_id for r in left.collect() if r.doc_id is not None)
    assert left.columns == docs.columns and 1 in ids and 2 not in ids and ids.count(8) == 1
    assert left.where("doc_id is null").count() == 1


def test_components(spark):
    rng = random.Random(2)
    edges = [(f"n{i}", f"n{i + 1}") for i in range(60)] + [(f"m{rng.randrange(30)}", "hub") for _ in range(40)] + [("a", "a"), ("b", None), ("p", "q"), ("q", "p")]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert len({got[f"n{i}"] for i in range(61)}) == 1
    assert len({got[n] for n in got if n[0] == "m"} | {got["hub"]}) == 1
    assert got["p"] == got["q"] and len(set(got.values())) == 3 and "a" not in got
    assert graph.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_warc(spark):
    big = "x" * 1200
    rows = [(1, "http://a/ä b", big), (2, "http://b", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", "é" * 700), (8, "u", big), (8, "u", big), (None, "u", big), (9, "u", "long" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    stored = warc.write(pages, archive_bytes=500)
    got = warc.read(stored, chunk=100).collect()
    assert len(got) == len(rows) and stored.count() > 1 and all(r.verified for r in got)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    for page, _, html in rows:
        data = (html or "").encode()
        for r in by[page]:
            assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
            assert r.record_type == "response" or r.payload is None
    assert {(p, r.record_type, r.refers_to) for p, rs in by.items() for r in rs} == {(1, "revisit", 8), (2, "revisit", 8), (None, "revisit", 8), *[(p, "response", None) for p in (3, 4, 5, 6, 7, 8, 9)]}
    assert warc.read(warc.write(pages.where("false"))).count() == 0


def test_broken_archives():
    good = warc.member(warc.record(1, "u", b"payload", warc._sha1(b"payload"), None))
    assert next(iter(warc.read_records([good[:10], good[10:]])))["payload"] == b"payload"
    forged = warc.member(warc.record(1, "u", b"payload", warc._sha1(b"other"), None))
    assert not next(iter(warc.read_records([forged])))["verified"]
    with pytest.raises(ValueError):
        list(warc.read_records([good[:-12]]))
    cut = warc.record(1, "u", b"payload", warc._sha1(b"payload"), None).replace(b"Content-Length: 7\r\n\r\npayload", b"Content-Length: 7\r\n\r\npay")
    with pytest.raises(ValueError):
        list(warc.read_records([warc.member(cut)]))


def test_pipeline(spark, data):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(p.STAGES):
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        docs = p.materialise(stage(spark, docs, data), f"test{k}")
        rows = docs.collect()
        ids = [r.doc_id for r in rows]
        assert len(set(ids)) == len(ids) and set(ids) <= set(before) and rows, name
        if k < 4:
            assert docs.columns == columns
        if name == "MinHash near-dedup":
            want = {c for _, _, c in brute(sorted(before.items()), 5, 80, 100)}
            assert set(ids) == want
        if name == "line dedup":
            assert all(set((r.text or "").split("\n")) <= set((before[r.doc_id] or "").split("\n")) for r in rows)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
    assert p.STAGES[0][1](spark, spark.read.parquet(f"{data}/documents.parquet").where("false"), data).count() == 0
