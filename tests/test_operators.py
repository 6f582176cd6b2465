"""Operators on inline frames, with nulls, ties and empty inputs."""

import math

import pytest
from pyspark.sql import functions as F

from marketloom.operators import alerts, feed, ranking, similarity, tables, timeseries
from marketloom.sources import html, readers


def series_of(spark, values):
    return spark.createDataFrame([(values,)], "v array<double>")


def test_indicators(spark):
    rising = series_of(spark, [float(i) for i in range(1, 40)])
    flat = series_of(spark, [5.0] * 39)
    short = series_of(spark, [1.0, 2.0])
    assert rising.select(timeseries.rsi(F.col("v"))).first()[0] == 100.0
    assert flat.select(timeseries.rsi(F.col("v"))).first()[0] == 50.0
    assert short.select(timeseries.rsi(F.col("v"))).first()[0] is None
    assert short.select(timeseries.macd(F.col("v"))).first()[0] is None
    values = [100.0 + i % 7 for i in range(120)]
    k, e = 2 / 21, sum(values[:20]) / 20
    for v in values[20:]:
        e = v * k + e * (1 - k)
    assert math.isclose(series_of(spark, values).select(timeseries.ema(F.col("v"), 20)).first()[0], e, rel_tol=1e-12)

    def chain(xs, p):
        out = [sum(xs[:p]) / p]
        for x in xs[p:]:
            out.append(x * 2 / (p + 1) + out[-1] * (1 - 2 / (p + 1)))
        return out

    line = [a - b for a, b in zip(chain(values, 12)[14:], chain(values, 26), strict=True)]
    m = series_of(spark, values).select(timeseries.macd(F.col("v")).alias("m")).first()["m"]
    assert math.isclose(m["macd"], line[-1], abs_tol=1e-9)
    assert math.isclose(m["signal"], chain(line, 9)[-1], abs_tol=1e-9)


def test_empty_ticks(spark):
    empty = spark.createDataFrame([], "symbol string, ts timestamp, price double, id long")
    bars = timeseries.candles(empty, "symbol", "ts", "price", "id")
    assert timeseries.sma(bars).count() == 0
    assert timeseries.snapshot(bars).count() == 0


def test_median_and_midrank(spark):
    assert series_of(spark, [4.0, 1.0, 3.0, 2.0]).select(ranking.upper_median(F.col("v"))).first()[0] == 3.0
    got = {r.k: r.pct for r in ranking.midrank(spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 20.0), (4, 0.0), (5, None)], "k int, v double"), "v").collect()}
    assert got == {1: pytest.approx(0.5 / 3), 2: pytest.approx(2 / 3), 3: pytest.approx(2 / 3), 4: 0.0, 5: 0.0}
    assert ranking.midrank(spark.createDataFrame([], "k int, v double"), "v").count() == 0


def test_anomaly(spark):
    counts = spark.createDataFrame([("A", i, 2) for i in range(15)] + [("A", 15, 12)], "symbol string, cycle int, n long")
    last = timeseries.volume_zscore(counts, window=10).where("cycle = 15").first()
    assert last.z == 20.0 and last.severity == "high"
    assert timeseries.volume_ratio(counts).where("cycle = 15").first().anomaly


def test_upsert(spark):
    old = spark.createDataFrame([("a", "t1", "fa", "s1"), ("b", "t2", "", "s2")], "id string, title string, title_fa string, summary string")
    new = spark.createDataFrame([("a", "T1", "", "S1"), ("c", "t3", "x", "s3")], "id string, title string, title_fa string, summary string")
    got = {r.id: tuple(r)[1:] for r in tables.upsert(old, new, "id", keep_if_empty=("title_fa",), never=("summary",)).collect()}
    assert got == {"a": ("T1", "fa", "s1"), "b": ("t2", "", "s2"), "c": ("t3", "x", "s3")}


def test_retention_and_diff(spark):
    posts = spark.createDataFrame([("h", f"p_{i}", i) for i in range(80)], "handle string, id string, t int")
    left = tables.retain(posts, "handle", [F.desc("t")], 60)
    assert {r.id for r in left.collect()} == {f"p_{i}" for i in range(20, 80)}
    a, b = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int"), spark.createDataFrame([("y", 3), ("z", 1)], "k string, v int")
    assert {(r.k, r.direction) for r in tables.snapshot_diff(a, b, "k", "v").collect()} == {("x", "removed"), ("y", "up"), ("z", "added")}


def test_alerts(spark):
    rules = spark.createDataFrame([("and", "AND", "X", "price", ">", 1.0), ("and", "AND", "?", "price", ">", 1.0), ("or", "OR", "X", "price", ">", 1.0), ("or", "OR", "?", "price", ">", 1.0), ("no", "AND", "X", "price", "<", 1.0), ("no", "AND", "?", "price", ">", 1.0)], alerts.RULES)
    snap = spark.createDataFrame([("X", 2.0, 0.1)], "symbol string, price double, change double")
    assert {r.id: r.fires for r in alerts.evaluate(rules, snap).collect()} == {"and": None, "or": True, "no": False}


def test_query_and_greedy(spark):
    q = feed.Query.parse('gold -silver src:wire asset:xau "record high"')
    assert (q.must, q.never, q.source, q.asset) == (["gold", "record high"], ["silver"], "wire", "XAU")
    items = spark.createDataFrame([(i,) for i in range(5)], "id long")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "a long, b long")
    assert sorted(r.id for r in feed.greedy_dedup(pairs, items, "id").collect()) == [0, 2, 4]


def test_overlap_and_cosine(spark):
    d = spark.createDataFrame([(1, "gold price record", "a"), (2, "record gold price today", "b"), (3, "silver", "c"), (4, None, "d")], "id long, text string, source string")
    assert {(r.left_id, r.right_id, r.hits) for r in similarity.overlap(d, "id", d, "id", "text", 3).where("left_id < right_id").collect()} == {(1, 2, 3)}
    assert {r.id: r.sources for r in similarity.coverage(d, "id", "text", "source").collect()} == {1: 1, 2: 1, 3: 0, 4: 0}
    pair = similarity.cosine_pairs(d, "id", "text", 0.8).first()
    assert (pair.a, pair.b) == (1, 2) and math.isclose(pair.cosine, 3 / math.sqrt(12))


def test_html(spark):
    page = "<html><head><title>A  title</title></head><body><nav><p>" + "menu " * 20 + "</p></nav><p>" + "word " * 20 + "</p><p>" + "word " * 20 + "</p><p>short</p></body></html>"
    got = html.body(page)
    assert got == {"title": "A title", "paragraphs": [("word " * 20).strip()], "word_count": 20, "partial": True, "site": "", "published": ""}
    assert html.body(None)["paragraphs"] == []
    assert html.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>A</title><link>http://x</link><pubDate>Mon, 1 Jan 2024 10:00:00 +0000</pubDate></item><item><title>B</title></item></channel></rss>")
    rows = {r.title: r.published for r in readers.feed(spark, str(tmp_path / "feed.xml")).collect()}
    assert rows["A"].year == 2024 and rows["B"] is None
    (tmp_path / "chart.json").write_text('{"symbol":"X","timestamp":[1,2],"open":[1,null],"high":[2,2],"low":[1,1],"close":[1.5,1],"volume":[null,3]}')
    bar = readers.chart(spark, str(tmp_path / "chart.json")).collect()
    assert len(bar) == 1 and bar[0].volume == 0.0
    lex = spark.createDataFrame([("gold", "طلا", "m", "s", 0.9)], readers.LEXICON)
    readers.write_lexicon(lex, str(tmp_path / "lex"))
    assert readers.lexicon(spark, str(tmp_path / "lex"), 0.5).first().fa == "طلا"
    arrays = readers.state_arrays(spark.createDataFrame([('["a"]',), ("bad",), (None,)], "x string"), "x")
    assert [r.x for r in arrays.collect()] == [["a"], [], []]


def test_chrf_rows(spark):
    """Counted in rows, n-grams give what a plain count gives."""
    from collections import Counter

    from marketloom.operators import studio

    pairs = [(1, "the cat sat", "the cat sits there"), (2, "abc", "abc"), (3, "", "x"), (4, None, None), (5, "aaaa aaaa", "aa"), (6, "no", "yes")]

    def plain(a, b):
        a, b = "".join((a or "").split()), "".join((b or "").split())
        p, r = [], []
        for n in range(1, 7):
            x, y = (Counter(t[i : i + n] for i in range(len(t) - n + 1)) for t in (a, b))
            common = sum((x & y).values())
            p += [common / x.total()] if x else []
            r += [common / y.total()] if y else []
        p, r = sum(p) / max(1, len(p)), sum(r) / max(1, len(r))
        return 5 * p * r / (4 * p + r) if 4 * p + r else 0.0

    got = {row["id"]: row["chrf"] for row in studio.chrf_rows(spark.createDataFrame(pairs, "id int, a string, b string"), "id", "a", "b").collect()}
    assert got.keys() == {i for i, _, _ in pairs}
    for i, a, b in pairs:
        assert abs(got[i] - plain(a, b)) < 1e-9


def test_edit_distance_of_all_pairs_that_share_a_word(spark):
    from marketloom.operators import similarity

    texts = {1: "Márkets rally todäy", 2: "markets rally today again", 13: "rally of the bonds", 25: "nothing in common", 36: None}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    df = spark.createDataFrame(list(texts.items()), "item_id long, text string")
    got = {(r.a, r.b): r.distance for r in similarity.edit_pairs(df, "item_id", "text").collect()}
    assert got == {(a, b): edits(texts[a], texts[b]) for a, b in ((1, 2), (1, 13), (2, 13))}
