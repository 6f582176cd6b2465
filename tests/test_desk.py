"""The news desk on small frames, and the library without its corpus operators."""

import os
import shutil
import subprocess
import sys

from pyspark.sql import functions as F

from marketloom.functions import scoring, text
from marketloom.operators import correlation, desk, feed, ranking, search, timeseries
from tests.conftest import ROOT


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_relevance(spark):
    gate = lambda t, s="": one(spark, t, lambda c: scoring.relevant(c, F.lit(s)))
    assert gate("S. Korea captures gold in women's sabre") is False
    assert gate("Top stocks to buy today as bitcoin climbs") is False
    assert gate("Gold price target $4,000 says bank") is True
    assert gate("Company announces quarterly earnings", "the fed may cut") is False
    assert gate("A new day at work", "the fomc decided") is True
    assert gate("A new day at work", "x" * 400 + " fomc") is False
    assert gate(None) is False


def test_custom_assets(spark):
    assert scoring.asset_pattern("LINK", "chainlink - link,  chain  link") == r"\b(?:chainlink|link|chain\s+link)\b"
    assert scoring.asset_pattern("A.B") == r"\b(?:A\.B)\b"
    assert one(spark, "Chain   Link moves", lambda c: scoring.assets(c, {"LINK": scoring.asset_pattern("LINK", "chain link")})) == ["LINK"]


def test_persian_sentiment(spark):
    rise = one(spark, "رشد و افزایش قیمت", lambda c: scoring.sentiment(c, F.lit("")))
    assert rise["label"] == "positive" and one(spark, "سقوط بازار", lambda c: scoring.sentiment(c, F.lit("")))["label"] == "negative"
    assert one(spark, "ریزش‌های بازار".replace("‌", ""), lambda c: c.rlike(scoring.word_pattern("ریزش"))) is True
    assert one(spark, "fedora", lambda c: c.rlike(scoring.word_pattern("fed"))) is False


def test_first_wins(spark):
    import random

    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", "c", "d", None, "e", "f"]), rng.choice(["p", "q", None, "r", "s", "t"])) for i in range(60)]
    got = {r.id for r in feed.first_wins(spark.createDataFrame(rows, "id long, t string, l string"), [F.col("t"), F.col("l")], [F.col("id")], "id").collect()}
    seen_t, seen_l, want = set(), set(), set()
    for i, t, link in rows:
        if (t is None or t not in seen_t) and (link is None or link not in seen_l):
            want.add(i)
            seen_t.add(t)
            seen_l.add(link)
    assert got == want
    empty = spark.createDataFrame([], "id long, t string")
    assert feed.first_wins(empty, [F.col("t")], [F.col("id")], "id").count() == 0


def test_greedy_dedup_leaves_no_tables(spark):
    items = spark.createDataFrame([(i,) for i in range(1, 7)], "id long")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 6)], "a long, b long")
    assert sorted(r.id for r in feed.greedy_dedup(pairs, items, "id").collect()) == [1, 3, 5]


def test_late_ticks(spark):
    """A checkpoint takes the first tick after its horizon, whatever the delay."""
    ticks = spark.sql("SELECT 'a' AS symbol, timestamp '2024-01-01 00:00:00' AS ts, 1.0D AS price, 1L AS tick UNION ALL SELECT 'a', timestamp '2024-02-20 05:00:00', 3.0D, 2L")
    got = correlation.checkpoints(ticks.where("tick = 1").select(F.col("tick").alias("id"), "symbol", "ts"), ticks).collect()
    assert sorted((r.h, r.price_after) for r in got) == [(1, 3.0), (4, 3.0), (24, 3.0)]


def test_crossover(spark):
    rows = [("up", i, 0.1 * i) for i in range(12)] + [("flat", i, 0.5) for i in range(12)] + [("few", i, 1.0) for i in range(9)]
    got = {r.symbol: r for r in timeseries.crossover(spark.createDataFrame(rows, "symbol string, cycle int, score double")).collect()}
    assert got["up"].prediction == "bullish" and got["up"].momentum == 1.0 and got["up"].confidence == 1.0
    assert got["flat"].prediction == "neutral" and got["flat"].confidence == 1.0
    assert got["few"].prediction == "neutral" and got["few"].confidence == 0.0 and got["few"].fast is None


def test_rsi_series_of_flat_closes(spark):
    flat, mixed = [1.0] * 20, [1.0, 2.0, 1.5] * 7
    d = spark.createDataFrame([(flat,), (mixed,)], "c array<double>").select(timeseries.rsi(F.col("c")).alias("last"), timeseries.rsi_series(F.col("c")).alias("all"), timeseries.ema_aligned(F.col("c"), 5).alias("e"), "c").collect()
    assert d[0].last == 50.0 and set(d[0].all) == {100.0}
    assert abs(d[1].last - d[1].all[-1]) < 1e-9 and len(d[1].all) == len(mixed) - 14
    assert len(d[1].e) == len(mixed) and d[1].e[:4] == [None] * 4 and d[1].e[4] == sum(mixed[:5]) / 5


def test_upper_medians(spark):
    rows = [("a", float(v)) for v in (1, 2, 3, 4)] + [("b", 7.0)] * 3 + [("c", float(v)) for v in (9, 1, 5)]
    got = {r.k: r.m for r in ranking.upper_medians(spark.createDataFrame(rows, "k string, v double"), "k", "v", "m", cells=2).collect()}
    assert got == {"a": 3.0, "b": 7.0, "c": 5.0}


def test_search_expansions(spark):
    rows = [(f"term{i:02d}", d, 1.0) for i in range(20) for d in range(i + 1)] + [("term", 3, 1.0)]
    post = spark.createDataFrame(rows, "term string, doc long, w double")
    got = search.expansions(post, ["term"]).collect()
    assert len(got) == 8 and "term" in {r.term for r in got} and min(r.df for r in got if r.term != "term") == 14
    assert search.search(post, "doc", 20, ["term", "nothing"]).where("matched = 1").count() > 3


def test_text_helpers(spark):
    assert one(spark, '["btc", " Eth "]', text.string_or_array) == ["BTC", "ETH"] and one(spark, None, text.string_or_array) == []
    assert one(spark, "https://x.example/news/bitcoin-rally-continues-today", lambda c: text.url_matches(c, F.lit("Bitcoin rally continues"))) is True
    assert one(spark, "https://x.example/sport/final", lambda c: text.url_matches(c, F.lit("Bitcoin rally continues"))) is False
    assert one(spark, "# Head\n- [Prices of gold](http://a.b) rose for the third day in a row, and traders cheered them\n12 34 56 78 90 12 34 56 78 90 12 34 56 78 90 12 34 56 78 90", text.prose_lines) == ["Prices of gold rose for the third day in a row, and traders cheered them"]
    assert one(spark, "آب‌ها", text.family_key) == one(spark, "اب ها", text.family_key)
    assert one(spark, "برای اطلاعات بیشتر کلیک کنید", text.boilerplate) is True
    assert one(spark, "see www.x.example", text.boilerplate) is True
    assert one(spark, "Read more here", text.boilerplate) is False


def test_expiry_and_desks(spark):
    at = F.lit("2024-01-02").cast("timestamp")
    assert one(spark, "2024-01-01T00:00:00", lambda c: desk.expired(c, at)) is True
    assert one(spark, "never", lambda c: desk.expired(c, at)) is False and one(spark, None, lambda c: desk.expired(c, at)) is False
    spec = {"gold": {"words": ["gold"], "ambiguous": ["bar"]}, "oil": {"words": ["crude"], "ambiguous": ["bar", "well"]}}
    assert one(spark, "a gold bar", lambda c: desk.buckets(c, spec)) == {"gold": ["gold"]}
    assert one(spark, "a bar by the well", lambda c: desk.buckets(c, spec)) == {"gold": ["bar"]}
    assert one(spark, "barrels", lambda c: desk.buckets(c, spec)) == {}


def test_without_corpus_operators(tmp_path):
    """The library imports and lists its queries when the corpus operators and their pipeline are gone."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(s) <= set(q) and not any(n.startswith('op') and n[2].isdigit() for n in q); print(len(q))"
    env = {**os.environ, "PYTHONPATH": str(copy)}
    assert int(subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, check=True).stdout) > 100
