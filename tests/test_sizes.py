"""Results at the edges that only larger tables reach, and steps that must stay bounded."""

import random

import duckdb
import pandas as pd
from pyspark.sql import functions as F

import __spark_entry__ as entry
from marketloom.operators import census, postedit, quality, signals, similarity
from marketloom.streaming import similar, states


def test_horizon_rounds_seconds_as_its_sql(spark, tmp_path):
    begin, week = 1_700_000_000_400_000, 7 * 86_400_000_000
    at = [begin, begin + week - 100_000, begin + week + 50_000, begin + week + 150_000, begin + week + 700_000, begin + week + 1_200_000]
    frame = pd.DataFrame({"event_id": range(len(at)), "ts": pd.to_datetime(at, unit="us").astype("datetime64[us]"), "user_id": 1, "event_type": "view", "value": 1.0, "props": "{}"})
    path = f"{tmp_path}/events.parquet"
    frame.to_parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{path}')")
    want = sorted(r[0] for r in con.execute(entry.oracle_sql()["calendar_horizon"]).fetchall())
    got = sorted(r.id for r in entry.queries()["calendar_horizon"](spark, str(tmp_path)).collect())
    assert got == want == [0, 1, 2]


def test_cosines_divide_whole_sums_once(spark):
    texts = ["g g g e e e a c", "e c b d a"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert similarity.cosine_pairs(frame, "id", "text", 0.0).first().cosine == 5 / (20**0.5 * 5**0.5)
    assert similarity.cosine_pairs(frame, "id", "text", 0.5).count() == 0


def test_coverage_drops_pairs_by_signature_and_loses_no_link(spark):
    draw = random.Random(4)
    words = [f"word{i}" for i in range(60)]
    texts = [" ".join(draw.choice(words[: draw.choice([8, 30, 60])]) for _ in range(draw.choice([1, 3, 4, 8, 30]))) for _ in range(150)]
    rows = [(i, t, f"s{i % 7}") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "id long, text string, source string")
    got = {r.id: r.sources for r in similarity.coverage(frame, "id", "text", "source").collect()}
    sets = {i: set(t.split()) for i, t, _ in rows}
    linked = lambda a, b: len(sets[a] & sets[b]) >= 3 and len(sets[a] & sets[b]) / min(len(sets[a]), len(sets[b])) >= 0.34
    assert got == {i: len({s for j, _, s in rows if j != i and linked(i, j)}) for i, _, _ in rows}
    one, two = (spark.createDataFrame([(w,)], "w array<string>").select(*similarity.signature(F.col("w"))).first() for w in (words[:20], words[10:60]))
    lacking = sum(bin(a & ~b & (2**64 - 1)).count("1") for a, b in zip(one, two, strict=True))
    assert 5 <= lacking <= 10


def test_owners_are_the_claims_of_all_matches(spark):
    draw = random.Random(9)
    words = [f"w{i}" for i in range(14)] + ["gold", "moves"]
    pick = lambda n: draw.sample(words, n)
    stories = spark.createDataFrame([(i, pick(draw.randint(0, 5)), draw.choice([None, 0.2, 0.9])) for i in range(80)], "id long, words array<string>, cred double")
    posts = [("post", i, pick(draw.randint(0, 4)), []) for i in range(30)]
    videos = [("video", i, ["gold", "moves", f"only{i}", *pick(draw.randint(0, 1))], draw.choice([["gold", "w1"], ["nothing"], None])) for i in range(60)]
    given = spark.createDataFrame(posts + videos, "kind string, key long, words array<string>, query array<string>")
    given = given.withColumn("words", F.array_distinct("words"))
    want = signals.claim(signals.match(stories, given), stories).collect()
    got = signals.owners(stories, given).collect()
    assert sorted(map(tuple, got)) == sorted((r.kind, r.key, r.id, r.hits) for r in want) and len(got) > 40


def test_top_runs_count_frequent_words_only(spark):
    draw = random.Random(3)
    texts = [" ".join(draw.choice("aaabbbccdefghij") for _ in range(draw.randint(0, 12))) for _ in range(60)] + [None, ""]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    every = quality.ngram_counts(frame, "text")
    for most in (3, 7, 5000):
        want = every.orderBy(F.desc("n"), "gram", "size").limit(most).collect()
        assert sorted(map(tuple, quality.ngram_top(frame, "text", most).collect())) == sorted(map(tuple, want))


class _State:
    def __init__(self):
        self.rows, self.timers = [], []

    def getListState(self, *_):
        return self

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(self.rows)

    def appendList(self, rows):
        self.rows += rows

    def clear(self):
        self.rows = []

    def registerTimer(self, at):
        self.timers.append(at)


def test_a_span_of_stories_is_one_list_with_one_timer():
    state, flow = _State(), similar._Pairs(0.65, 100)
    flow.init(state)
    story = lambda name, sec, own: (name, sec, own, ["gold", "rises"], [1, 1], ["gold"])
    give = lambda *rows: [tuple(r) for f in flow.handleInputRows((3, 0), iter([pd.DataFrame(rows, columns=["id", "sec", "own", "tokens", "tf", "meet"])]), None) for r in f.itertuples(index=False)]
    assert give(story("a", 250, False), story("b", 260, False)) == []
    assert give(story("c", 355, True), story("d", 399, True)) == [("b", "c"), ("c", "d")]
    assert state.timers == [400_000] and len(state.rows) == 4
    list(flow.handleExpiredTimer((3, 0), None, None))
    assert state.rows == []


def test_rows_of_a_key_come_in_steps():
    n = 2 * states.STEP + 5
    frames = [pd.DataFrame({"ts": range(n - 1, -1, -1), "value": 1.0}).iloc[k::2] for k in range(2)]
    rows = states._ordered(iter(frames), "ts", "value")
    assert not isinstance(rows, list) and [len(f) for f in states._given(rows, ["ts", "value"])] == [states.STEP, states.STEP, 5]
    assert [len(f) for f in states._given(iter([]), ["ts"])] == [0]


def test_no_window_of_a_joined_lexicon_is_broadcast(spark):
    terms = spark.createDataFrame([("latin", w, "واژه", False) for w in ("gold", "silver")], "kind string, key string, value string, entity boolean")
    rows = spark.createDataFrame([(0, "a gold here"), (1, None)], "id long, text string")
    out = postedit.edit(rows, terms, most=1)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.edited for r in out.collect()} == {0: "a واژه here", 1: None}


def test_word_searches_find_what_their_patterns_find_one_by_one(spark):
    """Grouped patterns, listed words and assets against every pattern on its own; a text without any topic is passed over once."""
    from marketloom.functions import scoring, values
    from marketloom.operators import office

    words = [*values.IMPACT, *(w for ws in office.OFF_PROFILE.values() for w in ws)]
    patterns = [*values.TOPICS.values(), *values.ASSETS.values(), values.SPONSORED, values.SPAM, values.SEO, values.CLICKBAIT, values.RISKY, values.NOISE]
    draw = random.Random(6)
    bits = [*words, "hacked", "SEC", "eip-12", "S&P 500", "us dollar index", "ounce of gold", "Spot XRP etf", "price forecast 2030", "10 best coins to buy", "xfed", "fedx", "crypto", "PRICE now", "100x", "bankers", "\u0637\u0644\u0627\u0647\u0627", "\u212a"]
    texts = [draw.choice((" ", "-", "\n", "")).join(draw.choice(bits) for _ in range(draw.choice([1, 2, 5, 9]))) for _ in range(250)] + ["", None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, x string").repartition(2)
    x, low = F.col("x"), F.lower(F.coalesce("x", F.lit("")))
    one = lambda t, p: F.coalesce(t.rlike(f"(?i){p}"), F.lit(False))
    first = F.lit("general")
    for name, p in reversed(values.TOPICS.items()):
        first = F.when(one(x, p), name).otherwise(first)
    named = F.array_compact(F.array(*[F.when(one(x, p), F.lit(s)) for s, p in values.ASSETS.items()]))
    rows = frame.select(
        F.array(*[one(x, p) for p in patterns]).alias("a"), F.array(*[scoring.matches(x, p) for p in patterns]).alias("b"), first.alias("t"), scoring.topic(x).alias("u"),
        F.when((F.size(named) == 0) & one(x, r"\bcrypto\b|\bbitcoin\b"), F.array(F.lit("BTC"))).otherwise(named).alias("n"), scoring.assets(x).alias("m"),
        F.array_distinct(F.array_compact(F.array(*[F.when(low.rlike(scoring.word_pattern(w)), F.lit(w)) for w in words]))).alias("v"), scoring.listed_words(low, words).alias("w"),
    ).collect()
    assert all(r.a == r.b and r.t == r.u and r.n == r.m and r.v == r.w for r in rows)
    assert len({r.t for r in rows}) > 5 and sum(len(r.v) for r in rows) > 250 and len({s for r in rows for s in r.n}) > 4
    assert len(scoring.alternatives(values.TOPICS["etf"])) == 9 and scoring.by_words(values.TOPICS["etf"]).count(r"\b(?=[") == 1


def test_neighbours_hold_few_cosines_at_once():
    """A block of queries against many rows: memory follows a slice of the rows; odd vectors are zero."""
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    from marketloom.operators import dense

    odd = pa.array([[3.0, 4.0], None, [1.0], [None, 2.0], [0.0, 0.0]], pa.list_(pa.float64()))
    assert dense._matrix(odd, 2).tolist() == [[0.6, 0.8], [0, 0], [0, 0], [0, 0], [0, 0]]
    draw = np.random.default_rng(2)
    vectors = draw.normal(size=(8192, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(range(8192)), pa.array(vectors.tolist())], ["key", "vector"])
    block = SimpleNamespace(value=(list(range(2048)), vectors[:2048].tolist()))
    tracemalloc.start()
    out = next(dense._against(block, 5, 8)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == 2048 * 5 and peak < 60e6


def test_feeds_land_in_few_files(spark, data):
    """a file for every two hundred orders made as many files as feeds (8 over sf0.001 before)."""
    from __spark_entry__ import queries

    files = queries()["landed_feed"](spark, data).inputFiles()
    assert len(files) <= 4  # no more than the shuffle has partitions


def test_lines_of_feeds_are_read_like_files(spark, tmp_path):
    from marketloom.sources import readers

    item = "<item><title>{0} &amp; b</title><link>l</link><pubDate>{1}</pubDate><guid>{0}</guid></item>"
    days = ("Mon, 1 Jan 2024 00:00:00 +0000", "soon", "Tue, 2 Jan 2024 01:00:00 +0100")
    docs = ["<rss><channel>" + "".join(item.format(10 * k + i, x) for i, x in enumerate(days[: k % 4])) + "</channel></rss>" for k in range(9)]
    (tmp_path / "lines").write_text("\n".join(docs))
    for k, one in enumerate(docs):
        (tmp_path / f"one{k}.xml").write_text(one)
    whole = sorted(map(str, readers.feed(spark, str(tmp_path / "one*.xml")).collect()))
    assert len(whole) == 12 and whole == sorted(map(str, readers.feed_lines(spark, str(tmp_path / "lines")).collect()))


def test_rare_grams_meet_no_frequent_term(spark, monkeypatch):
    """every gram of an output met every term of its source; ids may repeat or be missing, terms may be rare."""
    draw = random.Random(8)
    rows = [(draw.choice([i, i // 2, None]) if i % 9 == 0 else i, " ".join(draw.choice(["gold", "rises", "fed", "7"]) for _ in range(draw.randint(0, 4))) + (" seldom" if i % 40 == 0 else ""), " ".join([draw.choice(["one thing", "other", "third thing there"]), f"only{i}", *[f"x{i}y{k}" for k in range(20)]]) if i % 11 else None) for i in range(400)]
    sets, counts, grams, bg = {}, {}, [], {}
    for i, source, out in rows:
        for w in source.split():
            counts[w] = counts.get(w, 0) + 1
            sets.setdefault(w, set()).add(i)
        w = (out or "").split()
        two = {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}
        grams += [(i, 1, g) for g in two]
        for g in [*w, *two]:
            bg[g] = bg.get(g, 0) + 1
    grams += sorted({(i, 0, w) for i, _, out in rows for w in (out or "").split()}, key=str)
    want = {}
    for term in (w for w in counts if len(w) >= 3 and counts[w] >= 5 and len(sets[w]) >= 5):
        for i, kind, g in grams:
            if i is not None and i in sets[term]:
                want[term, kind, g] = want.get((term, kind, g), 0) + 1
    want = {k: n for k, n in want.items() if n >= max(2.0, 0.12 * len(sets[k[0]]))}
    seen, met = {}, census._met

    def spy(texts, sizes, background, least):
        out = met(texts, sizes, background, least)
        seen["met"] = out.count()
        assert {r.term: r.matched for r in sizes.collect()} == {w: len(s) for w, s in sets.items() if len(w) >= 3 and counts[w] >= 5 and len(s) >= 5}
        assert {r.gram: r.bg for r in background.collect()} == bg
        n = out.select(F.explode("terms").alias("term"), "kind", "gram").groupBy("term", "kind", "gram").count().join(sizes, "term").where(F.col("count") >= least)
        assert {(r.term, r.kind, r.gram): r["count"] for r in n.collect()} == want
        return out

    monkeypatch.setattr(census, "_met", spy)
    frame = spark.createDataFrame(rows, "id long, source string, output string").repartition(3)
    census.alternates(frame, 5, 5, 2).collect()
    assert len(want) > 12 and seen["met"] < 2_500 < len(grams) / 4
