"""Page readers on small pages, and stateful flows against plain loops."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from marketloom.sources import feeds, html
from marketloom.streaming import states


def as_of():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")

PARA = "This is a paragraph of the article that is long enough to be kept, number {}, and it says something."


def test_linked_data_before_paragraphs():
    text = "\n".join(PARA.format(i) for i in range(5))
    page = f'<html><head><title>T</title><meta property="og:title" content="OG"><meta property="og:site_name" content="Site"><script type="application/ld+json">{json.dumps({"@graph": [{"articleBody": text}]})}</script></head><body><p>{PARA.format("side")}</p></body></html>'
    got = html.body(page)
    assert got["title"] == "OG" and got["site"] == "Site" and got["paragraphs"] == text.split("\n")


def test_payload_of_an_app():
    prose = " ".join(PARA.format(i) for i in range(6))
    page = f'<script id="__NEXT_DATA__" type="application/json">{json.dumps({"props": {"articleBody": prose, "x": ["short"]}})}</script><p>{PARA.format(1)}</p>'
    assert html.body(page)["paragraphs"] == [prose]
    state = f'<script>window.__NUXT__={{a:{json.dumps(prose)}}}</script>'
    assert html.body(state)["paragraphs"] == [prose]


def test_containers_parents_and_meta():
    side = "".join(f"<p>{PARA.format('side')}{i}</p>" for i in range(2))
    main = "".join(f"<p>{PARA.format(i)}</p>" for i in range(4))
    assert len(html.body(f'<div>{side}</div><div class="x entry-content">{main}</div>')["paragraphs"]) == 4
    assert len(html.body(f"<section>{side}</section><section>{main}</section>")["paragraphs"]) == 4
    assert len(html.body(f"<aside>{main}</aside><section>{side}</section>")["paragraphs"]) == 2
    assert html.body('<meta name="description" content=" only this ">')["paragraphs"] == ["only this"]
    assert html.body(None)["paragraphs"] == [] and html.body("<p><p></b></div>")["partial"] is True
    same = "".join(f"<p>{'same start ' * 12}{i}</p>" for i in range(200))
    assert len(html.body(same)["paragraphs"]) == 1 and len(html.body(same, html.Rule(most=None, same=None))["paragraphs"]) == 200


def test_atom_and_channel(spark):
    xml = '<feed><entry><title>A &amp; B</title><link href="https://x/1"/><updated>2023-12-31T12:00:00Z</updated></entry><entry><title>no link</title></entry></feed>'
    rows = feeds.atom_entries(spark.createDataFrame([(1, xml), (2, None), (3, "broken <entry>")], "k int, x string"), "k", "x", as_of()).collect()
    assert [(r.title, r.link, r.age_hours) for r in rows] == [("A & B", "https://x/1", 12.0)]
    page = '<div data-post="c/1"><div class="tgme_widget_message_text">one <div>inner</div> end</div><time datetime="2023-12-31T00:00:00+00:00"></time></div><div data-post="c/2"><div class="tgme_widget_message_reply"><div class="tgme_widget_message_text">quote</div></div><div class="tgme_widget_message_text">two</div></div><div data-post="c/3"><i>pinned</i></div>'
    got = feeds.channel_posts(spark.createDataFrame([("c", page)], "k string, h string"), "k", "h", as_of()).orderBy("pos").collect()
    assert [(r.post_id, r.text, r.age_hours) for r in got] == [("c/2", "two", None), ("c/1", "one inner end", 24.0)]


def test_videos(spark):
    record = lambda i, **k: {"videoId": i, "title": {"runs": [{"text": "T"}, {"text": i}]}, "viewCountText": {"simpleText": "1,200 views"}, "publishedTimeText": {"simpleText": "2 hours ago"}, **k}
    data = {"a": [{"videoRenderer": record("x")}, {"deep": {"reelItemRenderer": {"videoId": "s"}}}, {"videoRenderer": record("x")}]}
    rows = feeds.videos(spark.createDataFrame([(1, f"var ytInitialData = {json.dumps(data)};</script>"), (2, "var ytInitialData = {bad};"), (3, None)], "k int, h string"), "k", "h").orderBy("pos").collect()
    assert [(r.id, r.kind, r.title, r.views, r.age_hours, r.views_per_hour) for r in rows] == [("x", "video", "Tx", 1200.0, 2.0, 600.0), ("s", "short", "", None, None, None)]


def test_fear_greed(spark):
    raw = json.dumps({"data": [{"value": str(50 + i), "value_classification": "x", "timestamp": str(1000 - i)} for i in range(10)]})
    got = feeds.fear_greed(spark.createDataFrame([(raw,)], "x string"), "x").collect()
    assert [r.value for r in got] == [57, 56, 55, 54, 53, 52, 51, 50]


@pytest.fixture(scope="module")
def calls():
    import random

    rng = random.Random(6)
    at, rows = 0, []
    for i in range(120):
        at += rng.randrange(1, 900)
        rows.append((rng.choice("ab"), at, rng.random() < 0.4, float(i)))
    return rows


def run(spark, tmp_path, rows, schema, flow):
    """Two files, so that state is carried from one batch to the next."""
    half = len(rows) // 2
    for n, part in enumerate((rows[:half], rows[half:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        del n
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    from marketloom.streaming.flows import drain

    return drain(flow(stream), str(tmp_path / "out"), str(tmp_path / "cp")).collect()


def test_breaker_and_quota(spark, tmp_path, calls):
    got = run(spark, tmp_path / "b", calls, "k string, ts bigint, ok boolean, v double", lambda x: states.breaker(x, "k"))
    want, state = set(), {}
    for k, ts, ok, _ in calls:
        failures, until = state.get(k, (0, 0))
        allowed = ts >= until
        if allowed:
            failures = 0 if ok else failures + 1
            if failures >= 2:
                failures, until = 0, ts + 600
        state[k] = failures, until
        want.add((k, ts, ok, allowed))
    assert {(r.k, r.ts, r.ok, r.allowed) for r in got} == want and any(not w[3] for w in want)
    got = run(spark, tmp_path / "q", calls, "k string, ts bigint, ok boolean, v double", lambda x: states.quota(x, "k", 3))
    want, state = set(), {}
    for k, ts, _, _ in calls:
        opened, used = state.get(k, (None, 0))
        if opened is None or ts - opened >= 3600:
            opened, used = ts, 0
        state[k] = opened, used + 1
        want.add((k, ts, used + 1, used < 3))
    assert {(r.k, r.ts, r.used, r.allowed) for r in got} == want


def test_sampled_points(spark, tmp_path, calls):
    got = run(spark, tmp_path, calls, "k string, ts bigint, ok boolean, value double", lambda x: states.sampled(x, "k", most=5))
    want, held = set(), {}
    for k, ts, _, v in calls:
        h = held.setdefault(k, [])
        if h and abs(h[-1] - ts) < 600:
            h[-1] = ts
        else:
            h.append(ts)
        del h[:-5]
        want.add((k, ts, v, len(h)))
    assert {(r.k, r.ts, r.value, r.points) for r in got} == want


def test_dates_of_articles(spark):
    from marketloom.operators import desk

    rows = spark.createDataFrame([("i", "t", "x" * 2000, "ftp://a", "s", 1.26, 0.5, int(datetime.datetime(2024, 3, 20, 12, tzinfo=datetime.timezone.utc).timestamp()))], "id string, title string, summary string, link string, source string, age_hours double, cred double, ts long")
    r = desk.public(rows).first()
    assert (len(r.summary), r.link, r.date_fa) == (1000, "", "1403/01/01")


def test_channel_scan_of_odd_texts_is_its_sql(spark, tmp_path):
    """rows of absent and empty titles were missing, marks inside titles were taken for markup, and pages of equal ids were one."""
    from marketloom.plans import catalog, pages
    from tests import oracle

    texts = [(1, None), (2, ""), (3, "\nsecond line"), (4, "a\x0bb"), (5, 'data-post="ch/9" here'), (6, "tgme_widget_message_photo"), (7, 'tgme_widget_message_views">9K<'), (8, "&lt;b&gt; one"), (9, "one"), (9, "two"), (9, None)]
    spark.createDataFrame(texts, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "length(text) AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    got = pages.channel_scan(spark, str(tmp_path)).toPandas()
    con = oracle.duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert oracle.rows(got) == oracle.rows(con.execute(catalog.SQL["channel_scan"]).df()) and len(got) == 22
