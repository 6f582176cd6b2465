"""Registered queries of gates, demand, reactions and text products; they extend the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions import scoring, text
from marketloom.operators import quality, studio, timeseries
from marketloom.plans.catalog import BARS, POLARITY, TITLE, WORDS, bars, docs, query
from marketloom.sources.readers import table

BODY = "CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END"
HEAD_POLARITY = POLARITY.replace("coalesce(text, '')", TITLE)
BOTH_POLARITY = POLARITY.replace("coalesce(text, '')", f"({TITLE} || ' ' || {BODY})")


@query(f"""WITH p AS (SELECT doc_id, {BOTH_POLARITY} AS lex, {HEAD_POLARITY} AS head FROM documents),
s AS (SELECT doc_id, lex, head, (2 * lex + CASE WHEN abs(head) > 0.3 THEN 1.5 * head ELSE 0 END) / (2 + CASE WHEN abs(head) > 0.3 THEN 1.5 ELSE 0 END) AS score FROM p)
SELECT doc_id, round(score, 6) AS score, CASE WHEN score > 0.15 THEN 'positive' WHEN score < -0.15 THEN 'negative' ELSE 'neutral' END AS label,
  round(least(1.0, abs(score) * CASE WHEN abs(head) > 0.3 THEN CASE WHEN lex * head > 0 THEN 1.2 ELSE 0.8 END ELSE 0.7 END), 6) AS confidence FROM s""")
def sentiment_ensemble(s, d):
    """Score, label and confidence of every article (the test texts have no emoji)."""
    c = scoring.sentiment(text.title_of(F.col("text")), text.summary_of(F.col("text")))
    return docs(s, d).select("doc_id", c.alias("c")).select("doc_id", F.round("c.score", 6).alias("score"), "c.label", F.round("c.confidence", 6).alias("confidence"))


@query("SELECT doc_id, quality AS score FROM documents JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id) WHERE quality >= 1")
def social_gate(s, d):
    """Articles with a known score past the gate; unknown scores fail."""
    scores = table(s, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("score"))
    return studio.social_gate(docs(s, d).select("doc_id"), scores, "doc_id", 1)


@query("""SELECT o_orderkey FROM orders WHERE o_totalprice >= 1000 AND o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') ORDER BY o_orderdate DESC, o_orderkey LIMIT 25""")
def dispatch_queue(s, d):
    """The next orders to dispatch: gated, not yet logged, newest first."""
    posted = table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    gate = (F.col("o_totalprice") >= 1000) & (F.col("o_orderstatus") == "O")
    return studio.queue(table(s, d, "orders"), posted, ["o_orderkey"], gate, [F.desc("o_orderdate"), F.col("o_orderkey")], 25).select("o_orderkey")


@query("""WITH q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id)
SELECT doc_id, round(100 * (1.0 * coalesce(quality, 0) + 0.9 * least(1.0, n_chars / 5000.0) + 1.1 * CASE WHEN lang = 'en' THEN 1.0 ELSE 0.5 END + pow(0.5, (doc_id % 96) / 12.0)) / 6.4 * CASE WHEN doc_id % 10 = 0 THEN 0.35 ELSE 1 END, 4) AS score
FROM documents LEFT JOIN q USING (doc_id)""")
def studio_score(s, d):
    """Weighted factors of every article; missing demand counts 0, repeated stories are penalised."""
    lab = table(s, d, "labels").groupBy("doc_id").agg(F.max("quality").cast("double").alias("credibility"))
    f = docs(s, d).join(lab, "doc_id", "left").select("doc_id", "credibility", F.least(F.lit(1.0), F.col("n_chars") / 5000).alias("coverage"), F.when(F.col("lang") == "en", 1.0).otherwise(0.5).alias("audience"), scoring.freshness(F.col("doc_id") % 96, 12.0).alias("freshness"), *[F.lit(0.0).alias(c) for c in ("youtube", "telegram", "reddit")])
    return studio.score(f, repeat=F.col("doc_id") % 10 == 0).select("doc_id", F.round("score", 4).alias("score"))


@query("""WITH e AS (SELECT p_partkey, CASE WHEN regexp_matches(p_name, '(?i)cpi|inflation|ppi') THEN 'inflation' WHEN regexp_matches(p_name, '(?i)payroll|unemploy|jobs') THEN 'jobs' WHEN regexp_matches(p_name, '(?i)rate|fomc') THEN 'rates' ELSE 'other' END AS rule, p_size FROM part),
r AS (SELECT rule, p_size % 3 - 1 AS surprise, (p_size % 3 - 1) * 0.5 * p_size AS move FROM e)
SELECT rule, count(*) FILTER (surprise > 0) AS beats, count(*) FILTER (surprise < 0) AS misses, count(*) FILTER (surprise = 0) AS flat, round(avg(move) FILTER (surprise <> 0), 6) AS mean_move FROM r GROUP BY rule""")
def reaction_stats(s, d):
    """Surprises and moves by the first matching rule."""
    e = studio.first_rule(table(s, d, "part"), "p_partkey", F.col("p_name")).withColumn("surprise", F.col("p_size") % 3 - 1)
    return studio.reaction_stats(e.withColumn("move", F.col("surprise") * 0.5 * F.col("p_size"))).withColumn("mean_move", F.round("mean_move", 6))


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS rn FROM documents) WHERE rn <= 10")
def stratified_sample(s, d):
    """Ten articles of every language, the same each time."""
    return studio.sample(docs(s, d).select("doc_id", "lang"), "lang", "doc_id", 10)


@query(f"""WITH {BARS}, p AS (SELECT symbol, bucket * 14400 AS epoch, close AS value FROM c), w AS (SELECT *, first_value(value) OVER v AS f, count(*) OVER v AS n FROM p WINDOW v AS (PARTITION BY symbol ORDER BY epoch RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW))
SELECT symbol, epoch, CASE WHEN n >= 2 AND f <> 0 THEN round((value - f) / f * 100, 6) END AS change FROM w""")
def hist_change_24h(s, d):
    """Change against the first point of the last day."""
    p = bars(s, d).select("symbol", (F.col("bucket") * 14400).alias("epoch"), F.col("close").alias("value"))
    return studio.hist_change(p, 86400).select("symbol", "epoch", F.round("change", 6).alias("change"))


@query(f"""WITH {BARS}, r AS (SELECT symbol, bucket, (close / lag(close) OVER (PARTITION BY symbol ORDER BY bucket) - 1) * 100 AS ret FROM c)
SELECT symbol, bucket, round(abs(ret) / greatest(0.35, avg(abs(ret)) OVER (PARTITION BY symbol)), 5) AS z FROM r""")
def move_zscore(s, d):
    """How large each bar's move is for its symbol."""
    return studio.move_z(bars(s, d)).select("symbol", "bucket", F.round("z", 5).alias("z"))


@query(rf"""WITH n AS (SELECT doc_id, list_distinct(regexp_extract_all({TITLE}, '\d+(?:[.,]\d+)?\s*%?')) AS a, list_distinct(regexp_extract_all({BODY}, '\d+(?:[.,]\d+)?\s*%?')) AS b FROM documents)
SELECT doc_id, len(a) AS claims, len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS proven FROM n""")
def number_provenance(s, d):
    """Whether all numbers of the headline occur in the body."""
    a, b = text.numbers(text.title_of(F.col("text"))), text.numbers(text.summary_of(F.col("text")))
    return docs(s, d).select("doc_id", F.size(a).cast("long").alias("claims"), (F.size(F.array_except(a, b)) == 0).alias("proven"))


@query(f"""WITH w AS (SELECT lang, unnest({WORDS.format('text')}) AS word FROM documents), n AS (SELECT lang, word, count(*) AS n FROM w WHERE len(word) >= 4 GROUP BY ALL)
SELECT lang, word, n FROM n QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= 12""")
def top_words(s, d):
    """The twelve most frequent longer words of every language."""
    from marketloom.operators.ranking import top_per_bucket

    w = docs(s, d).select("lang", F.explode(text.words(F.col("text"))).alias("word")).where(F.length("word") >= 4)
    return top_per_bucket(w.groupBy("lang", "word").agg(F.count("*").alias("n")), ["lang"], [F.desc("n"), F.col("word")], 12).drop("rn")


@query("""WITH n AS (SELECT substr(p_name, 1, 3) AS key, p_brand AS variant, count(*) AS n FROM part GROUP BY ALL), m AS (SELECT key, max(n) AS best, sum(n) AS total FROM n GROUP BY key)
SELECT n.key, min(variant) AS p_brand, round(any_value(best)::DOUBLE / any_value(total), 6) AS share FROM n JOIN m ON n.key = m.key AND n = best GROUP BY n.key""")
def variant_share(s, d):
    """The most frequent variant of every key."""
    return quality.family(table(s, d, "part").withColumn("key", F.substring("p_name", 1, 3)), "key", "p_brand").withColumn("share", F.round("share", 6))


@query("SELECT event_id, floor(epoch(ts))::BIGINT || '_' || substr(regexp_replace(event_type, '[^0-9A-Za-z]', '', 'g'), 1, 20) AS key FROM events")
def calendar_key(s, d):
    """Keys of calendar events."""
    e = table(s, d, "events")
    return e.select("event_id", F.concat_ws("_", F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"), F.substring(F.regexp_replace("event_type", "[^0-9A-Za-z]", ""), 1, 20)).alias("key"))


_IMPACT = " + ".join(f"regexp_matches(lower(text), '(^|[^a-z0-9]){w}([^a-z0-9]|$)')::INT" if w.isascii() else f"regexp_matches(lower(text), '(^|[^a-z0-9\u0600-\u06FF]){w}($|[^a-z0-9\u0600-\u06FF]|{'|'.join(scoring.ENDINGS)})')::INT" for w in scoring.IMPACT)


@query(f"SELECT doc_id, 0.35::DOUBLE + CASE WHEN regexp_matches(text, '[0-9]') THEN 0.25 ELSE 0 END + CASE WHEN {_IMPACT} >= 1 THEN 0.25 ELSE 0 END + CASE WHEN {_IMPACT} >= 3 THEN 0.15 ELSE 0 END AS impact FROM documents")
def market_impact(s, d):
    """Impact of every article."""
    return docs(s, d).select("doc_id", scoring.market_impact(text.fold(F.col("text")), text.numbers(F.col("text"))).alias("impact"))


@query()
def report_markdown(s, d):
    """A report of every symbol."""
    return studio.to_markdown(studio.sections(timeseries.snapshot(bars(s, d))))


@query()
def chrf_pairs(s, d):
    """Character n-gram F-scores of neighbouring reference items, over their whole texts."""
    b = table(s, d, "benchmark")
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("next"))
    return studio.chrf_rows(b.join(other, "item_id"), "item_id", "text", "next").withColumn("chrf", F.round("chrf", 6))
