"""Registered queries of text products, audits and the ingest chain; they extend the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions import scoring, text
from marketloom.operators import feed, reports, search, timeseries
from marketloom.plans import catalog
from marketloom.plans.catalog import TITLE, WORDS, bars, docs, query
from marketloom.plans.desk import ART, NOW, articles
from marketloom.plans.products import BODY
from marketloom.sources.readers import table

CLEAN = r"(SELECT CASE WHEN len(w) > 15 THEN array_to_string(w[1:15], ' ') || '…' ELSE array_to_string(w, ' ') END FROM (SELECT string_split(trim(regexp_replace(regexp_replace(split_part(title, chr(10), 1), 'https?://\S+|[@#][0-9A-Za-z_]+', ' ', 'g'), '\s+', ' ', 'g')), ' ') AS w))"


@query(f"""WITH {ART}, r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY cred DESC, ts DESC, id) AS index FROM art)
SELECT topic, index, id::VARCHAR AS key, {CLEAN} AS title, source || '.example' AS host, strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS stamp FROM r WHERE index <= 5""")
def citation_list(s, d):
    """The five most credible articles of every topic, as citations."""
    return reports.citations(articles(s, d), "topic", [F.desc("cred"), F.desc("ts")])


@query(f"""WITH {ART} SELECT id, substr(trim('*' || title || '*' || chr(10) || coalesce(publisher, '') || ' | ' || source), 1, 4000) AS message FROM art""")
def captions(s, d):
    """Messages of a template; missing values are empty."""
    value = {"title": F.col("title"), "publisher": F.col("publisher"), "source": F.col("source")}
    return articles(s, d).select("id", reports.rendered("*{title}*\n{publisher} | {source}", value).alias("message"))


@query(f"""WITH {ART}, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY cred DESC, id) AS rn FROM art)
SELECT lang, substr('News: ' || lang || chr(10) || string_agg('- ' || id || ' (' || source || ')', chr(10) ORDER BY rn), 1, 4000) AS text FROM r WHERE rn <= 5 GROUP BY lang""")
def news_digest(s, d):
    """One message for every language."""
    return reports.digest(articles(s, d), "lang", [F.desc("cred")], "- {id} ({source})", {"id": F.col("id"), "source": F.col("source")}, "News: {group}")


@query()
def report_prose(s, d):
    """Nine sections of prose for every symbol; tested on given numbers."""
    news = table(s, d, "events").groupBy(F.col("event_type").alias("symbol")).agg(F.count("*").alias("articles"))
    return reports.markdown(reports.prose(timeseries.snapshot(bars(s, d)), news))


@query(f"""WITH {ART}, k AS (SELECT id, ts FROM art WHERE ts >= {NOW - 86400} ORDER BY ts DESC, id LIMIT 100), p AS (SELECT DISTINCT id, unnest({WORDS.format('title')}) AS term FROM art),
r AS (SELECT term, id, row_number() OVER (PARTITION BY term ORDER BY ts DESC, id) AS rn FROM p JOIN k USING (id) WHERE len(term) >= 2) SELECT term, id, 3.0::DOUBLE AS w FROM r WHERE rn <= 20""")
def inverted_index(s, d):
    """Postings of the newest articles, a few for each term."""
    a = articles(s, d)
    return reports.inverted_index(search.postings(a, "id", {"title": F.col("title")}), a, "id", NOW, 1, 100, 20)


@query(f"SELECT count(*) AS rows, count(*) FILTER (length({TITLE}) < 20) AS short_titles, count(*) FILTER (length({BODY}) = 0) AS no_body, count(*) FILTER (lang IS NULL) AS no_language FROM documents")
def quality_audit(s, d):
    """How many articles have each flaw."""
    return reports.audit(docs(s, d), {"short_titles": F.length(text.title_of(F.col("text"))) < 20, "no_body": F.length(text.summary_of(F.col("text"))) == 0, "no_language": F.col("lang").isNull()})


@query("""WITH t AS (SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS actual, (user_id % 100)::DOUBLE AS forecast, CASE WHEN event_id % 3 = 0 THEN 'Unemployment rate' ELSE event_type END AS title FROM events)
SELECT id, round(actual - forecast, 6) AS surprise, (CASE WHEN actual > forecast THEN 1 WHEN actual < forecast THEN -1 END * CASE WHEN regexp_matches(lower(title), 'unemployment|jobless') THEN -1 ELSE 1 END)::INT AS better, actual IS NOT NULL AS released FROM t""")
def release_surprise(s, d):
    """Surprises of releases; less is better for some."""
    e, i = table(s, d, "events"), F.col("event_id")
    c = reports.surprise(F.when(i % 4 != 0, F.col("value")), (F.col("user_id") % 100).cast("double"), F.when(i % 3 == 0, "Unemployment rate").otherwise(F.col("event_type")), ["unemployment", "jobless"])
    return e.select(i.alias("id"), c.alias("c")).select("id", F.round("c.surprise", 6).alias("surprise"), "c.better", "c.released")


@query("SELECT event_id AS id, n AS step, floor(epoch(ts))::BIGINT - (n + 1) * 30 * 86400 AS sec FROM events, (SELECT unnest(range(0, 6)) AS n)")
def reference_rows(s, d):
    """Six earlier dates of every event at its cadence."""
    e = table(s, d, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    return reports.reference_rows(e).select("id", F.col("step").cast("long").alias("step"), F.unix_seconds("ts").alias("sec"))


@query("SELECT item_id, round(1 - exp(-greatest(0, (item_id % 20 - 5) / 4.0)), 6) AS x FROM benchmark")
def saturation(s, d):
    """Saturated signals."""
    return table(s, d, "benchmark").select("item_id", F.round(reports.saturated((F.col("item_id") % 20 - 5) / 4.0), 6).alias("x"))


@query(r"""WITH p AS (SELECT string_split(text, ' ') AS a, string_split(replace(text, ' the ', ' THE '), ' ') AS b FROM benchmark), c AS (SELECT unnest(list_transform(range(1, len(a) + 1), lambda i: {'old': a[i], 'new': b[i]})) AS c FROM p)
SELECT c.old AS old, c.new AS new, count(*) AS n FROM c WHERE c.old <> c.new GROUP BY ALL""")
def token_changes(s, d):
    """Words that an edit changed."""
    b = table(s, d, "benchmark").select("text", F.replace("text", F.lit(" the "), F.lit(" THE ")).alias("after"))
    return reports.token_changes(b, "text", "after")


@query()
def ingest_chain(s, d):
    """The whole gate: relevance, credibility, first title or link wins, tags, newest first; counted by its parts' own queries."""
    a = articles(s, d)
    c = scoring.credibility(F.col("title"), F.col("summary"), F.lit(0.8), F.col("age_hours"), link=F.col("link"))
    rows = a.where(scoring.relevant(F.col("title"), F.col("summary"))).withColumn("c", c).where("c.valid")
    key = F.nullif(F.substring(F.regexp_replace(F.lower("title"), "[^a-z0-9]", ""), 1, 128), F.lit(""))
    kept = feed.first_wins(rows, [key, F.regexp_replace("link", r"[?#].*$", "")], [-F.col("ts")], "id")
    return kept.select("id", "c.score", scoring.topic(F.concat_ws(" ", "title", "summary")).alias("topic"), F.array_join(scoring.assets(F.concat_ws(" ", "title", "summary")), ",").alias("assets"), "ts")


@query(f"""WITH n AS (SELECT symbol, max(cycle) AS last FROM ({catalog.SQL["volume_anomaly_zscore"]}) GROUP BY symbol), a AS (SELECT symbol, severity AS anomaly, z FROM ({catalog.SQL["volume_anomaly_zscore"]}) JOIN n USING (symbol) WHERE cycle = last AND severity <> 'none'),
m AS (SELECT * FROM ({catalog.SQL["sentiment_move_corr"]}) WHERE symbol IN ('view', 'click', 'purchase', 'signup', 'error', 'search') AND accuracy IS NOT NULL),
k AS (SELECT symbol, count(*) AS horizons, round(avg(accuracy), 6) AS accuracy FROM m GROUP BY symbol) SELECT coalesce(a.symbol, k.symbol) AS symbol, anomaly, z, coalesce(horizons, 0) AS horizons, accuracy FROM a FULL JOIN k ON a.symbol = k.symbol""")
def composite_summary(s, d):
    """Latest volume anomalies, and how well news told price moves for six symbols."""
    found = reports.intelligence(catalog.volume_anomaly_zscore(s, d), catalog.sentiment_move_corr(s, d), ["view", "click", "purchase", "signup", "error", "search"])
    mean = F.aggregate("moves", F.lit(0.0), lambda a, m: a + m.accuracy) / F.size("moves")
    return found.select("symbol", "anomaly", "z", F.coalesce(F.when(F.col("moves").isNotNull(), F.size("moves")), F.lit(0)).cast("bigint").alias("horizons"), F.round(mean, 6).alias("accuracy"))
