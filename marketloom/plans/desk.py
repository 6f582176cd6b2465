"""Registered queries of the news desk; they extend the catalogue.

The documents stand in for articles: their ids give times, kinds, publishers,
assets and credibility, by the same rules in Spark (``articles``) and SQL (ART).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions import scoring, text
from marketloom.operators import desk, feed, studio, timeseries
from marketloom.plans.catalog import BARS, CYCLES, POLARITY, SERIES, TITLE, TOKENS, WORDS, _ema_sql, _quoted, bars, cycles, docs, query
from marketloom.plans.products import BODY
from marketloom.sources.readers import table

#: The moment at which all ages are taken, in epoch seconds.
NOW = 1_700_000_000
#: Headlines put before the articles' own, so that the gates have something to decide.
LEADS = ("bitcoin rises again", "S. Korea captures gold in fencing", "top stocks to buy now, gold too", "quarterly earnings of a maker", "the fed and inflation", "a quiet day")
ASSETS_OF = (("BTC",), ("ETH", "BTC"), ("GOLD",), ())
KINDS = ("social", "news", "research", "news", "macro")
PUBLISHERS = ("Reuters", " CNBC ", "unknown", None)
TRUST = {"reuters": 0.95, "cnbc": 0.85}


def articles(s: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) if not isinstance(v, tuple) else F.array(*map(F.lit, v)).cast("array<string>") for v in values]), (i % len(values) + 1).cast("int"))
    return docs(s, d).select(i.alias("id"), F.concat_ws(" ", pick(LEADS), text.title_of(F.col("text"))).alias("title"), text.summary_of(F.col("text")).alias("summary"), "source", "lang", F.concat(F.when(i % 9 == 0, "ftp://").otherwise("https://"), F.col("source"), F.lit(".example/"), i).alias("link"), pick(KINDS).alias("kind"), pick(PUBLISHERS).alias("publisher"), pick(ASSETS_OF).alias("assets"), (NOW - i * 450).alias("ts"), (i / 8.0).alias("age_hours"), F.round(0.5 + (i % 50) / 100.0, 3).alias("cred"), F.col("n_chars").cast("long").alias("views"), scoring.topic(F.col("text")).alias("topic"))


def _cases(values, key: str) -> str:
    say = lambda v: "NULL" if v is None else "[" + ", ".join(f"'{x}'" for x in v) + "]::VARCHAR[]" if isinstance(v, tuple) else f"'{v}'"
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {k} THEN {say(v)}" for k, v in enumerate(values)) + " END"


TOPIC_SQL = "CASE " + " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{t}'" for t, p in scoring.TOPICS.items()) + " ELSE 'general' END"
ART = f"""art AS (SELECT doc_id AS id, {_cases(LEADS, 'doc_id')} || ' ' || {TITLE} AS title, {BODY} AS summary, source, lang,
  CASE WHEN doc_id % 9 = 0 THEN 'ftp://' ELSE 'https://' END || source || '.example/' || doc_id AS link, {_cases(KINDS, 'doc_id')} AS kind, {_cases(PUBLISHERS, 'doc_id')} AS publisher,
  {_cases(ASSETS_OF, 'doc_id')} AS assets, {NOW} - doc_id * 450 AS ts, doc_id / 8.0 AS age_hours, round(0.5 + (doc_id % 50) / 100.0, 3) AS cred, n_chars::BIGINT AS views, {TOPIC_SQL} AS topic FROM documents)"""


def _any(patterns, on: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({on}, '(?i){_quoted(p)}')" for p in patterns) + ")"


# ---- gates and projections


@query(f"""WITH {ART} SELECT id, CASE WHEN {_any([scoring.SPORTS, scoring.HARD_NOISE], 'title')} THEN FALSE WHEN {_any([*scoring.ASSETS.values(), r'\bcrypto\b|\bbitcoin\b'], 'title')} THEN TRUE
  WHEN {_any([scoring.NOISE], 'title')} THEN FALSE ELSE {_any([scoring.RELEVANT], "(title || ' ' || substr(summary, 1, 400))")} END AS relevant FROM art""")
def relevance_gate(s, d):
    """Whether each article is market news."""
    return articles(s, d).select("id", scoring.relevant(F.col("title"), F.col("summary")).alias("relevant"))


@query(f"""WITH {ART} SELECT id, greatest(0.7, CASE lower(trim(publisher)) {" ".join(f"WHEN '{k}' THEN {v}" for k, v in TRUST.items())} ELSE 0.64 END)::DOUBLE AS effective_trust FROM art""")
def publisher_trust(s, d):
    """The larger of source and publisher trust."""
    trust = s.createDataFrame(list(TRUST.items()), "publisher string, trust double")
    return desk.publisher_trust(articles(s, d).withColumn("source_trust", F.lit(0.7)), trust).select("id", "effective_trust")


@query(f"""WITH {ART} SELECT id, title, substr(summary, 1, 1000) AS summary, CASE WHEN link LIKE 'http%' THEN link ELSE '' END AS link, source, round(age_hours, 1)::DOUBLE AS age_hours, cred::DOUBLE AS cred FROM art""")
def public_articles(s, d):
    """What readers see of every article (the date has its own query)."""
    return desk.public(articles(s, d)).drop("date_fa")


@query(f"""WITH {ART} SELECT id, array_to_string(list_sort(list_distinct(list_concat(assets, ['NEWS']))), ',') AS symbols, CASE WHEN cred > 0.7 THEN 'high' ELSE 'low' END AS trust FROM art""")
def v1_articles(s, d):
    """Articles with their sorted symbols and the assets of the feed."""
    symbols = F.array_sort(F.array_union("assets", F.array(F.lit("NEWS"))))
    return articles(s, d).select("id", F.struct(F.array_join(symbols, ",").alias("symbols"), F.when(F.col("cred") > 0.7, "high").otherwise("low").alias("trust")).alias("v")).select("id", "v.*")


@query(f"WITH {ART} SELECT id FROM art WHERE list_contains(assets, 'BTC') AND kind = 'news' AND cred >= 0.6 AND ts >= {NOW - 400_000} AND lower(source) = 'src1'")
def feed_filter(s, d):
    """A feed with every kind of condition."""
    return articles(s, d).where(desk.matches_feed(asset="BTC", kind="news", source="src1", least_cred=0.6, since=NOW - 400_000)).select("id")


@query(f"WITH {ART} SELECT id FROM art WHERE list_contains(assets, 'BTC') AND cred >= 0.7 AND age_hours <= 72 AND kind IN ('news', 'macro')")
def report_eligible(s, d):
    """Articles that a report on one asset may cite."""
    return articles(s, d).where(desk.eligible("BTC", 0.7, 72, kinds=["news", "macro"])).select("id")


CAL = "cal AS (SELECT event_id AS id, event_type AS title, CASE event_id % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' WHEN 2 THEN 'Low' ELSE 'Holiday' END AS impact, CASE event_id % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'JPY' END AS currency, value IS NOT NULL AND event_id % 5 < 3 AS released, ts, epoch(ts)::BIGINT AS sec FROM events)"


def calendar_rows(s: SparkSession, d: str) -> DataFrame:
    e, i = table(s, d, "events"), F.col("event_id")
    impact = F.element_at(F.array(*map(F.lit, ("High", "Medium", "Low", "Holiday"))), (i % 4 + 1).cast("int"))
    currency = F.element_at(F.array(*map(F.lit, ("USD", "EUR", "JPY"))), (i % 3 + 1).cast("int"))
    return e.select(i.alias("id"), F.col("event_type").alias("title"), impact.alias("impact"), currency.alias("currency"), (F.col("value").isNotNull() & (i % 5 < 3)).alias("released"), "ts")


@query(f"WITH {CAL} SELECT id FROM cal WHERE impact IN ('High', 'Medium') AND currency IN ('USD', 'EUR') AND NOT released AND contains(lower(title), 'e')")
def calendar_filter(s, d):
    """Unreleased events of two currencies, medium importance or more."""
    return calendar_rows(s, d).where(desk.calendar_filter("Medium", ["USD", "EUR"], True, "E")).select("id")


@query(f"WITH {CAL}, o AS (SELECT *, row_number() OVER (ORDER BY CASE impact WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 WHEN 'Low' THEN 2 ELSE 3 END, ts, id) AS rn FROM cal) SELECT id, rn FROM o WHERE rn <= 50")
def calendar_by_impact(s, d):
    """The fifty most important events, earliest first."""
    top = desk.calendar_order(calendar_rows(s, d), "impact").limit(50)
    return top.select("id", F.row_number().over(_order(scoring.importance(F.col("impact")), "ts", "id")).alias("rn"))


def _order(*columns):
    """A window over the few rows of a limited board."""
    from pyspark.sql import Window

    return Window.orderBy(*columns)


@query(f"WITH {CAL}, m AS (SELECT min(sec) AS t0 FROM cal) SELECT id FROM cal, m WHERE sec <= t0 + 7 * 86400")
def calendar_horizon(s, d):
    """Events of the first week, by seconds rounded to the nearest one."""
    sec = F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long")
    first = calendar_rows(s, d).agg(F.min(sec)).first()[0] or 0
    return calendar_rows(s, d).where(desk.horizon(sec, first, 7)).select("id")


@query(f"WITH {CAL} SELECT CAST(ts + INTERVAL 210 MINUTE AS DATE)::VARCHAR AS day, count(*) AS n, count(*) FILTER (impact = 'High') AS high, count(*) FILTER (impact = 'Medium') AS medium FROM cal GROUP BY 1")
def calendar_days(s, d):
    """Events by local day."""
    return desk.days(calendar_rows(s, d), "ts", "impact").withColumn("day", F.col("day").cast("string"))


@query("""SELECT event_id AS id FROM events WHERE coalesce(TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'never' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) < (SELECT max(ts) FROM events) - INTERVAL 2 DAY, FALSE)""")
def expired_entries(s, d):
    """Entries past their time; times that can't be read never expire."""
    e = table(s, d, "events")
    last = e.agg(F.max(F.col("ts").cast("timestamp")) - F.expr("INTERVAL 2 DAYS")).first()[0]
    at = F.when(F.col("event_id") % 3 == 0, "never").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return e.where(desk.expired(at, F.lit(last).cast("timestamp"))).select(F.col("event_id").alias("id"))


@query(r"SELECT doc_id AS id, nullif(regexp_extract(' ' || regexp_replace(lower(text), '[^\p{L}\p{N}]', ' ', 'g') || ' ', ' (the|and) ', 1), '') AS word FROM documents WHERE regexp_matches(' ' || regexp_replace(lower(text), '[^\p{L}\p{N}]', ' ', 'g') || ' ', ' (the|and) ')")
def forbidden_words(s, d):
    """The first forbidden whole word of each article that has one."""
    return docs(s, d).select(F.col("doc_id").alias("id"), desk.forbidden(F.col("text"), ["the", "and"]).alias("word")).where("word is not null")


MARKERS = {"en": ["the", "and", "of"], "fr": ["le", "la", "et"], "de": ["der", "und", "die"], "es": ["el", "los", "y"]}


def _markers_sql() -> str:
    n = {k: f"len(list_filter({WORDS.format('text')}, lambda w: w IN ({', '.join(repr(x) for x in v)})))" for k, v in MARKERS.items()}
    return f"WITH c AS (SELECT doc_id AS id, {', '.join(f'{c} AS {k}' for k, c in n.items())} FROM documents), b AS (SELECT *, greatest({', '.join(n)}) AS best FROM c) SELECT id, CASE WHEN best = 0 THEN NULL {' '.join(f'WHEN {k} = best THEN {chr(39)}{k}{chr(39)}' for k in n)} END AS language FROM b"


@query(_markers_sql())
def language_markers(s, d):
    """The language whose stop-words an article uses most."""
    return docs(s, d).select(F.col("doc_id").alias("id"), desk.language(F.col("text"), MARKERS).alias("language"))


@query("SELECT c_custkey AS id, CASE WHEN length(c_mktsegment) > 0 THEN '***' ELSE c_mktsegment END AS token, c_name AS name FROM customer")
def redacted_settings(s, d):
    """Settings with their secrets masked."""
    m = F.create_map(F.lit("api_token"), F.col("c_mktsegment"), F.lit("name"), F.col("c_name"))
    return table(s, d, "customer").select(F.col("c_custkey").alias("id"), desk.redact(m).alias("m")).select("id", F.col("m")["api_token"].alias("token"), F.col("m")["name"].alias("name"))


@query(f"WITH {ART} SELECT id FROM art ORDER BY ts DESC, id LIMIT 20 OFFSET 40")
def third_page(s, d):
    """The third page of the newest articles."""
    return desk.page(articles(s, d), [F.desc("ts"), "id"], 20, 40).select("id")


@query("SELECT c_custkey AS id, CASE regexp_replace(upper(trim(v)), '-USD$', '') WHEN 'GOLD' THEN 'XAU' WHEN 'SILVER' THEN 'XAG' WHEN 'OIL' THEN 'WTI' ELSE regexp_replace(upper(trim(v)), '-USD$', '') END AS symbol FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'gold' WHEN 1 THEN ' btc-usd ' WHEN 2 THEN 'OIL-USD' ELSE c_mktsegment END AS v FROM customer)")
def symbol_alias(s, d):
    """Symbols by their usual names."""
    v = F.when(F.col("c_custkey") % 4 == 0, "gold").when(F.col("c_custkey") % 4 == 1, " btc-usd ").when(F.col("c_custkey") % 4 == 2, "OIL-USD").otherwise(F.col("c_mktsegment"))
    return table(s, d, "customer").select(F.col("c_custkey").alias("id"), scoring.alias(v).alias("symbol"))


DESKS = {"metals": {"words": ["the", "thorn"], "ambiguous": ["and"]}, "crypto": {"words": ["und"], "ambiguous": ["et", "la"]}}


def _hit_sql(w: str) -> str:
    return f"regexp_matches(t, '(^|[^a-z0-9]){w}([^a-z0-9]|$)')"


def _desks_sql() -> str:
    listed = lambda ws: "list_filter([" + ", ".join(f"CASE WHEN {_hit_sql(w)} THEN '{w}' END" for w in ws) + "], lambda x: x IS NOT NULL)"
    strong = {k: listed(v["words"]) for k, v in DESKS.items()}
    weak = {k: listed(v["ambiguous"]) for k, v in DESKS.items()}
    cols = ", ".join(f"{strong[k]} AS s_{k}, {weak[k]} AS w_{k}" for k in DESKS)
    none = " AND ".join(f"len(s_{k}) = 0" for k in DESKS)
    out, before = [], "TRUE"
    for k in DESKS:
        out.append(f"array_to_string(CASE WHEN {none} AND {before} THEN w_{k} ELSE s_{k} END, ' ') AS {k}")
        before += f" AND len(w_{k}) = 0"
    return f"WITH t AS (SELECT doc_id AS id, lower(text) AS t FROM documents), h AS (SELECT id, {cols} FROM t) SELECT id, {', '.join(out)} FROM h"


@query(_desks_sql())
def desk_buckets(s, d):
    """The desks an article speaks to, with the words that say so."""
    b = desk.buckets(F.lower("text"), DESKS)
    return docs(s, d).select(F.col("doc_id").alias("id"), b.alias("b")).select("id", *[F.coalesce(F.array_join(F.try_element_at("b", F.lit(k)), " "), F.lit("")).alias(k) for k in DESKS])


# ---- lookups and merges


@query("""WITH m AS (SELECT md5(text) AS k, 'translated ' || item_id AS t FROM benchmark WHERE item_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY item_id) = 1)
SELECT item_id, coalesce(t, text) AS text FROM benchmark LEFT JOIN m ON md5(text) = k""")
def translation_lookup(s, d):
    """Texts by their stored translation, found by hash."""
    b = table(s, d, "benchmark")
    memory = b.where("item_id % 2 = 0").groupBy(F.md5("text").alias("md5")).agg(F.concat(F.lit("translated "), F.min("item_id")).alias("translation"))
    return desk.translated(b.select("item_id", "text"), memory, "text")


@query("SELECT o_orderkey AS id, c_name AS name FROM orders LEFT JOIN customer ON o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 30")
def posted_stats(s, d):
    """The thirty newest posts with their content's name."""
    c = table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("name"))
    top = table(s, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(30)
    return top.join(F.broadcast(top.select("o_custkey").join(c, "o_custkey").distinct()), "o_custkey", "left").select(F.col("o_orderkey").alias("id"), "name")


@query("SELECT doc_id AS id, quality FROM documents JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id) WHERE text IS NOT NULL AND quality IS NOT NULL ORDER BY n_chars DESC, doc_id LIMIT 200")
def bodies_top(s, d):
    """The longest articles that have a body and a label."""
    lab = table(s, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return docs(s, d).where("text is not null").select("doc_id", "n_chars").join(lab, "doc_id", "left").where("quality is not null").orderBy(F.desc("n_chars"), "doc_id").limit(200).select(F.col("doc_id").alias("id"), "quality")


@query(f"""WITH {ART}, e AS (SELECT DISTINCT id, CASE a WHEN 'GOLD' THEN 'XAU' ELSE a END AS symbol FROM (SELECT id, unnest(assets) AS a FROM art)), p AS (SELECT * FROM (VALUES ('BTC', 65000.0), ('XAU', 2300.5), ('ETH', 0.0)) AS v(symbol, price))
SELECT symbol, id, price::DOUBLE AS price FROM e JOIN p USING (symbol) WHERE price > 0""")
def priced_events(s, d):
    """Events of articles whose assets have a price under any name."""
    prices = s.createDataFrame([("BTC-USD", 65000.0), ("gold", 2300.5), ("ETH", 0.0)], "symbol string, price double")
    return desk.priced_events(articles(s, d), prices)


@query(rf"""WITH {ART}, k AS (SELECT *, split_part(link, '?', 1) || '|' || left(regexp_replace(lower(title), '[^a-z0-9]', '', 'g'), 90) AS f FROM art), fresh AS (SELECT * FROM k WHERE id % 3 = 0),
old AS (SELECT id, ts, f FROM k WHERE id % 3 <> 1 UNION ALL SELECT 1000000 + id, ts, f FROM fresh UNION ALL SELECT 2000000 + id, ts, split_part(link, '?', 1) || '|' || left('new' || regexp_replace(lower(title), '[^a-z0-9]', '', 'g'), 90) FROM fresh)
SELECT id, FALSE AS carried FROM fresh UNION ALL SELECT id, TRUE FROM old WHERE ts >= {NOW - 300_000} AND id NOT IN (SELECT id FROM fresh) AND f NOT IN (SELECT f FROM fresh)""")
def carry_forward(s, d):
    """Articles of the cycle before that are neither fetched again nor too old; some came again under another id, title or link."""
    a = articles(s, d)
    fresh = a.where("id % 3 = 0")
    again = fresh.withColumn("id", F.col("id") + 1_000_000).withColumn("link", F.concat("link", F.lit("?again")))
    renamed = fresh.withColumn("id", F.col("id") + 2_000_000).withColumn("title", F.concat(F.lit("New: "), "title"))
    return desk.carry_forward(fresh, a.where("id % 3 <> 1").unionByName(again).unionByName(renamed), NOW - 300_000).select("id", "carried")


def archive_rows(s: SparkSession, d: str) -> DataFrame:
    """Articles of four cycles: every second one again under its id, every third under another id with a longer link."""
    a = articles(s, d).select("id", "title", "link")
    same = a.where("id % 2 = 0").withColumn("title", F.concat("title", F.lit(" updated")))
    again = a.where("id % 3 = 0").select((F.col("id") + 1_000_000).alias("id"), F.upper("title").alias("title"), F.concat("link", F.lit("?utm=1")).alias("link"))
    new = a.where("id % 5 = 0").select((F.col("id") + 2_000_000).alias("id"), F.concat(F.lit("More: "), "title").alias("title"), "link")
    parts = [p.withColumn("place", F.col("id") % 1_000_000 + k * 10_000_000) for k, p in enumerate((a, same, again, new))]
    return _stack(parts)


@query()
def archive_merge(s, d):
    """The last thousand articles of the archive, each story once; a plain loop tests it."""
    return desk.archive(archive_rows(s, d), most=1000).select("id", "place")


@query("""WITH u AS (SELECT n_name AS handle, 1 AS p FROM nation UNION ALL SELECT upper(n_name), 0 FROM nation WHERE n_nationkey % 4 = 0 UNION ALL SELECT r_name, 0 FROM region),
k AS (SELECT handle FROM u QUALIFY row_number() OVER (PARTITION BY lower(handle) ORDER BY p, handle) = 1) SELECT handle FROM k WHERE lower(handle) NOT IN (SELECT lower(n_name) FROM nation WHERE n_nationkey % 5 = 0)""")
def source_list(s, d):
    """Own and built-in sources without deleted ones."""
    n, r = table(s, d, "nation"), table(s, d, "region")
    extra = n.where("n_nationkey % 4 = 0").select(F.upper("n_name").alias("handle")).unionAll(r.select(F.col("r_name").alias("handle")))
    return desk.merged_sources(n.select(F.col("n_name").alias("handle")), extra, n.where("n_nationkey % 5 = 0").select(F.col("n_name").alias("handle")))


@query("SELECT DISTINCT floor(epoch(ts))::BIGINT AS at, event_type AS title FROM events WHERE user_id % 2 = 0 OR value > 50")
def two_weeks_union(s, d):
    """Two overlapping calendars, each event once."""
    e = table(s, d, "events")
    both = e.where("user_id % 2 = 0").unionByName(e.where("value > 50"))
    return both.select(F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.col("event_type").alias("title")).dropDuplicates(["at", "title"])


@query("SELECT c_nationkey AS k, 'missing' AS side FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT s_nationkey, 'new' FROM (SELECT s_nationkey FROM supplier EXCEPT SELECT c_nationkey FROM customer)")
def baseline_difference(s, d):
    """What only the baseline has, and what only the run has."""
    a, b = table(s, d, "customer").select(F.col("c_nationkey").alias("k")), table(s, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return a.subtract(b).withColumn("side", F.lit("missing")).unionAll(b.subtract(a).withColumn("side", F.lit("new")))


@query(f"WITH t AS (SELECT doc_id AS id, {TOKENS.format(TITLE)} AS a, {TOKENS.format(BODY)} AS b FROM documents) SELECT id, len(list_intersect(a, b)) AS shared, CASE WHEN greatest(len(a), len(b)) > 0 THEN round(len(list_intersect(a, b))::DOUBLE / greatest(len(a), len(b)), 6) ELSE 0 END AS overlap FROM t")
def title_overlap(s, d):
    """How much of its words a title shares with its text."""
    a, b = text.tokens(text.title_of(F.col("text"))), text.tokens(text.summary_of(F.col("text")))
    shared, most = F.size(F.array_intersect(a, b)), F.greatest(F.size(a), F.size(b))
    return docs(s, d).select(F.col("doc_id").alias("id"), shared.alias("shared"), F.when(most > 0, F.round(shared / most, 6)).otherwise(0.0).alias("overlap"))


@query(f"WITH {ART} SELECT id FROM art WHERE id IN (SELECT doc_id FROM labels) OR id % 10 = 0")
def cache_purge(s, d):
    """Cached ids that are live or archived."""
    a = articles(s, d).select("id")
    keep = table(s, d, "labels").select(F.col("doc_id").alias("id")).unionAll(a.where("id % 10 = 0"))
    return a.join(keep, "id", "left_semi")


@query()
def first_wins(s, d):
    """Articles of which no newer kept one begins with the same title or summary; tested against a plain loop."""
    a = articles(s, d).select("id", "title", "summary", "ts")
    return feed.first_wins(a, [F.substring(F.lower("title"), 1, 24), F.substring(F.lower("summary"), 1, 24)], [-F.col("ts")], "id").select("id")


@query("""WITH l AS (SELECT o_custkey AS id, o_orderdate AS t, o_orderkey AS k, o_orderstatus = 'O' AS hidden FROM orders) SELECT id FROM (SELECT id, arg_max(hidden, (t, k)) AS h FROM l GROUP BY id) WHERE h""")
def hidden_ids(s, d):
    """Ids whose last entry hides them."""
    o = table(s, d, "orders")
    return desk.tombstones(o.select(F.col("o_custkey").alias("id"), F.struct("o_orderdate", "o_orderkey").alias("at"), (F.col("o_orderstatus") == "O").alias("hidden")))


@query("WITH l AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) SELECT o_custkey AS id, o_orderstatus AS status FROM l WHERE rn = 1")
def latest_log(s, d):
    """The last log entry of every customer."""
    o = table(s, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    return desk.latest(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status"))


@query("""WITH r AS (SELECT l_orderkey AS k, l_linenumber AS t, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_returnflag END AS v FROM lineitem), l AS (SELECT k, arg_max(v, (t, v)) AS v FROM r GROUP BY k)
SELECT o_orderkey AS id, CASE WHEN coalesce(v, '') <> '' THEN v ELSE o_orderpriority END AS term FROM orders LEFT JOIN l ON o_orderkey = k""")
def corrections(s, d):
    """Terms with the last non-empty reply to each."""
    v = F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.col("l_returnflag"))
    replies = table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("at"), v.alias("term"))
    return desk.corrections(table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("term")), replies, "id", ["term"])


# ---- boards


@query("SELECT lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT a, count(*) FROM (SELECT unnest(" + _cases(ASSETS_OF, "doc_id") + ") AS a FROM documents) GROUP BY a")
def facets_with_assets(s, d):
    """Counts by language and by each asset of an article."""
    a = articles(s, d)
    return a.groupBy(F.col("lang").alias("value")).agg(F.count("*").alias("n")).unionAll(a.select(F.explode("assets").alias("value")).groupBy("value").agg(F.count("*").alias("n")))


@query(f"""WITH {ART}, p AS (SELECT source, {POLARITY.replace("coalesce(text, '')", "title")} AS p, CASE WHEN coalesce(cred, 0) = 0 THEN 0.5 ELSE cred END * CASE WHEN age_hours <= 6 THEN 1 WHEN age_hours <= 24 THEN 0.75 ELSE 0.5 END AS w FROM art),
g AS (SELECT source, count(*) AS n, round_even(round(50 + 42 * greatest(-1, least(1, coalesce(sum(w * p) / nullif(sum(w), 0), 0))), 9), 0)::INT AS gauge, count(*) FILTER (p > 0.15) AS pos, count(*) FILTER (p < -0.15) AS neg FROM p GROUP BY source)
SELECT source, n, gauge, CASE WHEN gauge < 25 THEN 'extreme fear' WHEN gauge < 45 THEN 'fear' WHEN gauge < 55 THEN 'neutral' WHEN gauge < 75 THEN 'greed' ELSE 'extreme greed' END AS mood, pos, neg FROM g""")
def mood_gauge(s, d):
    """The mood of each source from 0 to 100, by credibility and freshness."""
    return desk.gauge(articles(s, d), "source")


@query(f"""WITH {ART}, s AS (SELECT lang, id, views / (1 + age_hours) AS rate, cred AS rel FROM art), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY rate DESC, rel DESC, id) AS rn FROM s)
SELECT lang, max(id) FILTER (rn = 1) AS best, round(sum(rate) FILTER (rn <= 3), 6) AS top_rates, max(rel)::DOUBLE AS max_rel, count(*) AS n FROM r GROUP BY lang""")
def top_signals(s, d):
    """The fastest article of each language and the pace of its first three."""
    rows = articles(s, d).select("lang", "id", (F.col("views") / (1 + F.col("age_hours"))).alias("rate"), F.col("cred").alias("rel"))
    return desk.top_signals(rows, "lang", "rate", "rel").withColumn("top_rates", F.round("top_rates", 6))


@query(f"WITH {ART} SELECT source, count(*) AS n FROM art WHERE list_contains(assets, 'BTC') GROUP BY source ORDER BY n DESC, source")
def sources_used(s, d):
    """Sources of an asset's articles, most used first."""
    return articles(s, d).where(F.array_contains("assets", "BTC")).groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")


@query("SELECT count(DISTINCT coalesce(CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR END, source)) AS cited FROM documents")
def cited_news(s, d):
    """How many different articles are cited, by id, else link."""
    return docs(s, d).agg(F.count_distinct(F.coalesce(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")), F.col("source"))).alias("cited"))


@query(f"""WITH {BARS}, i AS (SELECT symbol, close, (row_number() OVER (PARTITION BY symbol ORDER BY bucket) - 1) // 7 AS chunk FROM c), k AS (SELECT symbol, chunk, max(close) AS high, min(close) AS low FROM i GROUP BY ALL HAVING count(*) = 7)
SELECT symbol, chunk, high, low FROM k QUALIFY count(*) OVER (PARTITION BY symbol) >= 2""")
def weekly_chunks(s, d):
    """Highs and lows of full runs of seven closes."""
    return desk.chunks(bars(s, d))


@query("""WITH l AS (SELECT lang, list_sort(list(n_chars)) AS v FROM documents WHERE n_chars IS NOT NULL GROUP BY lang)
SELECT lang, len(v) AS n, v[1] AS least, v[len(v) // 2 + 1] AS median, v[least(len(v) - 1, (len(v) * 9) // 10) + 1] AS p90, v[len(v)] AS most FROM l""")
def length_audit(s, d):
    """Least, upper median, nine-tenths element and largest length by language."""
    return desk.length_audit(docs(s, d), "lang", "n_chars")


@query(f"""WITH t AS (SELECT DISTINCT doc_id, quality, unnest({WORDS.format('text')}) AS token FROM documents JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)),
a AS (SELECT count(DISTINCT doc_id) AS docs, count(DISTINCT doc_id) FILTER (quality = 0) AS bad FROM t), e AS (SELECT token, count(*) AS n, count(*) FILTER (quality = 0) AS failing FROM t GROUP BY token HAVING count(*) >= 5)
SELECT token, n, failing, round((failing::DOUBLE / n) / nullif(bad::DOUBLE / docs, 0), 6) AS lift FROM e, a WHERE (failing::DOUBLE / n) / nullif(bad::DOUBLE / docs, 0) >= 3""")
def failing_lift(s, d):
    """Words that bad articles use at least three times as often."""
    lab = table(s, d, "labels").groupBy("doc_id").agg((F.max("quality") == 0).alias("failing"))
    t = docs(s, d).select("doc_id", F.explode(F.array_distinct(text.words(F.col("text")))).alias("token")).join(lab, "doc_id").withColumnRenamed("doc_id", "doc")
    return desk.co_occurrence(t, 3.0).withColumn("lift", F.round("lift", 6))


@query("""WITH t AS (SELECT substr(p_name, 1, 3) AS k, p_brand AS v, p_size / 100.0 AS conf FROM part), f AS (SELECT k, count(DISTINCT left(v, 8)) AS families, arg_min(v, (-conf, length(v), v)) AS best FROM t GROUP BY k) SELECT k, families, CASE WHEN families = 1 THEN best END AS v FROM f""")
def one_family(s, d):
    """The representative of keys with one family of variants."""
    t = table(s, d, "part").select(F.substring("p_name", 1, 3).alias("k"), F.col("p_brand").alias("v"), (F.col("p_size") / 100.0).alias("conf"))
    return desk.one_family(t, "k", "v", F.substring("v", 1, 8))


@query("""WITH o AS (SELECT substr(p_name, 1, 3) AS k, p_brand AS v, array_to_string(list_sort(list(DISTINCT p_type)), ';') AS domains, max(p_size) AS conf FROM part GROUP BY ALL) SELECT k, v, domains, conf, count(*) OVER (PARTITION BY k) > 1 AS contested FROM o""")
def merged_terms(s, d):
    """One row for each term and variant, with its domains, and whether it is contested."""
    t = table(s, d, "part").select(F.substring("p_name", 1, 3).alias("k"), F.col("p_brand").alias("v"), F.col("p_type").alias("domain"), F.lit("part").alias("source"), F.col("p_size").alias("conf"))
    return desk.merged_terms(t, "k", "v").select("k", "v", F.array_join("domains", ";").alias("domains"), "conf", "contested")


@query(f"WITH {CYCLES} SELECT symbol, count(*) AS n, array_to_string(list(n::VARCHAR ORDER BY cycle DESC), ' ') AS scores FROM (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY cycle DESC) <= 20) GROUP BY symbol")
def last_scores(s, d):
    """Each symbol's last twenty counts, newest first."""
    return desk.last_scores(cycles(s, d).withColumnRenamed("n", "score")).select("symbol", "n", F.array_join(F.col("scores").cast("array<string>"), " ").alias("scores"))


HEALTH = f"{CYCLES}, h AS (SELECT symbol AS source, cycle, n % 3 <> 0 AS ok FROM n), w AS (SELECT *, avg(ok::INT) OVER (PARTITION BY source ORDER BY cycle ROWS 29 PRECEDING) AS share, sum(ok::INT) OVER (PARTITION BY source ORDER BY cycle) AS g FROM h), b AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY source, g ORDER BY cycle) AS bad_run FROM w)"


@query(f"WITH {HEALTH} SELECT source, cycle::VARCHAR AS cycle, round(share, 6) AS share, bad_run::BIGINT AS bad_run, CASE WHEN bad_run >= 1 THEN least(360, 15 * pow(2, bad_run - 1)) ELSE 0 END::DOUBLE AS cooldown FROM b")
def source_health(s, d):
    """Share of good cycles, run of bad ones and cooldown of every source."""
    log = cycles(s, d).select(F.col("symbol").alias("source"), "cycle", (F.col("n") % 3 != 0).alias("ok"))
    return desk.breaker(log, least=1).select("source", F.col("cycle").cast("string").alias("cycle"), F.round("share", 6).alias("share"), "bad_run", "cooldown")


# ---- scores and orders

@query(f"""WITH {ART}, f AS (SELECT *, pow(0.5, age_hours / 12) AS freshness, least(1, ln(1 + views) / ln(1 + 10000)) AS audience, (id % 5) / 5.0 AS coverage, (id % 7) / 7.0 AS youtube, (id % 3) / 3.0 AS telegram FROM art)
SELECT id, round(100 * (1.0 * cred + 0.9 * coverage + 1.1 * audience + 1.0 * freshness + 0.9 * youtube + 1.0 * telegram) / 6.4 * CASE WHEN id % 11 = 0 THEN 0.35 ELSE 1 END, 6) AS score FROM f WHERE cred >= 0.6 AND views > 0""")
def studio_rank(s, d):
    """The studio's seven factors (no claims of the seventh here), gate and repeat penalty."""
    i = F.col("id")
    f = articles(s, d).select("id", "views", "cred", F.col("cred").alias("credibility"), (i % 5 / 5.0).alias("coverage"), scoring.log_norm(F.col("views"), 10_000.0).alias("audience"), scoring.freshness(F.col("age_hours"), 12.0).alias("freshness"), (i % 7 / 7.0).alias("youtube"), (i % 3 / 3.0).alias("telegram"), F.lit(None).cast("double").alias("reddit"))
    return studio.score(f.where("cred >= 0.6 and views > 0"), repeat=i % 11 == 0).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {ART}, r AS (SELECT id, age_hours, 0.55 * ((id % 13) / 13.0) + 0.45 * cred AS rank FROM art WHERE cred >= 0.55) SELECT id, round(rank, 6) AS rank FROM r ORDER BY r.rank DESC, age_hours, id LIMIT 40")
def channel_rank(s, d):
    """The channel's forty best articles by virality and fit."""
    rows = articles(s, d).select("id", "age_hours", F.col("cred").alias("fit"), (F.col("id") % 13 / 13.0).alias("viral"))
    return desk.channel_rank(rows, 0.55, 40).select("id", F.round("rank", 6).alias("rank"))


IDEAS = f"""{ART}, ideas AS (SELECT id, ts, id % 100 AS likes, id % 7 AS comments, views AS followers, id % 10 = 0 AS picked, id % 4 = 0 AS hot FROM art),
ip AS (SELECT *, likes * 3.0 + comments * 2.0 + log10(coalesce(followers, 0) + 1) * 4.0 + CASE WHEN picked THEN 6 ELSE 0 END + CASE WHEN hot THEN 4 ELSE 0 END AS p FROM ideas)"""


def ideas(s: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    return articles(s, d).select("id", "ts", (i % 100).alias("likes"), (i % 7).alias("comments"), F.col("views").alias("followers"), (i % 10 == 0).alias("picked"), (i % 4 == 0).alias("hot"))


@query(f"WITH {IDEAS} SELECT id, round(p, 6) AS popularity FROM ip ORDER BY p DESC, id LIMIT 60")
def popular_ideas(s, d):
    """The sixty most popular articles."""
    p = ideas(s, d).select("id", desk.popularity(*[F.col(c) for c in ("likes", "comments", "followers", "picked", "hot")]).alias("p"))
    return p.orderBy(F.desc("p"), "id").limit(60).select("id", F.round("p", 6).alias("popularity"))


@query(f"""WITH {IDEAS} SELECT * FROM (SELECT id, 'popular' AS mode FROM ip ORDER BY p DESC, ts DESC, id LIMIT 20) UNION ALL SELECT * FROM (SELECT id, 'recent' FROM ip ORDER BY ts DESC, id LIMIT 20)
UNION ALL SELECT * FROM (SELECT id, 'followers' FROM ip ORDER BY coalesce(followers, 0) DESC, likes DESC, ts DESC, id LIMIT 20)""")
def idea_orders(s, d):
    """The first twenty ideas in every order of the board."""
    rows = ideas(s, d)
    return _stack([desk.idea_order(rows, m).limit(20).select("id", F.lit(m).alias("mode")) for m in ("popular", "recent", "followers")])


@query(f"WITH {ART} SELECT * FROM (SELECT id, 'new' AS mode FROM art ORDER BY ts DESC, cred DESC, id LIMIT 10) UNION ALL SELECT * FROM (SELECT id, 'cred' FROM art ORDER BY cred DESC, ts DESC, id LIMIT 10) UNION ALL SELECT * FROM (SELECT id, 'source' FROM art ORDER BY source, ts DESC, id LIMIT 10)")
def feed_orders(s, d):
    """The first ten articles in every order of the feed."""
    a = articles(s, d)
    return _stack([desk.ordered(a, m).limit(10).select("id", F.lit(m).alias("mode")) for m in desk.ORDERS])


def _stack(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query("WITH a AS (SELECT n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey END AS rank FROM nation) SELECT name, row_number() OVER (ORDER BY rank NULLS LAST, name) AS place FROM a")
def assets_by_importance(s, d):
    """Assets by their rank in a dimension, own ones last."""
    n = table(s, d, "nation")
    dim = n.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("rank"))
    rows = desk.by_dimension(n.select(F.col("n_name").alias("name")), dim, "name")
    return rows.select("name", F.row_number().over(_order(F.asc_nulls_last("rank"), "name")).alias("place"))


@query("SELECT doc_id AS id, (2.0 * (n_chars < 100)::INT + (lang = 'de')::INT)::DOUBLE AS badness FROM documents ORDER BY badness DESC, id LIMIT 50")
def worst_rows(s, d):
    """The fifty worst rows by flags."""
    rows = docs(s, d).select(F.col("doc_id").alias("id"), (F.col("n_chars") < 100).alias("thin"), (F.col("lang") == "de").alias("german"))
    return desk.badness(rows, {"thin": 2.0, "german": 1.0}).limit(50).select("id", "badness")


# ---- functions


@query("SELECT item_id, substr(sha1(text), 1, 16) AS sha1, md5(text) AS md5, substr(sha256(text), 1, 16) AS sha256 FROM benchmark")
def text_hashes(s, d):
    """The short digests of texts."""
    return table(s, d, "benchmark").select("item_id", text.hashes(F.col("text")).alias("h")).select("item_id", "h.*")


@query(r"""WITH t AS (SELECT doc_id AS id, string_split(trim(regexp_replace(regexp_replace(split_part(text, chr(10), 1), 'https?://\S+|[@#][0-9A-Za-z_]+', ' ', 'g'), '\s+', ' ', 'g')), ' ') AS w FROM documents)
SELECT id, CASE WHEN len(w) > 15 THEN array_to_string(w[1:15], ' ') || '…' ELSE array_to_string(w, ' ') END AS title FROM t""")
def clean_titles(s, d):
    """Titles without addresses, cut after fifteen words."""
    return docs(s, d).select(F.col("doc_id").alias("id"), text.clean_title(F.col("text")).alias("title"))


KNOWN = ["the", "of the", "and", "und die", "und"]


@query(f"""WITH w AS (SELECT doc_id AS id, {WORDS.format('text')} AS w FROM documents), g AS (SELECT id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS two, w AS one FROM w)
SELECT id, len(list_filter(['of the', 'und die'], lambda p: list_contains(two, p))) + len(list_filter(['the', 'and', 'und'], lambda p: list_contains(one, p))) AS n FROM g""")
def known_phrases(s, d):
    """How many known phrases each article has."""
    # an explode of one array makes the words once; lambdas above it only refer to them
    w = docs(s, d).select(F.col("doc_id").alias("id"), F.explode(F.array(text.words(F.coalesce("text", F.lit(""))))).alias("w"))
    return w.select("id", F.size(text.phrases(F.col("w"), KNOWN)).alias("n"))


@query("""SELECT event_id AS id, CASE WHEN h < 1.0 / 60 THEN 'just now' WHEN h < 1 THEN greatest(1, floor(h * 60))::INT || ' min ago' WHEN h < 24 THEN round_even(h, 0)::INT || ' h ago' ELSE floor(h / 24)::INT || ' d ago' END AS ago FROM (SELECT event_id, event_id % 400 / 8.0 AS h FROM events)""")
def relative_ages(s, d):
    """Ages in words."""
    return table(s, d, "events").select(F.col("event_id").alias("id"), text.ago(F.col("event_id") % 400 / 8.0).alias("ago"))


@query("SELECT o_orderkey AS id, CASE WHEN v >= 1e9 THEN printf('%.1fB', v / 1e9) WHEN v >= 1e6 THEN printf('%.1fM', v / 1e6) WHEN v >= 1e3 THEN printf('%.1fK', v / 1e3) ELSE printf('%.0f', v) END AS shown FROM (SELECT o_orderkey, (o_orderkey % 7) * pow(37, o_orderkey % 6) AS v FROM orders)")
def short_counts(s, d):
    """Counts in thousands, millions and milliards."""
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), text.format_count((F.col("o_orderkey") % 7) * F.pow(F.lit(37.0), F.col("o_orderkey") % 6)).alias("shown"))


@query("SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'BTC|ETH' WHEN 1 THEN 'GOLD' ELSE '' END AS assets FROM customer")
def asset_lists(s, d):
    """Assets from JSON arrays or comma lists."""
    raw = F.when(F.col("c_custkey") % 3 == 0, '["btc", " eth "]').when(F.col("c_custkey") % 3 == 1, " gold, ").otherwise(F.lit(None).cast("string"))
    return table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.array_join(text.string_or_array(raw), "|").alias("assets"))


@query(f"WITH {SERIES} SELECT symbol, len(c) AS bars, len(c) - 19 AS known, round({_ema_sql('c', 20)}, 6) AS last FROM s WHERE len(c) >= 20")
def ema_aligned(s, d):
    """Exponential means padded to the bars' length."""
    a = timeseries.ema_aligned(F.col("closes"), 20)
    rows = timeseries.series(bars(s, d)).where(F.size("closes") >= 20).select("symbol", a.alias("a"))
    return rows.select("symbol", F.size("a").cast("long").alias("bars"), F.size(F.array_compact("a")).cast("long").alias("known"), F.round(F.element_at("a", -1), 6).alias("last"))


@query(f"WITH {BARS}, t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bucket DESC) <= 120), m AS (SELECT symbol, bucket, close, avg(close) OVER (PARTITION BY symbol ORDER BY bucket ROWS 19 PRECEDING) AS s, count(*) OVER (PARTITION BY symbol ORDER BY bucket ROWS 19 PRECEDING) AS n FROM c) SELECT t.symbol, t.bucket, t.close, CASE WHEN n = 20 THEN round(s, 6) END AS sma FROM t JOIN m USING (symbol, bucket)")
def chart_payload(s, d):
    """The last 120 bars of every symbol with their aligned mean."""
    return timeseries.tail(timeseries.sma(bars(s, d)), 120).select("symbol", "bucket", "close", F.round("sma_20", 6).alias("sma"))
