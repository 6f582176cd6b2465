"""Registered queries of the news office: sources, side tables, alerts, users, bodies, counters, releases, formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions import calendar, releases, text
from marketloom.operators import alerts, office, signals
from marketloom.plans.catalog import docs, query
from marketloom.plans.desk import ART, NOW, articles
from marketloom.sources.readers import table

SUPPLIERS = "s AS (SELECT 'S' || s_nationkey AS key, count(*) AS n, max(s_acctbal) > 5000 AS ok FROM supplier WHERE s_nationkey % 6 <> 0 GROUP BY s_nationkey)"


@query(f"""WITH {SUPPLIERS}, a AS (SELECT 'S' || n_nationkey AS key, n_name AS name, 0.5 + n_nationkey / 50.0 AS trust, FALSE AS custom FROM nation UNION ALL SELECT 's' || (r_regionkey * 7), r_name, 0.9, TRUE FROM region UNION ALL SELECT 'R' || r_regionkey, r_name, 0.7, TRUE FROM region),
f AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY lower(key) ORDER BY custom, key) = 1)
SELECT f.key, name, trust::DOUBLE AS trust, custom, coalesce(ok, FALSE) AS ok, coalesce(n, 0)::BIGINT AS count, ok IS NULL AS unseen FROM f LEFT JOIN s ON lower(f.key) = lower(s.key) WHERE lower(f.key) NOT IN (SELECT lower('S' || n_nationkey) FROM nation WHERE n_nationkey % 5 = 3)""")
def source_dimension(s, d):
    """Built-in and custom sources with their last status, without deleted ones."""
    n, r = table(s, d, "nation"), table(s, d, "region")
    key = F.concat(F.lit("S"), "n_nationkey")
    built_in = n.select(key.alias("key"), F.col("n_name").alias("name"), (0.5 + F.col("n_nationkey") / 50).alias("trust"))
    custom = r.select(F.concat(F.lit("s"), F.col("r_regionkey") * 7).alias("key"), F.col("r_name").alias("name"), F.lit(0.9).alias("trust")).unionByName(r.select(F.concat(F.lit("R"), "r_regionkey").alias("key"), F.col("r_name").alias("name"), F.lit(0.7).alias("trust")))
    status = table(s, d, "supplier").where("s_nationkey % 6 <> 0").groupBy(F.concat(F.lit("S"), "s_nationkey").alias("key")).agg((F.max("s_acctbal") > 5000).alias("ok"), F.count("*").alias("count"))
    return office.source_dimension(built_in, custom, n.where("n_nationkey % 5 = 3").select(key.alias("key")), status)


@query(f"""WITH p AS (SELECT p_partkey AS symbol FROM part), f AS (SELECT l_partkey AS symbol, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS v, {NOW} - (l_orderkey % 900) * 10 + l_linenumber AS t FROM lineitem),
g AS (SELECT symbol, arg_max({{'v': v}}, (t, v IS NOT NULL, v)).v AS v FROM f WHERE t > {NOW} - 300 AND t <= {NOW} GROUP BY symbol) SELECT p.symbol, g.v::DOUBLE AS funding, g.symbol IS NULL AS funding_due FROM p LEFT JOIN g USING (symbol)""")
def side_tables(s, d):
    """Funding of every symbol if it was fetched in the last five minutes."""
    side = table(s, d, "lineitem").select(F.col("l_partkey").alias("symbol"), F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("value"), (NOW - F.col("l_orderkey") % 900 * 10 + F.col("l_linenumber")).alias("at"))
    one = side.groupBy("symbol", "at").agg(F.max("value").alias("value"))  # of fetches of one moment the larger
    rows = table(s, d, "part").select(F.col("p_partkey").alias("symbol"))
    return office.with_side_tables(rows, {"funding": one}, "symbol", NOW).withColumn("funding", F.col("funding").cast("double"))


@query("SELECT o_orderkey AS id, o_custkey AS custkey, coalesce(n, 0)::BIGINT AS followers FROM orders LEFT JOIN (SELECT c_custkey, c_nationkey AS n FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey")
def enriched(s, d):
    """Orders with a number of their customer, 0 where it is unknown."""
    side = table(s, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("custkey"), F.col("c_nationkey").cast("bigint").alias("followers"))
    return office.enrich(table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("custkey")), side, "custkey", ["followers"])


@query(f"""WITH {ART}, c AS (SELECT id, title, 0 AS cache FROM art WHERE id % 2 = 0 UNION ALL SELECT id, 'archived ' || title, 1 FROM art WHERE id % 3 = 0 UNION ALL SELECT id, 'saved ' || title, 2 FROM art WHERE id % 5 = 0)
SELECT id, title, cache FROM c WHERE id IN (SELECT item_id FROM benchmark) OR id % 7 = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY cache) = 1""")
def point_lookup(s, d):
    """Wanted articles from the feed, else the archive, else the bookmarks."""
    a = articles(s, d).select("id", "title")
    named = lambda w, n: a.where(F.col("id") % n == 0).withColumn("title", F.concat(F.lit(w), "title"))
    ids = table(s, d, "benchmark").select(F.col("item_id").alias("id")).unionByName(a.where("id % 7 = 0").select("id"))
    return office.first_hit(ids, "id", [named("", 2), named("archived ", 3), named("saved ", 5)])


@query("""WITH m AS (SELECT o_orderkey AS key, o_totalprice AS value, o_custkey AS "at" FROM orders), n AS (SELECT count(*) AS n FROM m)
SELECT key, value::DOUBLE AS value, "at" FROM m QUALIFY row_number() OVER (ORDER BY "at" DESC, key DESC) <= (SELECT n - CASE WHEN n > 1000 THEN ceil((n - 1000) / 250.0) * 250 ELSE 0 END FROM n)""")
def memory_bound(s, d):
    """A memory table of a thousand rows at most; the oldest go by 250."""
    m = table(s, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").cast("double").alias("value"), F.col("o_custkey").alias("at"))
    return office.evicted(m, 1000, 250)


@query("""WITH e AS (SELECT event_id AS id, epoch_us(ts) AS us, CASE WHEN event_id % 9 = 0 THEN 'Unknown' ELSE upper(event_type) END AS ticker, CASE event_id % 2 WHEN 0 THEN 'buy' ELSE 'sell' END AS action FROM events WHERE event_id % 4 <> 1)
SELECT id, ticker, action, FALSE AS leaks FROM e WHERE upper(ticker) = 'VIEW' ORDER BY us DESC, id DESC LIMIT 20""")
def ticker_alerts(s, d):
    """The last twenty accepted alerts of one ticker; the secret is in none."""
    i = F.col("event_id")
    payload = F.to_json(F.struct(F.when(i % 4 != 1, "key").otherwise("wrong").alias("secret"), F.when(i % 9 != 0, F.upper("event_type")).alias("ticker"), F.when(i % 2 == 0, "buy").otherwise("sell").alias("action"), F.col("value").cast("string").alias("price")))
    rows = table(s, d, "events").select(i.alias("id"), "ts", payload.alias("payload"))
    last = office.last_alerts(office.accepted_alerts(rows, "key"), 20, "view")
    return last.select("id", "ticker", "action", F.contains("raw", F.lit("secret")).alias("leaks"))


USERS = """u AS (SELECT 'user' || c_custkey AS email, 'k' || c_custkey AS key_hash, 'free' AS tier, -1 AS seq FROM customer WHERE c_custkey % 2 = 0),
n AS (SELECT 'user' || o_custkey AS email, 'k' || (o_custkey + CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END) AS key_hash, CASE WHEN o_orderkey % 5 = 0 THEN 'pro' ELSE 'free' END AS tier, o_orderkey AS seq FROM orders),
l AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY email ORDER BY seq DESC) = 1), c AS (SELECT email, key_hash, seq FROM u UNION ALL SELECT email, key_hash, seq FROM l), o AS (SELECT key_hash, arg_min(email, (seq, email)) AS owner FROM c GROUP BY key_hash),
j AS (SELECT l.*, owner = email AS ok FROM l JOIN o USING (key_hash)), after AS (SELECT email, key_hash, tier FROM u WHERE email NOT IN (SELECT email FROM j WHERE ok) UNION ALL SELECT email, key_hash, tier FROM j WHERE ok)"""


def _users(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    name = lambda c: F.concat(F.lit("user"), c)
    stored = table(s, d, "customer").where("c_custkey % 2 = 0").select(name(F.col("c_custkey")).alias("email"), F.concat(F.lit("k"), "c_custkey").alias("key_hash"), F.lit("free").alias("tier"))
    o = table(s, d, "orders")
    new = o.select(name(F.col("o_custkey")).alias("email"), F.concat(F.lit("k"), F.col("o_custkey") + F.when(F.col("o_orderkey") % 3 == 0, 2).otherwise(0)).alias("key_hash"), F.when(F.col("o_orderkey") % 5 == 0, "pro").otherwise("free").alias("tier"), F.col("o_orderkey").alias("seq"))
    return office.register(stored, new)


@query(f"WITH {USERS} SELECT email, key_hash, tier, TRUE AS ok FROM after UNION ALL SELECT email, key_hash, tier, FALSE FROM j WHERE NOT ok")
def registered_users(s, d):
    """Users after registrations, and the registrations that were refused."""
    users, refused = _users(s, d)
    return users.withColumn("ok", F.lit(True)).unionByName(refused.withColumn("ok", F.lit(False)))


@query(f"WITH {USERS} SELECT email, event_type AS feature, count(*) AS n FROM events JOIN after ON key_hash = 'k' || user_id GROUP BY ALL")
def usage_by_user(s, d):
    """Calls of known users by feature."""
    calls = table(s, d, "events").select(F.concat(F.lit("k"), "user_id").alias("key_hash"), F.col("event_type").alias("feature"), "ts")
    return office.usage_log(calls, _users(s, d)[0]).groupBy("email", "feature").agg(F.count("*").alias("n"))


@query(r"""WITH a AS (SELECT doc_id AS id, 0 AS rung, split_part(text, chr(10), 1) AS t FROM documents UNION ALL SELECT doc_id, 1, text FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 2, text || ' ' || text FROM documents),
w AS (SELECT *, len(list_filter(regexp_split_to_array(coalesce(t, ''), '\s+'), lambda x: x <> '')) AS words FROM a),
b AS (SELECT * FROM w WHERE words > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY words < 250, CASE WHEN words >= 250 THEN rung ELSE -words END, rung) = 1) SELECT id, rung, words::BIGINT AS words, md5(t) AS text_md5 FROM b""")
def best_bodies(s, d):
    """The body of every article: the first way that gives 250 words, else the longest."""
    a = docs(s, d).select(F.col("doc_id").alias("id"), "text")
    way = lambda rows, n, c: rows.select("id", F.lit(n).alias("rung"), c.alias("text"))
    attempts = way(a, 0, text.title_of(F.col("text"))).unionByName(way(a.where("id % 3 <> 0"), 1, F.col("text"))).unionByName(way(a, 2, F.concat("text", F.lit(" "), "text")))
    return office.best_body(attempts, "id").select("id", "rung", "words", F.md5("text").alias("text_md5"))


@query(f"WITH {ART} SELECT id, ts FROM art WHERE list_contains(assets, 'BTC') AND topic = 'general' AND ts >= {NOW - 900_000} AND ts <= {NOW - 1000} AND contains(lower(title || ' ' || summary), 'the') ORDER BY ts DESC, id LIMIT 100")
def stored_scan(s, d):
    """A hundred stored articles by asset, topic, time and word."""
    return office.stored_articles(articles(s, d), "BTC", "general", NOW - 900_000, NOW - 1000, "The", 100).select("id", "ts")


@query(f"""WITH {ART}, l AS (SELECT event_type AS source, event_id % 7 <> 0 AS ok FROM events) SELECT * FROM (VALUES ('articles', (SELECT count(*) FROM art)::DOUBLE), ('sources', (SELECT count(DISTINCT source) FROM art)), ('with_assets', (SELECT round(avg((len(assets) > 0)::INT), 6) FROM art)), ('newest', (SELECT max(ts) FROM art)),
('fetches_ok', (SELECT count(*) FROM l WHERE ok)), ('fetches_bad', (SELECT count(*) FROM l WHERE NOT ok)), ('sources_failing', (SELECT count(DISTINCT source) FROM l WHERE NOT ok))) v(name, value)""")
def office_counters(s, d):
    """The office's counters."""
    log = table(s, d, "events").select(F.col("event_type").alias("source"), (F.col("event_id") % 7 != 0).alias("ok"))
    return office.counters(articles(s, d), log)


LINES = ("Toman falls again", "free giveaway and airdrop claim", "Taylor Swift in Hollywood", "quiet markets", "tomanic rise")
HOSTS = ("https://a.example/x", "https://news.ir/x", "https://b.example/x.irx")


def _case(values, key):
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


_WORD = lambda w: f"regexp_matches(t, '(^|[^a-z0-9]){w}($|[^a-z0-9])')"


@query(f"""WITH x AS (SELECT doc_id AS id, lower({_case(LINES, 'doc_id')} || ' ' || coalesce(text, '')) AS t, {_case(HOSTS, 'doc_id')} AS link FROM documents),
h AS (SELECT id, CASE WHEN contains(link, '.ir/') THEN ['source'] ELSE [] END || {" || ".join(f"CASE WHEN {_WORD(w)} THEN ['{w}'] ELSE [] END" for w in ("toman", "iranian rial", "tehran market", "tsetmc"))} AS domestic,
  {" || ".join(f"CASE WHEN {_WORD(w)} THEN ['{w}'] ELSE [] END" for w in ("airdrop claim", "free giveaway", "seed phrase", "wallet drainer", "phishing scam"))} AS scam, {" || ".join(f"CASE WHEN {_WORD(w)} THEN ['{w}'] ELSE [] END" for w in ("hollywood", "kardashian", "taylor swift"))} AS gossip FROM x)
SELECT id, array_to_string(domestic, ',') AS domestic, array_to_string(scam, ',') AS scam, array_to_string(gossip, ',') AS gossip FROM h""")
def off_profile(s, d):
    """Why an article is not for the channel."""
    i = F.col("doc_id")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))
    folded = F.lower(F.concat(pick(LINES), F.lit(" "), F.coalesce("text", F.lit(""))))
    found = office.off_profile(folded, F.col("source"), pick(HOSTS), F.lit(""))
    rows = docs(s, d).select(i.alias("id"), found.alias("m"))
    return rows.select("id", *[F.coalesce(F.array_join(F.col("m")[c], ","), F.lit("")).alias(c) for c in office.OFF_PROFILE])


@query("""WITH w AS (SELECT date_trunc('week', max(ts)) - INTERVAL 7 DAY AS a FROM events), e AS (SELECT event_id AS id, ts, event_type AS title, CASE event_id % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE '' END AS currency FROM events, w WHERE ts >= a AND ts < a + INTERVAL 7 DAY)
SELECT title, currency, min(id) AS id FROM (SELECT *, date_trunc('second', ts) AS sec FROM e QUALIFY row_number() OVER (PARTITION BY date_trunc('second', ts), title, currency ORDER BY ts, id) = 1) GROUP BY sec, title, currency""")
def week_events(s, d):
    """The events of the week before the last one, each once."""
    i = F.col("event_id")
    e = table(s, d, "events").select(i.alias("id"), "ts", F.col("event_type").alias("title"), F.when(i % 3 == 0, "USD").when(i % 3 == 1, " EUR ").alias("currency"))
    last = e.agg(F.max("ts")).first()[0]
    return office.calendar_week(e, F.lit(last), -1).select("title", "currency", "id")


@query("""WITH c AS (SELECT lang, list_sort(list(n_chars)) AS v FROM documents WHERE n_chars IS NOT NULL GROUP BY lang), b AS (SELECT lang, list(doc_id ORDER BY n_chars DESC NULLS LAST, doc_id DESC, doc_id)[1:3] AS best, count(*) AS posts FROM documents GROUP BY lang)
SELECT lang, posts, v[len(v) // 2 + 1]::BIGINT AS median, array_to_string(best, ',') AS best FROM b LEFT JOIN c USING (lang)""")
def demand_bundles(s, d):
    """Posts, upper median of views and the three most seen posts of every channel."""
    rows = docs(s, d).select(F.col("doc_id").alias("id"), "lang", F.col("n_chars").cast("bigint").alias("views"), F.col("doc_id").alias("ts"))
    return office.bundles(rows, "lang", "views", "ts").withColumn("best", F.array_join(F.transform("best", lambda x: x.cast("string")), ","))


RELEASES = ("Core CPI MoM", "Fed Chair Speaks", "10-Year Bond Auction", "Crude Oil Inventories", "Interest Rate Decision", "FOMC Minutes", "Manufacturing PMI", "Nonfarm Payrolls", "Building Permits", "GDP QoQ", "Trade Balance", "Bank Holiday", "PCE YoY", "Jackson Hole Summit", "Personal Spending", "Initial Claims", "Something Else", "Daily Fixing")


def _first_sql(rules, otherwise):
    return "CASE " + " ".join(f"WHEN regexp_matches(k, '{p}') THEN '{n}'" for n, p in rules) + f" ELSE '{otherwise}' END"


@query(rf"""WITH e AS (SELECT event_id AS id, lower({_case(RELEASES, 'event_id')}) AS x, event_id % 4 AS i FROM events), k AS (SELECT id, i, regexp_replace(regexp_replace(regexp_replace(x, '\bmom\b', 'm/m'), '\byoy\b', 'y/y'), '\bqoq\b', 'q/q') AS k FROM e),
c AS (SELECT id, i, {_first_sql(releases.CATEGORIES, 'other')} AS category, {_first_sql(releases.CADENCES, 'monthly')} AS cadence FROM k)
SELECT id, category, cadence, CASE WHEN category = 'holiday' THEN 'not published' ELSE 'published ' || CASE cadence {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in releases.CADENCE_WORDS.items())} END || ' for US' END AS published,
  CASE i WHEN 0 THEN 'moves markets at once when it surprises' WHEN 1 THEN 'moves markets when it is far from the forecast' WHEN 3 THEN 'thins trading' ELSE 'gives context' END AS weight FROM c""")
def event_documents(s, d):
    """Category, cadence and weight of every calendar event."""
    i = F.col("event_id")
    title = F.element_at(F.array(*map(F.lit, RELEASES)), (i % len(RELEASES) + 1).cast("int"))
    impact = F.element_at(F.array(*map(F.lit, ("High", "Medium", "Low", "Holiday"))), (i % 4 + 1).cast("int"))
    rows = table(s, d, "events").select(i.alias("id"), title.alias("title"), impact.alias("impact"))
    return rows.select("id", releases.document(F.col("title"), F.lit("US"), F.col("impact")).alias("x")).select("id", "x.category", "x.cadence", "x.published", "x.weight")


SENTENCES = r"list_filter(list_transform(regexp_split_to_array(regexp_replace({0}, '([.!?؟])\s+', chr(1) || '\1' || chr(2), 'g'), '\x02|\n+'), lambda x: trim(replace(x, chr(1), ''))), lambda x: length(x) > 12)"


@query(rf"""WITH {ART}, a AS (SELECT *, CASE id % 4 WHEN 0 THEN 'Prices crash by 12% today. ' WHEN 1 THEN 'They rose 3, then 5.5 and 7 points of 100. ' ELSE '' END || summary AS body FROM art), s AS (SELECT id, title, body, views, {SENTENCES.format('body')} AS s FROM a),
n AS (SELECT *, list_distinct(regexp_extract_all(array_to_string(s, ' '), '\d+(?:[.,]\d+)?\s*%?')) AS nums0 FROM s), m AS (SELECT *, least(20, len(nums0)) AS n, len(s) AS k, lower(title || ' ' || body) AS low FROM n),
f AS (SELECT id, round(least(1, 0.55 - 0.05 * least(3, k) + CASE WHEN n <= 1 THEN 0.1 ELSE 0 END), 2) AS text, round(least(1, 0.3 + 0.12 * least(4, n) + 0.1 * least(3, k) + CASE WHEN n >= 3 THEN 0.15 ELSE 0 END + CASE WHEN views > 0 THEN 0.08 ELSE 0 END), 2) AS carousel,
  round(least(1, 0.25 + 0.22 * least(2, {" + ".join(f"contains(low, '{w}')::INT" for w in releases.DRAMATIC)}) + CASE WHEN len(list_filter(nums0[1:20], lambda x: contains(x, '%'))) > 0 THEN 0.15 ELSE 0 END), 2) AS video FROM m)
SELECT id, text::DOUBLE AS text, carousel::DOUBLE AS carousel, video::DOUBLE AS video, CASE WHEN text >= carousel AND text >= video THEN 'text' WHEN carousel >= video THEN 'carousel' ELSE 'video' END AS best FROM f""")
def format_choice(s, d):
    """How well text, slides and video fit every story."""
    lead = F.when(F.col("id") % 4 == 0, "Prices crash by 12% today. ").when(F.col("id") % 4 == 1, "They rose 3, then 5.5 and 7 points of 100. ").otherwise("")
    a = articles(s, d).withColumn("body", F.concat(lead, "summary"))
    return a.select("id", releases.formats(F.col("title"), F.col("body"), None, F.col("views")).alias("f")).select("id", "f.*")


@query("""SELECT event_id AS id, coalesce(json_extract_string(props, '$.k'), 'none') AS k, 'none' AS deep FROM events""")
def nested_paths(s, d):
    """Values of nested paths, with what stands for missing ones."""
    e = table(s, d, "events")
    return e.select(F.col("event_id").alias("id"), text.json_path(F.col("props"), "$.k", "none").alias("k"), text.json_path(F.col("props"), "$.a.b[0].c", "none").alias("deep"))


# ---- demand signals

_WORDS = r"list_distinct(list_filter(string_split(lower(regexp_replace(coalesce({0}, ''), '[^\p{{L}}\p{{N}}_&%]+', ' ', 'g')), ' '), lambda w: length(w) > 2 AND NOT list_contains({1}, w)))"
_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "]"


@query(rf"""WITH {ART}, st AS (SELECT id, cred, list_distinct(list_concat(list_filter({_WORDS.format("title || ' ' || summary", _STOP)}, lambda w: NOT regexp_matches(w, '^[0-9]+$')), flatten(list_transform(assets, lambda a: CASE a WHEN 'BTC' THEN ['bitcoin', 'btc'] WHEN 'ETH' THEN ['ethereum', 'ether', 'eth'] ELSE ['gold', 'xau'] END)))) AS own FROM art),
sg AS (SELECT 'post' AS kind, item_id AS key, {_WORDS.format("text", _STOP)} AS w, []::VARCHAR[] AS q FROM benchmark UNION ALL SELECT 'video', p_partkey, {_WORDS.format("p_name || ' gold moves'", _STOP)}, {_WORDS.format("CASE p_partkey % 4 WHEN 0 THEN 'bitcoin' WHEN 1 THEN 'gold price' ELSE 'nothing' END", _STOP)} FROM part WHERE p_size < 5),
m AS (SELECT id, kind, key, cred, len(list_filter(w, lambda x: list_contains(own, x))) AS h, CASE kind WHEN 'video' THEN len(list_filter(q, lambda x: list_contains(own, x))) ELSE 0 END AS a FROM st, sg)
SELECT kind, key, arg_min(id, (-(h + a), -cred, id)) AS id, max(h + a) AS hits FROM m WHERE h >= 2 OR (h >= 1 AND a >= 1) GROUP BY kind, key""")
def signal_claims(s, d):
    """The story that owns each post and video: most shared words, then credibility."""
    a = articles(s, d)
    stories = a.select("id", "cred", signals.story_words(F.concat_ws(" ", "title", "summary"), F.col("assets")).alias("words"))
    posts = table(s, d, "benchmark").select(F.lit("post").alias("kind"), F.col("item_id").alias("key"), signals.signal_words(F.col("text")).alias("words"), F.array().cast("array<string>").alias("query"))
    asked = F.when(F.col("p_partkey") % 4 == 0, "bitcoin").when(F.col("p_partkey") % 4 == 1, "gold price").otherwise("nothing")
    videos = table(s, d, "part").where("p_size < 5").select(F.lit("video").alias("kind"), F.col("p_partkey").alias("key"), signals.signal_words(F.concat("p_name", F.lit(" gold moves"))).alias("words"), signals.signal_words(asked).alias("query"))
    return signals.owners(stories, posts.unionByName(videos))


# ---- alerts over prices, events and news

AT = NOW - 1000
CONDITIONS = [
    ("r1", "AND", "price", "view", "gt", "0", None, None, None, None),
    ("r1", "AND", "news", None, None, None, None, ["bitcoin"], 0.6, None),
    ("r2", "OR", "event", None, None, None, "High", None, None, None),
    ("r2", "OR", "price", "nothing", "gt", "0", None, None, None, None),
    ("r3", "AND", "price", "nothing", "gt", "0", None, None, None, None),
    ("r4", "AND", "news", None, None, None, None, ["no such words here"], None, 60),
    ("r5", "AND", "news", None, None, None, None, None, 0.9, 600),
    ("r6", "AND", "price", "click", "eq", "-1", None, None, None, None),
    ("r7", "AND", "event", None, None, None, None, None, None, None),
    ("r8", "OR", "price", "view", "contains", ".", None, None, None, None),
]


@query(f"""WITH {ART}, p AS (SELECT event_type AS symbol, arg_max(value, (ts, event_id)) AS price FROM events GROUP BY event_type), h AS (SELECT max(ts) AS ts FROM events WHERE event_id % 4 = 0 AND event_id % 5 < 3), a AS (SELECT max(ts) AS ts FROM events WHERE event_id % 5 < 3),
n1 AS (SELECT arg_max(id, (ts, id)) AS id FROM art WHERE cred >= 0.6 AND contains(lower(title || ' ' || summary), 'bitcoin')), n5 AS (SELECT arg_max(id, (ts, id)) AS id FROM art WHERE cred >= 0.9 AND {AT} - ts <= 36000)
SELECT 'r1' AS id, 'a:' || n1.id || '~p:view|' || printf('%.4f', price) AS sig FROM p, n1 WHERE symbol = 'view' AND price > 0 AND n1.id IS NOT NULL
UNION ALL SELECT 'r2', 'e:' || strftime(h.ts, '%Y-%m-%d') FROM h WHERE h.ts IS NOT NULL UNION ALL SELECT 'r5', 'a:' || n5.id FROM n5 WHERE n5.id IS NOT NULL UNION ALL SELECT 'r8', 'p:view|' || printf('%.4f', price) FROM p WHERE symbol = 'view' AND contains(price::VARCHAR, '.')""")
def alert_conditions(s, d):
    """Rules over prices, events and news that fire now; r7 is quiet, as it fired a minute ago."""
    order = F.struct("ts", "event_id")
    e = table(s, d, "events")
    prices = e.groupBy(F.col("event_type").alias("symbol")).agg(F.max_by("value", order).alias("price"), F.lit(0.0).alias("change"))
    impact = F.element_at(F.array(*map(F.lit, ("High", "Medium", "Low", "Holiday"))), (F.col("event_id") % 4 + 1).cast("int"))
    events = e.select("ts", F.col("event_type").alias("title"), impact.alias("impact"), (F.col("event_id") % 5 < 3).alias("released"))
    rules = s.createDataFrame(CONDITIONS, alerts.CONDITIONS)
    log = s.createDataFrame([("r7", AT - 60, "e:", 30), ("r1", AT - 60, "p:", 0), ("r8", AT - 4000, "p:", 30)], "id string, at long, sig string, cooldown int")
    news = articles(s, d).select("id", "title", "summary", "cred", "ts")
    found = alerts.fired(alerts.conditions(rules, prices, events, news, AT), log, AT)
    return found.select("id", F.when(F.col("sig").startswith("e:"), F.substring("sig", 1, 12)).otherwise(F.col("sig")).alias("sig"))


# ---- times in words


@query("""WITH s AS (SELECT event_id AS id, (event_id * 7919) % 400000 AS s, event_id % 3000 / 8.0 - 2 AS h FROM events), p AS (SELECT *, s // 86400 AS d, s % 86400 // 3600 AS hh, s % 3600 // 60 AS m FROM s)
SELECT id, CASE WHEN d > 0 THEN printf('%dd %02dh', d, hh) WHEN hh > 0 THEN printf('%dh %02dm', hh, m) ELSE printf('%dm %02ds', m, s % 60) END AS left_,
  CASE WHEN h < 0 THEN '' WHEN h < 1 THEN translate(greatest(1, floor(h * 60))::INT::VARCHAR, '0123456789', '۰۱۲۳۴۵۶۷۸۹') || ' دقیقه پیش' WHEN h < 24 THEN translate(round_even(h, 0)::INT::VARCHAR, '0123456789', '۰۱۲۳۴۵۶۷۸۹') || ' ساعت پیش' ELSE translate(floor(h / 24)::INT::VARCHAR, '0123456789', '۰۱۲۳۴۵۶۷۸۹') || ' روز پیش' END AS ago FROM p""")
def countdowns(s, d):
    """Time left and time gone in words."""
    i = F.col("event_id")
    return table(s, d, "events").select(i.alias("id"), calendar.countdown(i * 7919 % 400000, True).alias("left_"), calendar.fa_ago(i % 3000 / 8.0 - 2).alias("ago"))
