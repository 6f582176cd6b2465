"""Registered queries of the news and market engine over the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.functions import calendar, scoring, text
from marketloom.operators import alerts, correlation, feed, quality, ranking, search, similarity, tables, timeseries
from marketloom.sources import html
from marketloom.sources.readers import table
from marketloom.streaming import flows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def bars(s: SparkSession, d: str, hours: int = 4) -> DataFrame:
    return timeseries.candles(table(s, d, "events"), "event_type", "ts", "value", "event_id", hours)


BARS = """
c AS (SELECT event_type AS symbol, floor(epoch(ts) / 14400)::BIGINT AS bucket, min(ts) AS time, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
      min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events WHERE value IS NOT NULL GROUP BY ALL)"""
WORDS = r"list_filter(string_split(regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"
TITLE = "split_part(text, chr(10), 1)"
STOP = "[" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "]"
TOKENS = f"list_distinct(list_filter({WORDS}, lambda w: len(w) >= 3 AND NOT list_contains({STOP}, w) AND NOT regexp_matches(w, '^[0-9]+$')))"


def _list(ws) -> str:
    return "[" + ", ".join(f"'{w}'" for w in ws) + "]"


POLARITY = f"""(SELECT CASE WHEN bull + bear > 0 THEN (bull - bear)::DOUBLE / (bull + bear) ELSE 0 END FROM (SELECT
  len(list_intersect(list_distinct(regexp_split_to_array(lower(coalesce(text, '')), '\\s+')), {_list(scoring.BULLISH)})) + {" + ".join(f"contains(lower(coalesce(text, '')), '{p}')::INT" for p in scoring.BULLISH if " " in p)} AS bull,
  len(list_intersect(list_distinct(regexp_split_to_array(lower(coalesce(text, '')), '\\s+')), {_list(scoring.BEARISH)})) AS bear))"""


# ---- articles


@query(f"""WITH p AS (SELECT source, {POLARITY} AS score FROM documents)
SELECT source, count(*) AS total, round(avg(score), 6) AS avg_score, count(*) FILTER (score > 0.15) AS positive, count(*) FILTER (score < -0.15) AS negative,
       CASE WHEN avg(score) > 0.1 THEN 'bullish' WHEN avg(score) < -0.1 THEN 'bearish' ELSE 'mixed' END AS trend FROM p GROUP BY source""")
def mood_by_source(s, d):
    """Lexicon mood of the articles by source."""
    p = docs(s, d).select("source", scoring.polarity(F.col("text")).alias("score"))
    mean = F.avg("score")
    return p.groupBy("source").agg(F.count("*").alias("total"), F.round(mean, 6).alias("avg_score"), F.count_if(F.col("score") > 0.15).alias("positive"), F.count_if(F.col("score") < -0.15).alias("negative"), F.when(mean > 0.1, "bullish").when(mean < -0.1, "bearish").otherwise("mixed").alias("trend"))


@query("SELECT doc_id, CASE WHEN source = 'src0' THEN 'social' WHEN length(trim(text)) < 80 THEN 'too_short' ELSE 'kept' END AS reason FROM documents")
def hygiene_filter(s, d):
    """Reason for which each article is dropped."""
    kind = F.when(F.col("source") == "src0", "social").otherwise("news")
    return docs(s, d).select("doc_id", F.coalesce(feed.hygiene_reason(kind, F.col("text"), F.lit(None).cast("string")), F.lit("kept")).alias("reason"))


@query("SELECT reason, count(*) AS n FROM (" + "SELECT CASE WHEN source = 'src0' THEN 'social' WHEN length(trim(text)) < 80 THEN 'too_short' ELSE 'kept' END AS reason FROM documents" + ") GROUP BY reason")
def hygiene_reasons(s, d):
    """Counts of the reasons."""
    return hygiene_filter(s, d).groupBy("reason").agg(F.count("*").alias("n"))


def _quoted(p: str) -> str:
    return p.replace("'", "''")


def _topic_sql() -> str:
    cases = " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{t}'" for t, p in scoring.TOPICS.items())
    return f"SELECT doc_id, CASE {cases} ELSE 'general' END AS topic FROM documents"


@query(_topic_sql())
def topic_first_match(s, d):
    """First topic of each article."""
    return docs(s, d).select("doc_id", scoring.topic(F.col("text")).alias("topic"))


#: Names that stand before texts, so that some name assets.
NAMED = ("bitcoin and ether", "crypto", "gold bullion", "the s&p 500", "a quiet day", "brent crude")
NAMED_SQL = "(" + "CASE doc_id % 6 " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(NAMED)) + " END || ' ' || coalesce(text, ''))"
ASSET_SQL = " UNION ALL ".join(f"SELECT '{a}' AS symbol FROM t WHERE regexp_matches(x, '(?i){p}')" for a, p in scoring.ASSETS.items())


@query(f"WITH t AS (SELECT {NAMED_SQL} AS x FROM documents), m AS ({ASSET_SQL} UNION ALL SELECT 'BTC' FROM t WHERE regexp_matches(x, '(?i)\\bcrypto\\b') AND NOT (" + " OR ".join(f"regexp_matches(x, '(?i){p}')" for p in scoring.ASSETS.values()) + ")) SELECT symbol, count(*) AS n FROM m GROUP BY symbol")
def asset_mentions(s, d):
    """How many articles name each asset."""
    name = F.element_at(F.array(*map(F.lit, NAMED)), (F.col("doc_id") % 6 + 1).cast("int"))
    named = docs(s, d).select(F.concat(name, F.lit(" "), F.coalesce("text", F.lit(""))).alias("x"))
    return named.select(F.explode(scoring.assets(F.col("x"))).alias("symbol")).groupBy("symbol").agg(F.count("*").alias("n"))


@query(rf"""WITH a AS (SELECT doc_id, trim({TITLE}) AS title, trim(CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END) AS summary,
  coalesce(quality, 0) * 0.36 + 0.6 AS trust, (doc_id % 96)::DOUBLE AS age, CASE WHEN doc_id % 7 = 0 THEN 'https://x.y/press release' ELSE 'https://x.y/a' END AS link FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)),
r AS (SELECT *, CASE WHEN length(title) < 20 THEN 'title_too_short' WHEN regexp_matches(title || ' ' || summary, '(?i){_quoted(scoring.SPONSORED)}') THEN 'sponsored'
  WHEN regexp_matches(title, '(?i){_quoted(scoring.SPAM)}') THEN 'spam_topic' WHEN regexp_matches(title, '(?i){_quoted(scoring.SEO)}') THEN 'seo_page' WHEN age > 72 THEN 'stale' END AS reason FROM a)
SELECT doc_id, reason, CASE WHEN reason IS NOT NULL THEN 0 ELSE round(greatest(0.05, least(1.0, (trust - CASE WHEN regexp_matches(title, '(?i){_quoted(scoring.CLICKBAIT)}') THEN 0.15 ELSE 0 END
  - CASE WHEN length(summary) < 40 THEN 0.2 ELSE 0 END - CASE WHEN regexp_matches(title || ' ' || summary, '(?i){_quoted(scoring.RISKY)}') THEN 0.1 ELSE 0 END - CASE WHEN regexp_matches(link, '(?i){_quoted(scoring.SPONSORED)}') THEN 0.35 ELSE 0 END)
  * CASE WHEN age <= 6 THEN 1.0 WHEN age <= 24 THEN 0.96 WHEN age <= 48 THEN 0.9 ELSE 0.84 END)), 3) END::DOUBLE AS score FROM r""")
def credibility_score(s, d):
    """Rejection reason or credibility of each article; the labels stand in for trust, ids for ages and links."""
    link = F.when(F.col("doc_id") % 7 == 0, "https://x.y/press release").otherwise("https://x.y/a")
    # what the texts give is one small column before the join, so no text is shuffled and no pattern runs twice
    found = scoring.doubts(text.title_of(F.col("text")), text.summary_of(F.col("text")), (F.col("doc_id") % 96).cast("double"), link=link)
    trust = table(s, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = docs(s, d).select("doc_id", F.explode(F.array(found)).alias("found")).join(trust, "doc_id", "left")
    c = scoring.trusted(F.col("found"), F.when(F.col("quality") == 1, 0.96).otherwise(0.6))
    return rows.select("doc_id", c.alias("c")).select("doc_id", "c.reason", "c.score")


@query("SELECT page_id, substr(md5(lower(trim(url)) || '|' || url), 1, 12) AS id FROM pages")
def make_id(s, d):
    """Article ids of pages."""
    return table(s, d, "pages").select("page_id", text.make_id(F.col("url"), F.col("url")).alias("id"))


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def hidden_anti_join(s, d):
    """Articles that are not hidden."""
    return docs(s, d).select("doc_id").join(table(s, d, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_anti")


@query(f"""WITH k AS (SELECT doc_id, array_to_string(list_slice({WORDS.format(TITLE)}, 1, 6), ' ') AS fingerprint, n_chars FROM documents)
SELECT fingerprint, min(doc_id) AS doc_id, count(*) AS copies FROM k GROUP BY fingerprint""")
def title_fingerprint_dedup(s, d):
    """First article of every title key."""
    key = text.title_key(text.title_of(F.col("text")))
    return docs(s, d).groupBy(key.alias("fingerprint")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("""SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source""")
def facet_counts(s, d):
    """Counts by language and by source in one pass."""
    return feed.facets(docs(s, d), ["lang", "source"])


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND NOT contains(lower(text), 'thorn') AND lower(source) = 'src1'")
def query_language_filter(s, d):
    """A feed query with a word, an excluded word and a source."""
    q = feed.Query.parse("the -thorn src:src1")
    return docs(s, d).where(q.column(F.col("text"), F.col("source"))).select("doc_id")


@query(f"""WITH x AS (SELECT doc_id AS id, unnest({TOKENS.format('text')}) AS t FROM documents), b AS (SELECT item_id AS id, unnest({TOKENS.format('text')}) AS t FROM benchmark)
SELECT x.id AS doc_id, b.id AS item_id, count(*) AS hits FROM x JOIN b USING (t) GROUP BY ALL HAVING count(*) >= 8""")
def token_overlap_match(s, d):
    """Articles and reference items that share at least eight words."""
    m = similarity.overlap(docs(s, d), "doc_id", table(s, d, "benchmark"), "item_id", "text", 8)
    return m.select(F.col("left_id").alias("doc_id"), F.col("right_id").alias("item_id"), "hits")


@query(f"""WITH x AS (SELECT doc_id AS id, unnest({TOKENS.format('text')}) AS t FROM documents), b AS (SELECT item_id AS id, unnest({TOKENS.format('text')}) AS t FROM benchmark),
m AS (SELECT x.id AS doc_id, b.id AS item_id, count(*) AS hits FROM x JOIN b USING (t) GROUP BY ALL HAVING count(*) >= 8)
SELECT item_id, doc_id, hits FROM m QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) = 1""")
def argmax_claim(s, d):
    """The article that owns each reference item."""
    best = ranking.claim(token_overlap_match(s, d), "item_id", [(-F.col("hits")).alias("minus"), F.col("doc_id")])
    return best.select("item_id", F.col("best.doc_id").alias("doc_id"), (-F.col("best.minus")).alias("hits"))


@query(f"""WITH t AS (SELECT doc_id AS k, source, unnest({TOKENS.format(TITLE)}) AS w FROM documents), n AS (SELECT k, count(*) AS n FROM t GROUP BY k),
p AS (SELECT a.k AS x, b.k AS y, any_value(b.source) AS other, count(*) AS shared FROM t a JOIN t b ON a.w = b.w AND a.k <> b.k GROUP BY a.k, b.k HAVING count(*) >= 3)
SELECT d.doc_id, count(DISTINCT CASE WHEN shared::DOUBLE / least(nx.n, ny.n) >= 0.34 THEN other END) AS sources FROM documents d
LEFT JOIN p ON p.x = d.doc_id LEFT JOIN n nx ON nx.k = p.x LEFT JOIN n ny ON ny.k = p.y GROUP BY d.doc_id""")
def coverage_counts(s, d):
    """In how many other sources each headline's words are shared."""
    return similarity.coverage(docs(s, d).withColumn("title", text.title_of(F.col("text"))), "doc_id", "title", "source")


@query(f"""WITH i AS (SELECT item_id AS k, text FROM benchmark UNION ALL SELECT 1000000 + item_id, replace(text, ' the ', ' ') FROM benchmark), t AS (SELECT k, w, count(*) AS tf FROM (SELECT k, unnest({WORDS.format('text')}) AS w FROM i) GROUP BY ALL), n AS (SELECT k, sqrt(sum(tf * tf)) AS norm FROM t GROUP BY k)
SELECT a.k AS a, b.k AS b, round(sum(a.tf * b.tf) / any_value(x.norm * y.norm), 6) AS cosine FROM t a JOIN t b ON a.w = b.w AND a.k < b.k JOIN n x ON x.k = a.k JOIN n y ON y.k = b.k
GROUP BY a.k, b.k HAVING sum(a.tf * b.tf) / any_value(x.norm * y.norm) >= 0.5""")
def cosine_pairs_tf(s, d):
    """Similar reference items by term counts, among the items and their shortened copies."""
    items = table(s, d, "benchmark").select("item_id", "text")
    shorter = items.select((F.col("item_id") + 1_000_000).alias("item_id"), F.replace("text", F.lit(" the "), F.lit(" ")).alias("text"))
    return similarity.cosine_pairs(items.unionByName(shorter), "item_id", "text", 0.5).withColumn("cosine", F.round("cosine", 6))


@query()
def greedy_dedup(s, d):
    """Reference items that stay when the first of similar ones wins."""
    items = table(s, d, "benchmark").select("item_id")
    return feed.greedy_dedup(similarity.cosine_pairs(table(s, d, "benchmark"), "item_id", "text", 0.5).select("a", "b"), items, "item_id")


@query(f"""WITH w AS (SELECT doc_id, length(text) AS len, {WORDS.format('text')} AS w FROM documents), g AS (SELECT doc_id, len, unnest(w) AS gram, 1 AS size FROM w
  UNION ALL SELECT doc_id, len, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 2 FROM w WHERE len(w) >= 2
  UNION ALL SELECT doc_id, len, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))), 3 FROM w WHERE len(w) >= 3
  UNION ALL SELECT doc_id, len, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))), 4 FROM w WHERE len(w) >= 4),
t AS (SELECT gram, size, count(*) AS n FROM g GROUP BY ALL ORDER BY n DESC, gram, size LIMIT 200), e AS (SELECT gram, size, len, doc_id, row_number() OVER (PARTITION BY gram, size ORDER BY len, doc_id) AS rn FROM (SELECT DISTINCT gram, size, len, doc_id FROM g JOIN t USING (gram, size)))
SELECT t.gram, t.size, n, array_to_string(list(doc_id ORDER BY rn) FILTER (rn <= 2), ',') AS examples FROM t JOIN e USING (gram, size) GROUP BY t.gram, t.size, n""")
def ngram_top200(s, d):
    """The most frequent runs of one to four words, each with its two shortest articles."""
    top = quality.ngram_top(docs(s, d), "text", 200)
    found = quality.ngram_examples(docs(s, d), "doc_id", "text", top)
    return found.select("gram", "size", "n", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("examples"))


@query(f"""WITH t AS (SELECT quality = 1 AS good, unnest(list_distinct({WORDS.format('text')})) AS token FROM documents JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id))
SELECT token, count(*) AS total, count(*) FILTER (NOT good) AS failing, count(*) FILTER (good) AS passing FROM t GROUP BY token HAVING count(*) >= 5""")
def token_census(s, d):
    """In how many good and bad articles each word occurs."""
    lab = table(s, d, "labels").groupBy("doc_id").agg((F.max("quality") == 1).alias("good"))
    return quality.token_census(docs(s, d).join(lab, "doc_id"), "text", "good").where("total >= 5")


@query("""SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS passed, round(avg((quality = 1)::INT), 6) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), ())""")
def stratified_quality(s, d):
    """Pass rates by language and over all."""
    rows = docs(s, d).join(table(s, d, "labels"), "doc_id").withColumn("good", F.col("quality") == 1)
    return quality.strata(rows, "lang", "good").withColumn("rate", F.round("rate", 6))


@query(f"""WITH a AS (SELECT w, count(*) AS wiki FROM (SELECT unnest({WORDS.format('text')}) AS w FROM documents) GROUP BY w), b AS (SELECT w, count(*) AS feed FROM (SELECT unnest({WORDS.format('text')}) AS w FROM conversations) GROUP BY w)
SELECT coalesce(a.w, b.w) AS word, coalesce(wiki, 0) AS wiki, coalesce(feed, 0) AS feed, coalesce(wiki, 0) + coalesce(feed, 0) AS total FROM a FULL JOIN b ON a.w = b.w WHERE coalesce(wiki, 0) + coalesce(feed, 0) >= 10""")
def vocab_full_outer(s, d):
    """Word counts of two corpora side by side."""
    count = lambda t, c: table(s, d, t).select(F.explode(text.words(F.coalesce("text", F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias(c))
    both = count("documents", "wiki").join(count("conversations", "feed"), "word", "full")
    return both.select("word", F.coalesce("wiki", F.lit(0)).alias("wiki"), F.coalesce("feed", F.lit(0)).alias("feed")).withColumn("total", F.col("wiki") + F.col("feed")).where("total >= 10")


@query()
def edit_distance(s, d):
    """Edit distance of every reference item to the item after it, which stands for its reference text."""
    b = table(s, d, "benchmark")
    return similarity.edit_distances(b, b.select((F.col("item_id") - 1).alias("item_id"), "text"), "item_id", "text")


@query()
def edit_distance_pairs(s, d):
    """Edit distances of all reference items that share a word, whatever their ids."""
    return similarity.edit_pairs(table(s, d, "benchmark"), "item_id", "text")


SEARCH = ("the", "ther")


@query(f"""WITH p AS (SELECT term, doc_id, sum(w) AS w FROM (
  SELECT doc_id, unnest(list_distinct(list_filter({WORDS.format(TITLE)}, lambda w: len(w) >= 2))) AS term, 3.0::DOUBLE AS w FROM documents
  UNION ALL SELECT doc_id, unnest(list_distinct(list_filter({WORDS.format("CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END")}, lambda w: len(w) >= 2))), 1.0 FROM documents
  UNION ALL SELECT doc_id, unnest(list_distinct(list_filter({WORDS.format("source")}, lambda w: len(w) >= 2))), 0.4 FROM documents) GROUP BY ALL),
q AS (SELECT unnest(['the', 'ther']) AS q), h AS (SELECT q, term, doc_id, w FROM p JOIN q ON starts_with(term, q)), f AS (SELECT q, term, count(*) AS df FROM h GROUP BY ALL),
x AS (SELECT q, term, df FROM f QUALIFY row_number() OVER (PARTITION BY q ORDER BY (term <> q)::INT, df DESC, term) <= 8),
e AS (SELECT doc_id, q, max(ln(1 + (SELECT count(*) FROM documents)::DOUBLE / (1 + df)) * (1 + ln(1 + w)) * CASE WHEN term = q THEN 1.6 ELSE 1 END) AS s FROM h JOIN x USING (q, term) GROUP BY ALL),
r AS (SELECT doc_id, sum(s) * (0.45 + 0.55 * count(*) / 2.0) * (0.35 + 0.65 * pow(0.5, (doc_id % 200) / 36.0)) AS score, count(*) AS matched FROM e GROUP BY doc_id)
SELECT doc_id, round(score, 6) AS score, matched FROM r WHERE matched = 2 ORDER BY r.score DESC, doc_id LIMIT 100""")
def search_ranked(s, d):
    """The best hundred articles with both words, by weight of fields, rarity, coverage and age."""
    a = docs(s, d)
    post = search.postings(a, "doc_id", {"title": text.title_of(F.col("text")), "summary": text.summary_of(F.col("text")), "source": F.col("source")})
    ages = a.select("doc_id", (F.col("doc_id") % 200).cast("double").alias("age_hours"))
    return search.search(post, "doc_id", a.count(), list(SEARCH), ages=ages, limit=100).withColumn("score", F.round("score", 6))


@query()
def html_extract(s, d):
    """Whole bodies of pages: all paragraphs, equal only where they are equal to the end."""
    return html.extract(table(s, d, "pages"), rule=html.Rule(most=None, same=None)).select("page_id", "title", F.size("paragraphs").alias("paragraphs"), "word_count", "partial")


@query(r"""SELECT doc_id, len(list_distinct(regexp_extract_all(text, '\d+(?:[.,]\d+)?\s*%?'))) AS numbers FROM documents""")
def numeric_claims(s, d):
    """Distinct numbers in each article."""
    return docs(s, d).select("doc_id", F.size(text.numbers(F.col("text"))).cast("long").alias("numbers"))


# ---- ticks and bars


@query(f"WITH {BARS} SELECT symbol, bucket, time, open, high, low, close, volume FROM c")
def candles_4h(s, d):
    """Four-hour bars."""
    return bars(s, d)


@query(f"WITH {BARS} SELECT symbol, bucket, CASE WHEN count(*) OVER w = 20 THEN round(avg(close) OVER w, 6) END AS sma_20 FROM c WINDOW w AS (PARTITION BY symbol ORDER BY bucket ROWS 19 PRECEDING)")
def sma_20(s, d):
    return timeseries.sma(bars(s, d)).select("symbol", "bucket", F.round("sma_20", 6).alias("sma_20"))


@query(f"""WITH {BARS}, w AS (SELECT symbol, bucket, count(*) OVER w AS n, avg(close) OVER w AS m, stddev_pop(close) OVER w AS sd FROM c WINDOW w AS (PARTITION BY symbol ORDER BY bucket ROWS 19 PRECEDING))
SELECT symbol, bucket, CASE WHEN n = 20 THEN round(m, 5) END AS mid, CASE WHEN n = 20 THEN round(m + 2 * sd, 5) END AS upper, CASE WHEN n = 20 THEN round(m - 2 * sd, 5) END AS lower FROM w""")
def bollinger_20(s, d):
    return timeseries.bollinger(bars(s, d)).select("symbol", "bucket", *[F.round(c, 5).alias(c) for c in ("mid", "upper", "lower")])


@query(f"""WITH {BARS}, w AS (SELECT symbol, bucket, CASE WHEN count(*) OVER w = 14 THEN round(CASE WHEN max(high) OVER w > min(low) OVER w THEN (close - min(low) OVER w) / (max(high) OVER w - min(low) OVER w) * 100 ELSE 50 END, 2) END AS k
FROM c WINDOW w AS (PARTITION BY symbol ORDER BY bucket ROWS 13 PRECEDING))
SELECT symbol, bucket, k, CASE WHEN count(k) OVER v = 3 THEN round(avg(k) OVER v, 2) END AS d FROM w WINDOW v AS (PARTITION BY symbol ORDER BY bucket ROWS 2 PRECEDING)""")
def stochastic_14(s, d):
    return timeseries.stochastic(bars(s, d)).select("symbol", "bucket", "k", "d")


@query(f"WITH {BARS} SELECT symbol, bucket, round((close - lag(close, 7) OVER w) / nullif(lag(close, 7) OVER w, 0) * 100, 6) AS pct_7 FROM c WINDOW w AS (PARTITION BY symbol ORDER BY bucket)")
def pct_change_7(s, d):
    return timeseries.pct_change(bars(s, d)).select("symbol", "bucket", F.round("pct_7", 6).alias("pct_7"))


@query(f"""WITH {BARS}, l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bucket DESC) AS rn FROM c), m AS (SELECT * FROM l WHERE rn <= 60), p AS (SELECT symbol, arg_max(close, bucket) AS spot, count(*) AS bars FROM m GROUP BY symbol)
SELECT symbol, spot, bars, max(close) FILTER (close < spot AND bars >= 10) AS support, min(close) FILTER (close > spot AND bars >= 10) AS resistance FROM m JOIN p USING (symbol) GROUP BY ALL""")
def pivot_levels(s, d):
    return timeseries.pivot_levels(bars(s, d))


@query(f"""WITH {BARS}, r AS (SELECT symbol, bucket, close / lag(close) OVER (PARTITION BY symbol ORDER BY bucket) - 1 AS ret FROM c)
SELECT symbol, bucket, CASE WHEN count(ret) OVER w = 30 THEN round(stddev_pop(ret) OVER w * sqrt(365) * 100, 4) END AS vol FROM r WINDOW w AS (PARTITION BY symbol ORDER BY bucket ROWS 29 PRECEDING)""")
def realized_vol_30(s, d):
    return timeseries.realized_vol(bars(s, d)).select("symbol", "bucket", F.round("vol", 4).alias("vol"))


SERIES = f"{BARS}, s AS (SELECT symbol, list(close ORDER BY bucket) AS c, list(high ORDER BY bucket) AS h, list(low ORDER BY bucket) AS l, list(volume::DOUBLE ORDER BY bucket) AS v FROM c GROUP BY symbol)"


def _ema_sql(values: str, p: int) -> str:
    return f"list_reduce(list_concat([list_avg({values}[1:{p}])], {values}[{p + 1}:]), lambda a, x: x * {2 / (p + 1)!r}::DOUBLE + a * {1 - 2 / (p + 1)!r}::DOUBLE)"


def _wilder_sql(values: str, p: int) -> str:
    return f"list_reduce(list_concat([list_avg({values}[1:{p}])], {values}[{p + 1}:]), lambda a, x: (a * {p - 1} + x) / {p})"


@query(f"WITH {SERIES} SELECT symbol, CASE WHEN len(c) >= 20 THEN round({_ema_sql('c', 20)}, 6) END AS ema_20 FROM s")
def ema_20(s, d):
    return timeseries.series(bars(s, d)).select("symbol", F.round(timeseries.ema(F.col("closes"), 20), 6).alias("ema_20"))


@query(f"""WITH {SERIES}, d AS (SELECT symbol, list_transform(range(2, len(c) + 1), lambda i: greatest(c[i] - c[i - 1], 0)) AS g, list_transform(range(2, len(c) + 1), lambda i: greatest(c[i - 1] - c[i], 0)) AS l FROM s)
SELECT symbol, CASE WHEN len(g) >= 14 THEN round(100 - 100 / (1 + {_wilder_sql('g', 14)} / {_wilder_sql('l', 14)}), 6) END AS rsi_14 FROM d""")
def rsi_14(s, d):
    return timeseries.series(bars(s, d)).select("symbol", F.round(timeseries.rsi(F.col("closes")), 6).alias("rsi_14"))


@query(f"""WITH {SERIES}, d AS (SELECT symbol, list_transform(range(2, len(c) + 1), lambda i: greatest(h[i] - l[i], abs(h[i] - c[i - 1]), abs(l[i] - c[i - 1]))) AS t FROM s)
SELECT symbol, CASE WHEN len(t) >= 14 THEN round({_wilder_sql('t', 14)}, 6) END AS atr_14 FROM d""")
def atr_14(s, d):
    b = timeseries.series(bars(s, d))
    return b.select("symbol", F.round(timeseries.atr(F.col("highs"), F.col("lows"), F.col("closes")), 6).alias("atr_14"))


MACD = f"""m AS (SELECT symbol, list_transform(range(26, len(c) + 1), lambda i: {_ema_sql('c[1:i]', 12)} - {_ema_sql('c[1:i]', 26)}) AS line FROM s),
k AS (SELECT symbol, CASE WHEN len(line) >= 10 THEN line[-1] END AS macd, CASE WHEN len(line) >= 10 THEN {_ema_sql('line', 9)} END AS macd_signal FROM m)"""


@query(f"WITH {SERIES}, {MACD} SELECT symbol, round(macd, 6) AS macd, round(macd_signal, 6) AS macd_signal, round(macd - macd_signal, 6) AS macd_hist FROM k")
def macd_12_26_9(s, d):
    m = timeseries.macd(F.col("closes"))
    return timeseries.series(bars(s, d)).select("symbol", F.round(m["macd"], 6).alias("macd"), F.round(m["signal"], 6).alias("macd_signal"), F.round(m["hist"], 6).alias("macd_hist"))


@query(f"""WITH {SERIES}, {MACD}, g AS (SELECT symbol, list_transform(range(2, len(c) + 1), lambda i: greatest(c[i] - c[i - 1], 0)) AS g, list_transform(range(2, len(c) + 1), lambda i: greatest(c[i - 1] - c[i], 0)) AS l,
  list_transform(range(2, len(c) + 1), lambda i: greatest(h[i] - l[i], abs(h[i] - c[i - 1]), abs(l[i] - c[i - 1]))) AS t FROM s)
SELECT symbol, len(c) AS bars, c[-1] AS price, CASE WHEN len(c) >= 20 THEN round({_ema_sql('c', 20)}, 6) END AS ema_20, CASE WHEN len(g.g) >= 14 THEN round(100 - 100 / (1 + {_wilder_sql('g.g', 14)} / {_wilder_sql('g.l', 14)}), 6) END AS rsi_14,
  round(macd, 6) AS macd, round(macd_signal, 6) AS macd_signal, round(macd - macd_signal, 6) AS macd_hist, CASE WHEN len(t) >= 14 THEN round({_wilder_sql('t', 14)}, 6) END AS atr_14,
  round((c[-1] - c[-8]) / c[-8] * 100, 6) AS chg_7, round((c[-1] - c[-31]) / c[-31] * 100, 6) AS chg_30, round((c[-1] - c[-91]) / c[-91] * 100, 6) AS chg_90,
  CASE WHEN len(v) >= 30 THEN round(list_avg(v[len(v) - 6 :]) / list_avg(v[len(v) - 29 : len(v) - 7]), 6) END AS volume_ratio FROM s JOIN g USING (symbol) JOIN k USING (symbol)""")
def indicator_snapshot(s, d):
    out = timeseries.snapshot(bars(s, d))
    return out.select("symbol", F.col("bars").cast("long").alias("bars"), "price", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("symbol", "bars", "price")])


CYCLES = "n AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS cycle, count(*) AS n FROM events GROUP BY ALL)"


def cycles(s, d) -> DataFrame:
    return table(s, d, "events").groupBy(F.col("event_type").alias("symbol"), F.to_date("ts").alias("cycle")).agg(F.count("*").alias("n"))


@query(f"""WITH {CYCLES}, r AS (SELECT *, CASE WHEN count(n) OVER w >= 4 THEN n / avg(n) OVER w END AS ratio FROM n WINDOW w AS (PARTITION BY symbol ORDER BY cycle ROWS BETWEEN 99 PRECEDING AND 1 PRECEDING))
SELECT symbol, cycle::VARCHAR AS cycle, n, round(ratio, 6) AS ratio, coalesce(ratio >= 3, false) AS anomaly FROM r""")
def volume_anomaly_ratio(s, d):
    """Daily counts against the days before."""
    return timeseries.volume_ratio(cycles(s, d)).select("symbol", F.col("cycle").cast("string").alias("cycle"), "n", F.round("ratio", 6).alias("ratio"), "anomaly")


@query(f"""WITH {CYCLES}, r AS (SELECT *, avg(n) OVER w AS mu, stddev_pop(n) OVER w AS sd, count(n) OVER w AS k FROM n WINDOW w AS (PARTITION BY symbol ORDER BY cycle ROWS BETWEEN 29 PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, CASE WHEN k >= 4 THEN CASE WHEN sd > 0 THEN (n - mu) / sd WHEN n > mu THEN (n - mu) / 0.5 ELSE 0 END END AS z FROM r)
SELECT symbol, cycle::VARCHAR AS cycle, n, round(z, 5) AS z, CASE WHEN z >= 3.5 THEN 'high' WHEN z >= 2.5 THEN 'medium' ELSE 'none' END AS severity FROM z""")
def volume_anomaly_zscore(s, d):
    return timeseries.volume_zscore(cycles(s, d)).select("symbol", F.col("cycle").cast("string").alias("cycle"), "n", F.round("z", 5).alias("z"), "severity")


@query("""WITH s AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS cycle, avg(value) / 100 AS score FROM events GROUP BY ALL),
r AS (SELECT *, avg(score) OVER w5 AS fast, avg(score) OVER w20 AS slow, lag(score, 9) OVER w AS first, row_number() OVER (PARTITION BY symbol ORDER BY cycle DESC) AS rn, count(*) OVER (PARTITION BY symbol) AS points FROM s
  WINDOW w AS (PARTITION BY symbol ORDER BY cycle), w5 AS (PARTITION BY symbol ORDER BY cycle ROWS 4 PRECEDING), w20 AS (PARTITION BY symbol ORDER BY cycle ROWS 19 PRECEDING)),
m AS (SELECT *, greatest(-1, least(1, (score - first) / greatest(abs(first), 0.01))) AS momentum FROM r WHERE rn = 1 AND points >= 10),
g AS (SELECT *, CASE WHEN fast > slow + 0.05 AND momentum > 0.1 THEN 'bullish' WHEN fast < slow - 0.05 AND momentum < -0.1 THEN 'bearish' ELSE 'neutral' END AS prediction FROM m)
SELECT symbol, points, round(fast, 6) AS fast, round(slow, 6) AS slow, round(momentum, 6) AS momentum, prediction,
  round(CASE WHEN prediction = 'neutral' THEN 1 - least(1, abs(fast - slow) * 5) ELSE least(1, abs(fast - slow) * 5 + abs(momentum)) END, 6) AS confidence FROM g
UNION ALL SELECT symbol, points, NULL, NULL, NULL, 'neutral', 0 FROM r WHERE rn = 1 AND points < 10""")
def ma_crossover_prediction(s, d):
    scores = table(s, d, "events").groupBy(F.col("event_type").alias("symbol"), F.to_date("ts").alias("cycle")).agg((F.avg("value") / 100).alias("score"))
    return timeseries.crossover(scores).select("symbol", "points", *[F.round(c, 6).alias(c) for c in ("fast", "slow", "momentum")], "prediction", F.round("confidence", 6).alias("confidence"))


CHECKPOINTS = """g AS (SELECT event_id AS id, event_type AS symbol, h, ts + h * INTERVAL 1 HOUR AS goal FROM events, (SELECT unnest([1, 4, 24]) AS h)),
t AS (SELECT event_type AS symbol, ts, arg_min(value, event_id) AS price_after FROM events GROUP BY ALL),
p AS (SELECT g.id, g.h, t.price_after FROM g ASOF JOIN t ON t.symbol = g.symbol AND t.ts >= g.goal)"""


@query(f"WITH {CHECKPOINTS} SELECT id, h, price_after FROM p")
def asof_checkpoints(s, d):
    """First price at or after 1, 4 and 24 hours, for every event."""
    e = table(s, d, "events")
    ticks = e.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.col("event_id").alias("tick"))
    return correlation.checkpoints(e.select(F.col("event_id").alias("id"), F.col("event_type").alias("symbol"), "ts"), ticks).select("id", "h", "price_after")


@query(f"""WITH e AS (SELECT event_id AS id, event_type AS symbol, value AS price, CASE WHEN user_id % 3 = 0 THEN 1 WHEN user_id % 3 = 1 THEN -1 ELSE 0 END AS sentiment FROM events), {CHECKPOINTS},
m AS (SELECT symbol, h, sentiment, (price_after - price) / price * 100 AS move FROM p JOIN e USING (id) WHERE price <> 0)
SELECT symbol, h, count(*) AS events, CASE WHEN count(*) >= 5 THEN round(avg(move) FILTER (sentiment > 0), 4) END AS move_pos, CASE WHEN count(*) >= 5 THEN round(avg(move) FILTER (sentiment < 0), 4) END AS move_neg,
  CASE WHEN count(*) >= 5 THEN round(avg((sign(sentiment) = sign(move))::INT) FILTER (sentiment <> 0), 6) END AS accuracy FROM m GROUP BY ALL""")
def sentiment_move_corr(s, d):
    """How prices move after events of either sign."""
    sign = F.when(F.col("user_id") % 3 == 0, 1).when(F.col("user_id") % 3 == 1, -1).otherwise(0)
    e = table(s, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("symbol"), F.col("value").alias("price"), sign.cast("double").alias("sentiment"))
    m = correlation.moves(asof_checkpoints(s, d).join(e, "id"))
    return m.select("symbol", "h", "events", F.round("move_pos", 4).alias("move_pos"), F.round("move_neg", 4).alias("move_neg"), F.round("accuracy", 6).alias("accuracy"))


@query("SELECT event_type, list_sort(list(value))[(count(*) // 2) + 1] AS median FROM events GROUP BY event_type")
def upper_median_by_group(s, d):
    """Upper median of values by type."""
    return ranking.upper_medians(table(s, d, "events").where("value is not null"), "event_type", "value", "median")


@query("""WITH r AS (SELECT s_suppkey, s_acctbal, CASE WHEN s_acctbal > 0 THEN rank() OVER (PARTITION BY s_acctbal > 0 ORDER BY s_acctbal) + count(*) OVER (PARTITION BY s_acctbal) / 2.0 - 1 END AS r FROM supplier)
SELECT s_suppkey, round(coalesce(r / (SELECT count(*) FROM supplier WHERE s_acctbal > 0), 0), 6) AS pct FROM r""")
def midrank_percentile(s, d):
    """Mid-rank share of positive balances."""
    return ranking.midrank(table(s, d, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal").select("s_suppkey", F.round("pct", 6).alias("pct"))


# ---- lists, lanes, logs


@query("""WITH b AS (SELECT d.doc_id, source, lang, 0.5 + 0.4 * quality + (d.doc_id % 7) * 0.01 AS cred FROM documents d JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)),
k AS (SELECT source, count(*) FILTER (cred >= 0.9) AS strict FROM b GROUP BY source), c AS (SELECT b.* FROM b JOIN k USING (source) WHERE cred >= 0.9 OR strict < 4)
SELECT source, lang, doc_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY cred DESC, doc_id) AS rn FROM c WHERE cred >= 0.5) WHERE rn <= 3""")
def topn_per_bucket_relaxed(s, d):
    """Top articles of every source and language, with a bar that relaxes."""
    lab = table(s, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    b = docs(s, d).join(lab, "doc_id").withColumn("cred", 0.5 + 0.4 * F.col("quality") + (F.col("doc_id") % 7) * 0.01)
    top = ranking.top_relaxed(b.select("doc_id", "source", "lang", "cred"), "source", "lang", "cred", [F.desc("cred"), F.col("doc_id")], 3, 0.9, 0.5)
    return top.select("source", "lang", "doc_id", "rn")


@query("""WITH r AS (SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) > 1 AS later FROM orders)
SELECT o_orderkey, o_custkey, o_totalprice FROM r ORDER BY later, o_totalprice DESC, o_orderkey LIMIT 20""")
def diversified_top20(s, d):
    """Best order of every customer first."""
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return ranking.diversified(o, "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 20).drop("later")


@query("""WITH l AS (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM']) AS lane, unnest([1, 2, 3]) AS place), r AS (SELECT o_orderkey, o_orderpriority, place, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders JOIN l ON lane = o_orderpriority)
SELECT o_orderkey, o_orderpriority, rn FROM r ORDER BY rn, place LIMIT 30""")
def lane_round_robin(s, d):
    """Lanes in turn."""
    o = table(s, d, "orders")
    return ranking.round_robin(o, "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"], [F.desc("o_totalprice"), F.col("o_orderkey")], 30).select("o_orderkey", "o_orderpriority", "rn")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate >= o_orderdate + INTERVAL 100 DAY)")
def posted_semi_join(s, d):
    """Orders with a late shipment."""
    o, l = table(s, d, "orders"), table(s, d, "lineitem")
    return o.join(l, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") >= F.col("o_orderdate") + F.expr("INTERVAL 100 DAYS")), "left_semi").select("o_orderkey")


@query("SELECT o_orderkey, coalesce(c_name, '') AS c_name, o_totalprice FROM orders LEFT JOIN customer ON o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def dispatch_log_left_join(s, d):
    """The latest dispatches with names."""
    o, c = table(s, d, "orders"), table(s, d, "customer")
    top = o.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50)
    return top.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.coalesce("c_name", F.lit("")).alias("c_name"), "o_totalprice")


@query("SELECT o_orderkey, count(l_linenumber) AS posts, coalesce(string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber), '') AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def nested_posts(s, d):
    """Orders with their lines nested."""
    lines = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("ls"))
    o = table(s, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select("o_orderkey", F.coalesce(F.size("ls"), F.lit(0)).cast("long").alias("posts"), F.coalesce(F.array_join(F.col("ls").cast("array<string>"), ","), F.lit("")).alias("lines"))


@query("SELECT user_id, arg_max(value, (-(event_type = 'view')::INT, ts, event_id)) AS value, arg_max(event_type, (-(event_type = 'view')::INT, ts, event_id)) AS provider FROM events WHERE value IS NOT NULL GROUP BY user_id")
def priority_quotes(s, d):
    """One quote for each symbol: better providers first, then the latest."""
    order = F.struct(-(F.col("event_type") == "view").cast("int"), "ts", "event_id")
    return table(s, d, "events").where("value is not null").groupBy("user_id").agg(F.max_by("value", order).alias("value"), F.max_by("event_type", order).alias("provider"))


@query("SELECT coalesce(r_name, '') AS region, count(*) AS nations FROM nation LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def symbol_alias_rollup(s, d):
    """Members of every alias group."""
    n, r = table(s, d, "nation"), table(s, d, "region")
    return n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"), "left").groupBy(F.coalesce("r_name", F.lit("")).alias("region")).agg(F.count("*").alias("nations"))


@query("SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def feed_window_recent(s, d):
    """Events of the last day."""
    e = table(s, d, "events")
    as_of = e.agg(F.max("ts")).first()[0]
    return feed.in_window(e, "ts", F.lit(as_of), 24)[0].select("event_id", "ts")


@query("SELECT event_id, ts FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 24 HOUR ORDER BY ts DESC, event_id LIMIT 250")
def feed_archive(s, d):
    """The newest older events."""
    e = table(s, d, "events")
    as_of = e.agg(F.max("ts")).first()[0]
    return feed.in_window(e, "ts", F.lit(as_of), 24)[1].select("event_id", "ts").orderBy(F.desc("ts"), "event_id").limit(250)


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def merge_latest_by_id(s, d):
    """The last event of every user."""
    e = table(s, d, "events").select("user_id", "event_id", "value", "ts")
    return tables.latest(e, "user_id", [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "value")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 60")
def retention_top60(s, d):
    """The newest 60 events of every user."""
    return tables.retain(table(s, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 60).select("user_id", "event_id")


@query("""WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), p AS (SELECT user_id, arg_max(value, (ts, event_id)) AS v FROM events WHERE CAST(ts AS DATE) <= (SELECT max(day) - 1 FROM d) GROUP BY user_id),
n AS (SELECT user_id, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY user_id)
SELECT coalesce(p.user_id, n.user_id) AS user_id, p.v AS old, n.v AS new, CASE WHEN p.v IS NULL THEN 'added' WHEN n.v IS NULL THEN 'removed' WHEN n.v > p.v THEN 'up' ELSE 'down' END AS direction
FROM p FULL JOIN n ON p.user_id = n.user_id WHERE p.v IS DISTINCT FROM n.v""")
def snapshot_diff(s, d):
    """Users whose latest value changed in the last day."""
    e = table(s, d, "events").select("user_id", "event_id", "value", "ts")
    last = e.agg(F.to_date(F.max("ts"))).first()[0]
    order = [F.col("ts"), F.col("event_id")]
    return tables.snapshot_diff(tables.latest(e.where(F.to_date("ts") < F.lit(last)), "user_id", order), tables.latest(e, "user_id", order), "user_id", "value")


@query("SELECT o_custkey AS custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def baseline_diff(s, d):
    """Keys in one set and not in the other."""
    return table(s, d, "orders").select(F.col("o_custkey").alias("custkey")).subtract(table(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey")))


@query("SELECT user_id, event_type AS feature, CAST(ts AS DATE)::VARCHAR AS day, count(*) AS n, count(*) > 3 AS over_quota FROM events GROUP BY ALL")
def quota_usage_daily(s, d):
    """Daily use by user and feature."""
    return table(s, d, "events").groupBy("user_id", F.col("event_type").alias("feature"), F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"), (F.count("*") > 3).alias("over_quota"))


@query("""SELECT l_orderkey, l_linenumber, round(l_extendedprice - round(l_extendedprice / 1000) * 1000, 4) AS surprise, CASE WHEN l_extendedprice > round(l_extendedprice / 1000) * 1000 THEN 1 WHEN l_extendedprice < round(l_extendedprice / 1000) * 1000 THEN -1 ELSE 0 END AS better FROM lineitem""")
def calendar_surprise(s, d):
    """Actual against a rounded forecast."""
    forecast = F.round(F.col("l_extendedprice") / 1000) * 1000
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") - forecast, 4).alias("surprise"), F.signum(F.col("l_extendedprice") - forecast).cast("int").alias("better"))


def _session_sql() -> str:
    out = []
    for name, (a, b) in calendar.SESSIONS.items():
        inside = f"hour(ts) >= {a} AND hour(ts) < {b}" if a < b else f"(hour(ts) >= {a} OR hour(ts) < {b})"
        open_ = f"(({inside}) AND isodow(ts) - 1 IN {calendar.DAYS[name]})"
        out.append(f"{open_} AS {name}")
        left = f"(CASE WHEN {open_} THEN {b * 60} ELSE {a * 60} END - hour(ts) * 60 - minute(ts))"
        out.append(f"(CASE WHEN {left} > 0 THEN {left} ELSE 1440 + {left} END)::INT AS {name}_minutes")
    return f"SELECT event_id, {', '.join(out)} FROM events"


@query(_session_sql())
def session_open_flags(s, d):
    """Which exchanges are open at each event, and the minutes to their next change."""
    ts = F.col("ts")
    return table(s, d, "events").select("event_id", *[c for n in calendar.SESSIONS for c in (calendar.session_open(ts, n).alias(n), calendar.session_minutes(ts, n).cast("int").alias(f"{n}_minutes"))])


@query("""WITH n AS (SELECT DISTINCT o_orderdate::DATE AS day, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + 1075195 AS n FROM orders),
b AS (SELECT day, n, (n % 12053) % 1461 AS r FROM n), y AS (SELECT *, greatest(0, (r - 1) // 365) AS y FROM b), q AS (SELECT *, CASE WHEN r > 365 THEN (r - 1) % 365 ELSE r END AS k FROM y)
SELECT day::VARCHAR AS day, (33 * (n // 12053) + 4 * ((n % 12053) // 1461) + CASE WHEN r > 365 THEN (r - 1) // 365 ELSE 0 END - 1595)::INT AS jy,
  (CASE WHEN k < 186 THEN 1 + k // 31 ELSE 7 + (k - 186) // 30 END)::INT AS jm, (CASE WHEN k < 186 THEN 1 + k % 31 ELSE 1 + (k - 186) % 30 END)::INT AS jd FROM q""")
def jalali_date(s, d):
    """Solar Hijri dates of order days."""
    days = table(s, d, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return days.select(F.col("d").cast("string").alias("day"), calendar.jalali(F.col("d")).alias("j")).select("day", "j.*")


RULES = [("r1", "AND", "view", "price", ">", 10.0), ("r2", "OR", "view", "price", "<", 0.0), ("r2", "OR", "click", "change", ">", -100.0), ("r3", "AND", "none", "price", ">", 0.0)]


@query(f"""WITH r(id, logic, sym, kind, op, value) AS (VALUES {", ".join(str(r) for r in RULES)}),
s AS (SELECT event_type AS symbol, arg_max(value, (ts, event_id)) AS price, arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)) AS change FROM events GROUP BY event_type),
t AS (SELECT id, logic, CASE WHEN op = '>' THEN CASE WHEN kind = 'price' THEN price ELSE change END > value ELSE CASE WHEN kind = 'price' THEN price ELSE change END < value END AS ok FROM r LEFT JOIN s ON sym = symbol)
SELECT id, CASE WHEN any_value(logic) = 'AND' THEN bool_and(ok) ELSE bool_or(ok) END AS fires FROM t GROUP BY id""")
def alert_rules(s, d):
    """Rules over the latest prices."""
    order = F.struct("ts", "event_id")
    snap = table(s, d, "events").groupBy(F.col("event_type").alias("symbol")).agg(F.max_by("value", order).alias("price"), (F.max_by("value", order) - F.min_by("value", order)).alias("change"))
    return alerts.evaluate(s.createDataFrame(RULES, alerts.RULES), snap)


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS norm FROM embeddings")
def vector_norms(s, d):
    """Norms of dense vectors."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    return table(s, d, "embeddings").select("vec_id", F.round(F.sqrt(F.aggregate(e, F.lit(0.0), lambda a, x: a + x * x)), 4).alias("norm"))


# ---- streams


def _events_dir(d: str) -> str:
    return f"{d}/events.parquet*"


def _drained(s: SparkSession, d: str, build, mode: str = "append") -> DataFrame:
    """Runs a stream over the landed events into the shared folder."""
    import uuid

    from marketloom.store import shared_dir

    at = f"{shared_dir(s)}/streams/{uuid.uuid4().hex}"
    return flows.drain(build(flows.events(s, _events_dir(d))), f"{at}/out", f"{at}/checkpoint", mode)


@query("SELECT event_type, user_id, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def stream_dedup_within_watermark(s, d):
    """Users and types, each once inside a watermark longer than the data."""
    out = _drained(s, d, lambda e: flows.idempotent(e.select("ts", "user_id", "event_type"), ["user_id", "event_type"], "60 days").select("user_id", "event_type"))
    return out.groupBy("event_type", "user_id").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT user_id, event_id, floor(value / 50) AS v, lag(floor(value / 50)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS o FROM events WHERE value IS NOT NULL)
SELECT user_id, count(*) AS changes FROM r WHERE v IS DISTINCT FROM o GROUP BY user_id""")
def stream_release_changes(s, d):
    """How often each user's level changed."""
    out = _drained(s, d, lambda e: flows.changes(e.withColumn("level", F.floor(F.col("value") / 50)).select("user_id", "event_id", "ts", "level"), "user_id", "level"))
    return out.groupBy("user_id").agg(F.count("*").alias("changes"))


@query("""WITH e AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, TRUE) AS begins FROM events), g AS (SELECT *, sum(begins::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e),
x AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM g GROUP BY user_id, k) SELECT user_id, epoch_us(start) AS start_us, epoch_us(stop) AS end_us, n FROM x WHERE stop <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_session_counts(s, d):
    """Closed sessions by user."""
    out = _drained(s, d, lambda e: flows.sessions(e, "user_id"))
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


