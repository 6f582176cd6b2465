"""Registered queries of censuses, strata, dense neighbours, the stored index and the log of sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.operators import census, dense, fetching, index, postedit, search, studio
from marketloom.plans.catalog import WORDS, docs, query
from marketloom.plans.desk import ART, articles
from marketloom.plans.translation import conversation_terms
from marketloom.sources.readers import table
from marketloom.store import materialise, shared_dir

# ---- censuses


def turn_pairs(s: SparkSession, d: str) -> DataFrame:
    """Every turn with the turn after it: a source and an output."""
    of = W.partitionBy("conv_id").orderBy("turn")
    rows = table(s, d, "conversations").withColumn("output", F.lead("text").over(of)).where("output is not null")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("source"), "output")


@query(f"""WITH p AS (SELECT id, {WORDS.format('src')} AS s, {WORDS.format('out')} AS o FROM (SELECT conv_id * 1000 + turn AS id, text AS src, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS out FROM conversations) WHERE out IS NOT NULL),
f AS (SELECT id, unnest(s) AS term FROM p), t2 AS (SELECT term, count(*) AS n FROM f WHERE NOT regexp_matches(term, '^[0-9]+$') GROUP BY term ORDER BY n DESC, term LIMIT 200),
t AS (SELECT term FROM t2 WHERE length(term) >= 3 AND n >= 20 ORDER BY n DESC, term LIMIT 80), m AS (SELECT DISTINCT id, term FROM f JOIN t USING (term)), z AS (SELECT term, count(*) AS matched FROM m GROUP BY term HAVING count(*) >= 15),
w AS (SELECT id, unnest(o) AS gram FROM p), b AS (SELECT id, unnest(list_distinct(list_transform(range(1, len(o)), lambda i: o[i] || ' ' || o[i + 1]))) AS gram FROM p),
e AS (SELECT DISTINCT id, gram, 0 AS kind FROM w UNION ALL SELECT id, gram, 1 FROM b), g AS (SELECT gram, 0 AS kind, count(*) AS bg FROM w GROUP BY gram UNION ALL SELECT gram, 1, count(*) FROM b GROUP BY gram),
tot AS (SELECT kind, sum(bg) AS total FROM g GROUP BY kind),
c AS (SELECT term, matched, kind, gram, count(*) AS n FROM m JOIN z USING (term) JOIN e USING (id) GROUP BY ALL HAVING count(*) >= greatest(6, 0.12 * matched)),
c40 AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY term, kind ORDER BY n DESC, gram) <= 40),
k AS (SELECT c40.*, replace(gram, ' ', '') AS key FROM c40 JOIN g USING (gram, kind) JOIN tot USING (kind) WHERE length(replace(gram, ' ', '')) >= 3 AND n / matched <= 0.8 AND (n / matched) / (bg / total) >= 5),
k1 AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY term, key ORDER BY n DESC, kind, gram) = 1), k2 AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY n DESC, gram) AS place FROM k1), top AS (SELECT * FROM k2 WHERE place <= 10),
h AS (SELECT top.term, top.place, m.id FROM top JOIN m USING (term) JOIN e ON e.id = m.id AND e.kind = top.kind AND e.gram = top.gram),
n AS (SELECT x.term, x.place AS pa, y.place AS pb, count(*) AS both FROM h x JOIN h y ON x.term = y.term AND x.id = y.id AND x.place < y.place GROUP BY ALL)
SELECT x.term, x.matched, x.gram AS one, x.n AS n_one, y.gram AS two, y.n AS n_two, coalesce(n.both, 0)::BIGINT AS both FROM top x JOIN top y ON x.term = y.term AND x.place < y.place AND NOT contains(x.key, y.key) AND NOT contains(y.key, x.key)
LEFT JOIN n ON n.term = x.term AND pa = x.place AND pb = y.place WHERE coalesce(n.both, 0) / x.matched < 0.5 * (x.n / x.matched) * (y.n / y.matched)""")
def term_alternates(s, d):
    """Words and pairs of words of answers that stand for one word of the question, but rarely together."""
    return census.alternates(turn_pairs(s, d), least_count=20)


@query()
def aligned_census(s, d):
    """What the post-editor changes in reference items and conversations, aligned, by rule class; a plain loop tests it."""
    lexicon = materialise(postedit.lexicon(conversation_terms(s, d)), "lexicon")
    rows = table(s, d, "benchmark").select("text").unionByName(table(s, d, "conversations").select("text"))
    pairs = postedit.edit(rows, lexicon)
    return census.rule_classes(census.aligned_changes(pairs, "text", "edited"), lexicon)


# ---- strata


@query("""WITH d AS (SELECT doc_id, lang, n_chars, md5(doc_id::VARCHAR) AS h FROM documents), a AS (SELECT doc_id FROM d WHERE n_chars > 4000 ORDER BY h, doc_id LIMIT 30),
b AS (SELECT doc_id FROM d WHERE lang = 'en' AND doc_id NOT IN (SELECT * FROM a) ORDER BY h, doc_id LIMIT 40), c AS (SELECT doc_id FROM d WHERE doc_id NOT IN (SELECT * FROM a) AND doc_id NOT IN (SELECT * FROM b) ORDER BY h, doc_id LIMIT 50)
SELECT doc_id, 'long' AS stratum FROM a UNION ALL SELECT doc_id, 'english' FROM b UNION ALL SELECT doc_id, 'any' FROM c""")
def overlapping_strata(s, d):
    """Thirty long articles, forty English ones and fifty of any kind, none twice."""
    strata = [("long", F.col("n_chars") > 4000, 30), ("english", F.col("lang") == "en", 40), ("any", F.lit(True), 50)]
    return studio.claim_strata(docs(s, d).select("doc_id", "lang", "n_chars"), "doc_id", strata).select("doc_id", "stratum")


# ---- dense vectors


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
c AS (SELECT q.vec_id AS query, v.vec_id AS neighbour, round(list_dot_product(q.e, v.e) / (q.n * v.n), 9) AS cosine FROM v q, v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)
SELECT query, neighbour, round(cosine, 6) AS cosine, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, neighbour)::INT AS rank FROM c QUALIFY row_number() OVER (PARTITION BY query ORDER BY cosine DESC, neighbour) <= 5""")
def cosine_pairs_dense(s, d):
    """The five nearest vectors of every twentieth vector, among all."""
    v = table(s, d, "embeddings")
    found = dense.neighbours(v, v.where("vec_id % 20 = 0"), "vec_id", "embedding")
    return found.select("query", "neighbour", F.round("cosine", 6).alias("cosine"), "rank")


# ---- the stored index


@query(f"""WITH {ART}, t AS (SELECT id, ts, unnest(list_distinct(list_filter({WORDS.format('title')}, lambda w: len(w) >= 2))) AS term FROM art),
r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY ts DESC, id) AS rn FROM t) SELECT term, id AS key, 3.0::DOUBLE AS w, ts FROM r WHERE rn <= 20""")
def index_merge(s, d):
    """The index of headlines after three batches, the newest twenty postings of each term."""
    a = articles(s, d).select("id", "ts", "title")
    store = index.TermIndex(s, f"{shared_dir(s)}/marketloom/{uuid.uuid4().hex}-index", buckets=8, most=20)
    post = search.postings(a, "id", {"title": F.col("title")}).join(a.select("id", "ts"), "id").select("term", F.col("id").alias("key"), "w", "ts")
    for part in range(3):
        store.merge(post.where(F.pmod("key", F.lit(3)) == part))
    return store.read().drop("df")


# ---- sources

ERRORS = ("SSLError: bad certificate", "ReadTimeout: timed out", "ConnectionError: failed to resolve", "TooManyRedirects: too many redirects", "ValueError: odd")
STATUS = (200, 401, 403, 404, 415, 429, 503, 500, 200, 302)
STEPS = ("backoff-3s", "feedreader", "ssl-lenient", "gn-mirror", "googlebot-UA")


def source_log(s: SparkSession, d: str) -> DataFrame:
    """A log of fetches by users: status, error and second tries that work follow from the events' ids."""
    i = F.col("event_id")
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (F.pmod(k, F.lit(len(values))) + 1).cast("int"))
    h = F.xxhash64("event_id")
    error = F.when(F.pmod(h, F.lit(4)) == 0, pick(ERRORS, F.shiftright(h, 7)))
    works = F.when(F.pmod(F.shiftright(h, 3), F.lit(3)) == 0, F.array(pick(STEPS, F.shiftright(h, 11)), pick(STEPS, F.shiftright(h, 17))))
    return table(s, d, "events").select(F.concat(F.lit("source"), (F.col("user_id") % 50).cast("string")).alias("source"), (i * 400).alias("ts"), pick(STATUS, F.shiftright(h, 23)).alias("http"), error.alias("error"), F.pmod(F.shiftright(h, 29), F.lit(3)).cast("int").alias("entries"), works.alias("works"))


@query()
def source_ladder(s, d):
    """Reasons, second tries and pauses of every source's cycles; a plain loop tests it."""
    out = fetching.cycles(source_log(s, d))
    return out.select("source", "ts", "reason", F.array_join("tried", ",").alias("tried"), "recovered", "failures", "open_until")
