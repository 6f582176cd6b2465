"""The numbered queries over the contract's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import decontaminate, dialogue, hmm, infill, licenses, lines, media, minhash, mixing, pieces, quality, toxicity, warc
from marketloom.llm.frames import pick, split_rule


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return pick(spark.read.parquet(f"{sf_dir}/{name}.parquet"), *columns)


def op1_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a lossless WebP image, read back and described."""
    return media.features(media.store(table(spark, sf_dir, "documents", "doc_id", "text")))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; learnt from labelled rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = quality.learn(docs, table(spark, sf_dir, "labels", "doc_id", "quality"), split_rule("doc_id", 5) != 0)
    scored = quality.score(docs, model)
    return scored.select("doc_id", (split_rule("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document, windows of 13 words."""
    found = decontaminate.scan(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    c = F.col("contamination")
    return found.select("doc_id", c.n_words.alias("n_words"), c.n_hit.alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", c["items"]), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every page into archives and reads all records back."""
    records = warc.read(warc.write(table(spark, sf_dir, "pages", "page_id", "url", "html")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated toxicity score of every document; learnt from labelled rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"), split_rule("doc_id", 4) != 2)
    return model.score(docs).select("doc_id", (split_rule("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.85 or more."""
    return minhash.link(table(spark, sf_dir, "documents", "doc_id", "text"), minhash.Rule(width=3, num=85))


def op7_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and hidden Markov log10 probabilities of every document; learnt outside the held-out fold."""
    scored = hmm.run(table(spark, sf_dir, "documents", "doc_id", "text"), split_rule("doc_id", 10) != 0)
    return scored.select("doc_id", (split_rule("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with one occurrence of each group of fuzzily equal lines."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("before", F.coalesce(F.length("text"), F.lit(0)))
    return lines.dedup(docs).select("doc_id", F.col("before").cast("long").alias("chars_before"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars_after"), F.md5("text").alias("text_md5"), "emptied")


def tokenizer() -> str:
    """Path of the public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text decoded from them, as digests."""
    coded = pieces.encode(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), pieces.ids_digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact license phrases and fuzzy short notices of every document."""
    found = licenses.scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    c = F.col("licenses")
    base = F.array_sort(F.array_distinct(c.places.label))
    labels = F.array_sort(F.array_distinct(F.concat(c.places.label, c.notices.label)))
    fuzzy = F.array_max(F.transform(c.notices, lambda n: 1 - n.edits / n.length))
    return found.select(
        "doc_id",
        c.n_words.alias("n_words"),
        F.size(c.places).cast("long").alias("n_base"),
        F.array_min(c.places.word).alias("first_word"),
        F.array_max(c.places.word).alias("last_word"),
        F.concat_ws(",", base).alias("base_labels"),
        F.concat_ws(",", labels).alias("labels"),
        F.when(F.size(c.places) > 0, 1.0).otherwise(F.coalesce(fuzzy, F.lit(0.0))).alias("score"),
        F.transform(c.notices, lambda n: F.struct(n.label.alias("label"), n.first_word.alias("first_word"), n.last_word.alias("last_word"), n.edits.alias("edits"))).alias("notices"),
    )


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a fill-in-the-middle text, and the text rebuilt from it, as digests."""
    made = infill.transform(table(spark, sf_dir, "documents", "doc_id", "text"))
    text, c = F.coalesce("text", F.lit("")), F.col("infill")
    return made.select("doc_id", c.n.alias("n"), c.form.alias("form"), c.prefix_chars.alias("prefix_chars"), c.middle_chars.alias("middle_chars"), F.sha2(text, 256).alias("output_sha256"), F.sha2(infill.restore(text, c.form), 256).alias("restored_sha256"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document a mix of the sources by their weights takes."""
    mix = mixing.sample(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op13_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after planted damage."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return dialogue.report(rows, dialogue.damage(rows))


ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LETTER_WORDS = rf"regexp_extract_all({ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {LETTER_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {LETTER_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS g
       FROM b, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
h AS (SELECT rid, dw.n, i, item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, n, i FROM h), unnest(range(i, i + n)) AS t(p) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
"""


OP4_SQL = """
WITH p AS (SELECT row_number() OVER () AS rid, page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest FROM p),
t AS (SELECT payload_digest, max(page_id) AS target FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1)
SELECT page_id, payload_bytes, d.payload_digest, CASE WHEN target <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN target <> page_id THEN target END AS refers_to, TRUE AS verified
FROM d LEFT JOIN t ON d.payload_digest = t.payload_digest AND d.payload_bytes >= 1000
"""


SPACE_WORDS = rf"regexp_extract_all({ASCII_LOWER}, '[^\x20\x09-\x0D]+')"

OP6_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {SPACE_WORDS} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d),
c AS (SELECT list_sort(g) AS g, min(doc_id) AS rep, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY ALL),
t AS (SELECT rep, n, unnest(g) AS x FROM c),
o AS (SELECT a.rep AS a, b.rep AS b, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb
      FROM t a JOIN t b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.rep, b.rep),
e AS (SELECT a, b FROM o WHERE 100 * common >= 85 * (na + nb - common)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT rep AS node, rep AS other FROM c UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a),
r AS (SELECT node, min(other) AS root FROM reach GROUP BY node)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(root, s.doc_id) AS component_id, s.doc_id = coalesce(root, s.doc_id) AS kept
FROM s LEFT JOIN c ON list_sort(s.g) = c.g LEFT JOIN r ON r.node = c.rep
"""


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
x AS (SELECT *, len(u)::BIGINT AS n, list_transform(range(4), lambda k: ('0x' || substr(h, 8 * k + 1, 8))::BIGINT) AS g FROM d),
c AS (SELECT *, least(g[1] % (n + 1), g[2] % (n + 1)) AS a, greatest(g[1] % (n + 1), g[2] % (n + 1)) AS b,
      CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR g[3] % 100 >= 90 THEN 'plain' WHEN g[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS digest FROM documents),
b AS (SELECT *, (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || digest), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM d),
s AS (SELECT source, sum(size)::DOUBLE AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM b GROUP BY source),
l AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER earlier, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER earlier, 0)) AS level
      FROM s WINDOW earlier AS (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, coalesce(least(2 * source_size, w * (SELECT arg_min(level, source_size / w) FROM l WHERE level * w <= 2 * source_size)), 2 * source_size) AS target FROM l),
k AS (SELECT source, size, count(*) AS n FROM b WHERE size > 0 GROUP BY source, size),
f AS (SELECT k.source, size, (target - 2 * coalesce(sum(size * n) OVER (PARTITION BY k.source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(size * sqrt(size) * n) OVER (PARTITION BY k.source ORDER BY size) AS c
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
c AS (SELECT source, arg_max(c, size) AS c FROM f WHERE c * sqrt(size) <= 2 GROUP BY source),
x AS (SELECT b.*, source_size, target, CASE WHEN size = 0 THEN 0 ELSE coalesce(least(2, c * sqrt(size)), 2) END AS wanted FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source LEFT JOIN c ON b.source IS NOT DISTINCT FROM c.source),
r AS (SELECT *, floor(wanted) AS certain, CASE WHEN wanted > floor(wanted) THEN (u / (1 - u)) / ((wanted - floor(wanted)) / (1 - (wanted - floor(wanted)))) END AS odds, target - sum(floor(wanted) * size) OVER (PARTITION BY source) AS rest FROM x),
o AS (SELECT *, odds IS NOT NULL AND size > 0 AND sum(CASE WHEN odds IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY odds NULLS LAST, digest, doc_id ROWS UNBOUNDED PRECEDING) <= rest AS chosen FROM r),
g AS (SELECT *, rest - coalesce(sum(CASE WHEN chosen THEN size END) OVER (PARTITION BY source), 0) AS gap FROM o),
e AS (SELECT source, arg_min(rid, (abs(size - gap), odds, digest, doc_id)) AS rid FROM g WHERE odds IS NOT NULL AND NOT chosen AND abs(size - gap) < gap GROUP BY source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (certain + chosen::INT + (e.rid IS NOT NULL)::INT)::INT AS copies, ((certain + chosen::INT + (e.rid IS NOT NULL)::INT) * size)::BIGINT AS taken
FROM g LEFT JOIN e ON g.rid = e.rid
"""

OP13_SQL = r"""
WITH RECURSIVE n AS (SELECT row_number() OVER () AS rid, conv_id, turn, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
z AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)),
      lambda h, x: list_reduce([xor(h, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 20 AS kind FROM n),
a AS (SELECT rid, conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM z, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS c(copy)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), rid) AS i, rtrim(text, E' \t\n\x0B\f\r') AS seen, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'x' END AS c FROM a),
p AS (SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS earlier, CASE WHEN seen = '' THEN 'blank' WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate' WHEN seen[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (earlier IS NOT NULL AND earlier || c NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows_left FROM p GROUP BY conv_id),
-- states: - nothing, s, u, a; before each row up to two rows are inserted
ins(state, n, behind, added, signs) AS (VALUES ('-', 0, '-', '', ''), ('-', 1, 'u', E'user:\n', 'I'), ('-', 2, 'a', E'user:\nassistant:\n', 'II'), ('s', 0, 's', '', ''), ('s', 1, 'u', E'user:\n', 'I'), ('s', 2, 'a', E'user:\nassistant:\n', 'II'),
      ('u', 0, 'u', '', ''), ('u', 1, 'a', E'assistant:\n', 'I'), ('u', 2, 'u', E'assistant:\nuser:\n', 'II'), ('a', 0, 'a', '', ''), ('a', 1, 'u', E'user:\n', 'I'), ('a', 2, 'a', E'user:\nassistant:\n', 'II')),
keep(state, c, behind) AS (VALUES ('-', 's', 's'), ('-', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, '-' AS state, {'cost': 0::BIGINT, 'audit': '', 'made': ''} AS best FROM counts
  UNION ALL
  SELECT conv_id, i, state, min(best) FROM (
    SELECT w.conv_id, p.i, e.behind AS state, {'cost': w.best.cost + 5 * ins.n + e.cost, 'audit': w.best.audit || ins.signs || e.sign, 'made': w.best.made || ins.added || e.made} AS best
    FROM walk w JOIN p ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND p.i = w.i + 1 JOIN ins ON ins.state = w.state,
    LATERAL (SELECT ins.behind, 2 AS cost, 'D' AS sign, '' AS made
             UNION ALL SELECT keep.behind, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, 'K', p.role || ':' || p.text || E'\n' FROM keep WHERE keep.state = ins.behind AND keep.c = p.c AND fault NOT IN ('blank', 'duplicate')
             UNION ALL SELECT keep.behind, 1 + CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, 'R', CASE keep.c WHEN 'u' THEN 'user:' ELSE 'assistant:' END || p.text || E'\n' FROM keep WHERE keep.state = ins.behind AND keep.c <> 's' AND fault NOT IN ('blank', 'duplicate')) AS e
  ) GROUP BY conv_id, i, state),
done AS (SELECT w.conv_id, min({'cost': w.best.cost + 5 * ins.n, 'audit': w.best.audit || ins.signs, 'made': w.best.made || ins.added}) AS best
         FROM walk w JOIN counts ON counts.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = rows_left JOIN ins ON ins.state = w.state WHERE ins.behind IN ('-', 'a') GROUP BY w.conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(best.made[:-2], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN counts ON e.conv_id IS NOT DISTINCT FROM counts.conv_id LEFT JOIN done ON e.conv_id IS NOT DISTINCT FROM done.conv_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_webp, op2_quality, op3_decontaminate, op4_warc, op5_toxicity, op6_minhash, op7_hmm, op8_line_dedup, op9_sentencepiece, op10_license_scan, op11_infill, op12_mixing, op13_dialogue)}


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": OP3_SQL, "op4_warc": OP4_SQL, "op6_minhash": OP6_SQL, "op11_infill": OP11_SQL, "op12_mixing": OP12_SQL, "op13_dialogue": OP13_SQL}
