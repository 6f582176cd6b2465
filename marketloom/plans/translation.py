"""Registered queries of the Persian desk: post-editing with a lexicon."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions import text
from marketloom.operators import postedit
from marketloom.plans.catalog import docs, query
from marketloom.sources.readers import table
from marketloom.store import materialise

#: Persian letters that stand for a to z in the renderings of test terms.
LETTERS = "ابتثجچحخدذرزسشصضطظعغفقکلمن"


def conversation_terms(s: SparkSession, d: str) -> DataFrame:
    """A lexicon from conversations: their words and pairs of words in two or more turns, spelt with Persian letters.

    The confidence follows the length; words of nine letters have a second,
    other rendering, so they are ambiguous.
    """
    # one pass over a text: its runs of letters and digits, of which those of three to thirty Latin letters are kept
    runs = F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z]{3,30}+)(?![\p{L}\p{N}])|[\p{L}\p{N}]+"), 1)
    w = table(s, d, "conversations").select(F.array_remove(runs, "").alias("w"))
    pairs = F.zip_with(F.col("w"), F.slice("w", 2, F.size("w")), lambda a, b: F.concat(a, F.lit(" "), b))
    counted = w.select(F.explode(F.concat("w", pairs)).alias("en")).where("en is not null").groupBy("en").agg(F.count("*").alias("n")).where("n >= 2")
    fa = F.translate("en", "abcdefghijklmnopqrstuvwxyz", LETTERS)
    base = counted.select("en", fa.alias("fa"), F.when(F.length("en") >= 4, 0.9).otherwise(0.5).alias("confidence"), (F.length("en") % 2 == 0).alias("entity"))
    return base.unionByName(base.where(F.length("en") == 9).withColumn("fa", F.reverse("fa")))


@query()
def post_edited(s, d):
    """Every article after post-editing, as digests; no SQL can follow greedy windows, a plain loop does."""
    lexicon = materialise(postedit.lexicon(conversation_terms(s, d)), "lexicon")
    out = postedit.edit(docs(s, d).select("doc_id", "text"), lexicon)
    return out.select("doc_id", F.md5("edited").alias("edited_md5"), (F.col("edited") != F.col("text")).alias("changed"))


def persian_stories(s: SparkSession, d: str) -> DataFrame:
    """Articles spelt with Persian letters: the first line as title, every other line a paragraph."""
    spelt = F.translate(F.lower(F.coalesce("text", F.lit(""))), "abcdefghijklmnopqrstuvwxyz", LETTERS)
    return docs(s, d).select("doc_id", spelt.alias("text")).select("doc_id", F.concat(F.lit("خبر "), text.title_of(F.col("text"))).alias("title"), F.lit(None).cast("string").alias("summary"), F.split("text", "\n").alias("paragraphs"))


@query()
def composed_posts(s, d):
    """A post from every article that gives one; a plain version of the rules tests it."""
    from marketloom.operators import posts

    terms = conversation_terms(s, d).where("entity").select(F.col("fa").alias("name"))
    made = posts.compose(persian_stories(s, d), terms)
    return made.select("doc_id", F.col("post.title").alias("title"), F.coalesce(F.size("post.blocks"), F.lit(0)).alias("blocks"), F.md5("post.text").alias("text_md5"))


@query()
def editorial_blocks(s, d):
    """Lead and caveat of every article; a plain loop tests it."""
    from marketloom.operators import posts

    rows = docs(s, d).select("doc_id", F.col("text").alias("summary"))
    return posts.editorial(rows).select("doc_id", "editorial.lead", "editorial.caveat")
