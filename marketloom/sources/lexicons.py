"""Lexicon builds: word counts of a wiki dump, entities of graph-store answers, names that match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.persian import LETTERS, ZWNJ

PAGE = "title string, ns string, redirect struct<_title:string>, revision struct<text:string>"

#: What a wiki text loses, in this order; templates go from the inside out.
MARKUP = (
    (r"(?s)<!--.*?-->", " "),
    (r"(?s)<ref[^>]*/>|<ref[^>]*>.*?</ref>", " "),
    (r"(?s)\{\|.*?\|\}", " "),
)
TEMPLATE = r"(?s)\{\{[^{}]*\}\}"
LINKS = (
    (r"(?i)\[\[(?:فایل|پرونده|Image|File|رده|Category):[^\]]*\]\]", " "),
    (r"\[\[([^\]|]+)\|([^\]]+)\]\]", "$2"),
    (r"\[\[([^\]]+)\]\]", "$1"),
    (r"https?://\S+|www\.\S+", " "),
    (r"</?[a-zA-Z][^>]*>", " "),
)


def wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """(title, text): article pages of a landed XML dump, packed or not; other namespaces, redirects and empty pages are skipped.

    The file is read as text that ends at ``</page>``, which Spark splits among
    tasks, in a bz2 file too; each page is then parsed on its own, but for
    those whose head names another namespace.
    """
    cut = spark.read.option("lineSep", "</page>").text(path).where(F.contains("value", F.lit("<page>")))
    page = F.concat(F.lit("<page>"), F.substring_index("value", "<page>", -1), F.lit("</page>"))
    # a generator keeps what it makes: a page is parsed once, not once a condition
    rows = cut.select(page.alias("page")).where(~elsewhere(F.col("page"))).select(F.explode(F.array(F.from_xml("page", PAGE, {"rowTag": "page"}))).alias("p")).select("p.*")
    text = F.col("revision.text")
    return rows.where((F.trim("ns") == "0") & (F.length(F.coalesce(text, F.lit(""))) > 0) & ~F.upper(F.ltrim(text)).startswith("#REDIRECT")).select(F.coalesce("title", F.lit("")).alias("title"), text.alias("text"))


def elsewhere(page: Column) -> Column:
    """Whether a page surely is of another namespace than that of articles, by its one ``ns`` before the revision; comments and CDATA leave it open."""
    head = F.substring_index(page, "<revision", 1)
    return ~F.contains(head, F.lit("<!")) & (F.size(F.split(head, "<ns")) == 2) & head.rlike(r"<ns>\s*-?[1-9][0-9]*\s*</ns>")


def without_markup(text: Column, depth: int = 8) -> Column:
    """A wiki text without comments, references, tables, templates (nested up to ``depth``), links' targets and tags."""
    for pattern, by in (*MARKUP, *[(TEMPLATE, " ")] * depth, *LINKS):
        text = F.regexp_replace(text, pattern, by)
    return text


def persian_words(text: Column) -> Column:
    """Words of two or more Persian letters, without joiners at their ends."""
    plain = F.translate(F.coalesce(text, F.lit("")), "يىكـ", "ییک")
    found = F.regexp_extract_all(plain, F.lit(rf"([{LETTERS}{ZWNJ}]+)"), 1)
    return F.filter(F.transform(found, lambda w: F.btrim(w, F.lit(ZWNJ))), lambda w: F.length(w) >= 2)


def word_frequencies(pages: DataFrame, feeds: DataFrame, least: int = 2) -> DataFrame:
    """(word, wiki_count, feed_count, total) of dump pages (text) and own feeds (text): words seen ``least`` times, or once in a feed."""
    each = pages.select(F.explode(persian_words(without_markup(F.col("text")))).alias("word"), F.lit(1).alias("w"), F.lit(0).alias("f")).unionByName(feeds.select(F.explode(persian_words(F.col("text"))).alias("word"), F.lit(0).alias("w"), F.lit(1).alias("f")))
    n = each.groupBy("word").agg(F.sum("w").alias("wiki_count"), F.sum("f").alias("feed_count"))
    return n.withColumn("total", F.col("wiki_count") + F.col("feed_count")).where((F.col("total") >= least) | (F.col("feed_count") >= 1))


def entities(answers: DataFrame) -> DataFrame:
    """(qid, kind, en, fa, aliases_en, aliases_fa, source): one row an entity, from bindings (place, qid, kind, en, fa, en_alt, fa_alt, source).

    Bindings without both labels don't count.  The first one gives labels and
    kind; other names, without it, are aliases in the order of their first place.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " "))
    rows = answers.where((plain("en") != "") & (plain("fa") != "") & F.col("qid").isNotNull()).select("place", "qid", "kind", "source", *[plain(c).alias(c) for c in ("en", "fa", "en_alt")], F.btrim(plain("fa_alt"), F.lit("\"'()[]{} ")).alias("fa_alt"))
    first = rows.groupBy("qid").agg(F.min_by(F.struct("kind", "en", "fa", "source"), "place").alias("e"))
    out = first.select("qid", "e.*")
    for alt, label in (("en_alt", "en"), ("fa_alt", "fa")):
        named = rows.where(F.col(alt) != "").groupBy("qid", F.col(alt).alias("alias")).agg(F.min("place").alias("at")).join(first.select("qid", F.col(f"e.{label}").alias("own")), "qid").where("alias <> own")
        seen = named.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "alias"))), lambda x: x["alias"]).alias(f"aliases_{label}"))
        out = out.join(seen, "qid", "left").withColumn(f"aliases_{label}", F.coalesce(f"aliases_{label}", F.array().cast("array<string>")))
    return out.select("qid", "kind", "en", "fa", "aliases_en", "aliases_fa", "source")


def plain_name(name: Column) -> Column:
    """A name without its points, commas and the words of its legal form."""
    low = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[.,]", " "), "'", "")
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"\b(?:the|group|inc|corp|corporation|company|holding)s?\b", " "), r"\s+", " "))


def names_match(one: Column, two: Column) -> Column:
    """Whether one name contains the other, or both share a word of five letters or more."""
    a, b = plain_name(one), plain_name(two)
    long = lambda c: F.filter(F.split(c, " "), lambda w: F.length(w) >= 5)
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a) | F.arrays_overlap(long(a), long(b)))
