"""Ranked full-text search over postings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.functions.text import words

#: Weights of the fields of an article.
FIELD_WEIGHTS = {"title": 3.0, "summary": 1.0, "source": 0.4}


def postings(docs: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """(term, key, w): each term of a document with the sum of its fields' weights."""
    parts = [docs.select(key, F.explode(F.array_distinct(F.filter(words(c), lambda t: F.length(t) >= 2))).alias("term"), F.lit(FIELD_WEIGHTS[f]).alias("w")) for f, c in fields.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("term", key).agg(F.sum("w").alias("w"))


def expansions(post: DataFrame, terms: list[str], most: int = 8) -> DataFrame:
    """(q, term, df): for each query term at most ``most`` vocabulary terms that begin with it, the exact one and then the most frequent first.

    The vocabulary is filtered by the prefixes before it is counted; the result
    has ``most`` rows a query term.
    """
    q = F.explode(F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.col("term").startswith(t))).alias("q")
    starts = reduce(lambda a, b: a | b, [F.col("term").startswith(t) for t in terms])
    counted = post.where(starts).groupBy("term").agg(F.count("*").alias("df")).select("term", "df", q)
    order = W.partitionBy("q").orderBy((F.col("term") != F.col("q")).cast("int"), F.desc("df"), "term")
    return counted.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most).drop("rn")


def search(post: DataFrame, key: str, total: int, terms: list[str], relax: int = 3, most: int = 8, ages: DataFrame | None = None, half_life: float = 36.0, limit: int | None = None) -> DataFrame:
    """(key, score, matched): idf x (1 + ln(1 + w)), prefix matches count less than exact ones.

    Documents with all terms are wanted; with fewer than ``relax`` of them,
    documents with any term come too.  Scores grow with the share of terms and,
    with ``ages`` (key, age_hours), fall to 0.35 with age; ``limit`` keeps the best.
    """
    terms = list(dict.fromkeys(terms))
    chosen = F.broadcast(expansions(post, terms, most))  # ``most`` rows a term
    scored = post.join(chosen, "term").select("q", key, (F.log(1 + F.lit(float(total)) / (1 + F.col("df"))) * (1 + F.log(1 + F.col("w"))) * F.when(F.col("term") == F.col("q"), 1.6).otherwise(1.0)).alias("s"))
    each = scored.groupBy(key, "q").agg(F.max("s").alias("s")).groupBy(key).agg(F.sum("s").alias("s"), F.count("*").alias("matched"))
    score = F.col("s") * (0.45 + 0.55 * F.col("matched") / len(terms))
    if ages is not None:
        each = each.join(ages.select(key, "age_hours"), key)
        score = score * (0.35 + 0.65 * F.pow(F.lit(0.5), F.greatest(F.lit(0.0), F.col("age_hours")) / half_life))
    out = each.select(key, score.alias("score"), "matched")
    # a single row tells how many documents have every term
    full = out.agg(F.count_if(F.col("matched") == len(terms)).alias("full"))
    out = out.crossJoin(F.broadcast(full)).where((F.col("matched") == len(terms)) | (F.col("full") < relax)).drop("full")
    return out.orderBy(F.desc("score"), key).limit(limit) if limit else out
