"""Audits: token censuses, n-grams, strata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.functions.text import words
from marketloom.store import discard, materialise


def ngram_counts(df: DataFrame, text: str, sizes: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """(gram, size, n) over all rows."""
    w = df.select(words(F.coalesce(F.col(text), F.lit(""))).alias("w"))

    def grams(k: int):
        return F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " ")) if k > 1 else F.col("w")

    parts = [w.where(F.size("w") >= k).select(F.explode(grams(k)).alias("gram"), F.lit(k).alias("size")) for k in sizes]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("gram", "size").agg(F.count("*").alias("n"))


#: Frequent words up to this many are looked up as a set of literals.
MOST_WORDS = 4096


def _runs(w: Column, n: int) -> Column:
    """Runs of ``n`` words of an array column; runs over a null are null."""
    gram = w
    for k in range(1, n):
        gram = F.zip_with(gram, F.slice(w, k + 1, F.greatest(F.size(w) - k, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_compact(gram)


def ngram_top(df: DataFrame, text: str, most: int = 200) -> DataFrame:
    """(gram, size, n): the ``most`` most frequent runs of one to four words, ties by gram and size; stored.

    A run is no more frequent than any of its words, so runs with a word less
    frequent than the last one of the ``most`` first words are none of them and
    are not made.
    """
    one = materialise(df.select(F.explode(words(F.coalesce(F.col(text), F.lit("")))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")), "words")
    first = [r.n for r in one.orderBy(F.desc("n")).limit(most).select("n").collect()]
    least = first[-1] if len(first) == most else 1
    often = [r.gram for r in one.where(F.col("n") >= least).limit(MOST_WORDS + 1).select("gram").collect()]
    if len(often) > MOST_WORDS:  # as many words of equal count: all runs are counted
        rows = ngram_counts(df, text)
    else:
        w = df.select(F.transform(words(F.coalesce(F.col(text), F.lit(""))), lambda x: F.when(x.isin(often), x)).alias("w")) if often else df.select(F.array().cast("array<string>").alias("w"))
        runs = [w.select(F.explode(_runs(F.col("w"), k)).alias("gram"), F.lit(k).alias("size")) for k in (2, 3, 4)]
        rows = reduce(lambda a, b: a.unionByName(b), runs).groupBy("gram", "size").agg(F.count("*").alias("n"))
        rows = one.where(F.col("n") >= least).select("gram", F.lit(1).alias("size"), "n").unionByName(rows)
    out = materialise(rows.orderBy(F.desc("n"), "gram", "size").limit(most), "top")
    discard(one)
    return out


def ngram_examples(df: DataFrame, key: str, text: str, grams: DataFrame, most: int = 2) -> DataFrame:
    """Adds ``examples`` to grams (gram, size): the keys of the ``most`` shortest texts with each, found in partial minima.

    ``grams`` is a report of a bounded number of rows and is broadcast; other
    words than its own make no runs.
    """
    often = sorted({w for r in grams.select("gram").collect() for w in r.gram.split(" ")})
    known = lambda x: F.when(x.isin(often), x) if often else F.lit(None).cast("string")
    w = df.select(F.col(key).alias("key"), F.length(text).alias("len"), F.transform(words(F.coalesce(F.col(text), F.lit(""))), known).alias("w"))
    rows = reduce(lambda a, b: a.unionByName(b), [w.select("key", "len", F.explode(F.array_distinct(_runs(F.col("w"), n))).alias("gram"), F.lit(n).alias("size")).join(F.broadcast(grams), ["gram", "size"]) for n in range(1, 5)])
    rank = F.row_number().over(W.partitionBy("gram", "size").orderBy("len", "key"))
    best = rows.withColumn("rank", rank).where(F.col("rank") <= most)
    return best.groupBy(*grams.columns).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "key"))), lambda x: x.key).alias("examples"))


def token_census(df: DataFrame, text: str, good: str) -> DataFrame:
    """(token, total, failing, passing): in how many good and other rows a token occurs."""
    rows = df.select(good, F.explode(F.array_distinct(words(F.coalesce(F.col(text), F.lit(""))))).alias("token"))
    return rows.groupBy("token").agg(F.count("*").alias("total"), F.count_if(~F.col(good)).alias("failing"), F.count_if(F.col(good)).alias("passing"))


def strata(df: DataFrame, stratum: str, good: str) -> DataFrame:
    """(stratum, n, passed, rate), and one row for all."""
    return df.groupingSets([[stratum], []], stratum).agg(F.count("*").alias("n"), F.count_if(F.col(good)).alias("passed"), F.avg(F.col(good).cast("double")).alias("rate"))


def family(df: DataFrame, key: str, variant: str) -> DataFrame:
    """(key, variant, share): the most frequent variant of every key and its share; ties by text."""
    n = df.groupBy(key, variant).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.min_by(variant, F.struct(-F.col("n"), F.col(variant))).alias(variant), (F.max("n") / F.sum("n")).alias("share"))
