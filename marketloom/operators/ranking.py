"""Ranks, top-N, interleaving and assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upper_median(values: Column) -> Column:
    """The element in the middle, the upper one of two."""
    s = F.array_sort(values)
    return F.element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int"))


def upper_medians(df: DataFrame, group: str, value: str, into: str, cells: int = 1024) -> DataFrame:
    """(group, into): the upper median of each group's values.

    Distinct values are counted in ``cells`` ranges between a group's least and
    largest value; only the range with the middle is then put in order, so no
    group is gathered unless all its values lie in one range.
    """
    v = df.groupBy(group, value).agg(F.count("*").alias("m"))
    span = v.groupBy(group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.sum("m").alias("n"))
    cell = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(cells - 1), F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * cells))).otherwise(0)
    placed = v.join(span, group).withColumn("cell", cell).withColumn("want", F.floor(F.col("n") / 2) + 1)
    sizes = placed.groupBy(group, "cell", "want").agg(F.sum("m").alias("c"))
    sizes = sizes.withColumn("upto", F.sum("c").over(W.partitionBy(group).orderBy("cell")))
    middle = sizes.where((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("c") < F.col("want"))).select(group, "cell", (F.col("want") - F.col("upto") + F.col("c")).alias("rest"))
    inside = placed.join(middle, [group, "cell"]).withColumn("run", F.sum("m").over(W.partitionBy(group).orderBy(value)))
    return inside.where(F.col("run") >= F.col("rest")).groupBy(group).agg(F.min(value).alias(into))


def midrank(df: DataFrame, value: str, into: str = "pct", ranges: int = 64) -> DataFrame:
    """Mid-rank share of positive values in the whole frame, ties averaged; others 0.

    The frame is cut into value ranges by approximate quantiles; ranks inside
    a range come from a window over that range, and a bounded table of range
    sizes gives the rest, so no window sees all rows.
    """
    positive = df.where(F.col(value) > 0)
    cuts = sorted(set(positive.approxQuantile(value, [k / ranges for k in range(1, ranges)], 0.01)))
    of = F.aggregate(F.array(*[F.lit(c) for c in cuts]), F.lit(0), lambda a, c: a + (F.col(value) > c).cast("int")) if cuts else F.lit(0)
    ties = positive.groupBy(F.col(value).alias("v"), of.alias("range")).agg(F.count("*").alias("m"))
    sizes = ties.groupBy("range").agg(F.sum("m").alias("size"))
    total = sizes.agg(F.sum("size").alias("n"))
    below = sizes.alias("a").join(F.broadcast(sizes.alias("b")), F.col("b.range") < F.col("a.range"), "left").groupBy("a.range").agg(F.coalesce(F.sum("b.size"), F.lit(0)).alias("below"))
    inner = W.partitionBy("range").orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    ranked = ties.withColumn("before", F.coalesce(F.sum("m").over(inner), F.lit(0))).join(F.broadcast(below), "range").crossJoin(F.broadcast(total))
    share = ranked.select("v", ((F.col("below") + F.col("before") + F.col("m") / 2) / F.col("n")).alias(into))
    return df.join(share, df[value] == share["v"], "left").drop("v").withColumn(into, F.coalesce(into, F.lit(0.0)))


def top_per_bucket(df: DataFrame, bucket: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(W.partitionBy(*bucket).orderBy(*order))).where(F.col("rn") <= n)


def top_relaxed(df: DataFrame, group: str, bucket: str, score: str, order: list[Column], n: int, high: float, low: float, least: int = 4) -> DataFrame:
    """Top n of every bucket above a quality bar; a group with too few rows above it falls back to the lower bar."""
    strict = df.where(F.col(score) >= high).groupBy(group).agg(F.count("*").alias("strict"))
    both = df.where(F.col(score) >= low).join(strict, group, "left")
    chosen = both.where((F.col(score) >= high) | (F.coalesce("strict", F.lit(0)) < least))
    return top_per_bucket(chosen, [group, bucket], order, n).drop("strict")


def diversified(df: DataFrame, key: str, order: list[Column], n: int = 20) -> DataFrame:
    """The best row of every key first, then the rest by score."""
    first = df.withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    return first.withColumn("later", (F.col("rn") > 1).cast("int")).orderBy("later", *order).limit(n).drop("rn")


def round_robin(df: DataFrame, lane: str, lanes: list[str], order: list[Column], n: int) -> DataFrame:
    """Rows of lanes in turn, in the given lane order."""
    ranked = top_per_bucket(df.where(F.col(lane).isin(lanes)), [lane], order, n)
    place = F.array_position(F.array(*[F.lit(x) for x in lanes]), F.col(lane))
    return ranked.orderBy("rn", place).limit(n)


def claim(pairs: DataFrame, item: str, order: list[Column]) -> DataFrame:
    """Each item goes to one owner, the first in order; a partial minimum, not a window."""
    return pairs.groupBy(item).agg(F.min(F.struct(*order)).alias("best"))
