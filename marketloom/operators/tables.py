"""Upserts, retention and differences of keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, keep_if_empty: tuple[str, ...] = (), never: tuple[str, ...] = ()) -> DataFrame:
    """Rows by key: new values win, but for ``never`` columns, and for ``keep_if_empty`` columns whose new value is ''."""
    o, n = old.select(*[F.col(c).alias(f"o_{c}") for c in old.columns]), new.select(*[F.col(c).alias(f"n_{c}") for c in old.columns])
    both = o.join(n, o[f"o_{key}"] == n[f"n_{key}"], "full")
    matched = F.col(f"o_{key}").isNotNull() & F.col(f"n_{key}").isNotNull()
    out = []
    for c in old.columns:
        a, b = F.col(f"o_{c}"), F.col(f"n_{c}")
        if c in never:
            v = F.when(matched, a).otherwise(F.coalesce(b, a))
        elif c in keep_if_empty:
            v = F.when(matched & (F.coalesce(b, F.lit("")) == ""), a).otherwise(F.coalesce(b, a))
        else:
            v = F.when(F.col(f"n_{key}").isNotNull(), b).otherwise(a)
        out.append(v.alias(c))
    return both.select(*out)


def latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of every key: a partial maximum of structs, not a window."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max(F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)], F.struct(*rest).alias("row"))).alias("b"))
    return best.select(key, "b.row.*")


def retain(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of every key in order (a group limit runs before the shuffle)."""
    return df.withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("rn") <= n).drop("rn")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, old, new, direction) of changed, added and removed keys."""
    a, b = before.select(F.col(key), F.col(value).alias("old")), after.select(F.col(key), F.col(value).alias("new"))
    diff = a.join(b, key, "full").where(~F.col("old").eqNullSafe(F.col("new")))
    way = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("new") > F.col("old"), "up").otherwise("down")
    return diff.withColumn("direction", way)
