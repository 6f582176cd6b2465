"""Prices after events, and how they agree with sentiment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def checkpoints(events: DataFrame, ticks: DataFrame, hours: tuple[int, ...] = (1, 4, 24)) -> DataFrame:
    """First price at or after each horizon, for events (id, symbol, ts) and ticks (symbol, ts, price, tick).

    Horizons and ticks are sorted together inside hours of a symbol, so a
    horizon finds the first tick after it in one running minimum.  Hours
    without a later tick take the first tick of the next hour that has one,
    whatever the delay; the first tick of every hour is a partial minimum, and
    a running minimum over a symbol's hours carries it back.
    """
    hour = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / 3600)
    tick = F.struct("ts", "tick", "price")
    goals = events.select("id", "symbol", F.explode(F.array(*[F.struct(F.lit(h).alias("h"), (F.col("ts") + F.make_interval(hours=F.lit(h))).alias("at")) for h in hours])).alias("g")).select("id", "symbol", "g.h", "g.at")
    own = ticks.select("symbol", F.col("ts").alias("at"), tick.alias("p"))
    both = goals.unionByName(own, allowMissingColumns=True).withColumn("bucket", hour("at"))
    backwards = W.partitionBy("symbol", "bucket").orderBy(F.desc("at")).rangeBetween(W.unboundedPreceding, W.currentRow)
    found = both.withColumn("first", F.min("p").over(backwards)).where("h is not null").select("id", "symbol", "h", "bucket", "first")
    firsts = ticks.withColumn("b", hour("ts")).groupBy("symbol", "b").agg(F.min(tick).alias("q"))
    open_ = found.where("first is null").select("symbol", "bucket").distinct()
    hours_ = open_.unionByName(firsts.select("symbol", F.col("b").alias("bucket"), "q"), allowMissingColumns=True)
    after = W.partitionBy("symbol").orderBy(F.desc("bucket")).rangeBetween(W.unboundedPreceding, -1)
    later = hours_.withColumn("next", F.min("q").over(after)).where("q is null").select("symbol", "bucket", "next")
    placed = found.join(later, ["symbol", "bucket"], "left").withColumn("p", F.coalesce("first", "next")).where("p is not null")
    return placed.select("id", "h", F.col("p.price").alias("price_after"), F.col("p.ts").alias("at"))


def moves(rows: DataFrame, least: int = 5) -> DataFrame:
    """By symbol and horizon: mean % move after positive and negative events, share of agreeing signs; null under ``least`` events."""
    move = (F.col("price_after") - F.col("price")) / F.col("price") * 100
    r = rows.where("price <> 0").withColumn("move", move)
    agree = F.avg(F.when(F.col("sentiment") != 0, (F.signum("sentiment") == F.signum("move")).cast("int")))
    few = F.count("*") < least
    return r.groupBy("symbol", "h").agg(F.count("*").alias("events"), F.when(~few, F.avg(F.when(F.col("sentiment") > 0, F.col("move")))).alias("move_pos"), F.when(~few, F.avg(F.when(F.col("sentiment") < 0, F.col("move")))).alias("move_neg"), F.when(~few, agree).alias("accuracy"))
