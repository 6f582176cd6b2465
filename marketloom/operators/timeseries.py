"""Candles and indicators over them.

Ticks are first resampled to bars with partial aggregates, whatever the share
of one symbol; a symbol's bars are bounded by calendar time, so windows and
folds over one symbol's bars stay small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def candles(ticks: DataFrame, symbol: str, ts: str, price: str, tie: str, hours: int = 4) -> DataFrame:
    """Bars (symbol, bucket, time, open, high, low, close, volume): time is the first tick's, ties in time by id."""
    order = F.struct(F.col(ts), F.col(tie))
    bucket = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / (hours * 3600))
    return (
        ticks.where(F.col(price).isNotNull())
        .groupBy(F.col(symbol).alias("symbol"), bucket.alias("bucket"))
        .agg(F.min(ts).alias("time"), F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count("*").alias("volume"))
    )


def _by() -> W:
    return W.partitionBy("symbol").orderBy("bucket")


def _frame(n: int) -> W:
    return _by().rowsBetween(1 - n, 0)


def full(n: int, value: Column) -> Column:
    """A frame's value, null before n bars."""
    return F.when(F.count(F.lit(1)).over(_frame(n)) == n, value)


def sma(bars: DataFrame, n: int = 20) -> DataFrame:
    return bars.withColumn(f"sma_{n}", full(n, F.avg("close").over(_frame(n))))


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    mid, dev = F.avg("close").over(_frame(n)), F.stddev_pop("close").over(_frame(n))
    return bars.withColumn("mid", full(n, mid)).withColumn("upper", full(n, mid + k * dev)).withColumn("lower", full(n, mid - k * dev))


def stochastic(bars: DataFrame, n: int = 14, d: int = 3) -> DataFrame:
    """%K of the frame (50 when flat, two decimals) and %D, the mean of d rounded %K, rounded too."""
    hi, lo = F.max("high").over(_frame(n)), F.min("low").over(_frame(n))
    k = full(n, F.when(hi > lo, (F.col("close") - lo) / (hi - lo) * 100).otherwise(50.0))
    out = bars.withColumn("k", F.round(k, 2))
    return out.withColumn("d", F.when(F.count("k").over(_frame(d)) == d, F.round(F.avg("k").over(_frame(d)), 2)))


def pct_change(bars: DataFrame, n: int = 7) -> DataFrame:
    old = F.lag("close", n).over(_by())
    return bars.withColumn(f"pct_{n}", F.when(old != 0, (F.col("close") - old) / old * 100))


def pivot_levels(bars: DataFrame, lookback: int = 60, least: int = 10) -> DataFrame:
    """For each symbol: last price, highest close below it and lowest above it in the last bars."""
    last = bars.withColumn("rn", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("bucket")))).where(F.col("rn") <= lookback)
    spot = last.groupBy("symbol").agg(F.max_by("close", "bucket").alias("spot"), F.count("*").alias("bars"))
    return last.join(spot, "symbol").groupBy("symbol", "spot", "bars").agg(F.max(F.when((F.col("close") < F.col("spot")) & (F.col("bars") >= least), F.col("close"))).alias("support"), F.min(F.when((F.col("close") > F.col("spot")) & (F.col("bars") >= least), F.col("close"))).alias("resistance"))


def realized_vol(bars: DataFrame, n: int = 30, periods: int = 365) -> DataFrame:
    """Deviation of the last n returns, annualised, in percent."""
    ret = bars.withColumn("ret", F.col("close") / F.lag("close").over(_by()) - 1)
    return ret.withColumn("vol", F.when(F.count("ret").over(_frame(n)) == n, F.stddev_pop("ret").over(_frame(n)) * F.sqrt(F.lit(float(periods))) * 100)).drop("ret")


# ---- recursive indicators: folds over a symbol's closes in order


def series(bars: DataFrame) -> DataFrame:
    """(symbol, closes, highs, lows, volumes): arrays in time order."""
    rows = F.array_sort(F.collect_list(F.struct("bucket", "close", "high", "low", F.col("volume").cast("double").alias("volume"))))
    s = bars.groupBy("symbol").agg(rows.alias("s"))
    return s.select("symbol", F.col("s.close").alias("closes"), F.col("s.high").alias("highs"), F.col("s.low").alias("lows"), F.col("s.volume").alias("volumes"))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def ema(values: Column, p: int) -> Column:
    """Last exponential mean, seeded with the mean of the first p; null when short."""
    k = 2.0 / (p + 1)
    folded = F.aggregate(F.slice(values, F.lit(p + 1), F.greatest(F.lit(0), F.size(values) - p)), _mean(F.slice(values, 1, p)), lambda a, x: x * k + a * (1 - k))
    return F.when(F.size(values) >= p, folded)


def ema_series(values: Column, p: int) -> Column:
    """All exponential means from the p-th value on."""
    k = 2.0 / (p + 1)
    rest = F.slice(values, F.lit(p + 1), F.greatest(F.lit(0), F.size(values) - p))
    return F.when(F.size(values) >= p, F.aggregate(rest, F.array(_mean(F.slice(values, 1, p))), lambda a, x: F.concat(a, F.array(x * k + F.element_at(a, -1) * (1 - k)))))


def ema_aligned(values: Column, p: int) -> Column:
    """The exponential means with nulls before the p-th value, as long as the values."""
    pad = F.array_repeat(F.lit(None).cast("double"), F.least(F.size(values), F.lit(p - 1)))
    return F.concat(pad, F.coalesce(ema_series(values, p), F.array().cast("array<double>")))


def tail(rows: DataFrame, n: int) -> DataFrame:
    """The last ``n`` bars of every symbol."""
    rn = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("bucket")))
    return rows.withColumn("_rn", rn).where(F.col("_rn") <= n).drop("_rn")


def rsi_series(values: Column, p: int = 14) -> Column:
    """Relative strength of every bar from the p-th change on; unlike the latest value, a flat series has 100."""
    d = deltas(values)
    gains, losses = F.transform(d, lambda x: F.greatest(x, F.lit(0.0))), F.transform(d, lambda x: F.greatest(-x, F.lit(0.0)))
    at = F.sequence(F.lit(p), F.size(d))
    part = lambda side, i: wilder(F.slice(side, F.lit(1), i), p)
    return F.when(F.size(d) >= p, F.transform(at, lambda i: F.when(part(losses, i) == 0, 100.0).otherwise(100 - 100 / (1 + part(gains, i) / F.nullif(part(losses, i), F.lit(0.0))))))


def wilder(values: Column, p: int) -> Column:
    """Wilder's mean: the mean of the first p, then (p - 1) parts old and one part new."""
    return F.when(F.size(values) >= p, F.aggregate(F.slice(values, F.lit(p + 1), F.greatest(F.lit(0), F.size(values) - p)), _mean(F.slice(values, 1, p)), lambda a, x: (a * (p - 1) + x) / p))


def deltas(values: Column) -> Column:
    """Differences of neighbours."""
    n = F.size(values)
    later = F.slice(values, F.lit(2), F.greatest(F.lit(0), n - 1))
    return F.zip_with(later, F.slice(values, F.lit(1), F.greatest(F.lit(0), n - 1)), lambda b, a: b - a)


def rsi(values: Column, p: int = 14) -> Column:
    """Latest relative strength: 50 for a flat series, 100 without losses."""
    d = deltas(values)
    gain = wilder(F.transform(d, lambda x: F.greatest(x, F.lit(0.0))), p)
    loss = wilder(F.transform(d, lambda x: F.greatest(-x, F.lit(0.0))), p)
    return F.when((gain == 0) & (loss == 0), 50.0).when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / F.nullif(loss, F.lit(0.0))))


def atr(highs: Column, lows: Column, closes: Column, p: int = 14) -> Column:
    """Wilder's mean of the true range against the close before."""
    n = F.greatest(F.lit(0), F.size(closes) - 1)
    rows = F.arrays_zip(F.slice(highs, F.lit(2), n).alias("h"), F.slice(lows, F.lit(2), n).alias("l"), F.slice(closes, F.lit(1), n).alias("c"))
    return wilder(F.transform(rows, lambda r: F.greatest(r["h"] - r["l"], F.abs(r["h"] - r["c"]), F.abs(r["l"] - r["c"]))), p)


def macd(values: Column, fast: int = 12, slow: int = 26, signal: int = 9) -> Column:
    """struct(macd, signal, hist) of the last bar; null under slow + signal bars."""
    short, long = ema_series(values, fast), ema_series(values, slow)
    line = F.zip_with(F.slice(short, F.lit(slow - fast + 1), F.greatest(F.lit(0), F.size(long))), long, lambda a, b: a - b)
    last, sig = F.element_at(line, -1), ema(line, signal)
    return F.when(F.size(values) >= slow + signal, F.struct(last.alias("macd"), sig.alias("signal"), (last - sig).alias("hist")))


def change(values: Column, n: int) -> Column:
    old = F.try_element_at(values, -F.lit(n + 1))
    return F.when(old != 0, (F.element_at(values, -1) - old) / old * 100)


def snapshot(bars: DataFrame) -> DataFrame:
    """One row of indicators for each symbol."""
    s, c, v = series(bars), F.col("closes"), F.col("volumes")
    tail = lambda x, a, n: F.slice(x, F.size(x) - a + 1, n)
    ratio = F.when(F.size(v) >= 30, _mean(tail(v, 7, 7)) / F.nullif(_mean(tail(v, 30, 23)), F.lit(0.0)))
    m = macd(c)
    return s.select("symbol", F.size(c).alias("bars"), F.element_at(c, -1).alias("price"), ema(c, 20).alias("ema_20"), rsi(c).alias("rsi_14"), m["macd"].alias("macd"), m["signal"].alias("macd_signal"), m["hist"].alias("macd_hist"), atr(F.col("highs"), F.col("lows"), c).alias("atr_14"), change(c, 7).alias("chg_7"), change(c, 30).alias("chg_30"), change(c, 90).alias("chg_90"), ratio.alias("volume_ratio"))


# ---- anomalies of counts per cycle


def volume_ratio(counts: DataFrame, least: int = 5, most: float = 3.0) -> DataFrame:
    """(symbol, cycle, n, ratio, anomaly): current count against the mean of at most 99 before it."""
    before = W.partitionBy("symbol").orderBy("cycle").rowsBetween(-99, -1)
    ratio = F.when(F.count("n").over(before) >= least - 1, F.col("n") / F.avg("n").over(before))
    return counts.withColumn("ratio", ratio).withColumn("anomaly", F.coalesce(F.col("ratio") >= most, F.lit(False)))


def volume_zscore(counts: DataFrame, window: int = 30, threshold: float = 2.5, severe: float = 3.5) -> DataFrame:
    """Adds z against the cycles before (deviation 0: half steps) and a severity."""
    before = W.partitionBy("symbol").orderBy("cycle").rowsBetween(1 - window, -1)
    mu, sd = F.avg("n").over(before), F.stddev_pop("n").over(before)
    z = F.when(F.count("n").over(before) >= 4, F.when(sd > 0, (F.col("n") - mu) / sd).when(F.col("n") > mu, (F.col("n") - mu) / 0.5).otherwise(0.0))
    return counts.withColumn("z", z).withColumn("severity", F.when(F.col("z") >= severe, "high").when(F.col("z") >= threshold, "medium").otherwise("none"))


def crossover(scores: DataFrame, short: int = 5, long: int = 20, band: float = 0.05, push: float = 0.1, least: int = 10) -> DataFrame:
    """(symbol, points, fast, slow, momentum, prediction, confidence) of the last cycle of (symbol, cycle, score).

    A prediction needs the means ``band`` apart and a momentum beyond ``push``:
    the change over the last ten scores against the first of them (0.01 at
    least), bounded by 1.  Symbols with fewer than ``least`` scores are neutral,
    without numbers.
    """
    order = W.partitionBy("symbol").orderBy("cycle")
    f, s = F.avg("score").over(order.rowsBetween(1 - short, 0)), F.avg("score").over(order.rowsBetween(1 - long, 0))
    first = F.lag("score", 9).over(order)
    momentum = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("score") - first) / F.greatest(F.abs(first), F.lit(0.01))))
    rows = scores.withColumn("fast", f).withColumn("slow", s).withColumn("momentum", momentum).withColumn("points", F.count("*").over(order))
    last = rows.withColumn("rn", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("cycle")))).where("rn = 1")
    gap, m = F.col("fast") - F.col("slow"), F.col("momentum")
    guess = F.when((gap > band) & (m > push), "bullish").when((gap < -band) & (m < -push), "bearish").otherwise("neutral")
    sure = F.when(guess == "neutral", 1.0 - F.least(F.lit(1.0), F.abs(gap) * 5)).otherwise(F.least(F.lit(1.0), F.abs(gap) * 5 + F.abs(m)))
    few = F.col("points") < least
    known = lambda c: F.when(~few, c)
    return last.select("symbol", "points", *[known(F.col(c)).alias(c) for c in ("fast", "slow", "momentum")], F.when(few, "neutral").otherwise(guess).alias("prediction"), F.when(few, 0.0).otherwise(sure).alias("confidence"))
