"""Demand ranking, dispatch, reactions, and report sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Weights of the factors of a story.
WEIGHTS = {"credibility": 1.0, "coverage": 0.9, "audience": 1.1, "freshness": 1.0, "youtube": 0.9, "telegram": 1.0, "reddit": 0.5}

#: Categories of calendar events, tried in this order.
REACTIONS = (("inflation", "cpi|inflation|ppi"), ("jobs", "payroll|unemploy|jobs"), ("rates", "rate|fomc"), ("other", ""))


def score(df: DataFrame, weights: dict[str, float] = WEIGHTS, repeat: Column | None = None, penalty: float = 0.35) -> DataFrame:
    """Weighted mean of the factor columns in percent; repeated stories keep a share of it."""
    total = reduce(lambda a, b: a + b, [F.lit(w) * F.coalesce(F.col(k), F.lit(0.0)) for k, w in weights.items()])
    value = 100.0 * total / sum(weights.values())
    return df.withColumn("score", value * F.when(repeat, penalty).otherwise(1.0) if repeat is not None else value)


def social_gate(df: DataFrame, scores: DataFrame, key: str, least: int, value: str = "score") -> DataFrame:
    """Rows with a score of at least ``least``; unknown scores fail."""
    return df.join(scores, key, "left").where(F.coalesce(F.col(value) >= least, F.lit(False)))


def queue(articles: DataFrame, posted: DataFrame, keys: list[str], gate: Column, order: list[Column], n: int) -> DataFrame:
    """The next rows to dispatch: past the gate, not in the log, in order."""
    return articles.where(gate).join(posted.select(*keys).distinct(), keys, "left_anti").orderBy(*order).limit(n)


def first_rule(events: DataFrame, key: str, title: Column, rules=REACTIONS) -> DataFrame:
    """Adds the first rule whose pattern matches."""
    out = F.when(title.rlike(f"(?i){rules[0][1]}"), rules[0][0])
    for name, pattern in rules[1:]:
        out = out.when(title.rlike(f"(?i){pattern}"), name)
    return events.withColumn("rule", out)


def reaction_stats(rows: DataFrame) -> DataFrame:
    """By rule: beats, misses, flat events, and the mean move of those that were not flat."""
    moved = F.col("surprise") != 0
    return rows.groupBy("rule").agg(F.count_if(F.col("surprise") > 0).alias("beats"), F.count_if(F.col("surprise") < 0).alias("misses"), F.count_if(~moved).alias("flat"), F.avg(F.when(moved, F.col("move"))).alias("mean_move"))


def sample(df: DataFrame, stratum: str, key: str, n: int) -> DataFrame:
    """The first n rows of every stratum by the MD5 of their key: the same rows each time."""
    h = F.md5(F.col(key).cast("string"))
    return df.withColumn("rn", F.row_number().over(W.partitionBy(stratum).orderBy(h, key))).where(F.col("rn") <= n).drop("rn")


def claim_strata(df: DataFrame, key: str, strata: list[tuple[str, Column, int]]) -> DataFrame:
    """Samples of overlapping strata without replacement: each (name, condition, n) takes its first n rows by the MD5 of their key, among those that no stratum before it has taken.

    A stratum's rows are a distributed top n, and at most the sum of all n is
    ever looked up.  Rows with equal keys are one row.
    """
    h = F.md5(F.col(key).cast("string"))
    rows, taken = df.where(F.col(key).isNotNull()).dropDuplicates([key]), None
    for name, condition, n in strata:
        left = rows.where(F.coalesce(condition, F.lit(False)))
        if taken is not None:
            left = left.join(F.broadcast(taken.select(key)), key, "left_anti")
        now = left.orderBy(h, key).limit(n).withColumn("stratum", F.lit(name))
        taken = now if taken is None else taken.unionByName(now)
    return taken


def hist_change(points: DataFrame, seconds: int) -> DataFrame:
    """Change in percent against the first point of the last seconds; needs two points and a first value that is not 0."""
    w = W.partitionBy("symbol").orderBy("epoch").rangeBetween(-seconds, 0)
    first = F.first("value").over(w)
    return points.withColumn("change", F.when((F.count("*").over(w) >= 2) & (first != 0), (F.col("value") - first) / first * 100))


def move_z(bars: DataFrame, floor: float = 0.35) -> DataFrame:
    """Size of each bar's move in mean absolute moves of its symbol (at least ``floor`` percent)."""
    ret = bars.withColumn("ret", (F.col("close") / F.lag("close").over(W.partitionBy("symbol").orderBy("bucket")) - 1) * 100)
    return ret.withColumn("z", F.abs("ret") / F.greatest(F.lit(floor), F.avg(F.abs("ret")).over(W.partitionBy("symbol"))))


def sections(snapshot: DataFrame) -> DataFrame:
    """(symbol, sections): a report as an array of (kind, payload), payloads as JSON; sections without data are left out."""
    trend = F.when(F.col("price") > F.col("ema_20"), "above its mean").when(F.col("price") < F.col("ema_20"), "below its mean").otherwise("at its mean")
    overview = F.struct(F.lit("overview").alias("kind"), F.to_json(F.struct("price", "chg_7", "chg_30")).alias("payload"))
    technical = F.when(F.col("rsi_14").isNotNull(), F.struct(F.lit("technical").alias("kind"), F.to_json(F.struct("rsi_14", "macd", "atr_14", trend.alias("stance"))).alias("payload")))
    return snapshot.select("symbol", F.array_compact(F.array(overview, technical)).alias("sections"))


def to_markdown(report: DataFrame) -> DataFrame:
    """(symbol, markdown): one heading and one line for each section."""
    lines = F.transform("sections", lambda s: F.concat(F.lit("## "), s["kind"], F.lit("\n"), s["payload"]))
    return report.select("symbol", F.concat(F.lit("# "), F.col("symbol"), F.lit("\n"), F.array_join(lines, "\n")).alias("markdown"))


def chrf(a: Column, b: Column, most: int = 6, beta: float = 2.0) -> Column:
    """Character n-gram F-score of two texts (1 to ``most``, blanks ignored), over distinct n-grams with counts."""
    a, b = F.regexp_replace(a, r"\s+", ""), F.regexp_replace(b, r"\s+", "")

    def grams(t: Column, n: int) -> Column:
        return F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, n))).otherwise(F.array().cast("array<string>"))

    def common(x: Column, y: Column) -> Column:
        count = lambda xs, g: F.size(F.filter(xs, lambda v: v == g))
        return F.aggregate(F.array_intersect(x, y), F.lit(0), lambda acc, g: acc + F.least(count(x, g), count(y, g)))

    parts = []
    for n in range(1, most + 1):
        x, y = grams(a, n), grams(b, n)
        c = common(x, y)
        parts.append((F.when(F.size(x) > 0, c / F.size(x)), F.when(F.size(y) > 0, c / F.size(y))))
    mean = lambda cs: reduce(lambda p, q: p + q, [F.coalesce(c, F.lit(0.0)) for c in cs]) / F.nullif(reduce(lambda p, q: p + q, [c.isNotNull().cast("int") for c in cs]), F.lit(0))
    p, r = mean([x for x, _ in parts]), mean([y for _, y in parts])
    return F.coalesce((1 + beta**2) * p * r / F.nullif(beta**2 * p + r, F.lit(0.0)), F.lit(0.0))


def chrf_rows(pairs: DataFrame, key: str, a: str, b: str, most: int = 6, beta: float = 2.0) -> DataFrame:
    """(key, chrf) as ``chrf`` gives it, for whole texts of any length: n-grams are counted in rows.

    Keys are unique; null texts count as empty; a pair without n-grams gets 0.
    """

    def counts(text: str, name: str) -> DataFrame:
        plain = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", "")
        sizes = pairs.select(F.col(key).alias("key"), plain.alias("t"), F.explode(F.sequence(F.lit(1), F.lit(most))).alias("n")).where(F.length("t") >= F.col("n"))
        grams = sizes.select("key", "n", "t", F.explode(F.sequence(F.lit(1), F.length("t") - F.col("n") + 1)).alias("i"))
        return grams.groupBy("key", "n", F.substring("t", F.col("i"), F.col("n")).alias("gram")).agg(F.count("*").alias(name))

    both = counts(a, "x").join(counts(b, "y"), ["key", "n", "gram"], "full")
    by_size = both.groupBy("key", "n").agg(F.sum(F.least("x", "y") * (F.col("x").isNotNull() & F.col("y").isNotNull()).cast("int")).alias("c"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    c = F.coalesce("c", F.lit(0))
    means = by_size.groupBy("key").agg(F.coalesce(F.avg(c / F.col("x")), F.lit(0.0)).alias("p"), F.coalesce(F.avg(c / F.col("y")), F.lit(0.0)).alias("r"))
    value = F.coalesce((1 + beta**2) * F.col("p") * F.col("r") / F.nullif(beta**2 * F.col("p") + F.col("r"), F.lit(0.0)), F.lit(0.0))
    return pairs.select(F.col(key)).join(means.select(F.col("key").alias(key), value.alias("chrf")), key, "left").select(key, F.coalesce("chrf", F.lit(0.0)).alias("chrf"))
