"""Text products: citations, captions, digests, report prose; audits and indexes behind them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.functions import text


def citations(articles: DataFrame, group: str, order: list, most: int = 5) -> DataFrame:
    """(group, index, key, title, host, stamp): the first ``most`` articles of each group, as a report cites them."""
    rn = F.row_number().over(W.partitionBy(group).orderBy(*order, "id"))
    kept = articles.withColumn("index", rn).where(F.col("index") <= most)
    host = F.regexp_replace(F.coalesce(F.try_parse_url("link", F.lit("HOST")), F.lit("")), r"^www\.", "")
    key = F.coalesce(F.col("id").cast("string"), F.nullif(F.col("link"), F.lit("")), F.col("title"))
    return kept.select(group, "index", key.alias("key"), text.clean_title(F.col("title")).alias("title"), host.alias("host"), F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd HH:mm").alias("stamp"))


def rendered(template: str, values: dict[str, Column], most: int = 4000) -> Column:
    """A message template with {name} filled in; missing values are empty, blank lines collapse, the whole is cut to ``most``."""
    out = reduce(lambda c, kv: F.replace(c, F.lit("{" + kv[0] + "}"), F.coalesce(kv[1].cast("string"), F.lit(""))), values.items(), F.lit(template))
    return F.substring(F.trim(F.regexp_replace(out, r"\n{3,}", "\n\n")), 1, most)


def digest(articles: DataFrame, group: str, order: list, template: str, values: dict[str, Column], head: str, top: int = 5, most: int = 4000) -> DataFrame:
    """(group, text): one message for each group with its first ``top`` articles, a line each."""
    rn = F.row_number().over(W.partitionBy(group).orderBy(*order, "id"))
    lines = articles.withColumn("rn", rn).where(F.col("rn") <= top).select(group, "rn", rendered(template, values).alias("line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "line"))), lambda r: r["line"]), "\n")
    return lines.groupBy(group).agg(joined.alias("body")).select(group, F.substring(F.concat(F.replace(F.lit(head), F.lit("{group}"), F.col(group)), F.lit("\n"), "body"), 1, most).alias("text"))


def stance(snapshot: DataFrame) -> DataFrame:
    """Adds ``stance`` (price and means stacked upwards, downwards, or mixed), ``heat`` of the RSI and a ``level`` of the change."""
    up, down = (F.col("price") > F.col("ema_20")) & (F.col("macd_hist") > 0), (F.col("price") < F.col("ema_20")) & (F.col("macd_hist") < 0)
    heat = F.when(F.col("rsi_14") >= 70, "overbought").when(F.col("rsi_14") <= 30, "oversold").otherwise("balanced")
    return snapshot.withColumn("stance", F.when(up, "bullish").when(down, "bearish").otherwise("mixed")).withColumn("heat", heat).withColumn("level", word(F.col("chg_7"), [(-5.0, "falls sharply"), (-1.0, "falls"), (1.0, "holds"), (5.0, "rises")], "rises sharply"))


def word(value: Column, steps: list[tuple[float, str]], above: str) -> Column:
    """The word of the first step that a value does not exceed; null values have none."""
    out = reduce(lambda c, s: F.when((value <= s[0]), s[1]).otherwise(c), reversed(steps), F.lit(above))
    return F.when(value.isNotNull(), out)


def prose(snapshot: DataFrame, news: DataFrame) -> DataFrame:
    """(symbol, sections): overview, momentum, trend, volatility, levels, volume, news, scenarios and conclusion, each a (kind, text).

    A section whose numbers are missing is left out, so one symbol's gaps don't
    stop its report.
    """
    rows = stance(snapshot).join(news, "symbol", "left")
    n = lambda c, d=2: F.format_string(f"%.{d}f", c)
    say = lambda kind, *parts: F.struct(F.lit(kind).alias("kind"), F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]).alias("text"))
    sections = [
        say("overview", F.col("symbol"), " trades at ", n(F.col("price")), " and ", F.col("level"), " over seven bars (", n(F.col("chg_7")), " %)."),
        say("momentum", "RSI is ", n(F.col("rsi_14"), 1), ", ", F.col("heat"), "."),
        say("trend", "MACD histogram is ", n(F.col("macd_hist"), 4), "; the trend is ", F.col("stance"), "."),
        say("volatility", "An average bar spans ", n(F.col("atr_14")), "."),
        say("change", "The change over thirty bars is ", n(F.col("chg_30")), " %."),
        say("volume", "Volume runs at ", n(F.col("volume_ratio")), " times its usual level."),
        say("news", F.coalesce("articles", F.lit(0)).cast("string"), " articles name it."),
        say("scenarios", "Above ", n(F.col("price") + F.col("atr_14")), " buyers are in charge, below ", n(F.col("price") - F.col("atr_14")), " sellers."),
        say("conclusion", "The picture is ", F.col("stance"), "."),
    ]
    return rows.select("symbol", F.filter(F.array(*sections), lambda s: s["text"].isNotNull()).alias("sections"))


def markdown(reports: DataFrame) -> DataFrame:
    """(symbol, markdown): a heading for every section."""
    body = F.array_join(F.transform("sections", lambda s: F.concat(F.lit("## "), F.initcap(s["kind"]), F.lit("\n\n"), s["text"])), "\n\n")
    return reports.select("symbol", F.concat(F.lit("# "), "symbol", F.lit("\n\n"), body).alias("markdown"))


def inverted_index(postings: DataFrame, documents: DataFrame, key: str, now: float, days: int = 21, most_docs: int = 4000, most_postings: int = 600) -> DataFrame:
    """(term, key, w): postings of the newest ``most_docs`` documents of the last ``days``, the newest ``most_postings`` of each term, heaviest weight of a pair."""
    kept = documents.where(F.col("ts") >= now - days * 86400).orderBy(F.desc("ts"), key).limit(most_docs).select(key, "ts")
    rows = postings.join(kept, key).groupBy("term", key).agg(F.max("w").alias("w"), F.max("ts").alias("ts"))
    rn = F.row_number().over(W.partitionBy("term").orderBy(F.desc("ts"), key))
    return rows.withColumn("rn", rn).where(F.col("rn") <= most_postings).select("term", key, "w")


def audit(rows: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """One row with the number of rows and how many meet each test."""
    return rows.agg(F.count("*").alias("rows"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in tests.items()])


def yahoo_candidates(symbol: Column) -> Column:
    """Names under which a quote may be found, likeliest first: as it is, as a dollar pair, as a future, as an index."""
    s = F.upper(F.trim(symbol))
    plain = F.regexp_replace(s, r"(?:-?USDT?|=F|\^)", "")
    return F.array_distinct(F.array_compact(F.array(F.nullif(s, F.lit("")), F.when(plain.rlike("^[A-Z]{2,6}$"), F.concat(plain, F.lit("-USD"))), F.when(plain.rlike("^[A-Z]{1,3}$"), F.concat(plain, F.lit("=F"))), F.when(plain.rlike("^[A-Z]{3,5}$"), F.concat(F.lit("^"), plain)))))


def reference_rows(events: DataFrame, days: int = 30, count: int = 6) -> DataFrame:
    """(id, step, ts): the ``count`` dates before each event at its cadence of ``days``, newest first."""
    return events.select("id", F.posexplode(F.sequence(F.col("ts") - F.expr(f"INTERVAL {days} DAYS"), F.col("ts") - F.expr(f"INTERVAL {days * count} DAYS"), F.expr(f"INTERVAL -{days} DAYS"))).alias("step", "ts"))


def surprise(actual: Column, forecast: Column, title: Column, lower_is_better: list[str]) -> Column:
    """struct(surprise, better, released): better is 1, -1 or null, turned round for indicators of which less is better."""
    diff = actual - forecast
    inverted = F.lower(title).rlike("|".join(lower_is_better))
    better = F.when(diff > 0, 1).when(diff < 0, -1)
    return F.struct(diff.alias("surprise"), F.when(inverted, -better).otherwise(better).alias("better"), actual.isNotNull().alias("released"))


def saturated(value: Column) -> Column:
    """1 - e^-x of what is above 0."""
    return 1 - F.exp(-F.greatest(F.lit(0.0), F.coalesce(value, F.lit(0.0))))


def token_changes(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """(old, new, n): words at the same place of texts of equal length that differ, counted; other pairs are 'rewritten'."""
    a, b = F.split(F.coalesce(before, F.lit("")), r"\s+"), F.split(F.coalesce(after, F.lit("")), r"\s+")
    same = F.size(a) == F.size(b)
    changed = F.filter(F.arrays_zip(a.alias("old"), b.alias("new")), lambda x: x["old"] != x["new"])
    rows = pairs.where(F.coalesce(before, F.lit("")) != F.coalesce(after, F.lit(""))).select(F.explode(F.when(same, changed).otherwise(F.array(F.struct(F.lit("*").alias("old"), F.lit("rewritten").alias("new"))))).alias("c"))
    return rows.groupBy("c.old", "c.new").agg(F.count("*").alias("n"))


def intelligence(anomalies: DataFrame, moves: DataFrame, symbols: list[str]) -> DataFrame:
    """(symbol, anomaly, z, moves): the latest anomaly of every symbol that has one, and news-to-price figures of the named symbols with enough events.

    ``anomalies`` (symbol, cycle, z, severity), ``moves`` (symbol, h, events,
    move_pos, move_neg, accuracy); symbols with neither are left out.
    """
    last = anomalies.groupBy("symbol").agg(F.max_by(F.struct("severity", "z"), "cycle").alias("a")).where("a.severity <> 'none'").select("symbol", F.col("a.severity").alias("anomaly"), F.col("a.z").alias("z"))
    known = moves.where(F.col("symbol").isin(symbols) & F.col("accuracy").isNotNull()).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("h", "events", "move_pos", "move_neg", "accuracy"))).alias("moves"))
    return last.join(known, "symbol", "full")
