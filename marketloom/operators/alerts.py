"""Alert rules as data: all or any of their conditions, with three-valued logic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = "id string, logic string, sym string, kind string, op string, value double"


def evaluate(rules: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(id, fires): conditions on the price or change of a symbol; null when the data can't tell.

    Rules are few and bounded by their authors; the snapshot has one row for
    each symbol, so the join is on symbols.
    """
    joined = rules.join(snapshot, rules["sym"] == snapshot["symbol"], "left")
    actual = F.when(F.col("kind") == "price", F.col("price")).otherwise(F.col("change"))
    test = F.when(F.col("op") == ">", actual > F.col("value")).when(F.col("op") == "<", actual < F.col("value")).when(F.col("op") == ">=", actual >= F.col("value")).otherwise(actual <= F.col("value"))
    t = joined.withColumn("ok", test).groupBy("id", "logic").agg(F.max(F.when(F.col("ok"), 1).otherwise(0)).alias("any"), F.min(F.when(F.col("ok") == False, 0).otherwise(1)).alias("no_false"), F.max(F.col("ok").isNull().cast("int")).alias("unknown"))  # noqa: E712
    every = F.when(F.col("no_false") == 0, False).when(F.col("unknown") == 1, None).otherwise(True)
    some = F.when(F.col("any") == 1, True).when(F.col("unknown") == 1, None).otherwise(False)
    return t.select("id", F.when(F.col("logic") == "AND", every).otherwise(some).alias("fires"))


def after_cooldown(firing: DataFrame, log: DataFrame, now, minutes: str = "cooldown") -> DataFrame:
    """Firing rules whose last alert is at least their cooldown old (or that have none)."""
    last = log.groupBy("id").agg(F.max("at").alias("last"))
    return firing.join(last, "id", "left").where(F.col("last").isNull() | (F.unix_seconds(now) - F.unix_seconds("last") >= F.col(minutes) * 60)).drop("last")


CONDITIONS = "id string, logic string, kind string, sym string, op string, value string, impact string, terms array<string>, min_cred double, within int"


def conditions(rules: DataFrame, prices: DataFrame, events: DataFrame, news: DataFrame, now: int) -> DataFrame:
    """(id, logic, kind, ok, sig): every condition of every rule against prices, released events and news.

    ``ok`` is null where a price is unknown.  A price or change fits by its
    operator (contains, gt, gte, lt, lte, eq); an event if one of its impact was
    released; news if an article is credible, young and has one of the terms.
    ``sig`` names what fitted: the newest event or article, or the price.  Rules
    are as few as their authors write and are broadcast for the theta joins
    only up to Spark's own size limit.
    """
    r = rules.withColumn("_n", F.monotonically_increasing_id())
    p = r.where(F.col("kind").isin("price", "change")).join(prices.select(F.col("symbol").alias("sym"), "price", "change"), "sym", "left")
    v = F.when(F.col("kind") == "price", F.col("price")).otherwise(F.col("change"))
    w = F.expr("try_cast(value as double)")
    by_op = F.when(F.col("op") == "contains", F.contains(F.lower(v.cast("string")), F.lower(F.coalesce("value", F.lit("")))))
    by_op = by_op.when(w.isNull(), False).when(F.col("op") == "gt", v > w).when(F.col("op") == "gte", v >= w).when(F.col("op") == "lt", v < w).when(F.col("op") == "lte", v <= w).when(F.col("op") == "eq", F.abs(v - w) <= F.when(w == 0, 1.0).otherwise(F.abs(w)) * 1e-9).otherwise(False)
    priced = p.select("id", "logic", "kind", F.when(v.isNotNull(), by_op).alias("ok"), F.concat(F.lit("p:"), "sym", F.lit("|"), F.format_string("%.4f", v)).alias("sig"))
    last = events.where("released").groupBy("impact").agg(F.max(F.struct("ts", "title")).alias("e"))
    every = last.agg(F.max("e").alias("e")).select(F.lit("all").alias("impact"), "e").where("e is not null")
    evented = r.where(F.col("kind") == "event").withColumn("impact", F.coalesce("impact", F.lit("all"))).join(last.unionByName(every), "impact", "left")
    evented = evented.select("id", "logic", "kind", F.col("e").isNotNull().alias("ok"), F.concat(F.lit("e:"), F.col("e.ts").cast("string"), F.lit("|"), F.col("e.title")).alias("sig"))
    wanted = r.where(F.col("kind") == "news")
    said = F.lower(F.concat_ws(" ", "title", "summary"))
    terms = F.filter(F.transform(F.coalesce("terms", F.array().cast("array<string>")), lambda t: F.lower(F.trim(t))), lambda t: t != "")
    fits = (F.coalesce("cred", F.lit(0.0)) >= F.coalesce("min_cred", F.lit(0.0))) & ((F.coalesce("within", F.lit(0)) == 0) | (now - F.col("n.ts") <= F.col("within") * 60)) & ((F.size(terms) == 0) | F.exists(terms, lambda t: F.contains(said, t)))
    hit = wanted.join(news.select(F.col("id").alias("article"), "title", "summary", "cred", "ts").alias("n"), fits).groupBy("_n").agg(F.max(F.struct("ts", F.col("article").alias("article"))).alias("a"))
    newsed = wanted.join(hit, "_n", "left").select("id", "logic", "kind", F.col("a").isNotNull().alias("ok"), F.concat(F.lit("a:"), F.col("a.article").cast("string")).alias("sig"))
    return priced.unionByName(evented).unionByName(newsed)


def fired(found: DataFrame, log: DataFrame, now: int) -> DataFrame:
    """(id, sig): rules whose conditions hold (all, or any with logic OR), quiet for their cooldown, and never twice for one article.

    ``found`` is the table of ``conditions``; ``log`` (id, at, sig, cooldown)
    has the last alert of a rule and its cooldown in minutes, which may be 0.
    """
    hits = F.array_sort(F.collect_list(F.when(F.coalesce("ok", F.lit(False)), F.struct("kind", "sig"))))
    each = found.groupBy("id").agg(F.max("logic").alias("logic"), F.count("*").alias("n"), F.count_if(F.coalesce("ok", F.lit(False))).alias("good"), hits.alias("hits"))
    sig, article = F.array_join(F.transform("hits", lambda h: h.sig), "~"), F.exists("hits", lambda h: h.kind == "news")
    holds = F.when(F.col("logic") == "OR", F.col("good") > 0).otherwise(F.col("good") == F.col("n"))
    rows = each.where(holds).select("id", sig.alias("sig"), article.alias("article")).join(log.select("id", "at", F.col("sig").alias("before"), "cooldown"), "id", "left")
    quiet = F.col("at").isNotNull() & (now - F.col("at") < F.coalesce("cooldown", F.lit(30)) * 60)
    again = F.col("article") & (F.col("before") == F.col("sig"))
    return rows.where(~F.coalesce(quiet, F.lit(False)) & ~F.coalesce(again, F.lit(False))).select("id", "sig")
