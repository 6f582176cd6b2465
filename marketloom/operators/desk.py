"""The news desk: projections, gates, lookups, boards and orders of articles.

Articles have id, title, summary, link, source, publisher, kind, topic, assets,
ts (epoch seconds), cred and age_hours as far as an operator needs them.  All
lookups are joins, so dimension tables may be of any size; Spark broadcasts
them while they are small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.functions import scoring, text

# ---- projections and predicates


def public(articles: DataFrame, most: int = 1000) -> DataFrame:
    """What readers see: cut summaries, only http links, age to one decimal, solar Hijri date of the local day."""
    from marketloom.functions.calendar import jalali, to_tehran

    day = jalali(F.to_date(to_tehran(F.timestamp_seconds("ts"))))
    date = F.format_string("%04d/%02d/%02d", day["jy"], day["jm"], day["jd"])
    return articles.select("id", "title", F.substring(F.coalesce("summary", F.lit("")), 1, most).alias("summary"), text.safe_url(F.col("link")).alias("link"), "source", F.round("age_hours", 1).alias("age_hours"), "cred", date.alias("date_fa"))


def publisher_trust(articles: DataFrame, trust: DataFrame, default: float = 0.64) -> DataFrame:
    """Adds ``effective_trust``: the larger of the source's trust and the publisher's, looked up by its trimmed lower-case name."""
    named = trust.select(F.col("publisher").alias("known"), F.col("trust").alias("publisher_trust"))
    joined = articles.join(named, F.lower(F.trim("publisher")) == F.col("known"), "left")
    return joined.withColumn("effective_trust", F.greatest("source_trust", F.coalesce("publisher_trust", F.lit(default)))).drop("known", "publisher_trust")


def matches_feed(topic: str | None = None, asset: str | None = None, source: str | None = None, kind: str | None = None, least_cred: float = 0.0, since: float | None = None, until: float | None = None, ids: list | None = None) -> Column:
    """The feed's filter: every given part must hold; unknown credibility counts as 0."""
    tests = [F.coalesce("cred", F.lit(0.0)) >= least_cred]
    tests += [F.col("topic") == topic] if topic else []
    tests += [F.array_contains("assets", asset)] if asset else []
    tests += [F.lower("source") == source.lower()] if source else []
    tests += [F.col("kind") == kind] if kind else []
    tests += [F.col("ts") >= since] if since is not None else []
    tests += [F.col("ts") <= until] if until is not None else []
    tests += [F.col("id").isin(ids)] if ids is not None else []
    return reduce(lambda a, b: a & b, tests)


def eligible(symbol: str, least_cred: float, max_age: float, topics: list[str] | None = None, kinds: list[str] | None = None) -> Column:
    """Articles that a report on a symbol may cite: unknown ages pass."""
    tests = F.array_contains("assets", symbol) & (F.coalesce("cred", F.lit(0.0)) >= least_cred) & (F.col("age_hours").isNull() | (F.col("age_hours") <= max_age))
    tests = tests & F.col("topic").isin(topics) if topics else tests
    return tests & F.col("kind").isin(kinds) if kinds else tests


def calendar_filter(level: str = "Low", currencies: list[str] | None = None, hide_released: bool = False, needle: str = "") -> Column:
    """Calendar rows of at least a level of importance, some currencies, unreleased ones, a text."""
    rank = scoring.importance(F.col("impact"))
    tests = rank <= scoring.importance(F.lit(level))
    tests = tests & F.col("currency").isin(currencies) if currencies else tests
    tests = tests & ~F.col("released") if hide_released else tests
    return tests & F.contains(F.lower("title"), F.lit(needle.lower())) if needle else tests


def horizon(ts: Column, now: float, days: int) -> Column:
    """Events up to ``days`` ahead (1 to 31); from 14 days on everything passes."""
    days = max(1, min(31, days))
    return ts <= now + days * 86400 if days < 14 else F.lit(True)


def expired(expires: Column, now: Column) -> Column:
    """Whether an ISO time lies before ``now``; one that can't be read has not expired."""
    return F.coalesce(F.try_to_timestamp(expires) < now, F.lit(False))


def forbidden(value: Column, words: list[str]) -> Column:
    """The first forbidden word of a text that stands as a whole word, null without any."""
    found = F.regexp_extract(F.lower(value), r"(?<![\p{L}\p{N}])(" + "|".join(words) + r")(?![\p{L}\p{N}])", 1)
    return F.when(found != "", found)


def redact(settings: Column, secret: str = r"(?i)token|secret|key|password", mask: str = "***") -> Column:
    """A map with the non-empty values of secret keys masked."""
    return F.transform_values(settings, lambda k, v: F.when(k.rlike(secret) & (F.coalesce(v, F.lit("")) != ""), mask).otherwise(v))


def page(rows: DataFrame, order: list, limit: int, offset: int = 0, most: int = 2000) -> DataFrame:
    """One page of an ordered table; the limit is held between 1 and ``most``."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(1, min(most, limit)))


def language(value: Column, markers: dict[str, list[str]]) -> Column:
    """The language with the most marker words in a text (first one on ties), null without any."""
    w = text.words(F.coalesce(value, F.lit("")))
    count = lambda ws: F.size(F.filter(w, lambda x: x.isin(ws)))
    counts = [(name, count(ws)) for name, ws in markers.items()]
    best = F.greatest(*[c for _, c in counts])
    out = reduce(lambda acc, nc: acc.when(nc[1] == best, nc[0]), counts[1:], F.when((best > 0) & (counts[0][1] == best), counts[0][0]).when(best == 0, F.lit(None).cast("string")))
    return out


def buckets(value: Column, lexicon: dict[str, dict], most: int = 6) -> Column:
    """map<bucket, evidence> of a folded text: words of a bucket; words that are ambiguous count only where nothing else matched."""
    def hits(ws):
        return F.slice(F.array_compact(F.array(*[F.when(value.rlike(scoring.word_pattern(w)), F.lit(w)) for w in ws])), 1, most) if ws else F.array().cast("array<string>")

    strong = {k: hits([w for w in spec["words"] if w not in spec.get("ambiguous", ())]) for k, spec in lexicon.items()}
    weak = {k: hits(spec.get("ambiguous", ())) for k, spec in lexicon.items()}
    none = reduce(lambda a, b: a & b, [F.size(c) == 0 for c in strong.values()])
    # of the ambiguous matches only the first bucket's counts
    first = F.element_at(F.array_append(F.array_compact(F.array(*[F.when(F.size(c) > 0, F.lit(k)) for k, c in weak.items()])), F.lit("")), 1)
    entries = [F.struct(F.lit(k).alias("key"), F.when(none & (first == k), weak[k]).otherwise(strong[k]).alias("value")) for k in lexicon]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: F.size(e["value"]) > 0))


def blurb(summary: Column, most: int = 280) -> Column:
    """The first two sentences, cut to ``most`` characters."""
    return F.substring(F.array_join(F.slice(text.sentences(F.coalesce(summary, F.lit(""))), 1, 2), " "), 1, most)


# ---- lookups and merges


def translated(rows: DataFrame, memory: DataFrame, column: str) -> DataFrame:
    """Replaces a text by its translation, looked up by MD5; texts without one, and Persian ones, stay."""
    memory = memory.select(F.col("md5").alias("_md5"), "translation").dropDuplicates(["_md5"])
    joined = rows.withColumn("_key", F.md5(F.col(column))).join(memory, F.col("_key") == F.col("_md5"), "left")
    return joined.withColumn(column, F.when(text.is_persian(F.col(column)), F.col(column)).otherwise(F.coalesce("translation", F.col(column)))).drop("_md5", "_key", "translation")


def priced_events(articles: DataFrame, prices: DataFrame) -> DataFrame:
    """(symbol, id, price), once for each symbol an article names under any alias and that has a price above 0."""
    named = articles.select("id", F.explode(F.array_distinct(F.transform("assets", scoring.alias))).alias("symbol"))
    return named.join(prices.where("price > 0").select(scoring.alias(F.col("symbol")).alias("symbol"), "price"), "symbol").dropDuplicates(["symbol", "id"])


def fingerprint(link: Column, title: Column) -> Column:
    """struct(base, norm): the link up to its query, and the first 90 of the title's letters a-z and digits; one story has one."""
    base = F.substring_index(F.coalesce(link, F.lit("")), "?", 1)
    return F.struct(base.alias("base"), F.substring(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]", ""), 1, 90).alias("norm"))


def carry_forward(fresh: DataFrame, before: DataFrame, since: float) -> DataFrame:
    """Fresh articles, and those of the cycle before that are inside the window and repeat no fresh id or fingerprint."""
    key = lambda df: df.withColumn("_f", fingerprint(F.col("link"), F.col("title")))
    old = key(before.where(F.coalesce(F.col("ts") >= since, F.lit(since <= 0))))
    kept = old.join(fresh.select("id"), "id", "left_anti").join(key(fresh).select("_f"), "_f", "left_anti").drop("_f")
    return fresh.withColumn("carried", F.lit(False)).unionByName(kept.withColumn("carried", F.lit(True)))


def archive(rows: DataFrame, place: str = "place", most: int = 1200) -> DataFrame:
    """The archive: rows in the order of ``place``, a unique number, of which no earlier kept one has the id or the fingerprint; the last ``most`` stay."""
    from marketloom.operators.feed import first_wins

    print_ = fingerprint(F.col("link"), F.col("title"))
    kept = first_wins(rows, [F.col("id").cast("string"), F.to_json(print_)], [F.col(place)], place)
    return kept.orderBy(F.desc(place)).limit(most)


def merged_sources(base: DataFrame, extra: DataFrame, deleted: DataFrame) -> DataFrame:
    """Built-in and own sources without deleted ones; handles don't depend on case, own ones win."""
    both = extra.withColumn("_p", F.lit(0)).unionByName(base.withColumn("_p", F.lit(1)), allowMissingColumns=True).withColumn("_h", F.lower("handle"))
    w = W.partitionBy("_h").orderBy("_p", "handle")
    kept = both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    return kept.join(deleted.select(F.lower("handle").alias("_h")), "_h", "left_anti").drop("_h", "_p", "_rn")


def tombstones(log: DataFrame) -> DataFrame:
    """Ids that are hidden: the last entry of each id (id, at, hidden) says so."""
    return log.groupBy("id").agg(F.max_by("hidden", "at").alias("hidden")).where("hidden").select("id")


def latest(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key of an append-only log, by a partial maximum."""
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*")


def corrections(table: DataFrame, replies: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A table with the non-empty values of the last reply to each key; replies of one time go by their values."""
    last = latest(replies, [key], ["at", *columns]).select(key, *[F.col(c).alias(f"new_{c}") for c in columns])
    joined = table.join(last, key, "left")
    return joined.select(*[F.when(F.coalesce(F.col(f"new_{c}"), F.lit("")) != "", F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns])


# ---- boards


def gauge(articles: DataFrame, group: str) -> DataFrame:
    """(group, n, gauge, mood, pos, neg): mean polarity of headlines by credibility and age, on a scale around 50; 50 without weight.

    Articles of the last 6 hours count whole, of the last day three quarters,
    older ones half; a missing credibility is 0.5.
    """
    age = F.when(F.col("age_hours") <= 6, 1.0).when(F.col("age_hours") <= 24, 0.75).otherwise(0.5)
    w = F.when(F.coalesce("cred", F.lit(0.0)) == 0, 0.5).otherwise(F.col("cred")) * age
    p = scoring.polarity(F.col("title"))
    mean = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(F.sum(w * p), F.sum(w)), F.lit(0.0))))
    g = F.bround(F.round(50 + 42 * mean, 9), 0).cast("int")
    word = F.when(g < 25, "extreme fear").when(g < 45, "fear").when(g < 55, "neutral").when(g < 75, "greed").otherwise("extreme greed")
    return articles.groupBy(group).agg(F.count("*").alias("n"), g.alias("gauge"), word.alias("mood"), F.count_if(p > 0.15).alias("pos"), F.count_if(p < -0.15).alias("neg"))


def top_signals(signals: DataFrame, group: str, rate: str, rel: str, top: int = 3) -> DataFrame:
    """By group: the item with the highest rate (then the highest share), the sum of the ``top`` rates, the largest share and the count; nulls are 0."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    rn = F.row_number().over(W.partitionBy(group).orderBy(z(rate).desc(), z(rel).desc(), "id"))
    best = signals.withColumn("rn", rn).where(F.col("rn") <= top).groupBy(group).agg(F.min_by("id", "rn").alias("best"), F.sum(rate).alias("top_rates"))
    return best.join(signals.groupBy(group).agg(F.max(rel).alias("max_rel"), F.count("*").alias("n")), group)


def days(rows: DataFrame, ts: str, impact: str) -> DataFrame:
    """By local day: rows, and how many are of high and of medium impact."""
    from marketloom.functions.calendar import to_tehran

    return rows.groupBy(F.to_date(to_tehran(F.col(ts))).alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col(impact) == "High").alias("high"), F.count_if(F.col(impact) == "Medium").alias("medium"))


def chunks(bars: DataFrame, size: int = 7) -> DataFrame:
    """(symbol, chunk, high, low) of full runs of ``size`` closes; nothing for symbols with fewer than two."""
    i = F.row_number().over(W.partitionBy("symbol").orderBy("bucket")) - 1
    full = bars.withColumn("chunk", F.floor(i / size)).groupBy("symbol", "chunk").agg(F.max("close").alias("high"), F.min("close").alias("low"), F.count("*").alias("n")).where(F.col("n") == size)
    return full.withColumn("of", F.count("*").over(W.partitionBy("symbol"))).where("of >= 2").drop("n", "of")


def length_audit(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Least, upper median, element at nine tenths and largest value of each group, by counted values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("m"))
    w = W.partitionBy(group).orderBy(value)
    run = counts.withColumn("upto", F.sum("m").over(w)).withColumn("n", F.sum("m").over(W.partitionBy(group)))
    at = lambda index: F.min(F.when(F.col("upto") > index, F.col(value)))
    return run.groupBy(group).agg(F.first("n").alias("n"), F.min(value).alias("least"), at(F.floor(F.col("n") / 2)).alias("median"), at(F.least(F.col("n") - 1, F.floor(F.col("n") * 0.9))).alias("p90"), F.max(value).alias("most"))


def co_occurrence(tokens: DataFrame, least_lift: float = 5.0, least: int = 5) -> DataFrame:
    """(token, lift, failing): tokens (doc, token, failing) that fail at least ``least_lift`` times as often as the rest."""
    all_ = tokens.groupBy("doc").agg(F.max(F.col("failing").cast("int")).alias("f")).agg(F.count("*").alias("docs"), F.sum("f").alias("bad"))
    each = tokens.dropDuplicates(["doc", "token"]).groupBy("token").agg(F.count("*").alias("n"), F.count_if("failing").alias("failing")).where(F.col("n") >= least)
    rate = (F.col("failing") / F.col("n")) / F.nullif(F.col("bad") / F.col("docs"), F.lit(0.0))
    return each.crossJoin(F.broadcast(all_)).withColumn("lift", rate).where(F.col("lift") >= least_lift).select("token", "n", "failing", "lift")


def one_family(terms: DataFrame, key: str, variant: str, family: Column) -> DataFrame:
    """(key, variant): the representative of keys whose variants are of exactly one family; null for contested ones.

    Representatives prefer a joiner inside, then confidence, then brevity.
    """
    rows = terms.withColumn("_fam", family)
    best = F.min_by(variant, F.struct((~F.contains(F.col(variant), F.lit("‌"))).cast("int"), -F.col("conf"), F.length(variant), variant))
    found = rows.groupBy(key).agg(F.count_distinct("_fam").alias("families"), best.alias("best"))
    return found.select(key, "families", F.when(F.col("families") == 1, F.col("best")).alias(variant))


def merged_terms(terms: DataFrame, key: str, variant: str) -> DataFrame:
    """One row for each (key, variant): the union of domains and sources, the largest confidence, and whether the key is contested."""
    one = terms.groupBy(key, variant).agg(F.array_sort(F.collect_set("domain")).alias("domains"), F.array_sort(F.collect_set("source")).alias("sources"), F.max("conf").alias("conf"))
    many = one.groupBy(key).agg((F.count("*") > 1).alias("contested"))
    return one.join(many, key)


def last_scores(scores: DataFrame, most: int = 20) -> DataFrame:
    """(symbol, n, scores): each symbol's last scores, newest first."""
    rn = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("cycle")))
    kept = scores.withColumn("rn", rn).where(F.col("rn") <= most)
    return kept.groupBy("symbol").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("rn", "score"))), lambda r: r["score"]).alias("scores"))


def health(log: DataFrame, most: int = 30) -> DataFrame:
    """Adds the share of good cycles among a source's last ``most`` and the run of bad ones before each row (source, cycle, ok)."""
    w = W.partitionBy("source").orderBy("cycle")
    rows = log.withColumn("share", F.avg(F.col("ok").cast("int")).over(w.rowsBetween(1 - most, 0)))
    rows = rows.withColumn("_good", F.sum(F.col("ok").cast("int")).over(w))
    return rows.withColumn("bad_run", F.sum((~F.col("ok")).cast("int")).over(W.partitionBy("source", "_good").orderBy("cycle"))).drop("_good")


def breaker(log: DataFrame, least: int = 4, minutes: int = 15, longest: int = 360) -> DataFrame:
    """Adds the cooldown in minutes after each cycle: from ``least`` failures in a row on, doubled with each more, up to ``longest``."""
    over = F.col("bad_run") - least
    return health(log).withColumn("cooldown", F.when(over >= 0, F.least(F.lit(float(longest)), minutes * F.pow(F.lit(2.0), F.least(over, F.lit(10))))).otherwise(0.0))


# ---- scores and orders


def seven_factors(rows: DataFrame, weights: dict[str, float], gate: Column, repeated: Column, penalty: float = 0.35) -> DataFrame:
    """Adds ``score``: the weighted mean of factor columns; rows outside the gate go, repeated keys keep ``penalty`` of theirs."""
    total = sum(weights.values())
    score = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) * w for c, w in weights.items()]) / total
    return rows.where(gate).withColumn("score", score * F.when(repeated, penalty).otherwise(1.0))


def channel_rank(rows: DataFrame, least_fit: float = 0.0, limit: int | None = None) -> DataFrame:
    """Adds rank = 0.55 viral + 0.45 fit; best first, younger first on ties."""
    out = rows.where(F.col("fit") >= least_fit).withColumn("rank", 0.55 * F.col("viral") + 0.45 * F.col("fit")).orderBy(F.desc("rank"), "age_hours", "id")
    return out.limit(limit) if limit else out


def popularity(likes: Column, comments: Column, followers: Column, picked: Column, hot: Column) -> Column:
    """Engagement first, the author's followers after it, and what editors picked or made hot; nulls are 0."""
    z = lambda c: F.coalesce(c, F.lit(0))
    flag = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0.0)
    return z(likes) * 3.0 + z(comments) * 2.0 + F.log10(z(followers) + 1) * 4.0 + flag(picked, 6.0) + flag(hot, 4.0)


def idea_order(ideas: DataFrame, mode: str = "popular") -> DataFrame:
    """Ideas (id, likes, comments, followers, picked, hot, ts), popular, recent or by followers first; ids settle ties."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).desc()
    score = popularity(*[F.col(c) for c in ("likes", "comments", "followers", "picked", "hot")])
    orders = {"recent": [z("ts")], "followers": [z("followers"), z("likes"), z("ts")], "popular": [score.desc(), z("ts")]}
    return ideas.orderBy(*orders.get(mode, orders["popular"]), "id")


#: Orders of boards by name; ids settle all ties.
ORDERS = {
    "new": [F.desc, "ts", F.desc, "cred"],
    "cred": [F.desc, "cred", F.desc, "ts"],
    "source": [F.asc, "source", F.desc, "ts"],
}


def ordered(rows: DataFrame, mode: str) -> DataFrame:
    """A feed by its newest, most credible or alphabetically first source."""
    spec = ORDERS[mode]
    return rows.orderBy(*[d(c) for d, c in zip(spec[::2], spec[1::2], strict=True)], "id")


def calendar_order(rows: DataFrame, mode: str) -> DataFrame:
    """A calendar by importance, by released ones first, or by time."""
    first = {"impact": [scoring.importance(F.col("impact"))], "released": [F.desc("released")], "time": []}[mode]
    return rows.orderBy(*first, "ts", "id")


def by_dimension(rows: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Rows by the ``rank`` of a dimension table, unknown ones last."""
    return rows.join(dimension.select(key, "rank"), key, "left").orderBy(F.asc_nulls_last("rank"), key)


def badness(rows: DataFrame, parts: dict[str, float]) -> DataFrame:
    """Adds ``badness``, a weighted sum of flags, worst first."""
    score = reduce(lambda a, b: a + b, [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c, w in parts.items()])
    return rows.withColumn("badness", score).orderBy(F.desc("badness"), "id")
