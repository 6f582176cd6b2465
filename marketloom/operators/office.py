"""Sources, side tables, alerts, users, bodies and counters: lookups of the news office."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.functions import scoring

# ---- sources and side tables


def source_dimension(built_in: DataFrame, custom: DataFrame, deleted: DataFrame, status: DataFrame) -> DataFrame:
    """Sources (key, name, trust, tier, kind) with their last status: built-in ones, then custom ones of other keys, without deleted ones.

    Keys are compared without case; a source without a status has not been seen.
    """
    both = built_in.withColumn("custom", F.lit(False)).unionByName(custom.withColumn("custom", F.lit(True))).withColumn("k", F.lower("key"))
    first = both.groupBy("k").agg(F.min_by(F.struct(*[c for c in both.columns if c != "k"]), F.struct("custom", "key")).alias("s"))
    kept = first.join(deleted.select(F.lower("key").alias("k")).distinct(), "k", "left_anti")
    seen = status.select(F.lower("key").alias("k"), F.col("ok").alias("ok"), F.col("count").alias("count"))
    return kept.join(seen, "k", "left").select("s.*", F.coalesce("ok", F.lit(False)).alias("ok"), F.coalesce("count", F.lit(0)).cast("bigint").alias("count"), F.col("ok").isNull().alias("unseen"))


def with_side_tables(rows: DataFrame, sides: dict[str, DataFrame], key: str, now: int, seconds: int = 300) -> DataFrame:
    """Adds the value of each side table (key, value, at) that was fetched in the last ``seconds``; older ones are null.

    A fetch that failed has a null value, which stands as long as any other, so
    a broken side is not asked again before its time.  ``<name>_due`` says that
    a key has no fetch inside the time.
    """
    out = rows
    for name, side in sides.items():
        last = side.where((F.col("at") > now - seconds) & (F.col("at") <= now)).groupBy(key).agg(F.max_by(F.struct("value"), "at").alias("_v"))
        out = out.join(last, key, "left").withColumn(name, F.col("_v.value")).withColumn(f"{name}_due", F.col("_v").isNull()).drop("_v")
    return out


def enrich(rows: DataFrame, side: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Adds columns of a side table with unique keys; unknown keys and nulls are 0."""
    return rows.join(side.select(key, *columns), key, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in columns})


def first_hit(ids: DataFrame, key: str, caches: list[DataFrame]) -> DataFrame:
    """The row of every wanted key in the first cache that has it, with the cache's place; unknown keys are left out."""
    parts = [c.join(ids.select(key).distinct(), key, "left_semi").withColumn("cache", F.lit(i)) for i, c in enumerate(caches)]
    every = reduce(lambda a, b: a.unionByName(b), parts)
    rest = [c for c in every.columns if c != key]
    return every.groupBy(key).agg(F.min_by(F.struct(*rest), "cache").alias("r")).select(key, "r.*")


def evicted(memory: DataFrame, most: int = 40_000, drop: int = 10_000) -> DataFrame:
    """A memory table (key, value, at) within its bound: above ``most`` rows the ``drop`` oldest go, as often as needed."""
    n = memory.count()
    excess = -(-(n - most) // drop) * drop if n > most else 0
    return memory.orderBy(F.desc("at"), F.desc("key")).limit(max(0, n - excess))


# ---- alerts of charts


def accepted_alerts(payloads: DataFrame, secret: str, payload: str = "payload") -> DataFrame:
    """(id, ts, strategy, ticker, action, price, message, raw) of JSON payloads (id, ts) that bear the secret, which is not kept."""
    fields = F.from_json(payload, "map<string,string>")
    got = payloads.withColumn("m", fields).where(F.coalesce(F.col("m")["secret"] == secret, F.lit(False)) & F.lit(bool(secret)))
    say = lambda c, other: F.coalesce(F.col("m")[c], F.lit(other)).alias(c)
    raw = F.to_json(F.map_filter("m", lambda k, _: k != "secret"))
    return got.select("id", "ts", say("strategy", "Unknown"), say("ticker", "Unknown"), say("action", "unknown"), F.col("m")["price"].alias("price"), say("message", ""), raw.alias("raw"))


def last_alerts(alerts: DataFrame, limit: int = 20, ticker: str | None = None) -> DataFrame:
    """The newest alerts, of one ticker in any case if one is given."""
    rows = alerts if ticker is None else alerts.where(F.upper("ticker") == ticker.upper())
    return rows.orderBy(F.desc("ts"), F.desc("id")).limit(limit)


# ---- users


def register(users: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Users (email, key_hash, tier) after registrations (email, key_hash, tier, seq), and those that were refused.

    An email's last registration wins.  A key that belongs to another email,
    stored or earlier in the batch, is refused, as keys are unique.
    """
    last = new.groupBy("email").agg(F.max_by(F.struct("key_hash", "tier", "seq"), "seq").alias("r")).select("email", "r.*")
    claims = users.select("email", "key_hash", F.lit(-1).cast("bigint").alias("seq")).unionByName(last.select("email", "key_hash", F.col("seq").cast("bigint").alias("seq")))
    owner = claims.groupBy("key_hash").agg(F.min_by("email", F.struct("seq", "email")).alias("owner"))
    judged = last.join(owner, "key_hash").withColumn("ok", F.col("owner") == F.col("email"))
    good = judged.where("ok").select("email", "key_hash", "tier")
    return users.join(good, "email", "left_anti").select("email", "key_hash", "tier").unionByName(good), judged.where("not ok").select("email", "key_hash", "tier")


def usage_log(calls: DataFrame, users: DataFrame) -> DataFrame:
    """(email, feature, ts) of calls (key_hash, feature, ts) by known users; other calls leave no trace."""
    return calls.join(users.select("key_hash", "email"), "key_hash").select("email", "feature", "ts")


# ---- bodies and stored articles


def best_body(attempts: DataFrame, key: str, text: str = "text", rung: str = "rung", enough: int = 250) -> DataFrame:
    """(key, rung, words, text): of the ways to a body, in their order, the first with ``enough`` words, else the one with most."""
    words = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != ""))
    order = F.struct((F.col("words") < enough).alias("short"), F.when(F.col("words") >= enough, F.col(rung)).otherwise(-F.col("words")).alias("by"), F.col(rung))
    rows = attempts.withColumn("words", words).where("words > 0")
    best = rows.groupBy(key).agg(F.min_by(F.struct(F.col(rung).alias("rung"), F.col("words").cast("bigint").alias("words"), F.col(text).alias("text")), order).alias("b"))
    return best.select(key, "b.*")


def stored_articles(articles: DataFrame, asset: str | None = None, topic: str | None = None, since: int | None = None, until: int | None = None, words: str | None = None, limit: int = 200) -> DataFrame:
    """Articles of a store, newest first, by any of its indexes: asset, topic, time; ``words`` must stand in title or summary."""
    # tests run in this order: a topic that is made of a text is asked for last, of few rows
    tests: list[Column] = []
    tests += [F.col("ts") >= since] if since is not None else []
    tests += [F.col("ts") <= until] if until is not None else []
    tests += [F.array_contains("assets", asset)] if asset else []
    tests += [F.contains(F.lower(F.concat_ws(" ", "title", "summary")), F.lit(words.lower()))] if words else []
    tests += [F.col("topic") == topic] if topic else []
    return articles.where(reduce(lambda a, b: a & b, tests, F.lit(True))).orderBy(F.desc("ts"), "id").limit(min(limit, 2000))


def counters(articles: DataFrame, log: DataFrame) -> DataFrame:
    """(name, value) of the office: articles, their sources, share with assets, newest time; good and bad fetches of the log (source, ok)."""
    a = articles.agg(F.count("*").alias("articles"), F.count_distinct("source").alias("sources"), F.round(F.avg((F.size("assets") > 0).cast("double")), 6).alias("with_assets"), F.max("ts").alias("newest"))
    b = log.agg(F.count_if("ok").alias("fetches_ok"), F.count_if(~F.col("ok")).alias("fetches_bad"), F.count_distinct(F.when(~F.col("ok"), F.col("source"))).alias("sources_failing"))
    rows = [f.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in f.columns])).alias("x")).select("x.*") for f in (a, b)]
    return rows[0].unionByName(rows[1])


# ---- what a channel does not take

#: Words of stories that are off a channel's profile, by category, and marks of domestic sources.
OFF_PROFILE = {
    "domestic": ("تومان", "ریال", "کارت ملی", "سکه بهار آزادی", "سکه امامی", "نیم سکه", "ربع سکه", "طلای ۱۸", "طلای ۲۴", "طلای آب", "آب شده", "آبشده", "مثقال", "بازار تهران", "سبزه میدان", "بورس تهران", "فرابورس", "سامانه نیما", "ارز نیمایی", "سامانه سنا", "ارز توافقی", "یارانه", "خودرو داخلی", "ایران خودرو", "سایپا", "وزارت صمت", "بانک مرکزی ایران", "شاخص کل بورس", "بازار آزاد تهران", "صرافی ملی", "صندوق بازنشستگی", "مجلس شورای اسلامی", "toman", "iranian rial", "tehran market", "tsetmc", "cbi.ir"),
    "scam": ("airdrop claim", "free giveaway", "seed phrase", "wallet drainer", "phishing scam", "کلاهبرداری ایردراپ", "سرقت کلمات بازیابی", "فیشینگ"),
    "gossip": ("hollywood", "kardashian", "taylor swift", "سلبریتی زرد", "اینفلوئنسر زرد", "بازیگر هالیوود"),
}
DOMESTIC_KEYS = ("tejaratnews", "donya-eqtesad", "eghtesadonline", "isna", "mehrnews", "arzdigital")
DOMESTIC_LINKS = r"\.ir/|^[^/]*//[^/]*\.ir$|tejaratnews|donya-e-eqtesad|arzdigital"
DOMESTIC_NAMES = ("تجارت نیوز", "دنیای اقتصاد", "ایسنا", "مهر", "اقتصاد آنلاین")


def domestic(key: Column, link: Column, name: Column) -> Column:
    """Whether a source's key, a link or a source's name is domestic; nulls are not."""
    z = lambda c: F.coalesce(c, F.lit(""))
    return F.lower(z(key)).isin(*DOMESTIC_KEYS) | F.lower(z(link)).rlike(DOMESTIC_LINKS) | reduce(lambda a, b: a | b, [F.contains(z(name), F.lit(w)) for w in DOMESTIC_NAMES])


def off_profile(folded: Column, key: Column, link: Column, name: Column, most: int = 4) -> Column:
    """map<category, evidence> of a folded text; a domestic source is evidence of its own. Empty: nothing speaks against it."""
    home = domestic(key, link, name)

    def evidence(found: Column) -> Column:
        entries = []
        for category, words in OFF_PROFILE.items():
            hits = F.slice(F.array_intersect(F.array(*map(F.lit, words)), found), 1, most)
            if category == "domestic":
                hits = F.concat(F.when(home, F.array(F.lit("source"))).otherwise(F.array().cast("array<string>")), hits)
            entries.append(F.struct(F.lit(category).alias("key"), hits.alias("value")))
        return F.map_from_entries(F.filter(F.array(*entries), lambda e: F.size(e["value"]) > 0))

    return scoring.once(scoring.listed_words(folded, [w for words in OFF_PROFILE.values() for w in words]), evidence)


# ---- calendar weeks


def calendar_week(events: DataFrame, now: Column, offset: int = 0) -> DataFrame:
    """Events (ts, title, currency) of the UTC week from Monday on that holds ``now``, or one ``offset`` weeks from it; each once, without untitled ones."""
    start = F.date_trunc("week", now) + F.make_dt_interval(days=F.lit(7 * offset))
    inside = (F.col("ts") >= start) & (F.col("ts") < start + F.make_dt_interval(days=F.lit(7)))
    rows = events.withColumn("title", F.trim(F.coalesce("title", F.lit("")))).where(inside & (F.col("title") != "")).withColumn("_sec", F.date_trunc("second", "ts"))
    rest = [c for c in rows.columns if c not in ("_sec", "title", "currency")]
    first = rows.withColumn("currency", F.trim(F.coalesce("currency", F.lit("")))).groupBy("_sec", "title", "currency").agg(F.min_by(F.struct(*rest), F.struct("ts", *[c for c in rest if c != "ts"])).alias("r"))
    return first.select("title", "currency", "r.*")


# ---- demand bundles


def bundles(posts: DataFrame, channel: str, views: str, ts: str, top: int = 3) -> DataFrame:
    """(channel, posts, median, best): number of posts of a channel, upper median of their views, ids of its most seen ones.

    Medians come from counts of equal values, so a channel may have any number
    of posts.
    """
    counts = posts.where(F.col(views).isNotNull()).groupBy(channel, views).agg(F.count("*").alias("n"))
    of = W.partitionBy(channel)
    ranked = counts.withColumn("upto", F.sum("n").over(of.orderBy(views))).withColumn("all", F.sum("n").over(of))
    median = ranked.where(F.col("upto") > F.floor(F.col("all") / 2)).groupBy(channel).agg(F.min(views).alias("median"))
    rank = F.row_number().over(of.orderBy(F.desc_nulls_last(views), F.desc_nulls_last(ts), "id"))
    best = posts.withColumn("rank", rank).where(F.col("rank") <= top).groupBy(channel).agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("b"))
    return posts.groupBy(channel).agg(F.count("*").alias("posts")).join(median, channel, "left").join(best, channel).select(channel, "posts", "median", F.transform("b", lambda x: x.id).alias("best"))
