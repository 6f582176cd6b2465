"""The newsroom's ranking: how well a story fits the desks, how likely it is to spread, and which stories are taken."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.functions import scoring, text
from marketloom.operators import office
from marketloom.store import materialise

#: Words of stories that spread, words of subjects that are talked about, and words that leave no doubt about the technology desk.
VIRAL = ("رکورد", "بی‌سابقه", "برای اولین بار", "اولین بار", "تاریخی", "جهش", "سقوط", "سقف تاریخی", "کف تاریخی", "انفجار", "هشدار", "شوک", "بحران", "ناگهان", "ناگهانی", "پرش", "ریزش", "به بالاترین", "به پایین‌ترین", "شکست سقف", "شکست حمایت", "رکورد تاریخی", "وحشت", "پامپ", "طوفان", "میلیارد دلاری", "تریلیون دلاری", "انفجار قیمت", "record", "surge", "plunge", "historic", "unprecedented", "crash", "warn", "warning", "all-time high", "ath", "breakout", "crisis", "shock", "explosion", "skyrocket", "massive", "bull run", "bear market", "liquidation", "frenzy", "trillion", "billion")
BUZZ = ("gold", "bitcoin", "nvidia", "ai", "rate cut", "oil", "doge", "pepe", "طلا", "بیت کوین", "هوش مصنوعی", "انویدیا", "نفت")
TECH = ("nvidia", "ai", "apple", "microsoft", "openai", "semiconductor", "هوش مصنوعی", "تراشه", "انویدیا")
ROUND = r"(?:^|[\s،.:؛])([1-9]\d*)\s*(?:هزار|میلیون|میلیارد)(?:[\s،.:؛]|$)"
#: Words that a title's key leaves out, weights of the factors of fit and of virality.
KEYLESS = ("و", "در", "به", "از", "با", "که", "the", "a", "an", "in", "to", "for")
FIT = {"topic": 0.35, "impact": 0.30, "freshness": 0.20, "credibility": 0.15}
SPREAD = {"shock": 0.30, "novelty": 0.30, "buzz": 0.20, "demand": 0.10, "recency": 0.10}
REASONS = ("low_credibility", "off_profile", "no_desk", "other_desk", "duplicate")


def rounded(value: Column, digits: int = 1) -> Column:
    """Halves go up, also those that binary numbers put just below."""
    return F.floor(value * 10**digits + 0.5 + 1e-9) / 10**digits


def saturated(value: Column) -> Column:
    return F.when(value > 0, 1 - F.exp(-value)).otherwise(0.0)


def fading(age_hours: Column, half_life: float) -> Column:
    """Halves with every half-life, 0.05 at least; 1 for what is of now or later."""
    return F.when(age_hours <= 0, 1.0).otherwise(F.greatest(F.lit(0.05), F.pow(F.lit(0.5), age_hours / half_life)))


def word_hits(folded: Column, words, tokens: Column | None = None, persian: Column | None = None, spoken: Column | None = None) -> Column:
    """The words of a list that a folded text holds, in the list's order and each once, as ``scoring.word_pattern`` finds them one by one.

    ``tokens`` are the text's distinct Latin tokens, ``persian`` tells that it
    has letters of the other script and ``spoken`` are its words of that script
    (``persian_words``), where the caller has made them once for several lists.  Single Latin words are tokens; longer ones are looked for
    only where their first token is there, others only in texts of their script
    and in as few passes as they have words that begin another one.
    """
    tokens = latin_tokens(folded) if tokens is None else tokens
    persian = has_persian(folded) if persian is None else persian
    none = F.array().cast("array<string>")
    listed = list(dict.fromkeys(text_fold(w) for w in words))
    single = [w for w in listed if re.fullmatch("[a-z0-9]+", w)]
    longer = [w for w in listed if _latin(w) and w not in single]
    found = [F.array_intersect(tokens, F.array(*map(F.lit, single)))] if single else []
    if longer:
        first = _first_token
        found.append(F.array_compact(F.array(*[F.when(F.array_contains(tokens, first(w)), F.when(folded.rlike(scoring.word_pattern(w)), F.lit(w))) for w in longer])))
    others = [w for w in listed if not _latin(w)]
    if others:
        found.append(persian_words(folded, others, persian) if spoken is None else F.array_intersect(spoken, F.array(*map(F.lit, others))))
    return F.array_intersect(F.array(*map(F.lit, listed)), F.coalesce(F.concat(*found), none))


def _first_token(word: str) -> str:
    return re.findall("[a-z0-9]+", word)[0]


def latin_tokens(folded: Column, words=None) -> Column:
    """The distinct Latin tokens of a folded text; of those alone that the listed words ask for, if any are given."""
    if words is None:
        return F.array_distinct(F.split(folded, "[^a-z0-9]+"))
    listed = sorted({_first_token(w) for w in map(text_fold, words) if _latin(w)})
    return F.array_intersect(F.split(folded, "[^a-z0-9]+"), F.array(*map(F.lit, listed)).cast("array<string>"))


def persian_words(folded: Column, words, persian: Column) -> Column:
    """The listed words of the other script in a folded text, in as few passes as they have words that begin another one."""
    passes: list[list[str]] = []
    for w in dict.fromkeys(w for w in map(text_fold, words) if not _latin(w)):
        place = next((p for p in passes if not any(v.startswith(w) or w.startswith(v) for v in p)), None)
        if place is None:
            passes.append([w])
        else:
            place.append(w)
    none = F.array().cast("array<string>")
    ends = rf"(?:$|(?!{scoring.LETTER})|{'|'.join(scoring.ENDINGS)})"
    found = [F.regexp_extract_all(folded, F.lit(rf"(?<!{scoring.LETTER})(?=({'|'.join(map(re.escape, p))}){ends})"), F.lit(1)) for p in passes]
    return F.when(persian, F.array_distinct(F.concat(*found))).otherwise(none) if found else none


#: Longest stretch without letters of the other script that stays whole beside them; no listed word has one half as long.
APART = 40


def near_persian(folded: Column) -> Column:
    """A text without the inner part of long stretches that hold no letter of the other script: words of it are found as in the whole text."""
    other, half = "[^\u0600-\u06FF]", APART // 2
    return F.regexp_replace(folded, f"({other}{{{half}}}){other}+({other}{{{half}}})", "$1\n$2")


def has_persian(folded: Column) -> Column:
    return F.coalesce(folded.rlike("[\u0600-\u06FF]"), F.lit(False))


def _latin(word: str) -> bool:
    return re.fullmatch(r"[a-z0-9 &'.-]+", word) is not None


def text_fold(word: str) -> str:
    """What ``text.fold`` makes of a listed word."""
    table = str.maketrans(text.LETTER_FORMS[0] + text.PERSIAN_DIGITS + text.ARABIC_DIGITS + text.ZWNJ, text.LETTER_FORMS[1] + "0123456789" * 2 + " ")
    return re.sub(r"\s+", " ", re.sub("[ً-ْٰـ]", "", word.lower().translate(table))).strip()


def title_key(title: Column, n: int = 6) -> Column:
    """The first words of a folded title that say something: stories with equal keys are one story."""
    return F.array_join(F.slice(F.filter(F.split(text.fold(title), " "), lambda w: (w != "") & ~w.isin(*KEYLESS)), 1, n), " ")


def desk_evidence(rows: DataFrame, lexicon: dict[str, dict], hits, most: int = 6) -> DataFrame:
    """Adds ``desks``, map<desk, evidence>: a desk's assets first, then its words.

    ``lexicon``: desk -> {weight, words, assets, ambiguous}; ``hits`` gives the
    words of a list that a text holds (``word_hits``).  Words that are
    also ambiguous count for the first desk that has any, where nothing else
    speaks for a desk.  Evidence is made once, in columns of its own.
    """
    none = F.array().cast("array<string>")
    upper = F.transform(F.coalesce("assets", none), lambda a: F.upper(a))
    made = []
    for i, spec in enumerate(lexicon.values()):
        unclear = set(spec.get("ambiguous", ()))
        sure, doubt = [w for w in spec["words"] if w not in unclear], [w for w in spec["words"] if w in unclear]
        own = F.filter(upper, _one_of(spec.get("assets", ())))
        made += [F.slice(F.concat(own, hits(sure) if sure else none), 1, most).alias(f"_sure{i}"), (F.slice(hits(doubt), 1, most) if doubt else none).alias(f"_doubt{i}")]
    rows = rows.select("*", *made)
    places = range(len(lexicon))
    nothing = reduce(lambda a, b: a & b, [F.size(f"_sure{i}") == 0 for i in places])
    first = F.coalesce(*[F.when(F.size(f"_doubt{i}") > 0, i) for i in places], F.lit(-1))
    entries = [F.struct(F.lit(k).alias("key"), F.when(nothing & (first == i), F.col(f"_doubt{i}")).otherwise(F.col(f"_sure{i}")).alias("value")) for i, k in enumerate(lexicon)]
    return rows.withColumn("desks", F.map_from_entries(F.filter(F.array(*entries), lambda e: F.size(e["value"]) > 0))).drop(*[f"_{n}{i}" for n in ("sure", "doubt") for i in places])


def _one_of(names):
    return lambda a: a.isin(*names) if names else F.lit(False)


def _or_null(rows: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)


def assessed(rows: DataFrame, lexicon: dict[str, dict], now: float, least: float = 0.55) -> DataFrame:
    """What a story gives by itself; texts are left behind, so nothing after this shuffles one.

    Rows have id, title, summary, source, link, kind, assets, credibility and
    ts, and may have title_fa, summary_fa, source_name and social (a score).
    Result: (id, ts, kind, assets, key, credibility, age_hours, desks, primary,
    numbers, topic, impact, freshness, fit, novelty, buzz, demand, recency,
    drama, reject).  ``reject`` is the first of REASONS that is against the
    story, null without any; fit is 0 then.  Null credibility counts as 0.7, a
    missing time as 12 hours ago, milliseconds are known by their size; null
    texts are empty.  Numbers are taken of the Persian text where there is one.
    """
    z = lambda c: F.coalesce(c, F.lit(""))
    title_fa, summary_fa = _or_null(rows, "title_fa"), _or_null(rows, "summary_fa")
    told = lambda fa, other: F.coalesce(F.nullif(fa, F.lit("")), other, F.lit(""))
    seconds = scoring.epoch_seconds(F.col("ts").cast("double"))
    base = rows.select(
        "id", "ts", "kind", "assets", "source", "link",
        _or_null(rows, "source_name").alias("source_name"),
        _or_null(rows, "social", "double").alias("social"),
        F.coalesce(F.col("credibility").cast("double"), F.lit(0.7)).alias("credibility"),
        F.when(seconds > 0, F.greatest(F.lit(0.0), (now - seconds) / 3600)).otherwise(12.0).alias("age_hours"),
        title_key(told(title_fa, F.col("title"))).alias("key"),
        F.concat_ws(" ", told(title_fa, F.col("title")), told(summary_fa, F.col("summary"))).alias("_claims"),
        text.fold(F.concat_ws(" ", z(title_fa), z(F.col("title")), z(summary_fa), z(F.col("summary")))).alias("_folded"),
    )
    # every text is gone through once for the words of all lists together
    off_profile = [w for ws in office.OFF_PROFILE.values() for w in ws]
    every = [w for ws in (*[v["words"] for v in lexicon.values()], off_profile, scoring.IMPACT, VIRAL, BUZZ, TECH) for w in ws]
    short = all(len(gap) < APART // 2 for w in map(text_fold, every) if not _latin(w) for gap in re.findall("[^\u0600-\u06FF]+", w))
    base = base.withColumn("_tokens", latin_tokens(F.col("_folded"), every)).withColumn("_persian", has_persian(F.col("_folded")))
    base = base.withColumn("_near", F.when(F.col("_persian"), near_persian(F.col("_folded")) if short else F.col("_folded")))
    base = base.withColumn("_spoken", persian_words(F.col("_near"), every, F.col("_persian"))).drop("_near")
    hits = lambda words: word_hits(F.col("_folded"), words, F.col("_tokens"), F.col("_persian"), F.col("_spoken"))
    numbers = F.slice(F.array_distinct(F.regexp_extract_all(text.ascii_digits(F.col("_claims")), F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0))), 1, 12)
    rounds = F.when(F.col("_persian"), F.regexp_count(F.col("_folded"), F.lit(ROUND))).otherwise(0)
    base = desk_evidence(base, lexicon, hits)
    seen = base.select(
        *[c for c in base.columns if c not in ("_claims", "_folded", "_tokens", "_persian", "_spoken", "link", "source", "source_name")],
        numbers.alias("numbers"),
        (office.domestic(F.col("source"), F.col("link"), F.col("source_name")) | (F.size(hits(off_profile)) > 0)).alias("off"),
        F.size(hits(scoring.IMPACT)).alias("impacts"),
        hits(VIRAL).alias("drama"),
        F.size(hits(BUZZ)).alias("buzzing"),
        (F.size(hits(TECH)) > 0).alias("tech"),
        rounds.alias("rounds"),
    )
    names = F.map_keys("desks")
    weights = F.map_from_arrays(F.array(*[F.lit(k) for k in lexicon]), F.array(*[F.lit(float(v["weight"])) for v in lexicon.values()]))
    weighed = F.transform(names, lambda k: F.element_at(weights, k))
    topic = F.least(F.lit(1.0), F.aggregate(F.slice(F.sort_array(weighed, asc=False), 1, 2), F.lit(0.0), lambda a, w: a + w) / 1.7)
    impact = F.least(F.lit(1.0), 0.35 + F.when(F.size("numbers") > 0, 0.25).otherwise(0.0) + F.when(F.col("impacts") >= 1, 0.25).otherwise(0.0) + F.when(F.col("impacts") >= 3, 0.15).otherwise(0.0))
    places = {k: i for i, k in enumerate(lexicon)}
    order = F.transform(names, lambda k: F.struct(F.element_at(weights, k).alias("w"), F.size(F.element_at("desks", k)).alias("n"), (-F.element_at(F.map_from_arrays(F.array(*map(F.lit, places)), F.array(*map(F.lit, places.values()))), k)).alias("p"), k.alias("k")))
    primary = F.when(F.map_contains_key("desks", "tech") & F.col("tech"), "tech").when(F.map_contains_key("desks", "crypto"), "crypto").otherwise(F.array_max(order)["k"])
    known = seen.withColumn("topic", topic).withColumn("impact", impact).withColumn("freshness", fading(F.col("age_hours"), 12.0)).withColumn("primary", primary)
    reject = F.when(F.col("credibility") < least, "low_credibility").when(F.col("off"), "off_profile").when(F.size("desks") == 0, "no_desk")
    fit = reduce(lambda a, b: a + b, [F.lit(w) * F.col(c) for c, w in FIT.items()]) * F.when(F.col("kind") == "social", 0.92).otherwise(1.0)
    told_of = known.withColumn("reject", reject).withColumn("fit", F.when(F.col("reject").isNotNull(), 0.0).otherwise(rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), fit)) * 100.0)))
    return told_of.select(
        "id", "ts", "kind", "assets", "key", "credibility", "age_hours", "desks", "primary", "numbers", "topic", "impact", "freshness", "fit",
        saturated(F.size("drama") / 2.0 + F.col("rounds") / 3.0).alias("novelty"),
        saturated(F.col("buzzing") / 1.5).alias("buzz"),
        F.when(F.coalesce(F.col("social"), F.lit(0.0)) != 0, saturated(F.col("social") / 1500.0)).otherwise(0.2).alias("demand"),
        fading(F.col("age_hours"), 8.0).alias("recency"), "drama", "reject",
    )


def moves(market: DataFrame, floor: float = 0.35, least: int = 6) -> DataFrame:
    """(symbol, z): a day's change in mean absolute steps of a symbol's closes (in percent, ``floor`` at least), more for a price at the top of them.

    ``market``: (symbol, price, change_24h, closes), a row for each symbol.
    With fewer than ``least`` closes a change is taken in units of 3 percent;
    without a change z is 0.
    """
    closes = F.array_compact(F.coalesce("closes", F.array().cast("array<double>")))
    rows = market.where(F.col("symbol").isNotNull()).select("symbol", "price", "change_24h", closes.alias("c"))
    steps = F.filter(F.zip_with(F.slice("c", 1, F.greatest(F.size("c") - 1, F.lit(0))), F.slice("c", 2, F.greatest(F.size("c"), F.lit(1))), lambda a, b: F.when(a != 0, F.abs((b - a) / a) * 100)), lambda r: r.isNotNull())
    rows = rows.withColumn("r", steps)
    mean = F.when(F.size("r") > 0, F.aggregate("r", F.lit(0.0), lambda a, r: a + r) / F.size("r")).otherwise(1.0)
    top = F.coalesce(F.col("price") >= F.array_max("c") * 0.999, F.lit(False))
    bonus = F.when(top & (F.col("change_24h") > 0), 0.8).when(top & (F.col("change_24h") < 0), 0.5).otherwise(0.0)
    z = F.when(F.col("change_24h").isNull(), 0.0).when(F.size("c") >= least, F.abs("change_24h") / F.greatest(F.lit(floor), mean) + bonus).otherwise(F.abs("change_24h") / 3.0)
    return rows.select("symbol", z.alias("z"))


def viral(stories: DataFrame, market: DataFrame) -> DataFrame:
    """Adds mover (the asset that moved most, the first one named on ties), shock and viral to ``assessed`` stories; shock is 0.35 where no asset has a price.

    Ids and symbols alone are shuffled; ids are unique.
    """
    named = stories.where(F.size("assets") > 0).select("id", F.posexplode("assets").alias("at", "symbol"))
    best = named.join(moves(market), "symbol").groupBy("id").agg(F.max(F.struct("z", -F.col("at"), "symbol")).alias("best"))
    rows = stories.join(best, "id", "left").withColumn("mover", F.col("best.symbol")).withColumn("shock", F.when(F.col("best").isNotNull(), saturated(F.col("best.z") / 1.8)).otherwise(0.35)).drop("best")
    total = reduce(lambda a, b: a + b, [F.lit(w) * F.col(c) for c, w in SPREAD.items()])
    return rows.withColumn("viral", rounded(total * 100))


def judged(stories: DataFrame, market: DataFrame, order: list[Column], only: str | None = None) -> DataFrame:
    """``viral`` stories with ``rank`` = 0.55 viral + 0.45 fit and all reasons of rejection: also another desk than ``only``, and a title key that an earlier story in ``order`` has.

    Rejected stories claim no key, an empty key claims nothing.  One partial
    minimum finds the first story of a key and frequent keys are joined by a
    broadcast of at most 1,024 rows, so a title may be as frequent as it likes.  Stories are read several times and stored for that.
    """
    open_ = F.col("reject").isNull()
    rows = materialise(viral(materialise(stories, "assessed"), market), "viral")
    if only:
        rows = rows.withColumn("reject", F.when(open_ & (F.col("primary") != only), "other_desk").otherwise(F.col("reject")))
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col("id"))
    keyed = rows.where(open_ & (F.col("key") != "")).select("id", "key")
    first = materialise(rows.where(open_ & (F.col("key") != "")).groupBy("key").agg(F.min(place).alias("p"), F.count("*").alias("n")).where("n > 1").select("key", F.col("p.id").alias("lead"), "n"), "firsts")
    # keys with more than a 1,024th of all stories are at most 1,024: their stories stay where they are
    often = F.col("n") > rows.count() / 1024
    hot, rest = F.broadcast(first.where(often)), first.where(~often)
    pairs = keyed.join(hot, "key").unionByName(keyed.join(hot.select("key"), "key", "left_anti").join(rest, "key"))
    later = pairs.where(F.col("id") != F.col("lead")).select("id", F.lit(True).alias("later"))
    rows = rows.join(later, "id", "left").withColumn("reject", F.when(F.col("later"), "duplicate").otherwise(F.col("reject"))).drop("later")
    return rows.withColumn("rank", F.when(F.col("reject").isNull(), rounded(0.55 * F.col("viral") + 0.45 * F.col("fit"))))


def channel(stories: DataFrame, least_fit: float = 12.0, limit: int | None = None) -> DataFrame:
    """``judged`` stories that are taken: fit enough, best rank first, then younger, then by id."""
    out = stories.where(F.col("reject").isNull() & (F.col("fit") >= least_fit)).orderBy(F.desc("rank"), "age_hours", "id")
    return out.limit(limit) if limit else out


def rejections(stories: DataFrame) -> DataFrame:
    """(reason, n) of ``judged`` stories; 'taken' are those without a reason."""
    return stories.groupBy(F.coalesce("reject", F.lit("taken")).alias("reason")).agg(F.count("*").alias("n"))


def lanes(taken: DataFrame, lead: int = 3) -> DataFrame:
    """(primary, n, leads): stories of each desk in a channel, and the ids of its best."""
    rn = F.row_number().over(W.partitionBy("primary").orderBy(F.desc("rank"), "age_hours", "id"))
    best = taken.select("primary", "rank", "age_hours", "id").withColumn("rn", rn).where(F.col("rn") <= lead).groupBy("primary").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "id"))), lambda r: r["id"]).alias("leads"))
    return taken.groupBy("primary").agg(F.count("*").alias("n")).join(best, "primary")
