"""Documents of calendar events: category, cadence, how a figure comes about; and format choice of stories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketloom.functions import text as t

#: Categories of releases in the order in which they are tried, and their cadence.
CATEGORIES = (
    ("holiday", r"holiday|bank closed|market closed|non-economic"),
    ("speech", r"\bspeaks?\b|\bspeech\b|\bremarks\b|\baddress\b|press conference|\bconference\b|\bpost-meeting\b|\bbriefing\b"),
    ("auction", r"auction|bond sale|\bsale\b.*\bbond\b"),
    ("inventory", r"inventor|storage|\bstocks\b|\bsupply\b"),
    ("rate", r"\brate\b|policy rate|cash rate|funds rate|interest rate|refinancing|discount rate|yield curve"),
    ("document", r"statement|minutes|assessment|summary|outlook|\breport\b|bulletin|decision|tankan"),
    ("survey", r"confidence|sentiment|climate|expectations|\bmood\b|\bpmi\b|ifo|zew|economic optimism|business activity"),
    ("jobs", r"employment|unemployment|payroll|\bjobs?\b|jolts|job cuts|claims|participation rate|hiring|vacancies"),
    ("inflation", r"\bcpi\b|\bppi\b|inflation|price index|import prices|export prices|sppi|\bhpi\b|deflator"),
    ("housing", r"housing|home sales|building permits|construction|mortgage"),
    ("growth", r"\bgdp\b|industrial production|manufacturing production|factory orders|durable goods|retail sales|leading index|gross domestic|business climate"),
    ("trade", r"trade balance|current account|exports|imports|borrowing|\bbudget\b|\bm3\b|money supply|loans|net lending"),
    ("speech", r"summit|testimony|hearing|assembly|forum|press briefing|panel discussion"),
    ("trade", r"balance of trade"),
    ("inflation", r"\bpce\b"),
    ("growth", r"personal income|personal spending"),
)
CADENCES = (
    ("weekly", r"inventor|storage|claims|\bapi weekly\b|money supply|\bm3\b|mortgage applications|\bweekly\b"),
    ("quarterly", r"q/q|qoq|quarterly|tankan|\bgdp\b|gross domestic|refinancing"),
    ("annual", r"y/y|yoy|annual"),
    ("daily", r"\bdaily\b"),
)
PERIODS = {"mom": "m/m", "yoy": "y/y", "qoq": "q/q", "wow": "w/w"}
CADENCE_WORDS = {"weekly": "once a week", "monthly": "once a month", "quarterly": "once a quarter", "annual": "once a year", "daily": "every business day"}

#: How a category's figure comes about, in our words.
MADE = {
    "holiday": "Banks and exchanges are closed; no figure is published.",
    "speech": "An official speaks; there is no figure, only the tone against the last statement.",
    "auction": "Government paper is sold; cover and yield are the figures.",
    "inventory": "Stocks are counted and compared with the last count.",
    "rate": "A committee votes on the level of a benchmark rate.",
    "document": "A document is published; its wording and projections are read.",
    "survey": "Firms or households answer questions; the answers become an index.",
    "jobs": "Payrolls and households are surveyed; one release has several figures.",
    "inflation": "A basket of goods and services is priced and weighted.",
    "housing": "Permits, starts and sales of homes are counted in turn.",
    "growth": "Output is measured and deflated; the first figure is revised later.",
    "trade": "Goods, services and money that cross borders are totalled.",
    "other": "An agency compiles it on a fixed schedule.",
}

#: Words of dramatic stories.
DRAMATIC = ("ریخت", "سقوط", "جهش", "رکورد", "انفجار", "هک", "توافق", "تعلیق", "تحریم", "بحران", "هشدار", "جنگ", "توقف", "بازگشت", "غافلگیر", "crash", "plunge", "surge", "record", "halt", "ban", "hack")


def _first(key: Column, rules, otherwise: str) -> Column:
    name, pattern = rules[0]
    out = F.when(key.rlike(pattern), name)
    for name, pattern in rules[1:]:
        out = out.when(key.rlike(pattern), name)
    return out.otherwise(otherwise)


def release_key(title: Column) -> Column:
    """Lower-case title with one blank between words and one spelling of periods."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"\s+", " "))
    return reduce(lambda c, p: F.regexp_replace(c, rf"\b{p[0]}\b", p[1]), PERIODS.items(), plain)


def category(title: Column) -> Column:
    return _first(release_key(title), CATEGORIES, "other")


def cadence(title: Column) -> Column:
    return _first(release_key(title), CADENCES, "monthly")


def document(title: Column, country: Column, impact: Column) -> Column:
    """struct(category, cadence, made, published, weight) of a calendar event, by its title."""
    c, k = category(title), cadence(title)
    choose = lambda of, values: reduce(lambda out, kv: F.when(of == kv[0], kv[1]).otherwise(out), values.items(), F.lit(None).cast("string"))
    where = F.when(F.coalesce(country, F.lit("")) != "", F.concat(F.lit(" for "), country)).otherwise("")
    weight = F.when(impact == "High", "moves markets at once when it surprises").when(impact == "Medium", "moves markets when it is far from the forecast").when(impact == "Holiday", "thins trading").otherwise("gives context")
    published = F.when(c == "holiday", F.lit("not published")).otherwise(F.concat(F.lit("published "), choose(k, CADENCE_WORDS), where))
    return F.struct(c.alias("category"), k.alias("cadence"), choose(c, MADE).alias("made"), published.alias("published"), weight.alias("weight"))


def formats(title: Column, summary: Column, video_rate: Column | None = None, channel_rate: Column | None = None) -> Column:
    """struct(best, text, carousel, video): how well each format fits a story; the first of equals in this order."""
    body = F.coalesce(summary, F.lit(""))
    sents = t.sentences(body)
    nums = F.slice(t.numbers(F.array_join(sents, " ")), 1, 20)
    n, k = F.size(nums), F.size(sents)
    low = F.lower(F.concat_ws(" ", title, summary))
    dramatic = reduce(lambda a, b: a + b, [F.contains(low, F.lit(w)).cast("int") for w in DRAMATIC])
    moves = F.exists(nums, lambda x: x.rlike("%|٪|درصد"))
    has = lambda c: F.coalesce(c > 0, F.lit(False)) if c is not None else F.lit(False)
    cap = lambda c: F.round(F.least(F.lit(1.0), c), 2)
    text = cap(0.55 - 0.05 * F.least(F.lit(3), k) + F.when(n <= 1, 0.10).otherwise(0.0))
    carousel = cap(0.30 + 0.12 * F.least(F.lit(4), n) + 0.10 * F.least(F.lit(3), k) + F.when(n >= 3, 0.15).otherwise(0.0) + F.when(has(channel_rate), 0.08).otherwise(0.0))
    video = cap(0.25 + 0.22 * F.least(F.lit(2), dramatic) + F.when(moves, 0.15).otherwise(0.0) + F.when(has(video_rate), 0.10).otherwise(0.0))
    best = F.when((text >= carousel) & (text >= video), "text").when(carousel >= video, "carousel").otherwise("video")
    return F.struct(best.alias("best"), text.alias("text"), carousel.alias("carousel"), video.alias("video"))
