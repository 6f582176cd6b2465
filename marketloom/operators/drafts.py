"""Drafts of posts: a template that says only what the story says, replies in tagged blocks, and the two merged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions import text

#: Signs of stories, tried in this order: (sign, assets, words of title or summary).
SIGNS = (
    ("🚨", (), ("خبر فوری", "فوری:", "breaking news", "flash news", "alert:")),
    ("🤖", ("NVDA", "AAPL", "MSFT", "GOOGL", "AMZN", "META", "TSLA"), ("هوش مصنوعی", "تراشه", "انویدیا", "اوپن ای آی", "چت جی پی تی", "ai", "nvidia", "apple", "semiconductor", "openai")),
    ("🏦", (), ("بانک مرکزی", "فدرال رزرو", "پاول", "لاگارد", "نرخ بهره", "fomc", "central bank", "ecb", "سیاست پولی")),
    ("📊", (), ("cpi", "nfp", "gdp", "pmi", "تورم", "تولید ناخالص", "اشتغال", "بیکاری", "خرده‌فروشی", "خرده فروشی", "شاخص قیمت")),
    ("🟡", ("XAU",), ("طلا", "اونس", "انس جهانی", "gold", "xau")),
    ("⚪", ("XAG",), ("نقره", "silver", "xag")),
    ("₿", ("BTC", "ETH", "SOL", "XRP", "BNB", "ADA", "DOGE"), ("بیت‌کوین", "بیت کوین", "کریپتو", "اتریوم", "رمزارز", "ارز دیجیتال", "bitcoin", "crypto")),
    ("🛢️", ("WTI", "BRENT"), ("نفت", "اوپک", "برنت", "نفت خام", "بنزین", "oil", "crude", "brent", "opec")),
    ("💵", ("DXY",), ("شاخص دلار", "اسکناس آمریکایی", "dxy", "قیمت دلار", "نرخ دلار", "دلار آمریکا")),
    ("💶", (), ("یورو", "eur", "euro")),
)
#: Words of a title alone, then further signs, then the sign of all other stories.
TITLE_SIGN = ("💵", ("دلار", "dollar"))
LATER_SIGNS = (
    ("🇺🇸", ("آمریکا", "آمریکایی", "سیتی", "واشنگتن", "ایالات متحده", "us ", "u.s.", "citi")),
    ("📉", ("سقوط", "ریزش شدید", "افت سنگین", "افت ۳", "افت ۴", "افت ۵", "افت ۶", "افت ۷", "افت ۸", "افت ۹", "افت ۱۰", "crash", "plunge", "slump")),
    ("📈", ("رکورد تاریخی", "جهش شدید", "رشد چشمگیر", "قله تاریخی", "all-time high", "ath", "surge")),
    ("🏭", ("سهام شرکت", "درآمد فصلی", "بورس تهران", "وال استریت", "سهامداران")),
)
OTHER_SIGN = "💰"
#: Wording of drafts, and a number with its unit.
FOOTER = "این محتوا خلاصهٔ خبر است و توصیهٔ سرمایه‌گذاری نیست."
HEADLINE, FIGURES, ORIGIN = "تیتر", "اعداد کلیدی", "منبع و اعتبار"
KEY_POINT = "📌 **نکته کلیدی:** ارقام کلیدی: "
CLAIM = r"[0-9]+(?:[.,][0-9]+)?\s*(?:%|٪|درصد|دلار|تومان|میلیارد|میلیون|هزار)?"
NOT_WORD = r"[^\p{L}\p{N}_\x{0600}-\x{06FF}]+"

SLIDE = "array<struct<title:string,body:string>>"
SCENE = "array<struct<sec:string,on_screen:string,narration:string>>"


def market_sign(title: Column, summary: Column, assets: Column) -> Column:
    """The first sign whose assets or words a story has; null texts and assets are empty."""
    z = lambda c: F.lower(F.coalesce(c, F.lit("")))
    low, head = F.concat(z(title), F.lit(" "), z(summary)), z(title)
    upper = F.transform(F.coalesce(assets, F.array().cast("array<string>")), lambda a: F.upper(a))
    says = lambda c, words: reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])
    out = F.when(says(low, SIGNS[0][2]), SIGNS[0][0])
    for sign, symbols, words in SIGNS[1:]:
        test = says(low, words)
        out = out.when(F.arrays_overlap(upper, F.array(*map(F.lit, symbols))) | test if symbols else test, sign)
    out = out.when(says(head, TITLE_SIGN[1]), TITLE_SIGN[0])
    for sign, words in LATER_SIGNS:
        out = out.when(says(low, words), sign)
    return out.otherwise(OTHER_SIGN)


def stripped(value: Column) -> Column:
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def block(reply: Column, name: str) -> Column:
    """The inside of the first <name> block of a reply; empty without one."""
    return stripped(F.regexp_extract(reply, rf"(?s)<{name}>(.*?)</{name}>", 1))


def parsed(reply: Column, most: int = 1200) -> Column:
    """struct(caption, slides, scenes, hashtags) of a reply in tagged blocks; null for a null or empty one.

    Slides without title and body, and scenes without anything to say or show,
    are left out.  A reply without any block is a caption, cut to ``most``
    characters.  Hashtags are what starts with the sign, in order.
    """
    flat = lambda c: stripped(F.regexp_replace(c, r"\s+", " "))
    attribute = lambda c, name: stripped(F.regexp_extract(c, rf'{name}="([^"]*)"', 1))
    head = lambda c, tag: F.regexp_extract(c, rf"^<{tag}([^>]*)>", 1)
    inside = lambda c, tag: flat(F.regexp_extract(c, rf"(?s)^<{tag}[^>]*>(.*)</{tag}>$", 1))
    every = lambda name, tag: F.regexp_extract_all(block(reply, name), F.lit(rf"(?s)<{tag}[^>]*>.*?</{tag}>"), F.lit(0))
    slides = F.filter(F.transform(every("slides", "slide"), lambda x: F.struct(attribute(head(x, "slide"), "title").alias("title"), inside(x, "slide").alias("body"))), lambda s: (s["title"] != "") | (s["body"] != ""))
    scenes = F.filter(F.transform(every("script", "scene"), lambda x: F.struct(attribute(head(x, "scene"), "sec").alias("sec"), attribute(head(x, "scene"), "on_screen").alias("on_screen"), inside(x, "scene").alias("narration"))), lambda s: (s["on_screen"] != "") | (s["narration"] != ""))
    caption = block(reply, "caption")
    plain = (caption == "") & (F.size(slides) == 0) & (F.size(scenes) == 0)
    tags = F.filter(F.split(block(reply, "hashtags"), r"[\s,]+"), lambda h: h.startswith("#"))
    return F.when(F.coalesce(reply, F.lit("")) != "", F.struct(F.when(plain, F.substring(flat(reply), 1, most)).otherwise(caption).alias("caption"), slides.alias("slides"), scenes.alias("scenes"), tags.alias("hashtags")))


def _say(rows: DataFrame, name: str) -> Column:
    """A story's Persian text where there is one, else the other; null is empty."""
    fa = F.nullif(F.col(f"{name}_fa"), F.lit("")) if f"{name}_fa" in rows.columns else F.lit(None).cast("string")
    return F.coalesce(fa, F.col(name), F.lit(""))


def template(rows: DataFrame, into: str = "draft") -> DataFrame:
    """Adds ``into``: struct(caption, slides, scenes, hashtags) made of a story alone.

    Stories have title, summary, source, credibility and assets, and may have
    title_fa and summary_fa.  Sentences that say the title again (six words of
    ten shared) are left out; without others the caption takes the whole
    summary.  Nulls are empty, a null credibility is 0.
    """
    bag = lambda c: F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), NOT_WORD, " "), " "), lambda w: w != ""))
    base = rows.withColumn("_t", _say(rows, "title")).withColumn("_s", _say(rows, "summary"))
    base = base.withColumn("_bag", bag(F.col("_t")))
    told = lambda s: (F.size("_bag") > 0) & (F.size(bag(s)) > 0) & (F.size(F.array_intersect("_bag", bag(s))) >= 0.6 * F.least(F.size("_bag"), F.size(bag(s))))
    base = base.withColumn("_body", F.filter(text.sentences(F.col("_s")), lambda s: ~told(s)))
    base = base.withColumn("_n", F.slice(F.regexp_extract_all(text.ascii_digits(F.col("_s")), F.lit(CLAIM), F.lit(0)), 1, 8))
    source = F.coalesce("source", F.lit(""))
    trust = F.concat(F.bround(F.coalesce(F.col("credibility"), F.lit(0.0)) * 100).cast("int").cast("string"), F.lit("٪"))
    said = lambda i: F.coalesce(F.get("_body", F.lit(i)), F.lit(""))
    numbers = lambda n: F.array_join(F.slice("_n", 1, n), " · ")
    some = F.size("_body") > 0
    caption = F.concat(
        market_sign(F.col("_t"), F.col("_s"), F.col("assets")), F.lit(" **"), F.col("_t"), F.lit("**\n\n"),
        F.when(some, F.array_join(F.slice("_body", 1, 3), " ")).otherwise(F.col("_s")),
        F.when(F.size("_n") > 0, F.concat(F.lit("\n\n" + KEY_POINT), numbers(4))).otherwise(""),
        F.lit("\n\nمنبع: "), source, F.lit(" · اعتبار "), trust, F.lit(" — " + FOOTER),
    )
    page = lambda t, b: F.struct(t.alias("title"), b.alias("body"))
    none = F.array().cast(SLIDE)
    slides = F.concat(
        F.array(page(F.lit(HEADLINE), F.col("_t"))).cast(SLIDE),
        F.transform(F.slice("_body", 1, 4), lambda s: page(F.substring(s, 1, 40), s)).cast(SLIDE),
        F.when(F.size("_n") > 0, F.array(page(F.lit(FIGURES), numbers(5))).cast(SLIDE)).otherwise(none),
        F.array(page(F.lit(ORIGIN), F.concat(source, F.lit(" · اعتبار "), trust, F.lit(" — " + FOOTER)))).cast(SLIDE),
    )
    scene = lambda sec, shown, narration: F.struct(F.lit(sec).alias("sec"), shown.alias("on_screen"), narration.alias("narration"))
    scenes = F.array(
        scene("0-4", F.substring("_t", 1, 48), F.col("_t")),
        scene("4-14", F.lit(""), F.when(some, said(0)).otherwise(F.substring("_s", 1, 120))),
        scene("14-25", F.lit(""), said(1)),
        scene("25-35", F.concat(F.lit("منبع: "), source), F.concat(F.coalesce(F.get("_n", F.lit(0)), F.lit("")), F.lit(" — " + FOOTER))),
    )
    tags = F.slice(F.transform(F.filter(F.transform(F.coalesce("assets", F.array().cast("array<string>")), lambda a: F.upper(F.trim(a))), lambda a: a != ""), lambda a: F.concat(F.lit("#"), a)), 1, 4)
    made = F.struct(caption.alias("caption"), slides.alias("slides"), F.filter(scenes, lambda s: (s["narration"] != "") | (s["on_screen"] != "")).cast(SCENE).alias("scenes"), tags.alias("hashtags"))
    return base.withColumn(into, made).drop("_t", "_s", "_bag", "_body", "_n")


def merged(draft: Column, reply: Column) -> Column:
    """A draft with what a parsed reply says instead, and its method; a reply without caption and slides changes nothing."""
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    usable = F.coalesce((reply["caption"] != "") | some(reply["slides"]), F.lit(False))
    pick = lambda name, has: F.when(usable & has, reply[name]).otherwise(draft[name]).alias(name)
    return F.struct(pick("caption", reply["caption"] != ""), *[pick(n, some(reply[n])) for n in ("slides", "scenes", "hashtags")], F.when(usable, "reply").otherwise("template").alias("method"))


def request(rows: DataFrame, into: str = "request") -> DataFrame:
    """Adds a story as one tagged block, for whoever writes the reply; signs of tags in texts are replaced."""
    safe = lambda c: stripped(F.translate(F.coalesce(c.cast("string"), F.lit("")), "<>", "‹›"))
    have = lambda n: F.col(n) if n in rows.columns else F.lit(None).cast("string")
    line = lambda n: F.concat(F.lit(f"  <{n}>"), safe(have(n)), F.lit(f"</{n}>"))
    cred = F.bround(F.coalesce(F.col("credibility"), F.lit(0.0)) * 100).cast("int").cast("string")
    listed = F.array_join(F.transform("assets", lambda a: F.upper(F.trim(a))), ",")
    head = F.concat(F.lit('<news id="'), safe(F.col("id")), F.lit('" source="'), safe(F.col("source")), F.lit('" credibility="'), cred, F.lit('" assets="'), safe(listed), F.lit('">'))
    return rows.withColumn(into, F.concat_ws("\n", head, *[line(n) for n in ("title", "title_fa", "summary_fa", "summary", "link")], F.lit("</news>")))
