"""The newsroom's ranking and its drafts against plain versions and given replies."""

import math
import re

import pytest
from pyspark.sql import functions as F

from marketloom.functions import scoring
from marketloom.operators import drafts, newsroom

NOW = 1_700_000_000
LEXICON = {
    "gold": {"weight": 1.0, "assets": ("XAU",), "words": ("gold", "gold price", "طلا")},
    "currency": {"weight": 0.9, "words": ("dollar index", "dollar"), "ambiguous": ("dollar",)},
    "crypto": {"weight": 0.95, "assets": ("BTC",), "words": ("bitcoin",)},
    "tech": {"weight": 1.0, "words": ("nvidia", "chips")},
}
STORY = "id int, title string, summary string, source string, link string, kind string, assets array<string>, credibility double, ts double, social double"
MARKET = "symbol string, price double, change_24h double, closes array<double>"


def story(i, title, summary="", kind="news", assets=(), credibility=0.8, ts=float(NOW - 3600), social=None, link="https://a.example/1"):
    return (i, title, summary, "desk", link, kind, list(assets) if assets is not None else None, credibility, ts, social)


def assess(spark, *rows):
    return {r.id: r for r in newsroom.assessed(spark.createDataFrame(list(rows), STORY), LEXICON, NOW).collect()}


@pytest.mark.parametrize("words", [newsroom.VIRAL, newsroom.BUZZ, newsroom.TECH, scoring.IMPACT, ("gold", "gold price", "golden", "price record")])
def test_word_hits_equal_one_pattern_a_word(spark, words):
    folded = [newsroom.text_fold(w) for w in words]
    texts = [" ".join(folded), "", None, "-".join(folded), *[f"x {w} y" for w in folded], *[f"x{w}y" for w in folded], *[f"{w}های {w}xyz" for w in folded], "gold price record", "golden-gold price"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: list(r.h) for r in rows.select("i", newsroom.word_hits(F.col("t"), words).alias("h")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == [w for w in dict.fromkeys(folded) if t and re.search(scoring.word_pattern(w), t)], t


def test_fit_and_its_reasons(spark):
    got = assess(
        spark,
        story(1, "Gold price at a record of 2,100", "The Fed and inflation", assets=["XAU"]),
        story(2, "A quiet day"),
        story(3, "Gold", credibility=0.3),
        story(4, "Gold in a free giveaway"),
        story(5, "The dollar"),
        story(6, "The dollar and gold"),
        story(7, None, None, assets=None, credibility=None, ts=None),
        story(8, "Bitcoin and nvidia", kind="social"),
        story(9, "Gold", link="https://news.ir/x"),
    )
    assert got[1].reject is None and got[1].desks == {"gold": ["XAU", "gold", "gold price"]} and got[1].numbers == ["2,100"]
    topic, impact, fresh = 1 / 1.7, 1.0, 0.5 ** (1 / 12)
    assert got[1].fit == pytest.approx(math.floor((0.35 * topic + 0.3 * impact + 0.2 * fresh + 0.15 * 0.8) * 1000 + 0.5) / 10)
    assert [got[i].reject for i in range(2, 10)] == ["no_desk", "low_credibility", "off_profile", None, None, "no_desk", None, "off_profile"]
    assert all(got[i].fit == 0 for i in (2, 3, 4, 7, 9))
    assert got[5].desks == {"currency": ["dollar"]} and got[6].desks == {"gold": ["gold"]}  # an unclear word counts where nothing else does
    assert got[7].age_hours == 12 and got[7].credibility == 0.7 and got[7].key == ""
    assert got[8].primary == "tech" and set(got[8].desks) == {"crypto", "tech"}


def plain_z(price, change, closes):
    closes = [c for c in closes or [] if c is not None]
    if change is None:
        return 0.0
    if len(closes) < 6:
        return abs(change) / 3
    steps = [abs((b - a) / a) * 100 for a, b in zip(closes, closes[1:]) if a]
    z = abs(change) / max(0.35, sum(steps) / len(steps) if steps else 1.0)
    if price is not None and price >= max(closes) * 0.999:
        z += 0.8 if change > 0 else 0.5 if change < 0 else 0.0
    return z


def test_moves_of_symbols(spark):
    rows = [("A", 10.0, 5.0, [9.0, 9.5, 9.0, 9.2, 9.9, 10.0]), ("B", 9.0, -5.0, [9.0] * 6), ("C", 1.0, 6.0, [1.0, 2.0]), ("D", 1.0, None, [1.0] * 9), ("E", None, 2.0, [1.0, None, 2.0, 0.0, 3.0, 1.0, 1.0]), ("F", 1.0, 3.0, None), ("G", 0.0, 1.0, [0.0] * 7), (None, 1.0, 1.0, [1.0] * 7)]
    got = {r.symbol: r.z for r in newsroom.moves(spark.createDataFrame(rows, MARKET)).collect()}
    assert got == {s: pytest.approx(plain_z(p, c, l)) for s, p, c, l in rows if s}


def test_channel_takes_each_story_once(spark):
    rows = [story(i, t, ts=float(NOW - h * 3600), assets=a, kind=k, social=v) for i, t, h, a, k, v in [
        (1, "Gold hits a historic record high today again", 5, ["XAU"], "news", None), (2, "Gold hits a historic record high today here", 2, [], "news", None),
        (3, "Bitcoin crash", 1, ["XAU", "BTC"], "social", 3000.0), (4, "A quiet day", 1, [], "news", None), (5, "Nvidia chips", 1, None, "news", None), (6, "gold", 1, ["QQQ"], "news", None)]]
    market = spark.createDataFrame([("XAU", 1.0, 3.0, [1.0, 1.0]), ("BTC", 1.0, -3.0, [1.0, 1.0])], MARKET)
    seen = newsroom.judged(newsroom.assessed(spark.createDataFrame(rows, STORY), LEXICON, NOW), market, [F.col("ts")])
    got = {r.id: r for r in seen.collect()}
    assert got[2].reject == "duplicate" and got[1].reject is None  # the first one in the given order stays
    assert got[3].mover == "XAU"  # of equal moves the first named
    assert got[5].shock == got[6].shock == 0.35 and got[6].mover is None
    demand = 1 - math.exp(-2)
    viral = 0.3 * (1 - math.exp(-1 / 1.8)) + 0.3 * (1 - math.exp(-0.5)) + 0.2 * (1 - math.exp(-1 / 1.5)) + 0.1 * demand + 0.1 * 0.5 ** (1 / 8)
    assert got[3].viral == pytest.approx(round(viral * 100, 1))
    taken = newsroom.channel(seen).collect()
    assert [r.rank for r in taken] == sorted((r.rank for r in taken), reverse=True) and {r.id for r in taken} == {1, 3, 5, 6}
    assert {r.reason: r.n for r in newsroom.rejections(seen).collect()} == {"taken": 4, "no_desk": 1, "duplicate": 1}
    only = newsroom.judged(newsroom.assessed(spark.createDataFrame(rows, STORY), LEXICON, NOW), market, [F.col("ts")], only="tech")
    assert {r.id for r in newsroom.channel(only).collect()} == {5}
    none = newsroom.judged(newsroom.assessed(spark.createDataFrame([], STORY), LEXICON, NOW), spark.createDataFrame([], MARKET), [F.col("ts")])
    assert newsroom.lanes(newsroom.channel(none)).count() == 0


def parse(spark, *replies):
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string")
    return [x.p for x in rows.select("i", drafts.parsed(F.col("r")).alias("p")).orderBy("i").collect()]


def test_replies_in_blocks(spark):
    whole, plain, empty, null, bare = parse(
        spark,
        'noise <caption>\n A hook \n</caption><slides><slide title=" Start ">one\n two</slide><slide title=""> </slide><slide>three</slide></slides>'
        '<script><scene sec="0-4" on_screen="gold">words</scene><scene sec="4-9" on_screen=""></scene></script><hashtags>#a, b #c</hashtags>',
        "only a\n  paragraph " + "x" * 2000,
        "",
        None,
        "<slides><slide>one</slide>",
    )
    assert whole.caption == "A hook" and [(s.title, s.body) for s in whole.slides] == [("Start", "one two"), ("", "three")]
    assert [(s.sec, s.on_screen, s.narration) for s in whole.scenes] == [("0-4", "gold", "words")] and whole.hashtags == ["#a", "#c"]
    assert plain.caption.startswith("only a paragraph x") and len(plain.caption) == 1200
    assert empty is None and null is None
    assert bare.slides == [] and bare.caption == "<slides><slide>one</slide>"  # an open block is none


def test_templates_say_what_the_story_says(spark):
    rows = [(1, "Gold rises to a record", "Gold rises to a record today. Buyers gave 2,100 dollars an ounce. Miners rose 3 % on the day.", "wire", 0.85, ["xau", " "]), (2, None, None, None, None, None), (3, "Quiet", "Quiet", "wire", 0.5, [])]
    made = drafts.template(spark.createDataFrame(rows, "id int, title string, summary string, source string, credibility double, assets array<string>"))
    got = {r.id: r.draft for r in made.collect()}
    assert got[1].caption.startswith("🟡 **Gold rises to a record**\n\nBuyers gave") and "85٪" in got[1].caption and "2,100" in got[1].caption
    assert [s.title for s in got[1].slides][0] == drafts.HEADLINE and len(got[1].slides) == 5 and got[1].hashtags == ["#XAU"]
    assert [s.sec for s in got[1].scenes] == ["0-4", "4-14", "14-25", "25-35"]
    assert got[2].caption.startswith(drafts.OTHER_SIGN) and len(got[2].slides) == 2 and [s.sec for s in got[2].scenes] == ["25-35"] and got[2].hashtags == []
    assert "\n\nQuiet\n\n" in got[3].caption
    reply = drafts.parsed(F.when(F.col("id") == 1, "<caption>own</caption>").when(F.col("id") == 3, "<script><scene sec=\"1\">x</scene></script>"))
    said = {r.id: r.m for r in made.withColumn("p", reply).select("id", drafts.merged(F.col("draft"), F.col("p")).alias("m")).collect()}
    assert (said[1].method, said[1].caption) == ("reply", "own") and said[1].slides == got[1].slides
    assert said[2].method == said[3].method == "template" and said[3].scenes == got[3].scenes


def test_signs_look_for_parts_of_words(spark):
    """The rule takes any part of a text, so "said" has the "ai" of the second sign."""
    rows = spark.createDataFrame([("they said", None, None), ("", "oil", ["dxy"]), ("Dollar", "", []), (None, None, ["dxy"]), ("", "alert: gold", [])], "t string, s string, a array<string>")
    assert [r[0] for r in rows.select(drafts.market_sign(F.col("t"), F.col("s"), F.col("a"))).collect()] == ["🤖", "🛢️", "💵", "💵", "🚨"]


def test_lists_share_their_passes(spark, data):
    """each list went through every text by itself (twelve passes before)."""
    from marketloom.plans import newsroom as plans

    kept = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        plan = newsroom.assessed(plans.stories(spark, data), plans.LEXICON, plans.NOW)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", kept)
    assert 0 < plan.count("regexp_extract_all(") <= 6


def test_words_beside_long_stretches_are_found(spark):
    from marketloom.functions import text
    from marketloom.operators import office

    words = [*newsroom.VIRAL, *newsroom.TECH, *[w for ws in office.OFF_PROFILE.values() for w in ws]]
    gaps = (" ", "\n\t  ", " 18 ", "x", " " + "gold ai " * 4, " " + "all-time high " * 30, "é" * 50, "۷" * 45, ". ")
    texts = [g.join(words[(k * 5 + j * 7) % len(words)] for j in range(6)) + g for k, g in enumerate(gaps * 6)]
    rows = spark.createDataFrame([(t,) for t in [*texts, "", "plain", " ".join(words), None]], "t string").select("t", text.fold(F.col("t")).alias("f"))
    f = F.col("f")
    spoken = newsroom.persian_words(newsroom.near_persian(f), words, newsroom.has_persian(f))
    got = rows.select("t", "f", newsroom.word_hits(f, words).alias("a"), newsroom.word_hits(f, words, newsroom.latin_tokens(f, words), newsroom.has_persian(f), spoken).alias("b")).collect()
    for r in got:
        assert r.a == r.b, r.t
        if r.t is not None:
            table = str.maketrans(text.LETTER_FORMS[0] + text.PERSIAN_DIGITS + text.ARABIC_DIGITS + text.ZWNJ, text.LETTER_FORMS[1] + "0123456789" * 2 + " ")
            assert r.f == re.sub(r"[ \t-\r]+", " ", re.sub("[ً-ْٰـ]", "", r.t.lower().translate(table))).strip(" ")
            assert set(r.b) == {w for w in map(newsroom.text_fold, words) if re.search(scoring.word_pattern(w), r.f)}
