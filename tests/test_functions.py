"""Scalar functions on small frames."""

import datetime

from pyspark.sql import functions as F

from marketloom.functions import calendar, scoring, text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_text(spark):
    assert one(spark, "۱۲٫۵K", text.parse_count) == 12500.0
    assert one(spark, "none", text.parse_count) is None
    assert one(spark, "17h ago", text.parse_age_hours) == 17.0
    assert one(spark, "2 months ago", text.parse_age_hours) == 1460.0
    assert one(spark, "The Gold, the GOLD and 12 ounces", text.tokens) == ["gold", "ounces"]
    assert one(spark, "كتاب‌ها", text.fold) == "کتاب ها"
    assert one(spark, None, text.is_persian) is False
    assert one(spark, "قیمت طلا افزایش یافت", text.is_persian) is True
    assert one(spark, "قیمت gold one two three four", text.is_persian) is False
    assert one(spark, "Gold rose 3.5 percent today. Analysts were surprised!", text.sentences) == ["Gold rose 3.5 percent today.", "Analysts were surprised!"]
    assert one(spark, "Join us\nprices rose\n@channel", text.drop_promo_lines) == "prices rose"
    assert one(spark, "javascript:x", text.safe_url) == ""
    assert one(spark, "first\nsecond\nthird", text.summary_of) == "second\nthird"
    assert one(spark, "a <b>c</b> http://x.y d", text.clean_html) == "a c d"
    assert one(spark, "up 5% then 5% and 1.5", text.numbers) == ["5%", "1.5"]


def test_jalali(spark):
    days = spark.createDataFrame([(datetime.date(2026, 9, 15),), (datetime.date(2024, 3, 20),), (datetime.date(2024, 3, 19),)], "d date")
    got = [tuple(r.j) for r in days.select(calendar.jalali(F.col("d")).alias("j")).collect()]
    assert got == [(1405, 6, 24), (1403, 1, 1), (1402, 12, 29)]


def test_scoring(spark):
    assert one(spark, "prices surge and crash surge", scoring.polarity) == 0.0
    assert one(spark, "rally to a record high", scoring.polarity) == 1.0
    assert one(spark, None, scoring.polarity) == 0.0
    assert one(spark, "Exchange hacked after ETF approval", scoring.topic) == "security"
    assert one(spark, "nothing here", scoring.topic) == "general"
    assert one(spark, "Bitcoin and gold", scoring.assets) == ["BTC", "XAU"]
    assert one(spark, "crypto winter", scoring.assets) == ["BTC"]
    assert one(spark, "chainlink news", lambda c: scoring.assets(c, {"LINK": r"\bchainlink\b"})) == ["LINK"]
    c = lambda t: scoring.credibility(t, F.lit("x" * 50), F.lit(0.8), F.lit(10.0))
    assert one(spark, "short", c)["reason"] == "title_too_short"
    assert round(one(spark, "A long enough headline about gold", c)["score"], 3) == 0.768
    assert round(one(spark, "A shocking long headline about gold", c)["score"], 3) == 0.624
