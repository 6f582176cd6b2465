"""Dates: solar Hijri calendar, local time, ages, sessions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month and exchange tables.
JALALI_MONTHS = ("فروردین", "اردیبهشت", "خرداد", "تیر", "مرداد", "شهریور", "مهر", "آبان", "آذر", "دی", "بهمن", "اسفند")
SESSIONS = {"sydney": (21, 6), "tokyo": (0, 9), "london": (7, 16), "new_york": (12, 21)}
#: Days on which an exchange opens, from Monday, 0.
DAYS = {"sydney": (6, 0, 1, 2, 3, 4), "tokyo": (0, 1, 2, 3, 4), "london": (0, 1, 2, 3, 4), "new_york": (0, 1, 2, 3, 4)}



def jalali(day: Column) -> Column:
    """struct(jy, jm, jd) of a date: days are counted in cycles of 33 years (12,053 days) made of blocks of four (1,461)."""
    n = F.datediff(day, F.lit("1970-01-01").cast("date")) + 1075195  # days before 1970 in this count
    whole = lambda a, b: F.floor(a / b).cast("int")
    in_block = (n % 12053) % 1461
    year = F.greatest(F.lit(0), whole(in_block - 1, 365))  # the first year of a block has 366 days
    d = in_block - 365 * year - F.when(year > 0, 1).otherwise(0)
    half = F.when(d < 186, F.struct(F.lit(1).alias("m"), F.lit(31).alias("len"), d.alias("d"))).otherwise(F.struct(F.lit(7).alias("m"), F.lit(30).alias("len"), (d - 186).alias("d")))
    return F.struct((33 * whole(n, 12053) + 4 * whole(n % 12053, 1461) + year - 1595).cast("int").alias("jy"), (half["m"] + whole(half["d"], half["len"])).cast("int").alias("jm"), (1 + half["d"] % half["len"]).cast("int").alias("jd"))


def to_tehran(ts: Column) -> Column:
    """Local time at a fixed offset of three and a half hours."""
    return ts + F.expr("INTERVAL '03:30' HOUR TO MINUTE")


def session_open(ts: Column, name: str) -> Column:
    """Whether an exchange is open at a UTC time on one of its days; a session that wraps midnight tests the day of the time itself."""
    start, end = SESSIONS[name]
    hour = F.hour(ts)
    inside = (hour >= start) & (hour < end) if start < end else (hour >= start) | (hour < end)
    return inside & F.weekday(ts).isin(*DAYS[name])


def session_minutes(ts: Column, name: str) -> Column:
    """Minutes to an exchange's next close if it is open, else to its next opening hour, on whatever day."""
    start, end = SESSIONS[name]
    now = F.hour(ts) * 60 + F.minute(ts)
    boundary = F.when(session_open(ts, name), end * 60).otherwise(start * 60)
    return F.when(boundary > now, boundary - now).otherwise(1440 - now + boundary)


def countdown(seconds: Column, with_seconds: bool = False) -> Column:
    """Time left in the two largest of days, hours, minutes and seconds; none of it is negative."""
    s = F.greatest(F.lit(0), F.round(seconds, 0)).cast("bigint")
    d, h, m = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60)
    last = s % 60 if with_seconds else F.lit(0)
    return F.when(d > 0, F.format_string("%dd %02dh", d, h)).when(h > 0, F.format_string("%dh %02dm", h, m)).otherwise(F.format_string("%dm %02ds", m, last))


def fa_ago(hours: Column) -> Column:
    """Persian minutes, hours (halves to even) or days ago, one minute at least; none for the future."""
    from marketloom.functions.text import fa_digits

    say = lambda n, unit: F.concat(fa_digits(n.cast("bigint")), F.lit(f" {unit} پیش"))
    minutes = F.greatest(F.lit(1.0), F.floor(hours * 60))
    return F.when(hours.isNull() | (hours < 0), "").when(hours < 1, say(minutes, "دقیقه")).when(hours < 24, say(F.bround(hours, 0), "ساعت")).otherwise(say(F.floor(hours / 24), "روز"))


def age_words(hours: Column) -> Column:
    """Minutes, hours or days ago."""
    return F.when(hours < 0, "").when(hours < 1, F.concat(F.greatest(F.lit(1), F.floor(hours * 60)).cast("string"), F.lit(" minutes ago"))).when(hours < 24, F.concat(F.bround(hours).cast("int").cast("string"), F.lit(" hours ago"))).otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit(" days ago")))
