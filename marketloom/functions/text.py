"""Text functions on columns; all of them are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Persian digits, and Arabic letter forms folded to Persian ones.
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
LETTER_FORMS = ("يىك", "ییک")
ZWNJ = "‌"

#: Words without meaning of their own.
STOPWORDS = ("the", "and", "for", "with", "that", "this", "from", "was", "are", "has", "have", "not", "but", "its", "will", "after", "into", "over", "says", "new")


def title_of(text: Column) -> Column:
    """The first line of a text."""
    return F.substring_index(text, "\n", 1)


def summary_of(text: Column) -> Column:
    """Everything after the first line."""
    return F.when(F.instr(text, "\n") > 0, F.substr(text, F.instr(text, "\n") + 1)).otherwise(F.lit(""))


def make_id(title: Column, link: Column) -> Column:
    """Twelve hex digits of the MD5 of the trimmed lower-case title and the link."""
    return F.substring(F.md5(F.concat(F.lower(F.trim(title)), F.lit("|"), link)), 1, 12)


def fa_digits(text: Column) -> Column:
    return F.translate(text.cast("string"), "0123456789", PERSIAN_DIGITS)


def _span(signs: str) -> str:
    """A class of all characters from the first to the last of some: one range is found much faster than many characters."""
    return f"[{min(signs)}-{max(signs)}]"


def ascii_digits(text: Column) -> Column:
    digits = PERSIAN_DIGITS + ARABIC_DIGITS
    # a search costs less than spelling every letter anew
    return F.when(text.rlike(_span(digits)), F.translate(text, digits, "0123456789" * 2)).otherwise(text)


def fold(text: Column) -> Column:
    """Lower case, one letter form, ASCII digits, no vowel marks, joiners as spaces."""
    low, others = F.lower(text), LETTER_FORMS[0] + PERSIAN_DIGITS + ARABIC_DIGITS + ZWNJ
    plain = F.regexp_replace(F.translate(low, others, LETTER_FORMS[1] + "0123456789" * 2 + " "), "[ً-ْٰـ]", "")
    # a search costs less than spelling every letter anew; single blanks stay where they are
    return F.trim(F.regexp_replace(F.when(low.rlike(_span(others + "ًْٰـ")), plain).otherwise(low), r"\s(?:(?<! )|(?=\s))\s*", " "))


def words(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Distinct words of three letters or more, without stop-words and bare numbers."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.array_distinct(F.filter(words(text), lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w) & ~w.rlike("^[0-9]+$")))


def title_key(text: Column, n: int = 6) -> Column:
    """The first words of the normalised title; titles in any script keep theirs."""
    return F.array_join(F.slice(words(text), 1, n), " ")


def numbers(text: Column) -> Column:
    """Distinct numeric claims in order."""
    return F.array_distinct(F.regexp_extract_all(ascii_digits(text), F.lit(r"(\d+(?:[.,]\d+)?\s*%?)"), 1))


def sentences(text: Column) -> Column:
    """Pieces of more than twelve characters between sentence ends or line feeds; decimals stay whole."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?؟])\s+|\n+"), lambda s: F.trim(s)), lambda s: F.length(s) > 12)


def clean_html(text: Column, limit: int = 900) -> Column:
    """Without tags, addresses and repeated blanks, cut to a length."""
    plain = F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), r"https?://\S+", " ")
    return F.substring(F.trim(F.regexp_replace(plain, r"\s+", " ")), 1, limit)


def is_promo_line(line: Column) -> Column:
    """A line of handles, invitations or bare addresses."""
    return F.lower(line).rlike(r"^\s*(@\w+|https?://\S+|t\.me/\S+)\s*$|\b(?:join us|subscribe|follow us)\b")


def drop_promo_lines(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~is_promo_line(x)), "\n")


def persian_share(text: Column) -> Column:
    """Share of Persian letters among all letters."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.when(letters > 0, F.regexp_count(text, F.lit("[؀-ۿ]")) / letters).otherwise(0.0)


def longest_latin_run(text: Column) -> Column:
    """Most Latin words in a row; numbers and signs neither count nor break a run."""
    step = lambda acc, w: F.struct(
        F.when(w.rlike("[A-Za-z]"), acc["run"] + 1).when(w.rlike(r"\p{L}"), 0).otherwise(acc["run"]).alias("run"),
        F.greatest(acc["best"], F.when(w.rlike("[A-Za-z]"), acc["run"] + 1).otherwise(0)).alias("best"),
    )
    return F.aggregate(F.split(F.coalesce(text, F.lit("")), r"\s+"), F.struct(F.lit(0).alias("run"), F.lit(0).alias("best")), step, lambda acc: acc["best"])


def is_persian(text: Column) -> Column:
    """The script gate: enough Persian letters and no long Latin run."""
    return F.coalesce((persian_share(text) >= 0.45) & (longest_latin_run(text) < 4), F.lit(False))


def safe_url(url: Column) -> Column:
    return F.when(url.rlike("(?i)^https?://"), url).otherwise(F.lit(""))


def parse_count(text: Column) -> Column:
    """12.5K, 3M, 1B views and Persian digits as a number; null without one."""
    t = F.upper(F.regexp_replace(F.translate(ascii_digits(text), "٫", "."), ",", ""))
    number = F.expr("1") * F.try_to_number(F.regexp_extract(t, r"(\d+(?:\.\d+)?)", 1), F.lit("999999999999D999999")).cast("double")
    unit = F.regexp_extract(t, r"\d\s*([KMB])", 1)
    return number * F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)


def parse_age_hours(text: Column) -> Column:
    """'17h ago', '3 days ago' in hours; a month has 730 and a year 8,760."""
    t = F.lower(ascii_digits(text))
    n = F.regexp_extract(t, r"(\d+)", 1)
    unit = F.regexp_extract(t, r"\d+\s*(second|minute|min|hour|day|week|month|year|mo|s|m|h|d|w|y)", 1)
    hours = F.when(unit.isin("second", "s"), 1 / 3600).when(unit.isin("minute", "min", "m"), 1 / 60).when(unit.isin("hour", "h"), 1.0).when(unit.isin("day", "d"), 24.0).when(unit.isin("week", "w"), 168.0).when(unit.isin("month", "mo"), 730.0).when(unit.isin("year", "y"), 8760.0)
    return F.when(n != "", n.cast("double")) * hours


#: Words at which Persian spellings are joined or split, and the letters that vary.
FAMILY = ("آأإٱيىكةؤئ", "ااااییکهوی")


def family_key(text: Column) -> Column:
    """One key for the spellings of a Persian term: one letter form, no joiners, marks or blanks."""
    return F.regexp_replace(F.translate(F.lower(text), FAMILY[0], FAMILY[1]), r"[\u200c\u064b-\u0652\u0670\u0640\s-]+", "")


def hashes(text: Column) -> Column:
    """struct(sha1, md5, sha256): the short digests that name texts, keys and cache entries."""
    return F.struct(F.substring(F.sha1(text), 1, 16).alias("sha1"), F.md5(text).alias("md5"), F.substring(F.sha2(text, 256), 1, 16).alias("sha256"))


def clean_title(text: Column, most: int = 15) -> Column:
    """The first line without addresses, handles and repeated blanks, cut after ``most`` words."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(title_of(text), r"https?://\S+|[@#]\w+", " "), r"\s+", " "))
    w = F.split(plain, " ")
    return F.when(F.size(w) > most, F.concat(F.array_join(F.slice(w, 1, most), " "), F.lit("…"))).otherwise(plain)


#: What marks an address in a sentence.
ADDRESS = r"🔗|https?://|www\.|[a-zA-Z0-9-]+\.(?:com|org|net|io|ir)/\S*"


def boilerplate(sentence: Column) -> Column:
    """Sentences that carry no news: notices, credits and addresses."""
    from marketloom.functions.composer import NOTICES

    said = F.lower(F.coalesce(sentence, F.lit("")))
    return said.rlike(ADDRESS) | said.rlike("|".join(NOTICES))


def phrases(found: Column, known: list[str], most: int = 8) -> Column:
    """Known phrases of three, two or one word in an array of words, longest first, each once.

    ``found`` is a column of a table below, so that words are made once a row
    and not once for each window.
    """
    width = lambda n: [p for p in known if len(p.split()) == n]
    shifted = lambda k: F.slice(found, k + 1, F.greatest(F.size(found) - k, F.lit(0)))

    def grams(n: int) -> Column:
        out = found
        for k in range(1, n):
            out = F.zip_with(out, shifted(k), lambda a, b: F.concat(a, F.lit(" "), b))  # short ones are null
        return out

    kept = [F.array_intersect(grams(n), F.array(*[F.lit(p) for p in width(n)])) for n in (3, 2, 1) if width(n)]
    return F.slice(F.array_distinct(F.concat(*kept)), 1, most)


def ago(hours: Column) -> Column:
    """'just now', minutes, hours (halves to even) or days ago."""
    minutes = F.greatest(F.lit(1), F.floor(hours * 60).cast("int"))
    return F.when(hours.isNull(), "").when(hours < 1 / 60, "just now").when(hours < 1, F.concat(minutes.cast("string"), F.lit(" min ago"))).when(hours < 24, F.concat(F.bround(hours, 0).cast("int").cast("string"), F.lit(" h ago"))).otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit(" d ago")))


def format_count(value: Column) -> Column:
    """1234 as 1.2K, and so on; one decimal, none below a thousand."""
    out = F.format_string("%.0f", value.cast("double"))
    for limit, unit in ((1e3, "K"), (1e6, "M"), (1e9, "B")):
        out = F.when(F.abs(value) >= limit, F.concat(F.format_string("%.1f", value / limit), F.lit(unit))).otherwise(out)
    return out


def string_or_array(value: Column) -> Column:
    """A JSON array of strings, or a comma list, as upper-case trimmed entries."""
    listed = F.from_json(value, "array<string>")
    return F.filter(F.transform(F.coalesce(listed, F.split(F.coalesce(value, F.lit("")), ",")), lambda x: F.upper(F.trim(x))), lambda x: x != "")


def url_matches(url: Column, title: Column, least: int = 3, share: float = 0.34) -> Column:
    """Whether an address names a headline: a longer token of it in the path, and enough tokens altogether."""
    path = F.split(F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))), "[^a-z0-9]+", " "), " ")
    t = tokens(F.coalesce(title, F.lit("")))
    hits = F.array_intersect(t, path)
    return F.exists(hits, lambda w: F.length(w) >= 5) & (F.size(hits) >= F.greatest(F.lit(least), F.ceil(F.size(t) * share)))


def prose_lines(text: Column, least: int = 55, letters: float = 0.72) -> Column:
    """Lines of a markdown text that read as prose: long enough and mostly letters and blanks, links reduced to their words."""
    plain = F.regexp_replace(F.regexp_replace(text, r"!?\[([^\]]*)\]\([^)]*\)", "$1"), r"(?m)^\s*(?:[#>*-]+|\d+\.)\s*", "")
    good = lambda x: (F.length(x) >= least) & (F.length(F.regexp_replace(x, r"[^\p{L}\s]", "")) >= letters * F.length(x))
    return F.filter(F.transform(F.split(plain, "\n"), lambda x: F.trim(x)), good)


def json_path(value: Column, path: str, default: str) -> Column:
    """The text at a path of a JSON text; a missing path, null or malformed text gives the default."""
    return F.coalesce(F.get_json_object(value, path), F.lit(default))
