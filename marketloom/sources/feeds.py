"""Rows of landed pages and feeds: Atom entries, channel posts, video results, trading ideas, boards.

Everything but the video walk, whose JSON nests without a fixed path, is made of
column expressions.  Ages are taken at ``as_of``, a timestamp.  Null or broken
input gives no rows.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.text import parse_age_hours, parse_count, title_of

#: Class names of the public channel pages.
TEXT, REPLY, VIEWS, MEDIA = "tgme_widget_message_text", "tgme_widget_message_reply", "tgme_widget_message_views", ("video", "photo", "document", "animation")


def inner_div(html: Column, name: str) -> Column:
    """What the first div of a class holds, nested divs included; '' without one."""
    rest = F.regexp_extract(F.coalesce(html, F.lit("")), rf'(?s)<div[^>]*class="[^"]*\b{name}\b[^"]*"[^>]*>(.*)$', 1)
    parts = F.split(rest, r"(?=<div\b|</div>)")

    def step(acc, part):
        depth = acc["depth"] + F.when(part.rlike(r"^<div\b"), 1).when(part.startswith("</div>"), -1).otherwise(0)
        open_ = (acc["depth"] > 0) & (depth > 0)
        return F.struct(F.when(acc["depth"] > 0, depth).otherwise(0).alias("depth"), F.when(open_, F.concat(acc["text"], part)).otherwise(acc["text"]).alias("text"))

    return F.aggregate(parts, F.struct(F.lit(1).alias("depth"), F.lit("").alias("text")), step, lambda acc: acc["text"])


def plain(html: Column) -> Column:
    """Without tags, entities resolved, HTML's blanks collapsed."""
    out = F.regexp_replace(html, r"<[^>]+>", " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"[ \t\n\f\r]+", " "))


def age_hours(iso: Column, as_of: Column) -> Column:
    """Hours before ``as_of``, 0 for later times, null for times that can't be read."""
    at = F.try_to_timestamp(iso)
    return F.when(at.isNotNull(), F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros(at)) / 3.6e9))


def per_hour(views: Column, age: Column) -> Column:
    return F.when(age > 0.2, views / age)


def atom_entries(pages: DataFrame, key: str, xml: str, as_of: Column) -> DataFrame:
    """(key, pos, title, link, age_hours) of Atom entries that have both a link and a title."""
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(xml, F.lit(r"(?s)<entry>(.*?)</entry>"), 1)).alias("pos", "entry"))
    part = lambda p: F.regexp_extract("entry", p, 1)
    title = plain(part(r"(?s)<title[^>]*>(.*?)</title>"))
    rows = rows.where(F.col("entry").rlike("(?s)<title[^>]*>.*?</title>")).select(key, "pos", title.alias("title"), part(r'<link[^>]*href="([^"]+)"').alias("link"), age_hours(part(r"(?s)<updated>(.*?)</updated>"), as_of).alias("age_hours"))
    return rows.where("link <> ''")


def channel_posts(pages: DataFrame, key: str, html: str, as_of: Column, viewed: bool = False) -> DataFrame:
    """(key, pos, post_id, text, title, media, views, time, age_hours, views_per_hour, url) of a channel page, newest first.

    Posts begin at the tag with their data-post attribute, and marks count in
    tags only, not in what is said.  A quoted message is cut out before the
    body is looked for; posts with neither text nor media are service messages
    and left out, but with ``viewed`` those that have views are kept.  Pages of
    equal keys are pages of their own.
    """
    tag = r'<[^<>]*\bdata-post="'
    blocks = F.regexp_extract_all(html, F.lit(rf'(?s)({tag}[^"]+".*?)(?={tag}|$)'), 1)
    rows = pages.withColumn("_page", F.monotonically_increasing_id()).select(key, "_page", F.posexplode(blocks).alias("at", "block"))
    quoted = inner_div(F.col("block"), REPLY)
    rows = rows.withColumn("own", F.when(quoted != "", F.replace("block", quoted, F.lit(""))).otherwise(F.col("block")))
    media = F.coalesce(*[F.when(F.col("own").rlike(f"<[^<>]*tgme_widget_message_{m}"), F.lit(m)) for m in MEDIA])
    post, time = F.regexp_extract("block", r'\bdata-post="([^"]+)"', 1), F.regexp_extract("own", r'<time[^>]*datetime="([^"]+)"', 1)
    views = parse_count(F.nullif(F.regexp_extract("own", rf'<[^<>]*{VIEWS}"[^>]*>([^<]+)<', 1), F.lit("")))
    rows = rows.select(key, "_page", "at", post.alias("post_id"), plain(inner_div(F.col("own"), TEXT)).alias("text"), media.alias("media"), views.alias("views"), time.alias("time"), age_hours(time, as_of).alias("age_hours"))
    said = (F.col("text") != "") | F.col("media").isNotNull()
    rows = rows.where(F.contains("post_id", F.lit("/")) & (said | F.col("views").isNotNull() if viewed else said))
    order = F.row_number().over(_posts()) - 1
    return rows.select(key, order.alias("pos"), "post_id", "text", title_of(F.col("text")).alias("title"), "media", "views", "time", "age_hours", per_hour(F.col("views"), F.col("age_hours")).alias("views_per_hour"), F.concat(F.lit("https://t.me/"), "post_id").alias("url"))


def _posts():
    from pyspark.sql import Window

    return Window.partitionBy("_page").orderBy(F.desc("at"))  # the posts of one page


def _walk(html: str | None) -> list[dict]:
    """Video records of a results page, by a walk over whatever its JSON looks like; each id once."""
    m = re.search(r"ytInitialData\s*=\s*(\{.*?\});", html or "", re.S)
    try:
        stack = [json.loads(m.group(1))] if m else []
    except ValueError:
        stack = []
    text = lambda n: str(n.get("simpleText") or "".join(str(r.get("text", "")) for r in n.get("runs") or [] if isinstance(r, dict))) if isinstance(n, dict) else ""
    found: dict[str, dict] = {}
    while stack:  # depth first, in the order of the document
        node = stack.pop()
        if isinstance(node, list):
            stack += reversed(node)
        elif isinstance(node, dict):
            for name, kind in (("videoRenderer", "video"), ("reelItemRenderer", "short")):
                v = node.get(name)
                if isinstance(v, dict) and v.get("videoId"):
                    record = {"id": str(v["videoId"]), "kind": kind, "title": text(v.get("title")), "channel": text(v.get("ownerText") or v.get("longBylineText")), "views": text(v.get("viewCountText")) or text(v.get("shortViewCountText")), "age": text(v.get("publishedTimeText")), "duration": text(v.get("lengthText"))}
                    found.setdefault(record["id"], record)
            stack += reversed(list(node.values()))
    return list(found.values())


VIDEO = pa.struct([(c, pa.string()) for c in ("id", "kind", "title", "channel", "views", "age", "duration")])


def videos(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, id, kind, title, channel, views, age_hours, views_per_hour, duration, url) of the videos of results pages."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_walk(x) for x in batch.column(1).to_pylist()], pa.list_(VIDEO))], [key, "found"])

    fields = ",".join(f"{f.name}:string" for f in VIDEO)
    rows = pages.select(key, html).mapInArrow(run, f"{key} {dict(pages.dtypes)[key]}, found array<struct<{fields}>>").select(key, F.posexplode("found").alias("pos", "v"))
    views, age = parse_count(F.nullif(F.col("v.views"), F.lit(""))), parse_age_hours(F.col("v.age"))
    return rows.select(key, "pos", "v.id", "v.kind", "v.title", "v.channel", views.alias("views"), age.alias("age_hours"), per_hour(views, age).alias("views_per_hour"), "v.duration", F.concat(F.lit("https://www.youtube.com/watch?v="), "v.id").alias("url"))


#: The fields of a trading idea as it is delivered.
IDEA = "struct<id:string,name:string,description:string,date_timestamp:bigint,likes_count:bigint,views_count:bigint,comments_count:bigint,is_hot:boolean,is_picked:boolean,is_video:boolean,is_education:boolean,symbol:struct<full_name:string,short_name:string,interval:string,direction:int>,user:struct<username:string>>"


def ideas(raw: DataFrame, key: str, value: str) -> DataFrame:
    """Trading ideas of JSON arrays, flat; directions 1, -1, 0 become Long, Short, Neutral."""
    rows = raw.select(key, F.posexplode(F.from_json(value, f"array<{IDEA}>")).alias("pos", "i"))
    word = F.when(F.col("i.symbol.direction") == 1, "Long").when(F.col("i.symbol.direction") == -1, "Short").when(F.col("i.symbol.direction") == 0, "Neutral").otherwise("")
    zero = lambda c: F.coalesce(F.col(f"i.{c}"), F.lit(0)).alias(c.removesuffix("_count"))
    flag = lambda c: F.coalesce(F.col(f"i.{c}"), F.lit(False)).alias(c.removeprefix("is_"))
    body = F.coalesce("i.description", F.lit(""))
    return rows.select(key, "pos", F.coalesce("i.id", F.lit("")).alias("id"), F.trim(F.regexp_replace(F.coalesce("i.name", F.lit("")), r"\s+", " ")).alias("title"), F.substring(body, 1, 420).alias("snippet"), F.coalesce("i.symbol.full_name", "i.symbol.short_name", F.lit("")).alias("symbol"), F.coalesce("i.symbol.interval", F.lit("")).alias("interval"), word.alias("direction"), F.coalesce("i.user.username", F.lit("")).alias("user"), *[zero(c) for c in ("likes_count", "views_count", "comments_count")], *[flag(c) for c in ("is_hot", "is_picked", "is_video", "is_education")], F.coalesce("i.date_timestamp", F.lit(0)).alias("ts"))


def badge(kind: str) -> Column:
    """The filter of one badge; every idea for 'all'."""
    return {"picked": F.col("picked"), "video": F.col("video"), "education": F.col("education")}.get(kind, F.lit(True))


def fear_greed(raw: DataFrame, value: str, most: int = 8) -> DataFrame:
    """(ts, value, label) of the last ``most`` readings of a JSON answer, oldest first."""
    rows = raw.select(F.inline(F.from_json(value, "struct<data:array<struct<value:string,value_classification:string,timestamp:string>>>")["data"]))
    return rows.select(F.col("timestamp").cast("bigint").alias("ts"), F.col("value").cast("int").alias("value"), F.col("value_classification").alias("label")).orderBy(F.desc("ts")).limit(most).orderBy("ts")


def board(quotes: DataFrame, groups: DataFrame) -> DataFrame:
    """(symbol, group, price, change): % change against the close before, two decimals; groups from a dimension, else 'other'."""
    change = F.round((F.col("price") - F.col("prev")) / F.nullif(F.col("prev"), F.lit(0.0)) * 100, 2)
    return quotes.join(groups, "symbol", "left").select("symbol", F.coalesce("group", F.lit("other")).alias("group"), "price", change.alias("change"))


def snapshots(live: DataFrame, stale: DataFrame, history: DataFrame) -> DataFrame:
    """(symbol, price, change, stale): live prices, else those kept from before; a missing change comes from the last two closes (symbol, day, close)."""
    rank = F.row_number().over(_closes())
    two = history.withColumn("rn", rank).where("rn <= 2").groupBy("symbol").agg(F.max(F.when(F.col("rn") == 1, F.col("close"))).alias("last"), F.max(F.when(F.col("rn") == 2, F.col("close"))).alias("prev"))
    old = stale.select("symbol", F.col("price").alias("old_price"), F.col("change").alias("old_change"))
    rows = live.join(old, "symbol", "full").join(two, "symbol", "left")
    own = F.coalesce("change", F.when(F.col("price").isNull(), F.col("old_change")), (F.col("last") - F.col("prev")) / F.nullif(F.col("prev"), F.lit(0.0)) * 100)
    return rows.select("symbol", F.coalesce("price", "old_price", "last").alias("price"), own.alias("change"), F.col("price").isNull().alias("stale"))


def _closes():
    from pyspark.sql import Window

    return Window.partitionBy("symbol").orderBy(F.desc("day"))


def wiki_words(dump: DataFrame, value: str = "text", ns: str = "ns", redirect: str = "redirect") -> DataFrame:
    """(word, n): words of article pages, redirects skipped, markup removed."""
    strip = F.col(value)
    for pattern, by in ((r"(?s)<ref[^>]*>.*?</ref>|<[^>]+>", " "), (r"(?s)\{\{[^{}]*\}\}", " "), (r"(?s)\{\{[^{}]*\}\}", " "), (r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1"), (r"https?://\S+", " "), (r"'{2,}|={2,}", " ")):
        strip = F.regexp_replace(strip, pattern, by)
    from marketloom.functions.text import words

    rows = dump.where((F.col(ns) == 0) & F.col(redirect).isNull())
    return rows.select(F.explode(words(F.coalesce(strip, F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
