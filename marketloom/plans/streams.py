"""Registered queries of the similarity and checkpoint streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.plans.catalog import CHECKPOINTS, query
from marketloom.sources.readers import table
from marketloom.store import materialise, shared_dir
from marketloom.streaming import flows, similar

#: The moment of the first story.
BEGIN = 1_700_000_000
STORIES = "conv_id bigint, turn bigint, role string, text string"


def stories(rows: DataFrame) -> DataFrame:
    """Questions as stories, one place of time for each turn, 450 seconds apart; each is published again, with two words more, 0, 20, 40 or 60 hours later."""
    place = F.col("conv_id") * 16 + F.col("turn")
    again = F.explode(F.array(F.lit(0), F.lit(1))).alias("again")
    first = rows.where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), place.alias("place"), "text", again)
    ts = F.timestamp_seconds(BEGIN + F.col("place") * 450 + F.col("again") * (60 + F.col("place") % 4 * 72_000))
    return first.select((F.col("id") * 2 + F.col("again")).alias("id"), ts.alias("ts"), F.when(F.col("again") == 1, F.concat("text", F.lit(" reported again"))).otherwise(F.col("text")).alias("text"))


def run(stream: DataFrame) -> DataFrame:
    """What a stream gives over everything that has landed."""
    at = f"{shared_dir(stream.sparkSession)}/streams/{uuid.uuid4().hex}"
    return flows.drain(stream, f"{at}/out", f"{at}/checkpoint")


def story_pairs(s: SparkSession, d: str) -> DataFrame:
    landed = s.readStream.schema(STORIES).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(f"{d}/conversations.parquet*")
    return materialise(run(similar.similar_pairs(stories(landed), late="365 days")).distinct(), "pairs")


_STOP = "[" + ", ".join(f"'{w}'" for w in similar.STOP) + "]"
STORY_SQL = rf"""two AS (SELECT (conv_id * 1000 + turn) * 2 + again AS id, {BEGIN} + (conv_id * 16 + turn) * 450 + again * (60 + (conv_id * 16 + turn) % 4 * 72000) AS sec,
  CASE WHEN again = 1 THEN text || ' reported again' ELSE text END AS text FROM conversations, (VALUES (0), (1)) AS v(again) WHERE role = 'user'),
st AS (SELECT id, sec, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(coalesce(text, '')), '\$?([0-9]+),?000\b', '\1k', 'g'), '\bath\b', 'high', 'g'), '[^\p{{L}}\p{{N}}_]+'), lambda w: length(w) > 2 AND NOT list_contains({_STOP}, w)) AS w FROM two),
tf AS (SELECT id, any_value(sec) AS sec, t, count(*) AS n FROM (SELECT id, sec, unnest(w) AS t FROM st) GROUP BY id, t),
nm AS (SELECT id, sqrt(sum(n * n)) AS norm FROM tf GROUP BY id),
pr AS (SELECT a.id AS a, b.id AS b FROM tf a JOIN tf b ON a.t = b.t AND (a.sec, a.id::VARCHAR) < (b.sec, b.id::VARCHAR) AND b.sec - a.sec < 172800 JOIN nm x ON x.id = a.id JOIN nm y ON y.id = b.id GROUP BY a.id, b.id HAVING sum(a.n * b.n) / any_value(x.norm * y.norm) >= 0.65)"""


@query(f"WITH {STORY_SQL} SELECT a::VARCHAR AS a, b::VARCHAR AS b FROM pr")
def stream_similar_pairs(s, d):
    """Questions within 48 hours whose words have a cosine of 0.65 or more."""
    return story_pairs(s, d)


@query()
def stream_first_stories(s, d):
    """Questions that no earlier kept question of the last 48 hours resembles; a plain loop tests it."""
    return similar.first_stories(stories(table(s, d, "conversations")), story_pairs(s, d))


@query(f"WITH {CHECKPOINTS} SELECT id, h, price_after FROM p WHERE price_after IS NOT NULL")
def stream_checkpoints(s, d):
    """The first price at or after 1, 4 and 24 hours, as it comes in."""
    landed = flows.events(s, f"{d}/events.parquet*").select(F.col("event_type").alias("symbol"), F.col("event_id").alias("id"), "ts", F.col("value").alias("price"))
    return run(similar.checkpoints(landed)).select(F.col("id").cast("bigint").alias("id"), "h", "price_after")
