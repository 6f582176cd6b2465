"""Readers and sinks: landed files with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schemas of landed files.
ARTICLE = "id string, title string, summary string, link string, source_key string, source_kind string, credibility double, published_ts double, assets array<string>"
FEED_ITEM = "title string, link string, description string, pubDate string, guid string"
CHART = "symbol string, timestamp array<bigint>, open array<double>, high array<double>, low array<double>, close array<double>, volume array<double>"
LEXICON = "en string, fa string, domain string, source string, conf double"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def feed(spark: SparkSession, path: str) -> DataFrame:
    """Items of landed RSS files: undated items have a null time."""
    return _dated(spark.read.format("xml").option("rowTag", "item").schema(FEED_ITEM).load(path))


def feed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Items of landed RSS documents, of which a file holds one a line: as many feeds as they may be, files are few."""
    rss = F.from_xml("value", f"channel struct<item:array<struct<{FEED_ITEM.replace(' string', ':string')}>>>", {"rowTag": "rss"})
    return _dated(spark.read.text(path).select(F.inline(rss["channel"]["item"])))


def _dated(rows: DataFrame) -> DataFrame:
    return rows.withColumn("published", F.coalesce(F.try_to_timestamp(F.regexp_replace("pubDate", r"^\w+,\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp("pubDate")))


def chart(spark: SparkSession, path: str) -> DataFrame:
    """Bars of landed chart JSON, one row each; a bar without a price is dropped whole."""
    rows = spark.read.schema(CHART).json(path)
    bars = rows.select("symbol", F.inline(F.arrays_zip("timestamp", "open", "high", "low", "close", "volume")))
    bars = bars.na.drop(subset=["open", "high", "low", "close"])
    return bars.select("symbol", F.timestamp_seconds("timestamp").alias("time"), *[F.round(c, 6).alias(c) for c in ("open", "high", "low", "close")], F.coalesce("volume", F.lit(0.0)).alias("volume"))


def lexicon(spark: SparkSession, path: str, least: float = 0.0) -> DataFrame:
    """Rows of a tab-separated lexicon above a confidence."""
    return spark.read.schema(LEXICON).option("sep", "\t").option("header", True).csv(path).where(F.col("conf") >= least)


def state_arrays(df: DataFrame, column: str) -> DataFrame:
    """JSON text to an array of strings; malformed or null text is an empty array."""
    return df.withColumn(column, F.coalesce(F.from_json(F.col(column), "array<string>"), F.array().cast("array<string>")))


def write_lexicon(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
