"""Structured Streaming flows over landed files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """The landed event files as a stream; event time is a timestamp for watermarks."""
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.parquet").parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def idempotent(stream: DataFrame, keys: list[str], within: str = "24 hours") -> DataFrame:
    """One row for each key inside the watermark's delay."""
    return stream.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


def sessions(stream: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Counts by key and session window."""
    w = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return w.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def changes(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Rows whose value differs from the last one seen for the key, in event order inside a batch."""
    kinds = dict(stream.dtypes)

    def step(group, frames: Iterator[pd.DataFrame], state):
        last = state.get[0] if state.exists else None
        out = []
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for ts, event, v in zip(rows["ts"], rows["event_id"], rows[value], strict=True):
            if v is not None and v == v and v != last:
                out.append((group[0], event, ts, last, v))
                last = v
        if last is not None:
            state.update((last,))
        if out:
            yield pd.DataFrame(out, columns=[key, "event_id", "ts", "old", "new"])

    schema = f"{key} {kinds[key]}, event_id bigint, ts timestamp, old {kinds[value]}, new {kinds[value]}"
    return stream.groupBy(key).applyInPandasWithState(step, schema, f"last {kinds[value]}", "append", GroupStateTimeout.NoTimeout)


def state_store(spark: SparkSession) -> None:
    """Lets the session's streams keep timers and maps; streams that already run keep their own store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over everything that has landed and reads its output table."""
    spark = stream.sparkSession
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
