"""Intermediate tables in the folder that all executors share.

``spark.checkpoint.dir`` names that folder.  Where a local session leaves it
unset, as in tests, a new temporary folder takes its place; a cluster's session
must name one, as a machine-local folder would be lost with its executor.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_OF_LOCAL_SESSIONS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _OF_LOCAL_SESSIONS.get(context.applicationId) or f"file://{tempfile.mkdtemp(prefix='marketloom-')}"
        _OF_LOCAL_SESSIONS[context.applicationId] = found
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes a frame once as Parquet in the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/marketloom/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._marketloom_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Removes a frame of ``materialise`` that nothing reads any more."""
    path = getattr(df, "_marketloom_path", None)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
