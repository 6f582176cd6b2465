"""A stored inverted index that takes batches of postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.store import discard, materialise

SCHEMA = "term string, key bigint, w double, ts bigint, df bigint, bucket int"


class TermIndex:
    """Postings (term, key, w, ts) by term buckets in a folder that all executors share.

    A batch rewrites only the buckets of its terms: stored and new postings of
    a term are merged (the heaviest weight of a document, its newest time), the
    newest ``most`` stay, and ``df`` keeps the number of documents seen.  The
    merged buckets are written beside the index first and then replace theirs,
    each as a whole.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, most: int = 600):
        self.spark, self.path, self.buckets, self.most = spark, path, buckets, most
        self.stored = False

    def read(self) -> DataFrame:
        """All postings (term, key, w, ts, df)."""
        if not self.stored:
            return self.spark.createDataFrame([], SCHEMA).drop("bucket")
        return self.spark.read.schema(SCHEMA).parquet(self.path).drop("bucket")

    def merge(self, batch: DataFrame) -> None:
        """Adds postings (term, key, w, ts); a document may come again."""
        bucket = F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")
        new = materialise(batch.where("term is not null and key is not null").select("term", F.col("key").cast("bigint").alias("key"), F.col("w").cast("double").alias("w"), F.col("ts").cast("bigint").alias("ts"), F.lit(0).cast("bigint").alias("df"), bucket.alias("bucket")), "postings")
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # ``buckets`` of them at most
        rows = new
        if self.stored:
            rows = self.spark.read.schema(SCHEMA).parquet(self.path).where(F.col("bucket").isin(touched)).unionByName(new)
        each = rows.groupBy("bucket", "term", "key").agg(F.max("w").alias("w"), F.max("ts").alias("ts"), F.max("df").alias("df"))
        of = W.partitionBy("bucket", "term")
        ranked = each.withColumn("rn", F.row_number().over(of.orderBy(F.desc("ts"), "key"))).withColumn("df", F.greatest(F.max("df").over(of), F.count("*").over(of)))
        self._replace(ranked.where(F.col("rn") <= self.most).drop("rn"))
        discard(new)

    def prune(self, documents: DataFrame, now: int, days: int = 21, most_documents: int = 4000) -> None:
        """Keeps postings of the newest ``most_documents`` documents (key, ts) of the last ``days``."""
        kept = documents.where(F.col("ts") >= now - days * 86400).orderBy(F.desc("ts"), "key").limit(most_documents).select("key")
        if self.stored:
            left = materialise(self.spark.read.schema(SCHEMA).parquet(self.path).join(kept, "key", "left_semi"), "pruned")
            left.select(*[c.split()[0] for c in SCHEMA.split(", ")]).write.partitionBy("bucket").mode("overwrite").parquet(self.path)
            discard(left)

    def _replace(self, rows: DataFrame) -> None:
        done = materialise(rows.select(*[c.split()[0] for c in SCHEMA.split(", ")]), "merged")
        done.repartition("bucket").write.partitionBy("bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(self.path)
        discard(done)
        self.stored = True
