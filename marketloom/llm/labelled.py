"""A bounded, documented sample of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.llm.frames import pick
from marketloom.llm.store import materialise


def sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, bound: int) -> DataFrame:
    """At most ``bound`` labelled rows (doc_id, label, text), those of the smallest id hashes, stored in the shared folder.

    ``train`` is a condition on doc_id.  Rows with a null id, or a label other
    than 0 and 1, are no examples; an id that is labelled twice takes the larger
    label.  Rows are counted, not ids: ids follow in the order of their hashes
    while the rows seen so far are at most ``bound``; an id with more rows than
    that on its own is no example.  Only ids are sorted, and there are at most
    ``bound`` of them, so their broadcast is bounded too.
    """
    ids = pick(labels, "doc_id", label).withColumnRenamed(label, "label").where("doc_id is not null and label in (0, 1)").where(train).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    ids = ids.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(bound)
    sizes = pick(docs, "doc_id").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label", "order").agg(F.count("*").alias("n")).where(F.col("n") <= bound)
    running = F.sum("n").over(W.orderBy("order", "doc_id"))  # over at most ``bound`` rows
    chosen = sizes.withColumn("so_far", running).where(F.col("so_far") <= bound).select("doc_id", "label")
    return materialise(pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text")), "labelled")
