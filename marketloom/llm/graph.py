"""Connected components of an edge table, with DataFrame operations only.

Each round every node points to the smallest of itself and its neighbours
under a hash order, and edges are contracted along these pointers; random
order leaves a constant share of nodes at most, so rounds grow with the
logarithm of a component's size.  Minima are partial aggregates and joins put
the unique side on the right, so a node with very many edges is never
gathered in one task.  Rounds are stored in the shared folder.

Defined cases: self loops and repeated edges change nothing; edges with a null
end are ignored; an empty edge table gives no nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.store import discard, materialise


def _ranked(c: str):
    return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("x"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); nodes of one component, and only they, share a root."""
    left = edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct()
    left = materialise(left, "edges")
    labels = None
    while not left.isEmpty():
        both = left.select("a", "b").unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(_ranked("b")).alias("m"))
        parents = materialise(least.select(F.col("a").alias("node"), F.least(_ranked("a"), F.col("m"))["x"].alias("parent")), "parents")
        pa = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        pb = parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        after = materialise(left.join(pa, "a").join(pb, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")).where("a <> b").distinct(), "edges")
        if labels is None:
            labels = parents.withColumnRenamed("parent", "root")
        else:
            old, up = labels, parents.select(F.col("node").alias("root"), F.col("parent").alias("up"))
            labels = materialise(old.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "labels")
            discard(old)
            discard(parents)
        discard(left)
        left = after
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
