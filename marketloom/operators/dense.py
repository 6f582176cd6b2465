"""Exact nearest neighbours of dense vectors, in blocks of queries."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCHEMA = "query bigint, neighbour bigint, cosine double"


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Unit vectors as rows; null, shorter, longer and zero vectors are zero."""
    out = np.zeros((len(column), dims))
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False)
    flat = column.filter(fits).flatten()
    if len(flat):
        values = flat.to_numpy(zero_copy_only=False).reshape(-1, dims)
        whole = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, dims).all(axis=1, keepdims=True)
        out[fits.to_numpy(zero_copy_only=False)] = np.where(whole, values, 0.0)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def _against(block, k: int, dims: int, step: int = 512):
    def run(batches):
        ids, queries = block.value
        q, best = np.array(ids, np.int64), [[] for _ in ids]
        unit = _matrix(pa.array(queries, pa.list_(pa.float64())), dims)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                other = batch.column(0).to_numpy(zero_copy_only=False)
                cosine = np.round(unit @ _matrix(batch.column(1), dims).T, 9)
                for i in range(len(q)):
                    c = cosine[i]
                    # ties of the k-th are kept here and settled by id below
                    cut = np.partition(c, -k - 1)[-k - 1] if len(c) > k + 1 else -2.0  # one of them may be the query itself
                    best[i] += [(-c[j], int(other[j])) for j in np.flatnonzero(c >= cut) if other[j] != q[i]]
                    best[i] = sorted(best[i])[:k]
        rows = [(int(q[i]), n, -c) for i in range(len(q)) for c, n in best[i]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([float(r[2]) for r in rows], pa.float64())], ["query", "neighbour", "cosine"])

    return run


def neighbours(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 5, block: int = 2048) -> DataFrame:
    """(query, neighbour, cosine): the ``k`` most similar rows of every query, itself excluded, by exact cosines; ties by key.

    Queries are taken in blocks of at most ``block`` vectors, dealt by ranges of
    their keys; each block is broadcast and one pass over the rows, of which
    every task returns k a query.  Null ids are no queries or neighbours;
    vectors of another length than the first query's, null or zero ones have
    cosine 0.
    """
    spark = rows.sparkSession
    q = queries.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    other = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    first, parts, after = q.orderBy("key").first(), [], None
    dims = len(first.vector) if first else 0
    while True:
        left = (q if after is None else q.where(F.col("key") > after)).dropDuplicates(["key"]).orderBy("key").limit(block).collect()
        if not left:
            break
        after = left[-1].key
        sent = spark.sparkContext.broadcast(([r.key for r in left], [r.vector for r in left]))
        parts.append(other.mapInArrow(_against(sent, k, dims), SCHEMA))
    if not parts:
        return spark.createDataFrame([], SCHEMA)
    every = reduce(lambda a, b: a.unionAll(b), parts)
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("cosine"), "neighbour"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k)
