"""Small helpers for DataFrame plumbing in the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pick(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns only, so that extra columns of any name never clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def split_rule(doc_id: str, modulus: int):
    """crc32 of the id as text, modulo a number: the fixed split into folds (null ids: -1)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus, F.lit(-1))


def sieve(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str, bits: int = 18, keep: bool = True) -> DataFrame:
    """The rows whose key may be wanted (``keep``), or those whose key surely is not: by a broadcast bitmap of key hashes.

    The bitmap has 2**bits words of 64 bits at most, however many keys are
    wanted; with more of them it lets more rows pass, never fewer.  A null key
    is never wanted.
    """
    h = lambda c: F.xxhash64(F.col(f"`{c}`"))
    slot = lambda c: F.shiftrightunsigned(h(c), 64 - bits)
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), h(c).bitwiseAND(F.lit(63)).cast("int"))
    wanted = wanted.where(F.col(f"`{wanted_key}`").isNotNull())
    table = F.broadcast(wanted.groupBy(slot(wanted_key).alias("sieve_slot")).agg(F.bit_or(bit(wanted_key)).alias("sieve_bits")))
    held = (slot(key) == F.col("sieve_slot")) & (F.col("sieve_bits").bitwiseAND(bit(key)) != 0) & F.col(f"`{key}`").isNotNull()
    return rows.join(table, held, "left_semi" if keep else "left_anti")


def join_skewed(rows: DataFrame, side: DataFrame, on: list[str], weight: str, total: int, most: int = 1024) -> DataFrame:
    """Inner join with a side of unique keys, whose ``weight`` says how many of the ``total`` rows have the key.

    Keys with more than a ``most``-th of all rows are ``most`` at the most: they
    are broadcast, so their rows stay where they are; all other keys are joined
    by a shuffle in which no key is large.
    """
    limit = max(1024, total // most)
    hot, cold = side.where(F.col(weight) > limit), side.where(F.col(weight) <= limit)
    spread = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on)
    return rows.join(F.broadcast(hot), on).unionByName(spread)
