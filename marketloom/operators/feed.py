"""Feeds: windows, hygiene, facets, queries, paging."""

from __future__ import annotations

import shlex
from dataclasses import dataclass, field

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.store import discard, materialise

from marketloom.functions.text import title_key


def in_window(df: DataFrame, ts: str, as_of: Column, hours: float) -> tuple[DataFrame, DataFrame]:
    """(recent, archive): rows inside the last hours before as_of, and all older or undated ones."""
    fresh = F.coalesce(F.col(ts).cast("timestamp") >= as_of.cast("timestamp") - F.make_interval(secs=F.lit(hours * 3600)), F.lit(False))
    return df.where(fresh), df.where(~fresh)


def hygiene_reason(kind: Column, title: Column, summary: Column, min_chars: int = 80) -> Column:
    """Why a row is dropped: social kinds first, then short texts; null for rows that stay."""
    size = F.length(F.trim(F.concat_ws(" ", title, summary)))
    return F.when(F.coalesce(kind == "social", F.lit(False)), "social").when(size < min_chars, "too_short")


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n): counts for every named column in one pass."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])).alias("f"))
    return rows.groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


@dataclass
class Query:
    """A parsed feed query: phrases and words that must occur, words that must not, and field tests."""

    must: list[str] = field(default_factory=list)
    never: list[str] = field(default_factory=list)
    source: str | None = None
    asset: str | None = None

    @staticmethod
    def parse(text: str) -> Query:
        """-word, src:key, asset:SYM, "a phrase", and plain words."""
        q = Query()
        for part in shlex.split(text):
            low = part.lower()
            if low.startswith(("src:", "source:")):
                q.source = low.split(":", 1)[1]
            elif low.startswith("asset:"):
                q.asset = part.split(":", 1)[1].upper()
            elif part.startswith("-") and len(part) > 1:
                q.never.append(low[1:])
            else:
                q.must.append(low)
        return q

    def column(self, text: Column, source: Column, assets: Column | None = None) -> Column:
        low = F.lower(F.coalesce(text, F.lit("")))
        out = F.lit(True)
        for w in self.must:
            out = out & F.contains(low, F.lit(w))
        for w in self.never:
            out = out & ~F.contains(low, F.lit(w))
        if self.source:
            out = out & (F.lower(source) == self.source)
        if self.asset and assets is not None:
            out = out & F.array_contains(assets, self.asset)
        return out


def fingerprint_dedup(df: DataFrame, text: str, ts: str, tie: str) -> DataFrame:
    """One row for each title key, the newest, ties by the smallest id: a partial minimum of a small struct, then a join."""
    keyed = df.withColumn("fingerprint", title_key(F.col(text)))
    best = keyed.groupBy("fingerprint").agg(F.min(F.struct((-F.unix_micros(F.col(ts).cast("timestamp"))).alias("t"), F.col(tie).alias("tie"))).alias("b"))
    return keyed.join(best.select(F.col("b.tie").alias(tie)), tie, "left_semi")


def greedy_dedup(pairs: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """First-wins dedup of items by duplicate pairs (a before b): rounds decide items whose earlier neighbours are decided.

    An item stays when no earlier neighbour stays.  Each round settles all
    items whose earlier neighbours are all settled, so rounds are bounded by
    the longest chain of earlier neighbours; each is a table in the shared
    folder, and the tables before it are removed.
    """
    links = materialise(pairs.select("a", "b").distinct(), "links")
    linked = materialise(links.select(F.col("b").alias(key)).distinct(), "linked")
    settled = materialise(links.select(F.col("a").alias(key)).distinct().join(linked, key, "left_anti").withColumn("stays", F.lit(True)), "settled")
    while True:
        open_ = linked.join(settled, key, "left_anti")
        state = links.join(open_.select(F.col(key).alias("b")), "b", "left_semi").join(settled, F.col("a") == F.col(key), "left").groupBy("b").agg(F.max(F.coalesce("stays", F.lit(False))).alias("blocked"), F.max(F.col("stays").isNull()).alias("waits"))
        now = materialise(state.where("blocked or not waits").select(F.col("b").alias(key), (~F.col("blocked")).alias("stays")), "now")
        if now.isEmpty():
            break
        both = materialise(settled.unionAll(now), "settled")
        discard(settled)
        discard(now)
        settled = both
    out = items.join(settled.where("not stays").select(key), key, "left_anti")
    discard(links)
    discard(linked)
    return out


def first_wins(rows: DataFrame, keys: list, order: list, name: str) -> DataFrame:
    """Rows of which no earlier row *that stays* has the same value in any of the keys; null keys never match.

    A row that is first under all of its keys stays; rows that share a key
    with it leave; the rest is tried again.  ``order`` and then ``name``, a
    unique column, make the order; each round is two partial minima and joins
    on ``name`` and keys, whatever the number of rows with one key.
    """
    names = [f"k{i}" for i in range(len(keys))]
    small = rows.select(F.col(name).alias("id"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate([*order, F.col(name)])]).alias("o"), *[k.cast("string").alias(n) for n, k in zip(names, keys, strict=True)])
    open_, kept = materialise(small, "open"), []
    while not open_.isEmpty():
        state = open_
        for n in names:
            first = open_.where(F.col(n).isNotNull()).groupBy(n).agg(F.min("o").alias(f"first_{n}"))
            state = state.join(first, n, "left")
        leads = materialise(state.where(" and ".join(f"({n} is null or first_{n} = o)" for n in names)).select("id", *names), "leads")
        kept.append(leads)
        rest = open_.join(leads.select("id"), "id", "left_anti")
        for n in names:
            rest = rest.join(leads.where(F.col(n).isNotNull()).select(n), n, "left_anti")
        after = materialise(rest.select("id", "o", *names), "open")
        discard(open_)
        open_ = after
    stay = reduce(lambda a, b: a.unionByName(b), [k.select("id") for k in kept]) if kept else open_.select("id")
    return rows.join(stay.select(F.col("id").alias(name)), name, "left_semi")
