"""Similarity dedup and timed checkpoints as streams.

Both keep state by key in Spark's state store.  Pairs don't depend on the order
in which stories arrive, as long as none is later than the watermark allows;
checkpoints take ticks in time order, which files that land in time order give
whatever their split.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marketloom.operators.feed import greedy_dedup
from marketloom.streaming.flows import state_store

#: Words without weight in the similarity of stories.
STOP = ("the", "and", "for", "that", "this", "with", "from", "have", "has", "had", "are", "was", "were", "will", "would", "could", "should", "been", "being", "about", "after", "into", "over", "more", "most", "other", "some", "such", "than", "them", "then", "these", "they", "what", "when", "where", "which", "who", "why", "how", "all", "any", "both", "each", "few", "past", "mark", "reaches", "hits", "breaks", "barrier", "tops", "passes", "new", "time")


def story_tokens(text: Column) -> Column:
    """Words of a story that count: longer than two letters, no stop-words; round thousands are written with k."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\$?(?<![0-9])([0-9]+),?000(?![\p{L}\p{N}_])", "$1k"), r"(?<![\p{L}\p{N}_])ath(?![\p{L}\p{N}_])", "high")
    stop = F.array(*[F.lit(w) for w in STOP])
    return F.filter(F.split(plain, r"[^\p{L}\p{N}_]+"), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


def vector_of(tokens, least: float) -> tuple[list[str], list[int], int]:
    """Distinct tokens (longest first), their counts, and the length of the prefix behind which less than ``least`` of the vector's length is left.

    Two vectors with a cosine of ``least`` or more share a token in both
    prefixes: their first common token lies in both, or the tokens behind one
    of the prefixes would have to make up the whole cosine.
    """
    counts = Counter(tokens)
    order = sorted(counts, key=lambda w: (-len(w), w))
    left = sum(n * n for n in counts.values())
    bound, n = least * least * left * (1 - 1e-9), 0
    while n < len(order) and left >= bound:
        left -= counts[order[n]] ** 2
        n += 1
    return order, [counts[w] for w in order], n


class _Pairs(StatefulProcessor):
    """Pairs of stories of one span of time and the next whose cosine reaches the threshold within the window; the later one is ``b``.

    State is a list that grows by each batch's stories and goes as a whole when
    the span is over.  ``own`` stories are of the key's span, others of the
    span before; two of those have met there.
    """

    def __init__(self, least: float, seconds: int):
        self.least, self.seconds = least, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "id string, sec bigint, own boolean, tokens array<string>, tf array<bigint>, meet array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = sorted(((str(r.id), int(r.sec), bool(r.own), list(r.tokens), [int(x) for x in r.tf], list(r.meet)) for f in rows for r in f.itertuples()), key=lambda r: (r[1], r[0]))
        stories, under, out = [], {}, []

        def add(name, sec, own, tokens, tf, meet) -> None:
            stories.append((name, sec, own, dict(zip(tokens, tf, strict=True)), math.sqrt(sum(x * x for x in tf))))
            for w in meet:
                under.setdefault(w, []).append(len(stories) - 1)

        old = list(self.seen.get()) if self.seen.exists() else []
        for r in old:
            add(*r)
        for r in new:
            others = {k for w in r[5] for k in under.get(w, ())}
            add(*r)
            name, sec, own, vector, size = stories[-1]
            for k in others:
                other, then, theirs, before, length = stories[k]
                if other != name and (own or theirs) and abs(sec - then) < self.seconds:
                    few, many = (vector, before) if len(vector) < len(before) else (before, vector)
                    dot = sum(x * many.get(t, 0) for t, x in few.items())
                    if dot and dot / (size * length) >= self.least:
                        out.append((other, name) if (then, other) < (sec, name) else (name, other))
        self.seen.appendList(new)
        if not old:
            self.handle.registerTimer((int(key[0]) + 1) * self.seconds * 1000)
        yield pd.DataFrame(out, columns=["a", "b"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Drops a span that is over: all that come now are later."""
        self.seen.clear()
        yield pd.DataFrame({"a": pd.Series(dtype=str), "b": pd.Series(dtype=str)})

    def close(self) -> None:
        pass


def similar_pairs(stream: DataFrame, least: float = 0.65, hours: int = 48, late: str = "1 hour", salts: int = 4) -> DataFrame:
    """(a, b): stories (id, ts, text) whose term counts have a cosine of ``least`` or more and that are less than ``hours`` apart, a before b.

    Stories meet under the tokens of their prefixes, in spans of ``hours``: a
    story goes to its own span and to the next one, so two that are near enough
    share one.  The tokens of a span are dealt to ``salts`` keys, and a story
    goes to those of its tokens; a key holds two spans of time, however long
    the stream is.  A pair that meets under several keys comes several times.
    """

    @F.pandas_udf("tokens array<string>, tf array<bigint>, n int")
    def vectors(tokens: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([vector_of(t, least) for t in tokens], columns=["tokens", "tf", "n"])

    seconds = hours * 3600
    rows = stream.withWatermark("ts", late).select(F.col("id").cast("string").alias("id"), "ts", F.unix_seconds("ts").alias("sec"), vectors(story_tokens(F.col("text"))).alias("v"))
    prefix, dealt = F.slice("v.tokens", F.lit(1), F.col("v.n")), lambda w: F.pmod(F.xxhash64(w), F.lit(salts))
    keys = rows.withColumn("salt", F.explode(F.array_distinct(F.transform(prefix, dealt))))
    keys = keys.withColumn("meet", F.filter(prefix, lambda w: dealt(w) == F.col("salt")))
    span = F.floor(F.col("sec") / seconds)
    keys = keys.withColumn("place", F.explode(F.array(F.struct(span.alias("span"), F.lit(True).alias("own")), F.struct((span + 1).alias("span"), F.lit(False).alias("own")))))
    state_store(stream.sparkSession)
    flat = keys.select("place.span", "salt", "id", "ts", "sec", "place.own", "v.tokens", "v.tf", "meet")
    return flat.groupBy("span", "salt").transformWithStateInPandas(_Pairs(least, seconds), "a string, b string", "append", "EventTime")


def first_stories(stories: DataFrame, pairs: DataFrame) -> DataFrame:
    """The stories (id) that no earlier kept story resembles, from the pairs that a drained stream has stored."""
    named = stories.select(F.col("id").alias("_own"), F.col("id").cast("string").alias("id"))
    return greedy_dedup(pairs, named, "id").select(F.col("_own").alias("id"))


class _Checkpoints(StatefulProcessor):
    """First price at or after each open goal of one symbol's part."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "at array<bigint>, id array<string>, h array<int>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Columns of numbers only are held, as a batch may bring very many rows of a key."""
        held = self.open.get() if self.open.exists() else ([], [], [])
        goals = [(np.array(held[0], dtype=np.int64), pa.array(held[1], pa.string()), np.array(held[2], dtype=np.int32))]
        ticks = []
        for f in rows:
            tick = (f.h == 0).to_numpy()
            t, g = f[tick], f[~tick]
            ticks.append((t.us.to_numpy(np.int64), t.tick.to_numpy(np.int64), t.price.to_numpy(np.float64)))
            goals.append((g.us.to_numpy(np.int64), pa.array(g.id.astype(str), pa.string()), g.h.to_numpy(np.int32)))
        us, tick, price = (np.concatenate(c) for c in zip(*ticks, strict=True))
        order = np.lexsort((tick, us))
        us, price = us[order], price[order]
        first = np.flatnonzero(np.diff(us, prepend=us[:1] - 1))  # of ticks of one moment the first
        us, price = us[first], price[first]
        at, h = (np.concatenate([g[k] for g in goals]) for k in (0, 2))
        ids = pa.chunked_array([g[1] for g in goals], pa.string())
        found = np.searchsorted(us, at)
        done, left = np.flatnonzero(found < len(us)), np.flatnonzero(found == len(us))
        self.open.update((at[left].tolist(), ids.take(pa.array(left)).to_pylist(), h[left].tolist()))
        for k in range(0, max(1, len(done)), 10_000):
            part = done[k : k + 10_000]
            yield pd.DataFrame({"id": pd.Series(ids.take(pa.array(part)).to_pylist(), dtype=object), "h": h[part], "price_after": price[found[part]]})

    def close(self) -> None:
        pass


def checkpoints(stream: DataFrame, hours: tuple[int, ...] = (1, 4, 24), salts: int = 4) -> DataFrame:
    """(id, h, price_after) for rows (id, symbol, ts, price): the first price of the symbol at or after each horizon.

    A row is an event, whose horizons are goals, and a tick.  The goals of a
    symbol are dealt to ``salts`` keys and its ticks go to all of them, so no
    key holds all open goals of one symbol.  State holds open goals only; a
    goal without a later tick stays open.
    """
    us = F.unix_micros("ts")
    goals = F.array(*[F.struct(F.lit(h).alias("h"), (us + h * 3_600_000_000).alias("us")) for h in hours])
    own = F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")
    tick = F.transform(F.sequence(F.lit(0), F.lit(salts - 1)), lambda k: F.struct(F.lit(0).alias("h"), us.alias("us"), k.alias("salt")))
    goal = F.transform(goals, lambda g: F.struct(g.h.alias("h"), g.us.alias("us"), own.alias("salt")))
    rows = stream.select("symbol", "id", F.col("id").alias("tick"), "price", F.explode(F.concat(tick, goal)).alias("x"))
    state_store(stream.sparkSession)
    flat = rows.select("symbol", "x.salt", "x.h", "x.us", "id", "tick", "price").where("h > 0 or price is not null")
    return flat.groupBy("symbol", "salt").transformWithStateInPandas(_Checkpoints(), "id string, h int, price_after double", "append", "None")
