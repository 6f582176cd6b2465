"""Benchmark decontamination by hashed windows of normalised words.

Words are maximal runs of digits, a-z (A-Z lower-cased) and non-ASCII
characters.  A benchmark item gives every window of ``window`` consecutive
words; an item of fewer words, but not none, is one window.  The windows of a
block of items, bounded in bytes, become a hash set that is broadcast with the
scan; a larger benchmark is scanned in several blocks, one after the other, so
that no broadcast grows with it and no item is left out.  One window above the
bound is a block of its own.  Every hash hit is verified
against the window's words.

Defined cases: a null text has no words (nothing is hit); an item without
words has no window; items with a null id mark words but are not named; equal
rows get equal results; empty tables give empty results; extra columns pass
through whatever their names, but for the result column's own name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.llm.store import discard, materialise
from marketloom.llm.words import Words, buffers, letter_words, slices, spans_cover, windows, words

RESULT = "struct<n_words:bigint,n_hit:bigint,spans:array<struct<start:bigint,end:bigint>>,items:array<string>>"
KEEP = letter_words()
SIEVE_BITS = 20


class WindowSet:
    """The windows of a block of items: sorted hashes, and for each its words and item ids."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        data, offsets = buffers(pa.array([t for _, t in items], pa.string()))
        w = words(data, offsets, KEEP)
        counts = np.diff(w.first)
        owner = w.doc()
        found: dict[tuple[int, int], tuple[bytes, set]] = {}
        for length in sorted({min(int(n), window) for n in counts if n}):
            at, h = windows(w, length)
            for i, x in zip(at.tolist(), h.tolist(), strict=True):
                d = int(owner[i])
                if min(int(counts[d]), window) == length:
                    entry = found.setdefault((length, x), (w.text(i, i + length), set()))
                    if items[d][0] is not None:
                        entry[1].add(items[d][0])
        self.by_length = {}
        for length in sorted({k[0] for k in found}):
            keys = sorted(x for n, x in found if n == length)
            hashes = np.array(keys, dtype=np.uint64)
            sieve = np.zeros(1 << SIEVE_BITS, dtype=bool)
            sieve[hashes >> np.uint64(64 - SIEVE_BITS)] = True
            self.by_length[length] = (sieve, hashes, [found[length, x] for x in keys])

    def hits(self, w: Words):
        """Yields (first word, length, item ids) of every verified window in a slice."""
        for length, (sieve, hashes, entries) in self.by_length.items():
            at, h = windows(w, length)
            maybe = np.flatnonzero(sieve[h >> np.uint64(64 - SIEVE_BITS)])
            place = np.minimum(np.searchsorted(hashes, h[maybe]), len(hashes) - 1)
            same = hashes[place] == h[maybe]
            for i, p in zip(at[maybe[same]].tolist(), place[same].tolist(), strict=True):
                text, ids = entries[p]
                if w.text(i, i + length) == text:
                    yield i, length, ids


def _scan(block, text: str, into: str, window: int):
    def run(batches):
        index = WindowSet(block.value, window)
        for whole in batches:
            for batch in slices(whole, text):
                at = batch.schema.get_field_index(into)
                before = batch.column(at).to_pylist() if at >= 0 else [None] * batch.num_rows
                w = words(*buffers(batch.column(batch.schema.get_field_index(text))), KEEP)
                first, owner = w.first.tolist(), None
                starts, ends, items = [], [], {}
                for i, length, ids in index.hits(w):
                    starts.append(i)
                    ends.append(i + length)
                    items.setdefault(int(np.searchsorted(w.first, i, side="right")) - 1, set()).update(ids)
                for d, old in enumerate(before):
                    for s in old["spans"] if old else ():
                        starts.append(first[d] + s["start"])
                        ends.append(first[d] + s["end"])
                    if old and old["items"]:
                        items.setdefault(d, set()).update(old["items"])
                covered = spans_cover(np.array(starts, np.int64), np.array(ends, np.int64), len(w.hash))
                total = np.concatenate([[0], np.cumsum(covered)])
                owner = set(np.searchsorted(w.first, np.array(starts, np.int64), side="right") - 1) if starts else set()
                rows = []
                for d in range(batch.num_rows):
                    a, b = first[d], first[d + 1]
                    spans = []
                    if d in owner:
                        edge = np.diff(np.concatenate([[0], covered[a:b].view(np.int8), [0]]))
                        spans = [{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
                    rows.append({"n_words": b - a, "n_hit": int(total[b] - total[a]), "spans": spans, "items": sorted(items.get(d, ()), key=lambda x: x.encode())})
                kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])
                columns = [c for k, c in enumerate(batch.columns) if k != at]
                names = [n for n in batch.schema.names if n != into]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, kind)], [*names, into])

    return run


def _pieces(window: int, most: int):
    """Cuts items above ``most`` bytes into runs of words that overlap by window - 1 words, so every window lies in one of them."""

    def run(batches):
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = t.encode()
                cut = [t]
                if len(raw) > most:
                    w = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), KEEP)
                    cut, at, n = [], 0, len(w.hash)
                    while n >= window and at <= n - window:
                        end = max(at + window, int(np.searchsorted(w.end, w.start[at] + most, side="right")))
                        cut.append(w.text(at, end).decode())
                        at = end - window + 1
                    cut = cut or [t]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(cut), pa.string()), pa.array(cut, pa.string()), pa.array([len(c.encode()) for c in cut], pa.int64())], ["id", "text", "bytes"])

    return run


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, window: int, block_bytes: int):
    """The distinct items in blocks of at most ``block_bytes`` of text each, collected one by one.

    Items are cut to an eighth of a block at most (or one window, where that is
    longer).  Hash buckets of two blocks' bytes on average are filled into
    blocks of seven eighths in the order of their hashes, so no more than
    2 * bytes / block_bytes + 1 blocks arise, and none is empty.
    """
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("id"), F.col(f"`{item_text}`").alias("text")).where("text is not null")
    pieces = materialise(items.distinct().mapInArrow(_pieces(window, block_bytes // 8), "id string, text string, bytes bigint").distinct(), "pieces")
    size = pieces.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    if size <= block_bytes:
        yield [(r.id, r.text) for r in pieces.select("id", "text").collect()]
        discard(pieces)
        return
    key = F.xxhash64("id", "text")
    before = W.partitionBy("bucket").orderBy("key", "id", "text").rowsBetween(W.unboundedPreceding, -1)
    filled = pieces.withColumn("key", key).withColumn("bucket", F.pmod("key", F.lit(max(1, size // (2 * block_bytes)))))
    filled = materialise(filled.withColumn("block", F.floor(F.coalesce(F.sum("bytes").over(before), F.lit(0)) / max(1, block_bytes * 7 // 8))), "blocks")
    discard(pieces)
    for r in filled.select("bucket", "block").distinct().collect():
        yield [(x.id, x.text) for x in filled.where((F.col("bucket") == r.bucket) & (F.col("block") == r.block)).select("id", "text").collect()]
    discard(filled)


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", into: str = "contamination", window: int = 13, block_bytes: int = 8 << 20, chain: int = 2) -> DataFrame:
    """Adds ``into``: word count, hit words, their spans (words from 0, end exclusive) and the item ids, sorted.

    ``block_bytes`` bounds the item texts of one broadcast; repeated items count
    once and long ones are cut.  Each block is a pass over the documents; after
    every ``chain`` passes the rows are written, so a task never has more Python
    workers than that.  An earlier column named ``into`` gives way.
    """
    spark = docs.sparkSession
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != into])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{into}` {RESULT}"
    stored, passes = None, 0
    for part in _blocks(benchmark, item_id, item_text, window, block_bytes):
        if passes and passes % chain == 0:
            docs = materialise(docs, "scanned")
            discard(stored)
            stored = docs
        docs = docs.mapInArrow(_scan(spark.sparkContext.broadcast(part), text, into, window), schema)
        passes += 1
    return docs


def contaminated(into: str = "contamination", share: int = 20) -> Column:
    """At least one word in ``share`` is hit."""
    return (F.col(f"{into}.n_hit") > 0) & (share * F.col(f"{into}.n_hit") >= F.col(f"{into}.n_words"))


def _without_spans(text: str, into: str):
    def run(batches):
        for whole in batches:
            for batch in slices(whole, text):
                data, offsets = buffers(batch.column(batch.schema.get_field_index(text)))
                w = words(data, offsets, KEEP)
                keep = np.ones(len(data), dtype=bool)
                for d, found in enumerate(batch.column(batch.schema.get_field_index(into)).to_pylist()):
                    for s in found["spans"] if found else ():
                        keep[w.start[w.first[d] + s["start"]] : w.end[w.first[d] + s["end"] - 1]] = False
                total = np.concatenate([[0], np.cumsum(keep)])[offsets]
                left = data[keep].tobytes()
                cleaned = [left[a:b].decode() for a, b in zip(total[:-1].tolist(), total[1:].tolist(), strict=True)]
                old = batch.column(batch.schema.get_field_index(text))
                out = pa.array([None if n else c for n, c in zip(old.is_null().to_pylist(), cleaned, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([out if n == text else c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != into], [n for n in batch.schema.names if n != into])

    return run


def remove_documents(scanned: DataFrame, into: str = "contamination") -> DataFrame:
    """Drops contaminated documents; the others stay as they are."""
    return scanned.where(~contaminated(into)).drop(into)


def remove_spans(scanned: DataFrame, text: str = "text", into: str = "contamination") -> DataFrame:
    """Cuts the hit spans out of every text; null texts stay null."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scanned.schema if f.name != into)
    return scanned.mapInArrow(_without_spans(text, into), schema)
