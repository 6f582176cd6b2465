"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

A document's set holds its distinct word shingles; with fewer words the whole
sequence is one shingle, and without words the set is empty and linked with
nothing.  Two permutations of the 32-bit ring make all signature coordinates:
the first scatters a shingle, the second, circularly shifted by one place more
for each coordinate, ranks it.  Bands of coordinates are bucket keys.

Equal sets are one node.  In each bucket every node is compared with one
centre, and in larger buckets with a second one, the node nearest to the first;
then components are formed.  Nodes that share a bucket with another component go through an exact prefix join: under one order of all shingles,
rare ones first, linked sets share one of their first n - ceil(t n) + 1
shingles (the smaller set: n - ceil(2 t n / (1 + t)) + 1), with enough left
after it; only pairs in different components that do are compared.  So no pair
that could change a component is left out, a dense bucket costs about as many
comparisons as it has nodes, and near copies below the threshold, whose first
shingles are their own, cost none.  Links are confirmed on the full sets, made
again from the texts.

The number of bands follows from the wanted chance to miss a pair right at
the threshold.

Defined cases: null and empty texts are their own component; a component's id
is its smallest doc_id (nulls ignored); equal rows fall into one component;
empty tables give empty results; only the named columns are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.frames import join_skewed, pick
from marketloom.llm.graph import components
from marketloom.llm.store import discard, materialise
from marketloom.llm.words import buffers, mix, slices, space_words, windows, words

KEEP = space_words()
ROW_BYTES = 1 << 18


@dataclass(frozen=True)
class Rule:
    """Shingle width, link condition ``den * intersection >= num * union``, coordinates per band, and the chance to miss a pair at the threshold."""

    width: int = 5
    num: int = 80
    den: int = 100
    rows: int = 4
    miss: float = 1e-7

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - (self.num / self.den) ** self.rows))


def sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every document, one after another, and where each document's begin (n+1 values)."""
    w = words(data, offsets, KEEP)
    owner, count = w.doc(), np.diff(w.first)
    at, h = windows(w, width)
    d = owner[at]
    for short in range(1, width):
        if (count == short).any():
            at, hs = windows(w, short)
            whole = count[owner[at]] == short
            h, d = np.concatenate([h, hs[whole]]), np.concatenate([d, owner[at[whole]]])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], np.searchsorted(d[new], np.arange(len(count) + 1))


def totals(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of uint64 runs modulo 2**64; 0 for empty runs."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
    return total[first[1:]] - total[first[:-1]]


def digests(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128 bits that name each set: n x 2 uint64."""
    return np.stack([totals(mix(h ^ np.uint64(0x5851F42D4C957F2D)), first), totals(mix(h + np.uint64(0x14057B7EF767814F)), first) ^ np.diff(first).astype(np.uint64)], axis=1)


def _permute(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit ring."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(a)
    x ^= x >> np.uint32(13)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def signatures(h: np.ndarray, first: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash of every non-empty set: coordinates x sets (empty sets: all ones)."""
    full = np.flatnonzero(np.diff(first))
    out = np.full((coordinates, len(first) - 1), 0xFFFFFFFF, dtype=np.uint32)
    if len(full):
        spot = _permute((h >> np.uint64(32)).astype(np.uint32), 0x85EBCA6B, 0xC2B2AE35)
        starts = first[:-1][full]
        for k in range(coordinates):
            out[k, full] = np.minimum.reduceat(_permute(spot - np.uint32(k), 0x7FEB352D, 0x846CA68B), starts)
    return out


def bucket_keys(signature: np.ndarray, rule: Rule) -> np.ndarray:
    """One 64-bit key for each set and band: sets x bands."""
    keys = np.empty((signature.shape[1], rule.bands), dtype=np.int64)
    for band in range(rule.bands):
        h = np.full(signature.shape[1], band + 1, dtype=np.uint64)
        for k in range(rule.rows):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + signature[band * rule.rows + k])
        keys[:, band] = h.view(np.int64)
    return keys


def _names(pairs: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(pairs), [None, pa.py_buffer(np.ascontiguousarray(pairs).tobytes())]).cast(pa.binary())


def sign(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, n_shingles, node, keys): size and name of each document's set, and its bucket keys (none for an empty set)."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", ROW_BYTES):
                h, first = sets(*buffers(batch.column(1)), rule.width)
                n = np.diff(first)
                keys = bucket_keys(signatures(h, first, rule.bands * rule.rows), rule)[n > 0]
                cut = np.concatenate([[0], np.cumsum(np.where(n > 0, rule.bands, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), _names(digests(h, first)), pa.ListArray.from_arrays(cut, pa.array(keys.ravel()))], ["doc_id", "n_shingles", "node", "keys"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, node binary, keys array<bigint>")


def verify(pairs: DataFrame, rule: Rule) -> DataFrame:
    """(a, b, common, total, linked) for pairs (a, b, text_a, text_b) whose texts have the sets that a and b name."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text_b", ROW_BYTES):
                sides = []
                for name, text in (("a", "text_a"), ("b", "text_b")):
                    h, first = sets(*buffers(batch.column(batch.schema.names.index(text))), rule.width)
                    named = digests(h, first).tobytes()
                    sides.append((h, first.tolist(), [named[16 * i : 16 * i + 16] == x for i, x in enumerate(batch.column(batch.schema.names.index(name)).to_pylist())]))
                (ha, fa, ga), (hb, fb, gb) = sides
                good = [i for i in range(batch.num_rows) if ga[i] and gb[i]]
                common = [len(np.intersect1d(ha[fa[i] : fa[i + 1]], hb[fb[i] : fb[i + 1]], assume_unique=True)) for i in good]
                total = [fa[i + 1] - fa[i] + fb[i + 1] - fb[i] - c for i, c in zip(good, common, strict=True)]
                rows = batch.take(pa.array(good, pa.int64()))
                linked = [rule.den * c >= rule.num * t for c, t in zip(common, total, strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column(rows.schema.names.index("a")), rows.column(rows.schema.names.index("b")), pa.array(common, pa.int64()), pa.array(total, pa.int64()), pa.array(linked, pa.bool_())], ["a", "b", "common", "total", "linked"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary, common bigint, total bigint, linked boolean").dropDuplicates(["a", "b"])


SKETCH_BITS = 18


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def prefixes(texts: DataFrame, rule: Rule) -> DataFrame:
    """(node, token, i): the first shingles of each set, by which any linked set can be found, and their places.

    The order of shingles is by their count in a table of 2**SKETCH_BITS
    counters over all these texts (bounded, broadcast), then by hash; any order
    gives exact results.
    """
    spark = texts.sparkSession

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for whole in batches:
            for batch in slices(whole, "text", ROW_BYTES):
                h, _ = sets(*buffers(batch.column(batch.schema.names.index("text"))), rule.width)
                total += np.bincount(_slots(h), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

    table = texts.mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    counts[table["slot"].to_numpy()] = table["n"].to_numpy()
    shared = spark.sparkContext.broadcast(counts)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", ROW_BYTES):
                h, first = sets(*buffers(batch.column(batch.schema.names.index("text"))), rule.width)
                n = np.diff(first)
                owner = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((h, shared.value[_slots(h)], owner))
                length = n - -(-rule.num * n // rule.den) + 1
                place = np.arange(len(h)) - first[:-1][owner]  # order keeps each set's rows
                take = place < length[owner]
                names = batch.column(batch.schema.names.index("node")).take(pa.array(owner[take]))
                yield pa.RecordBatch.from_arrays([names, pa.array(h[order][take].view(np.int64)), pa.array(place[take])], ["node", "token", "i"])

    return texts.select("node", "text").mapInArrow(run, "node binary, token bigint, i bigint")


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts of both ends; the hot end, a, is joined last and stays on the left."""
    b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")


def _texts(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the wanted nodes, by the id of each node's first document; one text for a node unless ids repeat."""
    need = nodes.join(wanted, "node", "left_semi").select("node", "rep")
    rows = pick(docs, "doc_id", "text")
    return rows.join(need, rows.doc_id.eqNullSafe(need.rep)).select("node", "text").where("text is not null")


def link(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document."""
    signed = materialise(sign(docs, rule), "signed")
    nodes = materialise(signed.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys")), "nodes")
    member = nodes.select(F.explode("keys").alias("key"), "node", "n")
    centre = member.groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("a"), F.col("n").alias("na"))).alias("c"), F.count("*").alias("m")).where("m > 1")
    centre = materialise(centre.select("key", "c.a", "c.na", "m"), "centres")
    ratio = f"{rule.den} * least(n, na) >= {rule.num} * greatest(n, na)"
    crowd = join_skewed(member, centre, ["key"], "m", nodes.count() * rule.bands).select("key", "node", "n", "a", "na", "m")
    crowd = materialise(crowd, "crowd")
    first = crowd.where("a <> node").where(ratio).select("a", F.col("node").alias("b")).distinct()
    first = materialise(first, "pairs")
    texts = materialise(_texts(docs, nodes, crowd.select("node").distinct()), "texts")
    near = materialise(verify(_with_texts(first, texts), rule), "near")

    # a second centre for buckets of three or more: the node nearest to the first one
    nearness = near.select("a", F.col("b").alias("node"), (F.col("common") / F.col("total")).alias("j"))
    large = crowd.where("m > 2 and node <> a").select("key", "node", "n", "a")
    hub = large.join(nearness, ["a", "node"]).groupBy("key").agg(F.max(F.struct("j", F.col("node").alias("hub"), F.col("n").alias("na"))).alias("h")).select("key", "h.hub", "h.na")
    more = large.join(hub, "key").where("hub <> node").where(ratio).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    done = near.select("a", "b").unionAll(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    second = materialise(more.join(done, ["a", "b"], "left_anti"), "more")
    more = materialise(verify(_with_texts(second, texts), rule), "second")
    links = materialise(near.where("linked").select("a", "b").unionAll(more.where("linked").select("a", "b")), "links")
    roots = components(links)
    tried = near.select("a", "b").unionAll(more.select("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    # nodes that share a bucket with another component: an exact join of prefixes finds all that could be linked
    placed = crowd.select("key", "node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    own = materialise(placed.join(mixed, "key", "left_semi").select("node", "n", "root").distinct(), "mixed")
    prefix = materialise(prefixes(texts.join(own.select("node"), "node", "left_semi"), rule).join(own, "node"), "prefixes")
    # x is the smaller set: linked sets share n - ceil(2 t / (1 + t) n) + 1 of its first shingles, and after the first
    # common shingle enough must be left of both
    both = rule.num + rule.den
    x = prefix.where(f"i < n - ceil({2 * rule.num} * n / {both}) + 1").select("token", F.col("node").alias("x"), F.col("n").alias("na"), F.col("root").alias("rx"), F.col("i").alias("ix"))
    y = prefix.select("token", F.col("node").alias("y"), "n", F.col("root").alias("ry"), F.col("i").alias("iy"))
    meet = x.join(y, "token").where("(na < n or na = n and x < y) and rx <> ry").where(ratio).where(f"{both} * least(na - ix, n - iy) >= {rule.num} * (na + n)")
    rest = meet.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    rest = materialise(rest.join(tried, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        last = links.unionAll(verify(_with_texts(rest, texts), rule).where("linked").select("a", "b"))
        discard(roots)
        roots = components(last)

    placed = nodes.select("node", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    ids = materialise(placed.join(smallest, "root").select("node", "component_id"), "components")
    for old in (centre, crowd, first, texts, near, second, more, links, own, prefix, rest, roots, nodes):
        discard(old)
    out = signed.join(ids, "node", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The documents without near-duplicates: of each component the one with the smallest id stays, with all its columns.

    A row with a null id takes part under an id made from its text, larger
    than other ids; of rows that repeat an id and a text one stays.
    """
    own = F.coalesce("doc_id", F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62))
    rows = docs.select(own.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = link(rows.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")), rule)
    found = materialise(found.select(F.col("doc_id").alias("key"), "kept", "component_id", "n_shingles"), "linked")
    left = rows.join(found.where("not kept").select("key").distinct(), "key", "left_anti")
    twice = materialise(found.where("kept").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "repeated")
    if not twice.isEmpty():
        again = left.join(twice, "key", "left_semi").withColumn("same", F.sha2("row.text", 256)).dropDuplicates(["key", "same"]).drop("same")
        left = left.join(twice, "key", "left_anti").unionAll(again)
    return left.select("row.*")
