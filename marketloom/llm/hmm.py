"""Hidden Markov language model with corpus-wide Baum-Welch counts and exact sequence likelihoods.

Tokens are words (A-Z lower-cased) and one end token for each text.  Token
counts of the whole training corpus are one partial aggregate.  The emission
alphabet is the ``alphabet`` most frequent types, the end, and a tail symbol
for every other type; inside the tail a type has a fixed, smoothed share, so
the model is a proper distribution over all texts.  Baum-Welch statistics are
summed over partitions; each of the ``rounds`` covers the whole training corpus,
in runs of at most ``run`` tokens (a longer text gives several runs, so memory
and steps do not grow with it).  A text's likelihood comes from the scaled
forward recursion over all of its tokens; texts of a batch advance together.

Counts of the ``known`` most frequent types (a bounded table) are broadcast;
all rarer tokens of a text find their counts by a join, so no vocabulary size
is too large.

Defined cases: null and empty texts are the end token only; without training
texts all counts are 0 and the smoothing terms remain; equal texts get equal
scores; rows that repeat an id are scored row by row; empty tables give empty
results; only the named columns are read.  Scoring keeps nothing per token of a
very long text but its symbols and hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.frames import pick
from marketloom.llm.store import materialise
from marketloom.llm.words import buffers, slices, space_words, words

KEEP = space_words()
END = np.uint64(0x0E0D0E0D0E0D0E0D)
GROUP_TOKENS = 1 << 20
LOG10 = np.log(10.0)


@dataclass(frozen=True)
class Sizes:
    states: int = 8
    alphabet: int = 1 << 16
    known: int = 1 << 20
    rounds: int = 4
    run: int = 256
    smooth: float = 0.1
    prior: float = 100.0


def token_lists(batches, text: str = "text"):
    """Slices of batches with the hashes of all tokens, ends included, and each text's first token (n+1 values)."""
    for whole in batches:
        for batch in slices(whole, text):
            w = words(*buffers(batch.column(batch.schema.get_field_index(text))), KEEP)
            n = batch.num_rows
            first = w.first + np.arange(n + 1)
            tokens = np.empty(first[-1], dtype=np.uint64)
            ends = first[1:] - 1
            tokens[ends] = END
            body = np.ones(len(tokens), dtype=bool)
            body[ends] = False
            tokens[body] = w.hash
            yield batch, tokens, first


class Types:
    """A lookup table from token hashes to their place in a list; hashes are uniform, so their first bits find the spot."""

    def __init__(self, hashes: np.ndarray):
        order = np.argsort(hashes)
        self.sorted, self.place, n = hashes[order], order.astype(np.int32), len(hashes)
        self.bits = max(1, (2 * n).bit_length())
        self.first = np.searchsorted(self.sorted >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.most = int(np.diff(self.first).max()) if n else 0

    def find(self, tokens: np.ndarray) -> np.ndarray:
        """The place of each token, -1 for others."""
        out = np.full(len(tokens), -1, dtype=np.int32)
        slot = (tokens >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        todo = np.flatnonzero(at < end)
        for _ in range(self.most):
            spot = at[todo]
            same = self.sorted[spot] == tokens[todo]
            out[todo[same]] = self.place[spot[same]]
            at[todo] += 1
            todo = todo[~same & (spot + 1 < end[todo])]
            if not len(todo):
                break
        return out


def _count(batches):
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged():
        keys, place = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(place, weights=np.concatenate([c for _, c in held])).astype(np.int64)

    def out(keys, counts):
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["token", "c"])

    for _, tokens, _ in token_lists(batches):
        held.append(np.unique(tokens, return_counts=True))
        size += len(held[-1][0])
        if size > 1 << 20:
            held = [merged()]
            size = len(held[0][0])
            if size > 1 << 19:
                yield out(*held[0])
                held, size = [], 0
    if held:
        yield out(*merged())


def count_tokens(texts: DataFrame) -> DataFrame:
    """(token, c): how often each token, named by its hash, occurs in all texts; stored."""
    return materialise(pick(texts, "text").mapInArrow(_count, "token bigint, c bigint").groupBy("token").agg(F.sum("c").alias("c")), "counts")


@dataclass
class Vocabulary:
    """Corpus totals and the most frequent types with their counts."""

    total: int
    distinct: int
    hashes: np.ndarray
    counts: np.ndarray
    sizes: Sizes

    def __post_init__(self):
        s = self.sizes
        self.types = Types(self.hashes)
        ends = int(self.counts[self.hashes == END].sum())
        self.in_alphabet = min(s.alphabet, len(self.hashes))
        head = self.counts[: self.in_alphabet].astype(float)
        head[self.hashes[: self.in_alphabet] == END] = 0  # the end has a symbol of its own
        self.end_symbol, self.tail_symbol = self.in_alphabet, self.in_alphabet + 1
        self.tail_total = max(0.0, self.total - head.sum() - ends)
        self.tail_types = max(0, self.distinct - int((head > 0).sum()) - (ends > 0))
        self.tail_mass = self.tail_total + s.smooth * (self.tail_types + 1)
        p = np.concatenate([np.where(head > 0, head + s.smooth, 0), [ends + s.smooth, self.tail_mass]])
        self.unigram = p / p.sum()

    def symbols(self, tokens: np.ndarray, place: np.ndarray) -> np.ndarray:
        symbol = np.where((place >= 0) & (place < self.in_alphabet), place, self.tail_symbol).astype(np.int32)
        symbol[tokens == END] = self.end_symbol
        return symbol


@dataclass
class Hmm:
    """Initial, transition (from, to) and emission (symbol, state) probabilities."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @staticmethod
    def begin(unigram: np.ndarray, states: int, seed: int = 1) -> Hmm:
        """States that differ by fixed random factors, and seldom change."""
        rng = np.random.default_rng(seed)
        emit = unigram[:, None] * np.exp(0.5 * rng.standard_normal((len(unigram), states)))
        return Hmm(np.full(states, 1 / states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), emit / emit.sum(axis=0))

    @staticmethod
    def maximise(start: np.ndarray, move: np.ndarray, emit: np.ndarray, unigram: np.ndarray, prior: float) -> Hmm:
        """The M-step; emissions are drawn to the unigram by ``prior`` pseudo-counts."""
        e = emit + prior * unigram[:, None]
        m, s = move + 0.1, start + 0.1
        return Hmm(s / s.sum(), m / m.sum(axis=1, keepdims=True), e / e.sum(axis=0))

    def forward(self, symbols: np.ndarray, first: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
        """Natural log likelihood of every sequence; ``keep`` takes the scaled forward values (token, state), its last column the scale."""
        order, length, live = _lanes(first)
        log = np.zeros(len(order))
        begin, a = first[:-1][order], None
        for t, k in enumerate(live):
            at = begin[:k] + t
            a = self.emit[symbols[at]] * (self.start if t == 0 else a[:k] @ self.move)
            scale = a.sum(axis=1)
            a /= scale[:, None]
            log[:k] += np.log(scale)
            if keep is not None:
                keep[at, :-1], keep[at, -1] = a, scale
        out = np.empty(len(order))
        out[order] = log
        return out

    def expect(self, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected start, transition and emission counts of a group of sequences."""
        states = len(self.start)
        keep = np.empty((len(symbols), states + 1))
        self.forward(symbols, first, keep)
        order, _, live = _lanes(first)
        begin, move = first[:-1][order], np.zeros((states, states))
        beta = np.ones((0, states))
        for t in range(len(live) - 1, -1, -1):
            k = live[t]
            at = begin[:k] + t
            if len(beta):  # these lanes go on after t
                j = len(beta)
                ahead = self.emit[symbols[at[:j] + 1]] * beta / keep[at[:j] + 1, -1:]
                move += keep[at[:j], :-1].T @ ahead
                beta = np.concatenate([ahead @ self.move.T, np.ones((k - j, states))])
            else:
                beta = np.ones((k, states))
            keep[at, :-1] *= beta  # from forward values to state posteriors; step t - 1 needs its own only
        gamma = keep[:, :-1]
        emit = np.stack([np.bincount(symbols, weights=gamma[:, s], minlength=len(self.emit)) for s in range(states)], axis=1)
        return gamma[first[:-1]].sum(axis=0), move * self.move, emit


def _lanes(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Sequences by falling length, their lengths, and how many are left at each step."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    longest = int(length.max()) if len(length) else 0
    return order, length, (len(length) - np.searchsorted(np.sort(length), np.arange(longest), side="right")).tolist()


def _grouped(batches, vocabulary: Vocabulary):
    """Symbols of several slices together, cut into runs of at most ``run`` tokens."""
    held, size, most = [], 0, vocabulary.sizes.run

    def out():
        lengths = np.concatenate([n for _, n in held])
        runs = -(-lengths // most)
        cut = np.full(int(runs.sum()), most)
        cut[np.cumsum(runs) - 1] = lengths - most * (runs - 1)
        return np.concatenate([s for s, _ in held]), np.concatenate([[0], np.cumsum(cut)])

    for _, tokens, first in token_lists(batches):
        held.append((vocabulary.symbols(tokens, vocabulary.types.find(tokens)), np.diff(first)))
        size += len(tokens)
        if size >= GROUP_TOKENS:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def baum_welch(texts: DataFrame, vocabulary, model: Hmm, unigram: np.ndarray, prior: float) -> Hmm:
    """One round: expected counts of all texts, summed over partitions by symbol."""
    spark, states = texts.sparkSession, len(model.start)
    shared = spark.sparkContext.broadcast(model)
    names = [f"g{s}" for s in range(states)]

    def run(batches):
        m = shared.value
        start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros_like(m.emit)
        for symbols, first in _grouped(batches, vocabulary.value):
            a, b, c = m.expect(symbols, first)
            start, move = start + a, move + b
            emit += c
        seen = np.flatnonzero(emit.any(axis=1))
        rows = np.concatenate([start[None], move, emit[seen]])  # symbols below 0: start, then transitions by state
        keys = np.concatenate([np.arange(-1 - states, 0), seen])
        yield pa.RecordBatch.from_arrays([pa.array(keys), *[pa.array(np.ascontiguousarray(rows[:, s])) for s in range(states)]], ["symbol", *names])

    summed = pick(texts, "text").mapInArrow(run, "symbol bigint, " + ", ".join(f"{n} double" for n in names)).groupBy("symbol").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    keys = summed["symbol"].to_numpy()
    table = np.zeros((1 + states + len(model.emit), states))
    table[keys + 1 + states] = np.stack([summed[n].to_numpy() for n in names], axis=1) if len(keys) else 0
    shared.unpersist()
    return Hmm.maximise(table[0], table[1 : 1 + states], table[1 + states :], unigram, prior)


def learn(train: DataFrame, counts: DataFrame, sizes: Sizes = Sizes()):
    """The broadcast vocabulary and the model trained on all of ``train`` (doc_id, text)."""
    spark = train.sparkSession
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = counts.orderBy(F.desc("c"), "token").limit(sizes.known).toArrow()  # bounded by sizes.known
    vocabulary = Vocabulary(totals["n"], totals["v"], top["token"].to_numpy().view(np.uint64), top["c"].to_numpy(), sizes)
    shared = spark.sparkContext.broadcast(vocabulary)
    model = Hmm.begin(vocabulary.unigram, sizes.states)
    for _ in range(sizes.rounds):
        model = baum_welch(train, shared, model, vocabulary.unigram, sizes.prior)
    return shared, model


def score(docs: DataFrame, counts: DataFrame, vocabulary, model: Hmm) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark, v = docs.sparkSession, vocabulary.value
    shared = spark.sparkContext.broadcast(model)
    smooth, mass = v.sizes.smooth, v.total + v.sizes.smooth * (v.distinct + 1)

    def run(batches):
        voc, m = vocabulary.value, shared.value
        held, size = [], 0

        def flush():
            symbols = np.concatenate([h[1] for h in held])
            first = np.concatenate([[0], np.cumsum(np.concatenate([h[2] for h in held]))])
            log = m.forward(symbols, first) / LOG10
            at = 0
            for ids, _, lengths, known, base, inner, tails, tfs, cut in held:
                n = len(lengths)
                yield pa.RecordBatch.from_arrays([ids, pa.array(lengths), pa.array(known), pa.array(base), pa.array(log[at : at + n] + inner), pa.ListArray.from_arrays(cut, pa.StructArray.from_arrays([pa.array(tails), pa.array(tfs)], ["token", "tf"]))], ["doc_id", "n_tokens", "n_known", "base_score", "score", "tails"])
                at += n

        for batch, tokens, first in token_lists(batches):
            place = voc.types.find(tokens)
            n = batch.num_rows
            owner = np.repeat(np.arange(n), np.diff(first))
            found = place >= 0
            logs = np.log10(voc.counts + smooth) if len(voc.counts) else np.zeros(1)
            c = np.where(found, logs[np.maximum(place, 0)], 0.0)
            base = np.bincount(owner, weights=np.where(found, c - np.log10(mass), 0.0), minlength=n)
            rare = found & (place >= voc.in_alphabet) & (tokens != END)
            inner = np.bincount(owner, weights=np.where(rare, c - np.log10(voc.tail_mass), 0.0), minlength=n)
            keys = np.stack([owner[~found].astype(np.uint64), tokens[~found]], axis=1)
            keys, tfs = np.unique(keys, axis=0, return_counts=True) if len(keys) else (keys, np.zeros(0, np.int64))
            cut = np.searchsorted(keys[:, 0].astype(np.int64), np.arange(n + 1)).astype(np.int32)
            known = np.bincount(owner[found], minlength=n)
            held.append((batch.column(batch.schema.get_field_index("doc_id")), voc.symbols(tokens, place), np.diff(first), known, base, inner, keys[:, 1].copy().view(np.int64), tfs, cut))
            size += len(tokens)
            if size >= 2 * GROUP_TOKENS:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    schema = "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double, tails array<struct<token:bigint,tf:bigint>>"
    rows = materialise(pick(docs, "doc_id", "text").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    tails = rows.select("row", F.inline("tails")).join(counts, "token", "left")
    seen = F.coalesce("c", F.lit(0))
    log = F.log10(seen + smooth)
    added = tails.groupBy("row").agg(F.sum(F.when(seen > 0, F.col("tf")).otherwise(0)).alias("k"), F.sum(F.col("tf") * (log - float(np.log10(mass)))).alias("b"), F.sum(F.col("tf") * (log - float(np.log10(v.tail_mass)))).alias("s"))
    more = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return rows.join(added, "row", "left").select("doc_id", "n_tokens", more("n_known", "k"), F.lit(v.total).cast("long").alias("train_tokens"), more("base_score", "b"), more("score", "s"))


def run(docs: DataFrame, train: Column, sizes: Sizes = Sizes()) -> DataFrame:
    """Learns from the rows that meet ``train`` and scores every row."""
    rows = pick(docs, "doc_id", "text")
    learnt = rows.where(train)
    counts = count_tokens(learnt)
    vocabulary, model = learn(learnt, counts, sizes)
    return score(rows, counts, vocabulary, model)
