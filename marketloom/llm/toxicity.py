"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Terms are words (maximal runs of letters, digits and non-ASCII bytes, A-Z
lower-cased) and their first 4 to 8 bytes as stems.  The bounded labelled sample
is dealt, label by label, to three disjoint parts.  A lexicon of at most
``lexicon_size`` terms is mined from the first (five rows in ten) by how much
oftener toxic documents use a term, trees are boosted on the second (three) and
calibrated on the third (two).  The dense features of a document are
lexicon densities, the share of lexicon words near a second-person pronoun,
capitals, punctuation and obfuscation rates.

Defined cases: null and empty texts have zero features and get a score like
any other; with fewer than six labelled rows of either kind (two in each part)
the score is the share of label 1 (0 without any); equal texts get equal scores; empty tables
give empty results; extra columns of the input never take part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.llm.labelled import sample
from marketloom.llm.store import discard, materialise
from marketloom.llm.words import Words, buffers, letter_words, mix, slices, words

#: Second-person words of four languages.
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "tu", "te", "toi", "vous", "votre", "ton", "ta", "du", "dich", "dir", "dein", "deine", "sie", "ihr", "usted", "ustedes", "tú", "ti", "vosotros")
STEMS = (4, 5, 6, 7, 8)
#: The parts to which labelled rows are dealt in turn.
PARTS = ("lexicon", "trees", "calibration", "lexicon", "trees", "calibration", "lexicon", "trees", "lexicon", "lexicon")
NEAR = 6
FEATURES = ("lexicon_density", "lexicon_weight", "heaviest", "log_hits", "second_person", "near_share", "capitals", "punctuation", "exclamations", "obfuscation", "log_words")
KEEP = letter_words()


def terms(w: Words) -> np.ndarray:
    """For each word its own hash and those of its stems, 0 where it has no such stem: words x (1 + stems)."""
    out = np.zeros((len(w.hash), 1 + len(STEMS)), dtype=np.uint64)
    out[:, 0] = w.hash
    width = w.end - w.start
    padded = np.concatenate([w.data, np.zeros(STEMS[-1], np.uint8)]).astype(np.uint64)
    h = np.zeros(len(w.hash), dtype=np.uint64)
    for k in range(STEMS[-1]):
        h = h << np.uint64(8) | padded[w.start + k]
        if k + 1 in STEMS:
            out[:, 1 + STEMS.index(k + 1)] = np.where(width > k + 1, mix(h ^ np.uint64(0xABCD << 48 | k)), np.uint64(0))
    return out


def _term_counts(batches):
    """Documents, toxic and other, in which each term of a batch occurs."""
    for whole in batches:
        for batch in slices(whole, "text"):
            w = words(*buffers(batch.column(batch.schema.get_field_index("text"))), KEEP)
            t = terms(w)
            toxic = batch.column(batch.schema.get_field_index("label")).to_numpy(zero_copy_only=False)
            doc = np.repeat(w.doc()[:, None], t.shape[1], axis=1)[t != 0]
            pairs = np.unique(np.stack([t[t != 0], doc.astype(np.uint64)]), axis=1) if len(doc) else np.zeros((2, 0), np.uint64)
            keys, place = np.unique(pairs[0], return_inverse=True)
            bad = np.bincount(place, weights=toxic[pairs[1].astype(np.int64)], minlength=len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(bad), pa.array(np.bincount(place, minlength=len(keys)) - bad)], ["term", "bad", "good"])


@dataclass
class Lexicon:
    """Sorted term hashes and their weights."""

    keys: np.ndarray
    weights: np.ndarray

    def weigh(self, t: np.ndarray) -> np.ndarray:
        """The largest weight among a word's terms; 0 for a word outside the lexicon."""
        if not len(self.keys) or not len(t):
            return np.zeros(len(t))
        place = np.minimum(np.searchsorted(self.keys, t), len(self.keys) - 1)
        return np.where(self.keys[place] == t, self.weights[place], 0.0).max(axis=1)


def mine(rows: DataFrame, size: int = 512, least: int = 3) -> Lexicon:
    """The terms whose smoothed log-odds between toxic and other documents are surely largest (two standard errors off)."""
    totals = rows.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("bad"), F.count("*").alias("all")).first()
    a, b = totals["bad"] + 1.0, totals["all"] - totals["bad"] + 1.0
    counts = rows.mapInArrow(_term_counts, "term bigint, bad bigint, good bigint").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    p, q = F.col("bad") + 0.5, F.col("good") + 0.5
    odds = F.log(p / (a - F.col("bad") + 0.5)) - F.log(q / (b - F.col("good") + 0.5))
    best = counts.where(F.col("bad") >= least).withColumn("w", odds).withColumn("z", F.col("w") - 2 * F.sqrt(1 / p + 1 / q)).where("z > 0.7")
    top = sorted((np.uint64(r.term & ((1 << 64) - 1)), r.w) for r in best.orderBy(F.desc("z"), "term").limit(size).collect())
    return Lexicon(np.array([k for k, _ in top], dtype=np.uint64), np.array([w for _, w in top]))


def _hashes(texts) -> np.ndarray:
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    return np.sort(words(np.frombuffer(b"".join(raw), np.uint8), offsets, KEEP).hash)


def dense(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon, second: np.ndarray) -> np.ndarray:
    """The features of every document of a slice: documents x FEATURES."""
    w = words(data, offsets, KEEP)
    n, count = len(offsets) - 1, np.diff(w.first)
    owner, per = w.doc(), np.maximum(count, 1)
    weight = lexicon.weigh(terms(w))
    hit = weight > 0
    you = np.isin(w.hash, second)
    at = np.flatnonzero(you)
    near = np.zeros(len(hit), dtype=bool)
    if len(at):
        i = np.arange(len(hit))
        place = np.searchsorted(at, i)
        for p in (np.minimum(place, len(at) - 1), np.maximum(place - 1, 0)):
            near |= (np.abs(at[p] - i) <= NEAR) & (owner[at[p]] == owner)
    sums = lambda x: np.bincount(owner, weights=x, minlength=n)
    heaviest = np.zeros(n)
    np.maximum.at(heaviest, owner[hit], weight[hit])
    hits = sums(hit)

    def rate(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)

    capital = (data >= 65) & (data <= 90)
    sign = (data > 32) & (data < 127) & ~KEEP[data] & ~capital
    letter = KEEP[data] | capital
    inner = np.zeros(len(data), dtype=bool)  # a sign or digit between two letters
    odd = sign | ((data >= 48) & (data <= 57))
    inner[1:-1] = odd[1:-1] & (letter & ~odd)[:-2] & (letter & ~odd)[2:]
    return np.stack([hits / per, sums(weight) / per, heaviest, np.log1p(hits), sums(you) / per, sums(hit & near) / np.maximum(hits, 1), rate(capital), rate(sign), rate(data == 33), rate(inner), np.log1p(count)], axis=1)


def featurise(docs: DataFrame, lexicon: Lexicon, text: str = "text", into: str = "features") -> DataFrame:
    """Replaces the text column by an array of FEATURES."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        second = _hashes(SECOND_PERSON)
        for whole in batches:
            for batch in slices(whole, text):
                x = dense(*buffers(batch.column(batch.schema.get_field_index(text))), shared.value, second)
                column = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(c for c, s in zip(batch.columns, batch.schema.names, strict=True) if s != text), column], [*(s for s in batch.schema.names if s != text), into])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text)
    return docs.mapInArrow(run, f"{schema}, `{into}` array<double>")


@dataclass
class Model:
    """Lexicon, boosted trees and calibration; without trees, ``share`` is every score."""

    lexicon: Lexicon
    trees: object = None
    calibration: object = None
    share: float = 0.0

    def score(self, docs: DataFrame, text: str = "text", into: str = "score") -> DataFrame:
        """Keeps every column but the text and adds the calibrated probability of label 1; an earlier column of that name gives way."""
        docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != into])
        if self.trees is None:
            return docs.drop(text).withColumn(into, F.lit(self.share))
        row = docs.select(F.struct(*[f"`{c}`" for c in docs.columns if c != text]).alias("row"), F.col(f"`{text}`").alias("text"))
        x = featurise(row, self.lexicon).withColumn("_x", array_to_vector("features"))
        raw = self.trees.transform(x).withColumn("_p", vector_to_array("probability")[1])
        return self.calibration.transform(raw).select("row.*", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_calibrated"))).alias(into))


def learn(docs: DataFrame, labels: DataFrame, train, bound: int = 20_000, lexicon_size: int = 512, trees: int = 20, depth: int = 3) -> Model:
    """Fits lexicon, trees and calibration on at most ``bound`` labelled rows that meet ``train``, a condition on doc_id."""
    labelled = sample(docs, labels, "toxic", train, bound)
    dealt = F.row_number().over(W.partitionBy("label").orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id", F.xxhash64("text")))  # over at most ``bound`` rows
    rows = labelled.withColumn("part", F.element_at(F.array(*map(F.lit, PARTS)), (F.pmod(dealt - 1, F.lit(len(PARTS))) + 1).cast("int")))
    parts = materialise(rows, "parts")
    discard(labelled)
    counts = {r.label: r.n for r in parts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    lexicon = mine(parts.where("part = 'lexicon'"), lexicon_size) if total else Lexicon(np.zeros(0, np.uint64), np.zeros(0))
    if any(counts.get(label, 0) < 6 for label in (0, 1)):
        discard(parts)
        return Model(lexicon, share=share)
    fitted = materialise(featurise(parts.where("part <> 'lexicon'"), lexicon).select("label", "part", "doc_id", "features").repartition(2, "doc_id").sortWithinPartitions("doc_id"), "dense")
    discard(parts)
    x = fitted.withColumn("_x", array_to_vector("features"))
    booster = GBTClassifier(featuresCol="_x", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=5, minInstancesPerNode=3, maxBins=64)
    boosted = booster.fit(x.where("part = 'trees'"))
    calibrated = IsotonicRegression(featuresCol="_p", labelCol="label", predictionCol="_calibrated").fit(boosted.transform(x.where("part = 'calibration'")).withColumn("_p", vector_to_array("probability")[1]).select(F.col("label").cast("double").alias("label"), "_p"))
    discard(fitted)
    return Model(lexicon, boosted, calibrated, share)
