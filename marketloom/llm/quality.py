"""Quality classifier: logistic regression over hashed word n-grams, learnt by follow-the-regularised-leader.

Tokens are maximal runs of word characters or of other signs, case kept;
features are their 1- and 2-grams hashed to 2**BITS slots, and the 2- and
3-grams that begin and end with one token, whichever it is, as one slot each;
a feature's value is its share of the document's n-grams.  The bounded sample of labelled documents
is dealt to a fixed number of shards; each shard learns its own weights by
FTRL-proximal steps, and the model is their mean, so training is parallel and
does not depend on the number of executors.  A score is one sparse dot
product, taken for whole Arrow batches at once.

Defined cases: null and empty texts have no features and get the bias' score;
without labelled rows, or with one label only, the score is the smoothed share
of label 1 (0.5 without any); equal texts get equal scores; empty tables give
empty results; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.store import discard
from marketloom.llm.words import buffers, slices, token_classes, windows, words

BITS = 18
SCALE = 16.0
KINDS = token_classes()
#: Slots of the 2-gram of one token twice, and of the 3-gram with one token around another.
TWICE, AROUND = 1, 2


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot and document of every n-gram occurrence, ordered by document, and n-grams per document."""
    w = words(data, offsets, KINDS, lower=False)
    n = len(offsets) - 1
    at, pairs = windows(w, 2)
    owner = w.doc()
    triples, _ = windows(w, 3)
    twice, around = at[w.hash[at] == w.hash[at + 1]], triples[w.hash[triples] == w.hash[triples + 2]]
    slots = np.concatenate([(np.concatenate([w.hash, pairs]) >> np.uint64(64 - BITS)).astype(np.int64), np.full(len(twice), TWICE), np.full(len(around), AROUND)])
    docs = np.concatenate([owner, owner[at], owner[twice], owner[around]])
    return slots, docs, np.bincount(docs, minlength=n)


def _examples(batches):
    for whole in batches:
        for batch in slices(whole, "text"):
            slots, docs, total = features(*buffers(batch.column(batch.schema.get_field_index("text"))))
            keys, counts = np.unique(docs << BITS | slots, return_counts=True)
            owner, slot = keys >> BITS, (keys & ((1 << BITS) - 1)).astype(np.int32)
            value = (SCALE * counts / np.maximum(total, 1)[owner]).astype(np.float32)
            cut = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([batch.column(names.index("doc_id")), batch.column(names.index("label")), pa.ListArray.from_arrays(cut, pa.array(slot)), pa.ListArray.from_arrays(cut, pa.array(value))], ["doc_id", "label", "slots", "vals"])


@dataclass(frozen=True)
class Ftrl:
    """Parameters of FTRL-proximal: step size, its offset, and the two penalties."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.001
    epochs: int = 3

    def fit(self, examples) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the slots (the last one is the bias) after ``epochs`` passes in the given order."""
        z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
        for _ in range(self.epochs):
            for slots, vals, label in examples:
                x = np.append(vals, 1.0)
                at = np.append(slots, 1 << BITS)
                zi, ni = z[at], n[at]
                root = np.sqrt(ni)
                w = np.where(np.abs(zi) <= self.l1, 0.0, -(zi - np.sign(zi) * self.l1) / ((self.beta + root) / self.alpha + self.l2))
                g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
                z[at] += g - (np.sqrt(ni + g * g) - root) / self.alpha * w
                n[at] = ni + g * g
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))


def fit(sample: DataFrame, shards: int = 4, rule: Ftrl = Ftrl()) -> np.ndarray:
    """The 2**BITS + 1 weights learnt from a sample of (doc_id, label, text); the model has a fixed size."""

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "doc_id"])
        w = rule.fit([(np.asarray(s, dtype=np.int64), np.asarray(v, dtype=np.float64), y) for s, v, y in zip(pdf.slots, pdf.vals, pdf.label, strict=True)])
        at = np.flatnonzero(w)
        return pd.DataFrame({"slot": at, "weight": w[at]})

    counts = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    model = np.zeros((1 << BITS) + 1)
    if len(counts) < 2:
        share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
        model[-1] = np.log(share / (1 - share))
        return model
    rows = sample.mapInArrow(_examples, "doc_id bigint, label int, slots array<int>, vals array<float>").withColumn("key", F.xxhash64("doc_id", F.lit(7)))
    learnt = rows.withColumn("shard", F.pmod("key", F.lit(shards))).groupBy("shard").applyInPandas(train, "slot int, weight double")
    for r in learnt.groupBy("slot").agg((F.sum("weight") / shards).alias("weight")).toPandas().itertuples():
        model[r.slot] = r.weight
    return model


def score(docs: DataFrame, model: np.ndarray, text: str = "text", into: str = "score") -> DataFrame:
    """Adds the probability of label 1 as column ``into``; an earlier column of that name gives way."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != into])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        w = shared.value
        for whole in batches:
            for batch in slices(whole, text):
                slots, docs_, total = features(*buffers(batch.column(batch.schema.get_field_index(text))))
                dot = np.bincount(docs_, weights=w[slots], minlength=batch.num_rows) * SCALE / np.maximum(total, 1) + w[-1]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(dot, -35, 35))))], [*batch.schema.names, into])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, `{into}` double")


def learn(docs: DataFrame, labels: DataFrame, train, bound: int = 20_000) -> np.ndarray:
    """Fits on at most ``bound`` labelled rows that meet ``train``, a condition on doc_id."""
    from marketloom.llm.labelled import sample

    rows = sample(docs, labels, "quality", train, bound)
    model = fit(rows)
    discard(rows)
    return model
