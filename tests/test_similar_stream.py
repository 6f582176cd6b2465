"""Similarity dedup and checkpoints as streams, against plain loops, for several splits of the rows into files."""

import math
import os
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.plans import streams
from marketloom.streaming import similar

HOUR = 3600


def landed(folder, frame, parts):
    os.makedirs(folder)
    for k in range(parts):
        path = f"{folder}/{k:03}.parquet"
        frame.iloc[len(frame) * k // parts : len(frame) * (k + 1) // parts].to_parquet(path, coerce_timestamps="us")
        os.utime(path, (1_600_000_000 + k, 1_600_000_000 + k))
    return folder


@pytest.fixture(scope="module")
def stories():
    draw = random.Random(4)
    words = [f"word{k}" for k in range(30)] + ["ath", "$5,000", "2000", "the", "it"]
    rows, texts = [], []
    for k in range(70):
        text = draw.choice(texts) + draw.choice(["", " more", " word1 word2"]) if texts and draw.random() < 0.5 else " ".join(draw.choices(words, k=draw.randint(1, 12)))
        texts.append(text)
        rows.append((k, 1_700_000_000 + k * 3 * HOUR + draw.randint(0, HOUR), text))
    rows += [(70, rows[-1][1] + 5, None), (71, rows[-1][1] + 6, ""), (72, rows[-1][1] + 7, "the it a")]
    return pd.DataFrame(rows, columns=["id", "sec", "text"])


def plain_tokens(text):
    import re

    text = re.sub(r"\$?(\d+),?000\b", r"\1k", (text or "").lower())
    text = re.sub(r"[^\w\s]", " ", re.sub(r"\bath\b", "high", text))
    return [w for w in text.split() if len(w) > 2 and w not in similar.STOP]


def plain_first(rows, least=0.65, window=48 * HOUR):
    kept, vectors = [], {}
    for i, sec, text in rows:
        tf = Counter(plain_tokens(text))
        norm = math.sqrt(sum(n * n for n in tf.values()))
        same = any(0 <= sec - then < window and norm and n2 and sum(tf[w] * v[w] for w in tf) / (norm * n2) >= least for then, v, n2 in (vectors[j] for j in kept))
        if not same:
            kept.append(i)
            vectors[i] = (sec, tf, norm)
    return kept


@pytest.mark.parametrize("parts", [1, 4, 9])
def test_first_stories_whatever_the_split(spark, tmp_path, stories, parts):
    folder = landed(str(tmp_path / "in"), stories, parts)
    stream = spark.readStream.schema("id bigint, sec bigint, text string").option("maxFilesPerTrigger", 1).parquet(folder).select("id", F.timestamp_seconds("sec").alias("ts"), "text")
    pairs = streams.run(similar.similar_pairs(stream, salts=2))
    got = similar.first_stories(spark.createDataFrame(stories[["id"]]), pairs.distinct())
    want = plain_first(stories.itertuples(index=False))
    assert sorted(r.id for r in got.collect()) == want and len(want) < len(stories) - 5


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_checkpoints_whatever_the_split(spark, tmp_path, parts):
    draw = random.Random(6)
    at = sorted(draw.sample(range(200 * HOUR), 300))
    rows = [(k, draw.choice("abbb"), t * 1_000_000, draw.choice([1.0, 2.5, None, 3.0])) for k, t in enumerate(at)]
    rows += [(300, "a", rows[-1][2], 9.0), (301, "a", rows[-1][2], 8.0)]
    frame = pd.DataFrame(rows, columns=["id", "symbol", "us", "price"])
    folder = landed(str(tmp_path / "in"), frame, parts)
    stream = spark.readStream.schema("id bigint, symbol string, us bigint, price double").option("maxFilesPerTrigger", 1).parquet(folder).select("id", "symbol", F.timestamp_micros("us").alias("ts"), "price")
    got = {(int(r.id), r.h): r.price_after for r in streams.run(similar.checkpoints(stream)).collect()}
    want = {}
    for i, symbol, us, _ in rows:
        for h in (1, 4, 24):
            later = [(t, j, p) for j, s2, t, p in rows if s2 == symbol and t >= us + h * HOUR * 1_000_000 and p is not None]
            if later:
                want[i, h] = min(later)[2]
    assert got == want


def test_prefixes_meet():
    draw = random.Random(8)
    for _ in range(3000):
        a, b = ([f"w{draw.randint(0, 6)}" * draw.randint(1, 2) for _ in range(draw.randint(1, 9))] for _ in range(2))
        x, y = Counter(a), Counter(b)
        cosine = sum(x[w] * y[w] for w in x) / math.sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values()))
        if cosine >= 0.65:
            (u, _, n), (v, _, m) = similar.vector_of(a, 0.65), similar.vector_of(b, 0.65)
            assert set(u[:n]) & set(v[:m])
