"""Small inputs with the awkward cases of every operator."""

import pytest
from pyspark.sql import functions as F

BASE = " ".join(f"alpha{i} beta{i % 7}" for i in range(60))


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty, blank, repeated, near-equal and very long texts, and extra columns with clashing names."""
    rows = [
        (1, BASE, "en", "s"),
        (2, BASE + " tail", "en", "s"),
        (3, "short", "en", "s"),
        (4, "", "en", "s"),
        (5, None, None, None),
        (6, "  \t \n ", "en", "s"),
        (7, "one two three four five six\nA line, that repeats; 12 times!\nlast", "fr", "s"),
        (8, "other start of text here\na line that repeats 99 times\nend", "fr", "s"),
        (8, "other start of text here\na line that repeats 99 times\nend", "fr", "s"),
        (9, " ".join(f"w{i % 997}x{i}" for i in range(20_000)), "de", "s"),
        (10, "Released under the MIT License. Licensed under CC BY-NC 4.0.", "en", "s"),
        (11, "Licensed undr the Apache Licence, Version 2.0 of the code", "en", "s"),
        (12, "ñandú Straße 日本語 😀 \x01 ▁ </s> <0x41>", "es", "s"),
        (None, "a text without an id at all", "en", "s"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    extra = ("score", "features", "probability", "node", "key", "row", "label", "ids", "media", "contamination_", "word")
    return frame.withColumn("n_chars", F.length("text").cast("long")).select("*", *[F.lit(1).alias(c) for c in extra])


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 1), (None, 1, 1), (3, 7, 7)], "doc_id long, quality int, toxic int")
