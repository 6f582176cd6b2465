"""Post-editing of Persian texts with a lexicon of any size.

Texts are edited in groups.  A group holds what is known of the keys for which
its texts ask; keys of which nothing is known are joined with the lexicon.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructType

from marketloom.functions import persian
from marketloom.functions.text import ZWNJ
from marketloom.store import discard, materialise

#: Longer keys and values than this many characters are no terms.
MOST_CHARS = 120
#: Characters of the texts that hold their terms together, and bits that tell of most keys that they are no terms.
MOST_CHARS_TOGETHER, LOG_BITS = 1 << 19, 26


def lexicon(terms: DataFrame, least: float = 0.8) -> DataFrame:
    """(kind, key, value, entity) from terms (en, fa, confidence, entity): Latin keys with one family of renderings, and Persian typography.

    Renderings that differ by spaces and joiners only are a family; a key with
    several is ambiguous and left out.  A family is represented by the form
    with a joiner, then the higher confidence, the shorter, the first.
    """
    rows = terms.where((F.col("confidence") >= least) & (F.length(F.trim("fa")) > 0) & (F.length("fa") <= MOST_CHARS) & (F.length("en") <= MOST_CHARS))
    rows = rows.withColumn("key", F.lower(F.trim(F.regexp_replace("en", r"\s+", " "))))
    first = F.struct((~F.contains("fa", F.lit(ZWNJ))).alias("plain"), -F.col("confidence"), F.length("fa"), F.col("fa"))
    family = F.regexp_replace("fa", f"[ {ZWNJ}]", "")
    latin = rows.where("key <> ''").groupBy("key").agg(F.count_distinct(family).alias("families"), F.min_by("fa", first).alias("value"), F.max("entity").alias("entity")).where("families = 1")
    sep = F.regexp_replace(F.trim(F.translate("fa", ZWNJ, " ")), " +", ZWNJ)
    typography = rows.withColumn("sep", sep).groupBy(F.col("sep").alias("key")).agg(F.min_by("fa", first).alias("value"))
    return latin.select(F.lit("latin").alias("kind"), "key", "value", "entity").unionByName(typography.select(F.lit("persian").alias("kind"), "key", "value", F.lit(False).alias("entity")))


def _bits(terms: DataFrame) -> bytes:
    """The bits of ``Asking``: one of 2**LOG_BITS for the CRC-32 of every term's kind and key."""
    at = F.crc32(F.concat("kind", "key").cast("binary")).bitwiseAND(F.lit((1 << LOG_BITS) - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    found = terms.select(F.shiftright(at, 6).alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << LOG_BITS - 6, dtype="<i8")
    out[found["at"].to_numpy()] = found["bits"].to_numpy()
    return out.tobytes()


def edit(rows: DataFrame, terms: DataFrame, text: str = "text", into: str = "edited", source: str | None = None, most: int = MOST_CHARS_TOGETHER) -> DataFrame:
    """Adds the edited text; ``source`` names a column with the English text of which it is a translation.

    Null texts stay null, empty ones empty.  The lexicon may have any size: a
    group of texts with ``most`` characters, or one longer text, holds those
    terms only for which its texts ask.  A round of a text that asks for a key
    not looked up yet, of which bits of the lexicon don't tell that it is no
    term, does not count; the keys are joined with the lexicon and the round is
    repeated, until every text was edited as with the whole lexicon.
    """
    context = rows.sparkSession.sparkContext
    kept = rows.columns

    @F.pandas_udf("long")
    def group(lengths: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at, held = TaskContext.get().partitionId() << 32, 0
        for batch in lengths:
            out = []
            for n in batch:
                if held and held + n > most:
                    at, held = at + 1, 0
                held += n
                out.append(at)
            yield pd.Series(out, dtype="int64")

    bits = context.broadcast(_bits(terms))
    words = lambda kind, sign: F.coalesce(F.max(F.when(F.col("kind") == kind, F.size(F.split("key", sign)))), F.lit(0))
    widest = tuple(terms.agg(words("latin", " "), words("persian", ZWNJ)).first())
    said = F.col(source) if source else F.lit(None).cast("string")
    left = rows.select(*kept, group(F.coalesce(F.length(text), F.lit(0))).alias("_group"), said.alias("_said"), F.lit(None).cast("string").alias("_state"), F.lit(0).alias("_rounds"))
    left = materialise(left, "texts")
    fields = StructType([*left.schema.fields]).add("_done", BooleanType()).add("_asked", ArrayType(StringType()))

    def go_on(texts: pa.Table, answers: pa.Table) -> pa.Table:
        known = persian.Terms(zip(*(answers[c].to_pylist() for c in ("kind", "key", "value", "entity")), strict=True), bits.value, widest)
        given = zip(*(texts[c].to_pylist() for c in (text, "_state", "_said", "_rounds")), strict=True)
        out = [persian.edited_on(t if s is None else s, known, e, n) for t, s, e, n in given]
        asked = [f"{kind[0]}{k}" for kind, table in (("latin", known.latin), ("persian", known.persian)) for k in table.asked]
        new = {"_state": pa.array([t if n or d else None for t, n, d in out], pa.string()), "_rounds": pa.array([n for _, n, _ in out], pa.int32()), "_done": pa.array([d for *_, d in out], pa.bool_()), "_asked": pa.array([asked, *[[]] * (len(out) - 1)][: len(out)], pa.list_(pa.string()))}
        return pa.table({c: new[c] if c in new else texts[c] for c in fields.names})

    answers = rows.sparkSession.createDataFrame([], "_group long, kind string, key string, value string, entity boolean")
    ready, before = [], [left]
    while True:
        out = materialise(left.groupBy("_group").cogroup(answers.groupBy("_group")).applyInArrow(go_on, fields), "edits")
        for made in before:
            discard(made)
        ready.append(materialise(out.where("_done").select(*kept, F.col("_state").alias(into)), "edited"))
        asked = out.select("_group", F.explode("_asked").alias("a")).select("_group", F.when(F.col("a").startswith("l"), "latin").otherwise("persian").alias("kind"), F.expr("substr(a, 2)").alias("key"))
        left = out.where("not _done").select(*left.columns)
        if left.isEmpty():
            discard(out)
            discard(answers)
            return reduce(DataFrame.unionByName, ready)
        # a group brings many keys for its size, so neither side may be broadcast; keys that are no terms have null values
        found = asked.join(terms.select("kind", "key", "value", "entity").hint("merge"), ["kind", "key"], "left").select(*answers.columns)
        more = materialise(answers.unionByName(found), "answers")
        discard(answers)
        answers, before = more, [out]
