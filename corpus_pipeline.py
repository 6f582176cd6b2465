"""The training-corpus pipeline: five stages from raw documents to token ids.

Each stage is a function of (spark, docs, sf_dir) and works on everything its
predecessor kept; its result is written as Parquet and read again.  All stages
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import decontaminate, lines, minhash, pieces, quality
from marketloom.llm.frames import pick, split_rule
from marketloom.llm.queries import table, tokenizer
from marketloom.llm.store import discard, materialise


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects (score below 0.3)."""
    model = quality.learn(docs, table(spark, sf_dir, "labels", "doc_id", "quality"), split_rule("doc_id", 5) != 0)
    return quality.score(docs, model, into="quality_score").where("quality_score >= 0.3").drop("quality_score")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one occurrence of every group of fuzzily equal lines; documents without a line left go."""
    left = lines.dedup(docs).where("not emptied").drop("emptied")
    return left.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near-duplicates (five words, similarity 0.8)."""
    return minhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which one word in 20 lies in windows of benchmark items."""
    return decontaminate.remove_documents(decontaminate.scan(docs, table(spark, sf_dir, "benchmark", "item_id", "text")))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    coded = pieces.encode(pick(docs, "doc_id", "lang", "source", "n_chars", "text"), tokenizer())
    return coded.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece", sentencepiece),
]

#: Trained scores, SimHash and the tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars")
    before = None
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
        before = docs
    return docs
