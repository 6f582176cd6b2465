"""Mixing sources to target weights by Pareto order sampling.

Targets: the sources share ``share`` times all words by their weights; one
whose target would pass ``most`` times its words stops there, and the rest is
shared again by weight until none is above.  Within a source a document is to
be taken ``wanted`` times, in proportion to a power of its size and never more
than ``most`` times, such that the expected words meet the target.  The whole
part of that number is certain.  The fraction pi is an inclusion probability:
documents are ranked by the random odds u / (1 - u) over the inclusion odds
pi / (1 - pi), and taken in that order while their words fit what is left of
the target.  The size of the sample is thus fixed in words, not in documents;
what is still missing is closed by the one document, of those not taken, whose
size comes nearest to it (if that is nearer than none).

Running words are sums over range partitions of (source, rank), so one source
may hold any share of the documents.  Random numbers are digits of an MD5 of
seed, id and text: reruns agree on every cluster.

Defined cases: a null or empty text has size 0 and is taken 0 times; null
sources are one source, the last; documents with a null id draw by their
texts; repeated rows are documents of their own, of which any may be the one
that is taken; an empty table gives an empty table; only the named columns are
read, so extra ones of any name don't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.llm.frames import join_skewed
from marketloom.llm.store import discard, materialise


@dataclass(frozen=True)
class Rule:
    """Weights in the order of the sources (repeating), share of all words, most copies of a document, power of the size, seed."""

    weights: tuple[float, ...] = (5, 2, 1)
    share: float = 1.5
    most: int = 2
    power: float = 0.5
    seed: str = "mix"

    def __post_init__(self):
        if not self.weights or min(self.weights) <= 0:
            raise ValueError("weights must be above 0")


def size_of(text: Column) -> Column:
    """Number of words between white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def uniform(seed: str, *parts: Column) -> Column:
    """A number between 0 and 1, never either, from 52 bits of an MD5."""
    digits = F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    return (F.conv(F.substring(digits, 1, 13), 16, 10).cast("bigint") + 0.5) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Adds ``target`` to a table of sources (source, source_size), one row each.

    Sources that stop at their cap are those of the least cap for their weight;
    with them in that order, the level of the others follows from running sums.
    The table has one small row a source and is sorted as a whole.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in rule.weights]), (rank % len(rule.weights) + 1).cast("int"))
    cap = rule.most * F.col("source_size").cast("double")
    up_to = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    everywhere = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).orderBy(F.lit(0))
    level = (rule.share * F.sum("source_size").over(everywhere) - F.coalesce(F.sum("cap").over(up_to), F.lit(0.0))) / (F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(up_to), F.lit(0.0)))
    ranked = sizes.withColumn("weight", weight).withColumn("cap", cap).withColumn("level", level)
    first_free = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everywhere)
    return ranked.withColumn("level", first_free["level"]).withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))).drop("weight", "cap", "level")


def _factors(base: DataFrame, sources: DataFrame, rule: Rule) -> DataFrame:
    """For each source the factor c with sum of size * min(most, c * size**power) = target, from counts of equal sizes."""
    drawn = F.col("size") * F.pow("size", F.lit(rule.power)) * F.col("n")
    larger = W.partitionBy("key").orderBy(F.col("size").desc()).rowsBetween(W.unboundedPreceding, -1)
    here = W.partitionBy("key").orderBy("size").rowsBetween(W.unboundedPreceding, 0)
    counts = base.where("size > 0").groupBy("key", "size").agg(F.count("*").alias("n")).join(sources.select("key", "target"), "key")
    tried = counts.withColumn("c", (F.col("target") - rule.most * F.coalesce(F.sum(F.col("size") * F.col("n")).over(larger), F.lit(0))) / F.sum(drawn).over(here))
    fits = tried.where(F.col("c") * F.pow("size", F.lit(rule.power)) <= rule.most)
    return fits.groupBy("key").agg(F.max_by("c", "size").alias("c"))


def _running(rows: DataFrame, key: str, order: list[str], value: str, into: str) -> DataFrame:
    """Adds a running sum inside each key in a given order, and ``part`` and ``place``, which together number the rows.

    Rows are dealt by ranges of (key, order) and stored; the sums of earlier
    parts of a key, one row a part and key, are added to running sums inside
    parts, so no key meets in one task.
    """
    dealt = materialise(rows.repartitionByRange(key, *order).withColumn("part", F.spark_partition_id()), "ranked")
    inside = W.partitionBy("part", key).orderBy(*order)
    sums = dealt.groupBy("part", key).agg(F.sum(value).alias("all")).withColumn("before", F.coalesce(F.sum("all").over(W.partitionBy(key).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("all")
    out = dealt.withColumn("place", F.row_number().over(inside)).withColumn(into, F.sum(value).over(inside.rowsBetween(W.unboundedPreceding, 0)))
    out = materialise(out.join(sums, ["part", key]).withColumn(into, F.col(into) + F.col("before")).drop("before"), "running")
    discard(dealt)
    return out


def sample(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", rule: Rule = Rule()) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, copies, taken, and md5 of the text (null: of none)."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    named = F.col(f"`{source}`").cast("string")
    digest = F.md5(t.cast("binary"))
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), named.alias("source"), F.when(named.isNull(), "").otherwise(F.concat(F.lit("="), named)).alias("key"), size_of(t).alias("size"), digest.alias("digest"))
    base = materialise(base.withColumn("u", uniform(rule.seed, F.col("doc_id"), F.col("digest"))), "sizes")
    sources = materialise(targets(base.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), rule), "targets")
    total = sources.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = sources.join(_factors(base, sources, rule), "key", "left").drop("source")
    wanted = F.when(F.col("size") == 0, 0.0).otherwise(F.coalesce(F.least(F.lit(float(rule.most)), F.col("c") * F.pow("size", F.lit(rule.power))), F.lit(float(rule.most))))
    rows = join_skewed(base, known, ["key"], "n", total).withColumn("wanted", wanted)
    rows = rows.withColumn("certain", F.floor("wanted").cast("int")).withColumn("pi", F.col("wanted") - F.col("certain"))
    odds = F.when(F.col("pi") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("pi") / (1 - F.col("pi"))))
    rows = rows.select("key", "doc_id", "source", "size", "source_size", "target", "digest", "certain", F.coalesce(odds, F.lit(float("inf"))).alias("rank"))
    rows = rows.withColumn("drawn", F.when(F.col("rank") < float("inf"), F.col("size")).otherwise(0))
    summed = _running(rows, "key", ["rank", "digest", "doc_id"], "drawn", "so_far")
    left = summed.groupBy("key").agg((F.first("target") - F.sum(F.col("certain") * F.col("size"))).alias("left"), F.count("*").alias("n"))
    chosen = materialise(join_skewed(summed, left, ["key"], "n", total).drop("n").withColumn("chosen", (F.col("drawn") > 0) & (F.col("so_far") <= F.col("left"))), "chosen")
    gaps = chosen.groupBy("key").agg((F.first("left") - F.coalesce(F.sum(F.when(F.col("chosen"), F.col("size"))), F.lit(0))).alias("gap"), F.count("*").alias("n"))
    open_rows = join_skewed(chosen.where("drawn > 0 and not chosen").select("key", "size", "part", "place"), gaps, ["key"], "n", total)
    best = F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "part", "place"))
    closing = open_rows.groupBy("key").agg(best.alias("best"), F.first("gap").alias("gap")).where("best.off < gap").select("key", "best.part", "best.place", F.lit(1).alias("closes"))
    out = chosen.join(closing, ["key", "part", "place"], "left").withColumn("copies", F.col("certain") + F.col("chosen").cast("int") + F.coalesce("closes", F.lit(0)))
    result = materialise(out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"), "digest"), "mix")
    for used in (base, sources, summed, chosen):
        discard(used)
    return result


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", rule: Rule = Rule()) -> DataFrame:
    """The rows of the mix: every document as often as it is taken, numbered in ``copy``.

    Documents are found again by id, source and text; of rows that repeat all
    three, one stands for all of them and for their copies together.
    """
    taken = sample(docs, doc_id, text, source, rule).groupBy("doc_id", "source", "digest").agg(F.sum("copies").cast("int").alias("copies")).where("copies > 0")
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "copy"]).dropDuplicates([doc_id, source, text])
    one = F.md5(F.coalesce(F.col(f"d.`{text}`"), F.lit("")).cast("binary")) == F.col("t.digest")
    same = F.col(f"d.`{doc_id}`").eqNullSafe(F.col("t.doc_id")) & F.col(f"d.`{source}`").cast("string").eqNullSafe(F.col("t.source")) & one
    return rows.alias("d").join(taken.alias("t"), same).select("d.*", F.explode(F.sequence(F.lit(1), F.col("t.copies"))).alias("copy"))
