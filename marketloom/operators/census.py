"""Censuses of parallel texts: renderings that exclude each other, and aligned changes by rule class."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.functions import text as t
from marketloom.functions.persian import DIGITS, FORMS, ZWNJ
from marketloom.store import discard, materialise

# ---- renderings of one term that rarely stand together


def alternates(pairs: DataFrame, least_count: int = 40, least_matched: int = 15, least_seen: int = 6, share: float = 0.12, lift: float = 5.0, most_terms: int = 80, most_candidates: int = 10) -> DataFrame:
    """(term, matched, one, n_one, two, n_two, both): strong renderings of a source term that meet in less than half of the expected outputs.

    ``pairs`` has id, source and output.  Terms are the most frequent source
    words; candidates are words and pairs of words of the outputs by count,
    share and lift, at most ``most_candidates`` a term, so a matched output
    gives at most that many rows to the count of pairs.  A gram that is too rare
    in all outputs to be a candidate of any frequent term doesn't meet the terms.
    """
    texts = pairs.select("id", t.words(F.coalesce("source", F.lit(""))).alias("src"), t.words(F.coalesce("output", F.lit(""))).alias("out"))
    alone = F.when(F.col("id").isNull(), F.monotonically_increasing_id())  # rows without an id meet nothing and stay apart
    texts = materialise(texts.groupBy("id", alone.alias("alone")).agg(F.flatten(F.collect_list("src")).alias("src"), F.collect_list("out").alias("outs")), "texts")
    found = texts.select(F.explode("src").alias("term")).where((F.length("term") >= 1) & ~F.col("term").rlike("^[0-9]+$"))
    terms = found.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(200).where((F.length("term") >= 3) & (F.col("n") >= least_count)).orderBy(F.desc("n"), "term").limit(most_terms)
    sizes = materialise(_matching(texts, terms).select("id", F.explode("terms").alias("term")).groupBy("term").agg((F.count("id") + F.max(F.col("id").isNull().cast("int"))).alias("matched")).where(F.col("matched") >= least_matched), "sizes")
    every = F.transform(F.flatten("outs"), lambda g: F.struct(F.lit(0).alias("kind"), g.alias("gram")))
    background = materialise(texts.select(F.explode(F.concat(every, _bigrams())).alias("g")).groupBy("g.gram", "g.kind").agg(F.count("*").alias("bg")), "background")
    totals = background.groupBy("kind").agg(F.sum("bg").alias("total"))
    least = F.greatest(F.lit(float(least_seen)), share * F.col("matched"))
    met = _met(texts, sizes, background, least)
    seen = met.select(F.explode("terms").alias("term"), "gram", "kind").groupBy("term", "kind", "gram").agg(F.count("*").alias("n")).join(F.broadcast(sizes), "term")
    rank = F.row_number().over(W.partitionBy("term", "kind").orderBy(F.desc("n"), "gram"))
    strong = seen.where(F.col("n") >= least).withColumn("rank", rank).where("rank <= 40")
    key = t.family_key(F.col("gram"))
    strong = strong.where((F.length(key) >= 3) & (F.col("n") / F.col("matched") <= 0.8)).join(background, ["gram", "kind"]).join(F.broadcast(totals), "kind")
    strong = strong.where((F.col("n") / F.col("matched")) / (F.col("bg") / F.col("total")) >= lift).withColumn("key", key)
    best = strong.withColumn("first", F.row_number().over(W.partitionBy("term", "key").orderBy(F.desc("n"), "kind", "gram"))).where("first = 1")
    best = best.withColumn("place", F.row_number().over(W.partitionBy("term").orderBy(F.desc("n"), "gram"))).where(F.col("place") <= most_candidates).select("term", "matched", "place", "kind", "gram", "key", "n")
    best = materialise(best, "best")
    side = lambda x: best.select("term", *[F.col(c).alias(f"{c}_{x}") for c in ("place", "kind", "gram", "key", "n")])
    wanted = best.select("term", "matched").distinct().join(side("a"), "term").join(side("b"), "term").where("place_a < place_b and not contains(key_a, key_b) and not contains(key_b, key_a)")
    chosen = best.groupBy("gram", "kind").agg(F.collect_list(F.struct("term", "place")).alias("chosen"))
    held = _grams(_matching(texts, best.select("term").distinct())).join(F.broadcast(chosen), ["gram", "kind"])
    held = held.select("id", F.explode(F.filter("chosen", lambda c: F.array_contains("terms", c["term"]))).alias("c")).groupBy("c.term", "id").agg(F.collect_set("c.place").alias("places"))
    pair = F.explode(F.filter(F.flatten(F.transform("places", lambda a: F.transform("places", lambda b: F.struct(a.alias("place_a"), b.alias("place_b"))))), lambda p: p.place_a < p.place_b))
    both = held.select("term", pair.alias("p")).groupBy("term", "p.place_a", "p.place_b").agg(F.count("*").alias("both"))
    joined = wanted.join(both, ["term", "place_a", "place_b"], "left").withColumn("both", F.coalesce("both", F.lit(0)).cast("bigint"))
    rare = F.col("both") / F.col("matched") < 0.5 * (F.col("n_a") / F.col("matched")) * (F.col("n_b") / F.col("matched"))
    out = joined.where(rare).select("term", "matched", F.col("gram_a").alias("one"), F.col("n_a").alias("n_one"), F.col("gram_b").alias("two"), F.col("n_b").alias("n_two"), "both")
    out = materialise(out, "alternates")
    for made in (texts, sizes, background, best):
        discard(made)
    return out


def _matching(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, terms, outs): the texts with those of some few terms that they have; texts without one are left out."""
    these = terms.agg(F.collect_list("term").alias("these"))
    return texts.crossJoin(F.broadcast(these)).select("id", F.array_intersect("these", "src").alias("terms"), "outs").where("size(terms) > 0")


def _bigrams() -> Column:
    """The distinct pairs of neighbouring words of each list of ``outs``, as structs of kind and gram."""
    two = lambda w: F.array_distinct(F.zip_with(F.slice(w, 1, F.greatest(F.lit(0), F.size(w) - 1)), F.slice(w, 2, F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b)))
    return F.transform(F.flatten(F.transform("outs", two)), lambda g: F.struct(F.lit(1).alias("kind"), g.alias("gram")))


def _grams(rows: DataFrame) -> DataFrame:
    """(id, terms, gram, kind): the words and pairs of words of texts that have an id."""
    words = F.transform(F.array_distinct(F.flatten("outs")), lambda g: F.struct(F.lit(0).alias("kind"), g.alias("gram")))
    return rows.where("id is not null").select("id", "terms", F.explode(F.concat(words, _bigrams())).alias("g")).select("id", "terms", "g.gram", "g.kind")


def _met(texts: DataFrame, sizes: DataFrame, background: DataFrame, least: Column) -> DataFrame:
    """(id, terms, gram, kind): grams with the terms of their texts, but for those that are too rare for any term.

    A term in a thousandth of the texts or more needs grams seen ``least`` times,
    a share of that: they are few, however many texts there are, and are
    broadcast.  The rarer terms have few texts, and meet all grams of these.
    """
    often = F.col("matched") * 1000 >= texts.count()
    common = sizes.where(often)
    frequent = background.join(F.broadcast(common.agg(F.min(least).alias("least"))), F.col("bg") >= F.col("least")).select("gram", "kind")
    return _grams(_matching(texts, common)).join(F.broadcast(frequent), ["gram", "kind"]).unionByName(_grams(_matching(texts, sizes.where(~often))))


# ---- aligned changes

CLAUSE = re.compile(r"(?<=[.!؟?\n])\s+")
TOKEN = re.compile(r"\S+|\s+")


def changes_of(before: str | None, after: str | None) -> list[dict]:
    """Replaced stretches of two texts, clause by clause where they have equally many."""
    before, after = before or "", after or ""
    a, b = CLAUSE.split(before), CLAUSE.split(after)
    out = []
    for x, y in zip(a, b, strict=True) if len(a) == len(b) else [(before, after)]:
        if x != y:
            u, v = TOKEN.findall(x), TOKEN.findall(y)
            for tag, i, j, k, n in difflib.SequenceMatcher(None, u, v).get_opcodes():
                old, new = "".join(u[i:j]).strip(), "".join(v[k:n]).strip()
                if tag != "equal" and old and new and old != new:
                    out.append({"old": old, "new": new})
    return out


def aligned_changes(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """(old, new, n): stretches that an edit replaced, over all pairs; insertions and deletions move what stands behind them."""

    @F.pandas_udf("array<struct<old:string,new:string>>")
    def align(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([changes_of(a, b) for a, b in zip(x, y, strict=True)])

    differ = pairs.where(F.coalesce(before, F.lit("")) != F.coalesce(after, F.lit("")))
    return differ.select(F.explode(align(F.col(before), F.col(after))).alias("c")).groupBy("c.old", "c.new").agg(F.count("*").alias("n"))


def _plain(c: Column) -> Column:
    return F.regexp_replace(c, f"[ {ZWNJ}]", "")


def rule_classes(changes: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Adds ``rule``: digits, letters, known entities, joiners (of the verb's prefix, plural, comparative), spelling of the lexicon, or other."""
    ascii_, persian = "0123456789", "0123456789".translate(DIGITS)
    forms = "".join(map(chr, FORMS))
    letters = lambda c: F.translate(c, forms, "".join(v for v in FORMS.values() if v))
    digits = lambda c: F.translate(c, ascii_, persian)
    core = lambda c: F.regexp_replace(c, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")
    old, new = F.col("old"), F.col("new")
    latin = lexicon.where("kind = 'latin'").select("key", "value")
    keys = lambda c: F.array_distinct(F.array(F.lower(F.trim(c)), F.regexp_replace(F.lower(F.trim(c)), "['s]+$", "")))
    tried = changes.select("old", "new", F.explode(F.array(F.struct(keys(old).alias("keys"), new.alias("want")), F.struct(keys(core(old)).alias("keys"), core(new).alias("want")))).alias("x")).select("old", "new", F.explode("x.keys").alias("key"), "x.want")
    entity = tried.where("want <> ''").join(latin.hint("merge"), "key").where("value = want").select("old", "new").distinct().withColumn("entity", F.lit(True))
    canon = lexicon.where("kind = 'persian'").select(F.col("value").alias("new")).distinct().withColumn("canon", F.lit(True))
    ends = lambda *w: F.regexp_replace(old, r"\.+$", "").rlike(f" (?:{'|'.join(w)})$")
    same = _plain(old) == _plain(new)
    rule = (
        F.when(digits(old) == new, "digits")
        .when(letters(old) == new, "letters")
        .when(F.col("entity"), "entity")
        .when((core(old) != "") & (digits(core(old)) == core(new)), "digits")
        .when(same & old.rlike("(?:^| )ن?می "), "verb_joiner")
        .when(same & ends("ها", "های", "هایی", "هایمان", "هایشان", "هایش"), "plural_joiner")
        .when(same & ends("تر", "ترین"), "comparative_joiner")
        .when(same, "joiner")
        .when(_plain(digits(letters(old))) == _plain(new), "combined")
        .when(F.col("canon"), "spelling")
        .otherwise("other")
    )
    return changes.join(entity.hint("merge"), ["old", "new"], "left").join(canon.hint("merge"), "new", "left").select("old", "new", "n", rule.alias("rule"))
