"""Structure repair of conversations: least-cost edits that make roles alternate.

A conversation's rows stand in the order of turn (nulls first), role and MD5 of
the text.  The first fault of a row counts: blank (no visible character),
duplicate (role and text seen earlier), truncated (no sentence end last).  A
repaired conversation is empty, or an optional system row and then pairs of
user and assistant.  Keep costs 0, Rerole to user or assistant 1, Delete 2 (the
only edit of blank and duplicate rows), Insert an empty user or assistant row
5; a truncated row that stays adds 5.  Of the cheapest edits those with the
ASCII-least initials are taken.

Method: equal consecutive symbols (role class and fault) are runs; a run of k
rows advances the four states by binary powers of its min-plus transition,
which are cached; the choices inside a run are unrolled by halves.  Min-plus
products are associative, so a conversation may lie in any number of range
partitions: each part gives its own transition, a scan over the parts of a
conversation (as many as there are partitions at most) gives costs behind and
states before each part, and the parts are unrolled on their own.  Only the
digest of a repaired conversation needs its rows one after the other; they are
streamed.

Defined cases: null roles and texts count as one space (a role of no known
initial, a blank text), null turns come first and null ids are one
conversation; repeated rows are duplicates; an empty role has no known initial;
an empty table gives an empty table; only the named columns are read, so extra
ones of any name don't clash.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.llm.store import discard, materialise

INSERT, DELETE, REROLE, CUT = 5, 2, 1, 5
FAR = 1 << 40

#: States: nothing yet, system, user, assistant last.  From each state one role of user and assistant is legal.
LEGAL = ("u", "u", "a", "u")
AFTER = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "x": (None,) * 4}
END = (0, 2 * INSERT, INSERT, 0)

#: Symbols of a row by role class: clean, truncated, to be deleted.
CLEAN, TRUNCATED, GONE = "suax", "SUAX", "1234"


def _edits(symbol: str, p: int):
    """(audit initial, plan sign, cost, next state) of every edit that uses up a row."""
    yield "D", "D", DELETE, p
    if symbol not in GONE:
        extra = CUT if symbol in TRUNCATED else 0
        q = AFTER[symbol.lower()][p]
        if q is not None:
            yield "K", "K", extra, q
        yield "R", LEGAL[p].upper(), REROLE + extra, AFTER[LEGAL[p]][p]


@lru_cache(None)
def power(symbol: str, j: int) -> tuple:
    """Transition of 2**j equal rows: cost from each state before them to each after them."""
    if j:
        half = power(symbol, j - 1)
        return tuple(tuple(min(a[m] + half[m][q] for m in range(4)) for q in range(4)) for a in half)
    rows = []
    for start in range(4):
        best, p, paid = [FAR] * 4, start, 0
        for _ in range(3):  # no row, one or two rows inserted before
            for _, _, cost, q in _edits(symbol, p):
                best[q] = min(best[q], paid + cost)
            p, paid = AFTER[LEGAL[p]][p], paid + INSERT
        rows.append(tuple(best))
    return tuple(rows)


def times(matrix: tuple, costs: tuple) -> tuple:
    return tuple(min(a + b for a, b in zip(row, costs, strict=True)) for row in matrix)


def multiply(one: tuple, two: tuple) -> tuple:
    return tuple(tuple(min(FAR, *[row[m] + two[m][q] for m in range(4)]) for q in range(4)) for row in one)


@lru_cache(1 << 16)
def _advance(symbol: str, k: int, costs: tuple) -> tuple:
    for j in range(k.bit_length()):
        if k >> j & 1:
            costs = times(power(symbol, j), costs)
    return costs


def advance(symbol: str, k: int, costs: tuple) -> tuple:
    """Least costs to the end from before k equal rows, given those from behind them."""
    low = min(costs)
    return tuple(c + low for c in _advance(symbol, k, tuple(c - low for c in costs)))


@lru_cache(1 << 14)
def _unroll(symbol: str, k: int, p: int, costs: tuple) -> tuple[tuple[str, ...], int]:
    if k > 1:
        half = k // 2
        left, p = unroll(symbol, k - half, p, advance(symbol, half, costs))
        right, p = unroll(symbol, half, p, costs)
        return left + right, p
    plan = ""
    before = advance(symbol, 1, costs)
    while True:
        options = [(initial, sign, q) for initial, sign, cost, q in _edits(symbol, p) if cost + costs[q] == before[p]]
        q = AFTER[LEGAL[p]][p]
        if INSERT + before[q] == before[p]:
            options.append(("I", LEGAL[p], q))
        initial, sign, p = min(options)
        plan += sign
        if initial != "I":
            return (plan,), p


def unroll(symbol: str, k: int, p: int, costs: tuple) -> tuple[tuple[str, ...], int]:
    """The plan of k equal rows from state p, and the state behind them; one sign string a row.

    Signs: u, a for inserted rows; K keep, D delete, U and A rerole.
    """
    low = min(costs)
    return _unroll(symbol, k, p, tuple(c - low for c in costs))


def runs(symbols: str) -> list[tuple[str, int]]:
    return [(s, sum(1 for _ in g)) for s, g in groupby(symbols)]


def transition(symbols: str) -> tuple:
    """Min-plus transition of a part."""
    out = tuple(tuple(0 if p == q else FAR for q in range(4)) for p in range(4))
    for s, k in runs(symbols):
        for j in range(k.bit_length()):
            if k >> j & 1:
                out = multiply(out, power(s, j))
    return out


def plan(symbols: str, start: int, behind: tuple, last: bool = True) -> tuple[list[str], int, int]:
    """Signs of every row of a part, the cost from its start to the conversation's end, and the state behind it."""
    parts = runs(symbols)
    costs = [behind]
    for s, k in reversed(parts):
        costs.append(advance(s, k, costs[-1]))
    cost, signs, p = costs.pop()[start], [], start
    for s, k in parts:
        some, p = unroll(s, k, p, costs.pop())
        signs += some
    if last and signs:
        signs[-1] += ("", "ua", "a", "")[p]
    return signs, cost, p


#: Initials of the signs in an audit.
INITIALS = str.maketrans("uaUA", "IIRR")


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, by the CRC-32 of ``conv_id:turn`` modulo 20; nulls become one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    copies = F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    kept = rows.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), F.explode(copies).alias("_again"))
    return kept.drop("_again")


def _ordered(rows: DataFrame) -> DataFrame:
    """The rows in parts of a range partitioning, stored, with ``part`` and ``pos`` (unique, ascending)."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text")).withColumn("digest", F.md5("text"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(dealt.withColumn("part", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id()), "turns")


def _role_class(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("x")


def _parts(stored: DataFrame) -> DataFrame:
    """One row a part of a conversation: its rows' positions and symbols, and counts of faults."""
    firsts = stored.groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    visible = F.rtrim("text", F.lit("\t\n\x0b\x0c\r "))
    marked = stored.select("conv_id", "part", "pos", _role_class(F.col("role")).alias("class"), (visible == "").alias("blank"), (~F.right(visible, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    marked = marked.join(firsts, "pos", "left").withColumn("duplicate", ~F.col("blank") & F.col("first").isNull())
    symbol = F.when(F.col("blank") | F.col("duplicate"), F.translate("class", CLEAN, GONE)).when(F.col("cut"), F.translate("class", CLEAN, TRUNCATED)).otherwise(F.col("class"))
    count = lambda c: F.sum(c.cast("bigint"))
    found = marked.groupBy("conv_id", "part").agg(
        F.array_sort(F.collect_list(F.struct("pos", symbol.alias("symbol")))).alias("rows"),
        F.min("pos").alias("chunk"),
        count(F.col("blank")).alias("blank"),
        count(F.col("duplicate")).alias("duplicate"),
        count(F.col("cut") & ~F.col("blank") & ~F.col("duplicate")).alias("truncated"),
    )
    found = found.select("conv_id", "chunk", "blank", "duplicate", "truncated", F.transform("rows", lambda r: r.pos).alias("positions"), F.array_join(F.transform("rows", lambda r: r.symbol), "").alias("symbols"))
    found = materialise(found, "parts")
    of = W.partitionBy("conv_id")
    named = found.select("conv_id", "chunk").select("chunk", F.min("chunk").over(of).alias("conv"), F.count("*").over(of).alias("parts"))
    return found.join(named, "chunk")


def _transitions(frames):
    for f in frames:
        f["matrix"] = [[x for row in transition(s) for x in row] for s in f.symbols]
        yield f[["conv", "chunk", "matrix"]]


def _scan_back(f: pd.DataFrame) -> pd.DataFrame:
    """Costs behind every part of one conversation."""
    f = f.sort_values("chunk", ascending=False)
    costs, behind = END, []
    for m in f.matrix:
        behind.append(list(costs))
        costs = times(tuple(tuple(int(x) for x in m[4 * p : 4 * p + 4]) for p in range(4)), costs)
    return f[["conv", "chunk"]].assign(behind=behind, last=[k == 0 for k in range(len(f))])


def _states(frames):
    for f in frames:
        f["states"] = [[plan(s, p, tuple(b), False)[2] for p in range(4)] for s, b in zip(f.symbols, f.behind, strict=True)]
        yield f[["conv", "chunk", "behind", "last", "states"]]


def _scan_on(f: pd.DataFrame) -> pd.DataFrame:
    """The state before every part of one conversation."""
    f = f.sort_values("chunk")
    p, starts = 0, []
    for s in f.states:
        starts.append(p)
        p = int(s[p])
    return f[["chunk", "behind", "last"]].assign(start=starts)


def _plans(frames):
    for f in frames:
        out = []
        for symbols, start, behind, last in zip(f.symbols, f.start, f.behind, f["last"], strict=True):
            signs, cost, _ = plan(symbols, int(start), tuple(int(x) for x in behind), bool(last))
            kinds = symbols.translate(str.maketrans(TRUNCATED + GONE, CLEAN * 2))
            illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:], strict=False))
            out.append((signs, "".join(signs).translate(INITIALS), cost, illegal, kinds[0], kinds[-1]))
        f[["signs", "audit", "cost", "illegal", "head", "tail"]] = pd.DataFrame(out, columns=["signs", "audit", "cost", "illegal", "head", "tail"], index=f.index)
        yield f[["conv", "chunk", "positions", "signs", "audit", "cost", "illegal", "head", "tail"]]


def _planned(parts: DataFrame) -> DataFrame:
    """The plan of every part: positions and signs of its rows, audit, cost to the end, illegal pairs, first and last class."""
    several = parts.where("parts > 1").select("conv", "chunk", "symbols")
    back = several.mapInPandas(_transitions, "conv long, chunk long, matrix array<long>").groupBy("conv").applyInPandas(_scan_back, "conv long, chunk long, behind array<long>, last boolean")
    states = several.select("chunk", "symbols").join(back, "chunk").mapInPandas(_states, "conv long, chunk long, behind array<long>, last boolean, states array<int>")
    known = states.groupBy("conv").applyInPandas(_scan_on, "chunk long, behind array<long>, last boolean, start int")
    alone = F.array(*[F.lit(c).cast("long") for c in END])
    given = parts.select("conv", "chunk", "positions", "symbols").join(known, "chunk", "left")
    given = given.withColumn("behind", F.coalesce("behind", alone)).withColumn("last", F.coalesce("last", F.lit(True))).withColumn("start", F.coalesce("start", F.lit(0)))
    return given.mapInPandas(_plans, "conv long, chunk long, positions array<long>, signs array<string>, audit string, cost long, illegal long, head string, tail string")


def _lines(stored: DataFrame, planned: DataFrame) -> DataFrame:
    """The repaired rows: conv (a number), pos and place order them; edit is K, R or I."""
    row = F.explode(F.arrays_zip("positions", "signs")).alias("row")
    each = planned.select("conv", row).select("conv", F.col("row.positions").alias("pos"), F.col("row.signs").alias("signs"))
    full = {"u": "user", "a": "assistant", "U": "user", "A": "assistant"}
    name = lambda c: F.when(F.lower(c) == "u", full["u"]).otherwise(full["a"])
    made = stored.select("conv_id", "pos", "role", "text").join(each, "pos")
    one = lambda c: F.when(c.isin("u", "a"), F.struct(name(c).alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit"))).when(c.isin("U", "A"), F.struct(name(c).alias("role"), F.col("text"), F.lit("R").alias("edit"))).otherwise(F.struct(F.col("role"), F.col("text"), F.lit("K").alias("edit")))
    signs = F.filter(F.split("signs", ""), lambda c: ~c.isin("D", ""))
    return made.select("conv_id", "conv", "pos", F.posexplode(F.transform(signs, one)).alias("place", "line")).select("conv_id", "conv", "pos", "place", "line.role", "line.text", "line.edit")


def _digests(batches):
    """SHA-256 of the lines of every conversation; its rows come one after the other, in batches of any size."""
    conv, digest = None, None
    for batch in batches:
        done = []
        for c, line in zip(batch.column("conv").to_pylist(), batch.column("line"), strict=True):
            if c != conv:
                if digest:
                    done.append((conv, digest.hexdigest()))
                conv, digest = c, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(line.as_py().encode())
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()), pa.array([d for _, d in done], pa.string())], ["conv", "repaired_sha256"])
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([digest.hexdigest()], pa.string())], ["conv", "repaired_sha256"])


def repaired(rows: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: conv_id, pos and place (their order), role, text, edit (Keep, Rerole, Insert)."""
    stored = _ordered(rows)
    out = materialise(_lines(stored, _planned(_parts(stored))).drop("conv"), "repaired")
    discard(stored)
    return out


def repair(rows: DataFrame) -> DataFrame:
    """One row a conversation: counts of faults, illegal neighbours, cost and audit of the cheapest edits, digest of the repaired rows."""
    stored = _ordered(rows)
    parts = materialise(_parts(stored), "named-parts")
    planned = materialise(_planned(parts), "plans")
    lines = _lines(stored, planned).select("conv", "pos", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    digests = lines.repartition("conv").sortWithinPartitions("conv", "pos", "place").select("conv", "line").mapInArrow(_digests, "conv long, repaired_sha256 string")
    seq = F.array_sort(F.collect_list(F.struct("chunk", "audit", "head", "tail")))
    seams = lambda s: F.size(F.filter(F.sequence(F.lit(2), F.greatest(F.size(s), F.lit(2))), lambda k: (k <= F.size(s)) & ~F.concat(F.get(s, k - 2)["tail"], F.get(s, k - 1)["head"]).isin("su", "ua", "au")))
    edits = planned.groupBy("conv").agg(seq.alias("seq"), F.min_by("cost", "chunk").alias("cost"), F.sum("illegal").alias("inside"))
    edits = edits.select("conv", "cost", F.array_join(F.transform("seq", lambda s: s.audit), "").alias("audit"), (F.col("inside") + seams(F.col("seq"))).alias("illegal"))
    ids = parts.groupBy("conv").agg(F.first("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    turns = stored.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps")).select(F.col("conv_id").alias("of"), F.coalesce("gaps", F.lit(0)).cast("bigint").alias("gaps"))
    out = ids.join(edits, "conv").join(digests, "conv", "left").join(turns, F.col("conv_id").eqNullSafe(F.col("of")))
    out = materialise(out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")), "repair")
    for used in (stored, parts, planned):
        discard(used)
    return out


def report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """``repair`` of rows, with a row for every conversation of another table; one that has no rows left needs no edit."""
    every = conversations.select("conv_id").distinct()
    found = repair(rows)
    zeros = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    texts = [F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")]
    return every.alias("e").join(found.alias("f"), F.col("e.conv_id").eqNullSafe(F.col("f.conv_id")), "left").select("e.conv_id", *zeros, *texts)
