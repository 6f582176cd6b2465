"""Fuzzy line deduplication with DataFrame operations only.

A line's norm is its words (runs of letters and digits, lower-cased, each run
of digits as 0) joined by one space; equal norms are one node.  Nodes get a
SimHash of six blocks: a word's hash names the block that it counts in, and a
block is the SimHash (18 majority bits) of its own distinct words.  A changed
word alters two blocks at most, the old word's and the new one's, so two lines
that differ in two words at most agree in two blocks at least (pigeonhole),
whatever their length; every pair of blocks that together hold three words (two
in lines of about six words or fewer) is a bucket key.  Lines with more changes
agree by chance: of those with three, three in four.

In a bucket every node is first compared with one centre, if their lengths fit
and their SimHashes differ in at most APART bits, which settles groups of many
copies with few pairs.  In buckets that hold several components after that,
every pair of nodes of different components and fitting lengths is compared
too, unless it was before; signatures drop only pairs that surely share less
than half of their words.  So no pair that shares a bucket is lost.  Large
buckets are cut into slices of at most about SLICE nodes, and any two slices
meet in a cell of their own, so no task holds a whole bucket.

A link needs an edit similarity of ``similar`` between the norms: at most the
rest of the longer norm's characters is inserted, deleted or substituted, and at
least half of the distinct words of either norm are the other's too.  This holds
for norms of any length; bands of edits grow fourfold, so the time of an edit
distance follows the edits that there are.  Of each connected group the first occurrence, by doc_id and line
number, stays; every other occurrence leaves its document.

Defined cases: lines without words, and null or empty texts, stay as they are;
a document that loses all its lines with words is marked ``emptied``;
rows that repeat id and text are one document and keep the same lines; a null
id sorts first; empty tables give empty results; other columns pass through,
and a column that is already named like ``emptied`` gives way to the new one.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.frames import join_skewed, sieve
from marketloom.llm.graph import components
from marketloom.llm.store import discard, materialise

BLOCKS, WIDTH = 6, 18
KEYS = math.comb(BLOCKS, 2)
#: Words that one generated row sums up, and words counted together: a counter of 8 bits in a positive long holds 127.
STEP, CHUNK = 2, 124
LANE = 0x0101010101010101
#: Edits tried one after the other: most similar lines differ in few, and a narrow band of the edit table is cheap.
BANDS = (12, 40, 160, 640, 2_560)
#: SimHash bits, of all six blocks, in which a line and its bucket's centre may differ at first: unrelated ones that share two blocks differ in 36 of the other 72.
APART = 30
#: Longs of a signature of words, and nodes of a bucket that one slice holds.
LONGS, SLICE = 4, 512


def lines_of(docs: DataFrame, *names: str) -> DataFrame:
    """(names, pos, norm): the norm of every line with words of a text column, by line number."""
    signs = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}\n]+", " ")
    rows = docs.select(*names, F.posexplode(F.split(F.regexp_replace(signs, r"\p{N}+", "0"), "\n", -1)).alias("pos", "norm"))
    return rows.select(*names, "pos", F.trim("norm").alias("norm")).where("norm <> ''")


def node_of(norm: Column) -> list[Column]:
    """128 bits that name a norm, as two longs of differently seeded hashes."""
    return [F.xxhash64(norm).alias("n1"), F.xxhash64(F.lit(0x5EED), norm).alias("n2")]


def place(doc_id: Column, key: Column, pos: Column) -> Column:
    """Names a line by its document's id, its text's hash and its number there."""
    return F.xxhash64(doc_id, key, pos)


def simhash(rows: DataFrame, names: list[str], words: str, level: int = 0) -> DataFrame:
    """(names, bits_a, bits_b): the SimHash of each row's words; rows must differ in ``names``.

    Bits 0-53 of each long are three blocks; three bits a block above them tell
    its number of words: 0 to 3, or 4 and the rest of a division by 4.  Set
    bits are summed for STEP words in one expression and for CHUNK words in
    eight counters of 8 bits a long; longer lines add up their chunks.  The
    expressions are made as text, as there are some hundreds of them.
    """
    rows = rows.withColumn(words, F.array_distinct(words))
    each = rows.selectExpr(*names, words, f"size({words}) AS size", f"explode(sequence(0, size({words}) - 1, {STEP})) AS at")
    part = f"(h{{i}} & {(1 << WIDTH) - 1}L)"
    block = f"(shiftrightunsigned(h{{i}}, 32) % {BLOCKS})"
    hashed = each.selectExpr(*names, "size", f"cast(floor(at / {CHUNK}) AS int) AS chunk", f"least({STEP}, size - at) AS left", *[f"xxhash64({level}, get({words}, at + {i})) AS h{i}" for i in range(STEP)])
    parts = []
    for i in range(STEP):
        shifted = f"shiftleft({part}, cast({WIDTH} * ({block} % 3) AS int))"
        parts += [t.format(i=i) for t in (f"if({{i}} < left AND {block} < 3, {shifted}, 0L) AS a{{i}}", f"if({{i}} < left AND {block} >= 3, {shifted}, 0L) AS b{{i}}", f"if({{i}} < left, shiftleft(1L, cast(10 * {block} AS int)), 0L) AS c{{i}}")]
    made = hashed.selectExpr(*names, "size", "chunk", *parts)
    lanes = {f"{h}s{k}": " + ".join(f"(shiftrightunsigned({h}{i}, {k}) & {LANE}L)" for i in range(STEP)) for h in "ab" for k in range(8)}
    made = made.selectExpr(*names, "size", "chunk", *[f"{c} AS {n}" for n, c in lanes.items()], " + ".join(f"c{i}" for i in range(STEP)) + " AS count")
    counted = made.groupBy(*names, "chunk").agg(F.expr("max(size) AS size"), *[F.expr(f"sum({n}) AS {n}") for n in (*lanes, "count")])

    number = [f"(shiftrightunsigned(count, {10 * b}) & 1023L)" for b in range(BLOCKS)]
    short = counted.where(f"size <= {CHUNK}").selectExpr(*names, *[f"{_majority(h, number[3 * o : 3 * o + 3])} AS bits_{h}" for o, h in enumerate("ab")])
    places = [(h, p) for h in "ab" for p in range(3 * WIDTH)]
    sums = [F.expr(f"sum(shiftrightunsigned({h}s{p % 8}, {p // 8 * 8}) & 255L) AS {h}{p}") for h, p in places] + [F.expr(f"sum({n}) AS m{b}") for b, n in enumerate(number)]
    long = counted.where(f"size > {CHUNK}").groupBy(*names).agg(*sums)
    wide = []
    for o, h in enumerate("ab"):
        bits = [f"if(2 * {h}{p} > m{3 * o + p // WIDTH}, {1 << p}L, 0L)" for p in range(3 * WIDTH)]
        wide.append(" + ".join([*bits, *[_state(f"m{3 * o + b}", b) for b in range(3)]]) + f" AS bits_{h}")
    return short.unionAll(long.selectExpr(*names, *wide))


def _state(words: str, block: int) -> str:
    """A block's number of words in three bits, at its place above the SimHash bits."""
    return f"shiftleft(if({words} < 4, {words}, 4L + {words} % 4), {3 * WIDTH + 3 * block})"


def _majority(half: str, words: list[str]) -> str:
    """The bits whose counters exceed half of their block's words: all counters of a long are compared by one addition."""
    out = []
    for k in range(8):
        masks = [sum(1 << 8 * lane for lane in range(7) if 8 * lane + k in range(WIDTH * b, WIDTH * (b + 1))) for b in range(3)]
        raised = " + ".join([f"{half}s{k}", *[f"(127L - shiftrightunsigned({n}, 1)) * {m}L" for n, m in zip(words, masks, strict=True)]])
        out.append(f"shiftleft(shiftrightunsigned({raised}, 7) & {sum(masks)}L, {k})")
    return " | ".join([*out, *[_state(n, b) for b, n in enumerate(words)]])


def bucket_keys() -> Column:
    """The keys, from bits_a and bits_b, of all pairs of blocks that hold enough words, of their bits and word numbers; null for other pairs."""
    half = ["bits_a"] * 3 + ["bits_b"] * 3
    block = [f"shiftrightunsigned({h}, {WIDTH * (b % 3)}) & {(1 << WIDTH) - 1}L" for b, h in enumerate(half)]
    held = [f"(shiftrightunsigned({h}, {3 * WIDTH + 3 * (b % 3)}) & 7L)" for b, h in enumerate(half)]
    enough = f"if({' + '.join(held)} > {BLOCKS}, 3, 2)"
    keys = [f"if({held[i]} + {held[j]} >= {enough}, xxhash64({c}, {block[i]}, {block[j]}, {held[i]}, {held[j]}), cast(null AS bigint))" for c, (i, j) in enumerate(combinations(range(BLOCKS), 2))]
    return F.expr(f"array({', '.join(keys)})")


def occurrences(docs: DataFrame) -> DataFrame:
    """(key, doc_id, pos, n1, n2, length, bits_a, bits_b): every line with words, its node, the norm's length and SimHash."""
    docs = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    rows = lines_of(docs.withColumn("key", F.xxhash64("text")), "row", "key", "doc_id")
    names = ["row", "key", "doc_id", "pos", "n1", "n2", "length"]
    # names are made in a projection of their own: beside the explode they would be made for every few words
    rows = rows.select("row", "key", "doc_id", "pos", *node_of(F.col("norm")), F.length("norm").alias("length"), F.split("norm", " ", -1).alias("words"))
    return simhash(rows, names, "words").drop("row")


def edits_allowed(a: Column, b: Column, similar: float) -> Column:
    """Edits allowed between two norms of these lengths; null where the lengths differ by more."""
    most = F.floor((1 - similar) * F.greatest(a, b) + 1e-9).cast("int")
    return F.when(F.abs(a - b) <= most, most)


def middles(wa: Column, wb: Column) -> tuple[Column, Column]:
    """Two word lists without their common first and last words, each word followed by a blank: their edit distance is that of the whole texts."""
    differ = lambda x, y: F.array_position(F.zip_with(x, y, lambda v, w: F.coalesce(v == w, F.lit(False))), False).cast("int")
    start = F.greatest(F.lit(1), differ(wa, wb))
    ra, rb = (F.reverse(F.slice(x, start, F.size(x))) for x in (wa, wb))
    end = F.greatest(F.lit(1), differ(ra, rb))
    cut = lambda x: F.array_join(F.transform(F.reverse(F.slice(x, end, F.size(x))), lambda w: F.concat(w, F.lit(" "))), "")
    return cut(ra), cut(rb)


def shares_half(wa: Column, wb: Column) -> Column:
    """Whether at least half of the distinct words of either list are the other's too."""
    da, db = F.array_distinct(wa), F.array_distinct(wb)
    return 2 * F.size(F.array_intersect(da, db)) >= F.greatest(F.size(da), F.size(db))


def within(a: Column, b: Column, most: Column) -> Column:
    """Whether two texts differ in at most ``most`` characters, by bands of edits that grow."""
    lev = lambda limit: F.call_function("levenshtein", a, b, limit)
    out = lev(most) >= 0
    for few in reversed(BANDS):
        out = F.when(lev(F.least(most, F.lit(few))) >= 0, True).when(most <= few, False).otherwise(out)
    return out


def signature(words: Column) -> list[Column]:
    """LONGS longs in which every word of a list sets one bit, s0 and on: a bit that only one of two lines has is a word that the other lacks."""
    h = F.transform(words, lambda w: F.xxhash64(F.lit(0x51), w))
    one = F.lit(1).cast("long")
    part = lambda k: F.aggregate(h, F.lit(0).cast("long"), lambda acc, x: F.when(F.shiftrightunsigned(x, 6) % LONGS == k, acc.bitwiseOR(F.call_function("shiftleft", one, x.bitwiseAND(F.lit(63)).cast("int")))).otherwise(acc))
    return [part(k).alias(f"s{k}") for k in range(LONGS)]


class _Texts:
    """The norms of wanted nodes, fetched once each from the document that holds the node's named line."""

    def __init__(self, docs: DataFrame, nodes: DataFrame):
        self.docs, self.nodes, self.held = docs, nodes, None

    def of(self, pairs: DataFrame) -> DataFrame:
        """(node, norm) of all nodes asked for so far, those of ``pairs`` (a, b) included; stored."""
        ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
        if self.held is not None:
            ends = ends.join(self.held.select("node"), "node", "left_anti")
        wanted = materialise(self.nodes.join(ends.select("node.n1", "node.n2"), ["n1", "n2"], "left_semi").select("n1", "n2", "key", "place"), "wanted")
        rows = sieve(self.docs.select("doc_id", "text", F.xxhash64("text").alias("key")), "key", wanted, "key")
        lines = lines_of(rows, "doc_id", "key").select("norm", place(F.col("doc_id"), F.col("key"), F.col("pos")).alias("place"))
        lines = sieve(lines, "place", wanted, "place")
        found = lines.join(wanted.select("place", "n1", "n2"), "place").where(F.xxhash64("norm") == F.col("n1"))
        new = materialise(found.dropDuplicates(["n1", "n2"]).select(F.struct("n1", "n2").alias("node"), "norm"), "norms")
        discard(wanted)
        if self.held is not None:
            both = materialise(self.held.unionAll(new), "norms")
            discard(self.held)
            discard(new)
            new = both
        self.held = new
        return new


def _links(pairs: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """The pairs whose different norms differ in at most 1 - ``similar`` of the longer one's characters and share half of their words."""
    b = pairs.join(texts.select(F.col("node").alias("b"), F.col("norm").alias("nb")), "b")
    both = b.join(texts.select(F.col("node").alias("a"), F.col("norm").alias("na")), "a")
    most = edits_allowed(F.length("na"), F.length("nb"), similar)
    # generators keep what they make as columns: words and middles are made once a pair, not once a band
    once = lambda **c: F.explode(F.array(F.struct(*[v.alias(k) for k, v in c.items()]))).alias("x")
    split = both.select("a", "b", once(most=most, wa=F.split("na", " ", -1), wb=F.split("nb", " ", -1))).select("a", "b", "x.*").where("most is not null")
    half = split.where(shares_half(F.col("wa"), F.col("wb")))
    ma, mb = middles(F.col("wa"), F.col("wb"))
    cut = half.select("a", "b", once(most=F.col("most"), ma=ma, mb=mb)).select("a", "b", "x.*")
    return cut.where(within(F.col("ma"), F.col("mb"), F.col("most"))).select("a", "b")


def _crowd(member: DataFrame, rows: int) -> DataFrame:
    """(bucket, m1, a1, m): members of buckets of several nodes with the bucket's centre and size; stored."""
    centre = member.groupBy("bucket").agg(F.min("m1").alias("a1"), F.max("m1").alias("z1"), F.count("*").alias("m")).where("a1 <> z1").drop("z1")
    centre = materialise(centre, "centres")
    # most buckets hold one node: their rows are dropped where they are made
    member = sieve(member, "bucket", centre, "bucket", bits=20)
    crowd = materialise(join_skewed(member, centre, ["bucket"], "m", rows), "crowd")
    discard(centre)
    return crowd


def _meeting(own: DataFrame, similar: float) -> DataFrame:
    """(a, b): all pairs of nodes of one bucket that lie in different components, fit in length and may share half of their words.

    ``own`` has bucket, its number m of nodes, node, root, length, its number of
    words and their signature.  Slices i and j of a bucket meet in cell (i, j).
    """
    slices = F.ceil(F.col("m") / SLICE)
    own = own.withColumn("slice", F.pmod(F.xxhash64("node"), slices))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), slices - 1), lambda j: F.struct(F.least("slice", j).alias("lo"), F.greatest("slice", j).alias("hi")))
    signs = [f"s{k}" for k in range(LONGS)]
    dealt = own.select("bucket", F.explode(cells).alias("cell"), *[F.col(c) for c in ("slice", "node", "root", "length", "size", *signs)])
    side = lambda x: dealt.select("bucket", "cell", *[F.col(c).alias(f"{c}_{x}") for c in ("slice", "node", "root", "length", "size", *signs)])
    lacks = lambda x, y: reduce(lambda p, q: p + q, [F.bit_count(F.col(f"{s}_{x}").bitwiseAND(F.bitwise_not(F.col(f"{s}_{y}")))) for s in signs])
    shared = F.least(F.col("size_a") - lacks("a", "b"), F.col("size_b") - lacks("b", "a"))
    met = side("a").join(side("b"), ["bucket", "cell"]).where((F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")))
    met = met.where((F.col("cell.lo") == F.least("slice_a", "slice_b")) & (F.col("cell.hi") == F.greatest("slice_a", "slice_b")))
    met = met.where(edits_allowed(F.col("length_a"), F.col("length_b"), similar).isNotNull() & (2 * shared >= F.greatest("size_a", "size_b")))
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def groups(docs: DataFrame, similar: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """All occurrences, and for every node in a group of several occurrences its group: (n1, n2, root, n)."""
    found = materialise(occurrences(docs), "lines")
    named = found.withColumn("place", place(F.col("doc_id"), F.col("key"), F.col("pos")))
    # one line names a node: its place and its text's hash belong together as the place is the smallest
    nodes = named.groupBy("n1", "n2").agg(F.min("place").alias("place"), F.min_by("key", "place").alias("key"), F.count("*").alias("n"), F.max("length").alias("length"), F.max("bits_a").alias("bits_a"), F.max("bits_b").alias("bits_b"))
    nodes = materialise(nodes, "nodes")
    node = F.struct("n1", "n2").alias("node")
    # buckets name a node by half of its name, which may add candidates and never loses one
    known = nodes.select(node, F.col("n1").alias("m1"), "length", "bits_a", "bits_b")
    texts = _Texts(docs, nodes)
    member = nodes.select(F.explode(bucket_keys()).alias("bucket"), F.col("n1").alias("m1")).where("bucket is not null")
    crowd = _crowd(member, nodes.count() * KEYS)
    ends = materialise(sieve(known, "m1", crowd, "m1"), "ends")

    side = lambda n, m: ends.select(F.col("node").alias(n), F.col("m1").alias(m), *[F.col(c).alias(f"{c}_{n}") for c in ("length", "bits_a", "bits_b")])
    pairs = crowd.where("a1 <> m1").select("a1", "m1").distinct().join(side("b", "m1"), "m1").join(side("a", "a1"), "a1")
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"bits_{h}_a").bitwiseXOR(F.col(f"bits_{h}_b")).bitwiseAND(F.lit((1 << 3 * WIDTH) - 1))) for h in "ab"])
    pairs = pairs.where(edits_allowed(F.col("length_a"), F.col("length_b"), similar).isNotNull() & (apart <= APART))
    pairs = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    links = materialise(_links(pairs, texts.of(pairs), similar), "links")
    roots = components(links)

    # buckets that lie in several components: all other pairs of these components
    placed = crowd.select("bucket", "m1").join(ends.select("node", "m1", "length"), "m1").join(roots, "node", "left")
    placed = materialise(placed.select("bucket", "node", "length", F.xxhash64(F.coalesce("root", "node")).alias("root")), "placed")
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m")).where("lo <> hi").select("bucket", "m")
    mixed = materialise(mixed, "mixed")
    own = join_skewed(placed, mixed, ["bucket"], "m", placed.count())
    wanted = own.select("node").distinct()
    norms = texts.of(wanted.select(F.col("node").alias("a"), F.col("node").alias("b"))).join(wanted, "node", "left_semi")
    words = norms.select("node", F.array_distinct(F.split("norm", " ", -1)).alias("words"))
    signed = materialise(words.select("node", F.size("words").alias("size"), *signature(F.col("words"))), "signed")
    rest = _meeting(own.join(signed, "node"), similar).join(pairs, ["a", "b"], "left_anti")
    rest = materialise(rest, "rest")
    old = [nodes, crowd, ends, pairs, links, placed, mixed, signed, rest, roots]
    if not rest.isEmpty():
        links = materialise(links.unionAll(_links(rest, texts.held, similar)), "links")
        roots = components(links)
        old += [links, roots]

    grouped = nodes.select(node, "n").join(roots, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root"))
    several = grouped.groupBy("root").agg(F.sum("n").alias("total")).where("total > 1").drop("total")
    out = materialise(grouped.join(several, "root").select("node.n1", "node.n2", "root", "n"), "groups")
    for table in (*old, texts.held):
        discard(table)
    return found, out


def surplus(docs: DataFrame, similar: float = 0.8) -> DataFrame:
    """(doc_id, key, gone): the line numbers that leave each document (its id and its text's hash); stored."""
    found, grouped = groups(docs, similar)
    lines = join_skewed(found.select("doc_id", "key", "pos", "n1", "n2"), grouped, ["n1", "n2"], "n", found.count())
    lines = materialise(lines.select("doc_id", "key", "pos", "root", place(F.col("doc_id"), F.col("key"), F.col("pos")).alias("place")), "grouped")
    first = lines.groupBy("root").agg(F.min(F.struct("doc_id", "pos", "key", "place")).alias("first")).select("first.place")
    gone = lines.join(first, "place", "left_anti").groupBy("doc_id", "key").agg(F.collect_set("pos").alias("gone"))
    out = materialise(gone, "gone")
    for table in (found, grouped, lines):
        discard(table)
    return out


def dedup(docs: DataFrame, similar: float = 0.8, emptied: str = "emptied") -> DataFrame:
    """The documents with one occurrence of every group of lines; adds ``emptied``: it had lines with words and lost all of them."""
    gone = surplus(docs.select("doc_id", "text"), similar)
    rest = [c for c in docs.columns if c != emptied]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.xxhash64("text").alias("row_key"), F.xxhash64("doc_id", F.xxhash64("text")).alias("row_name"))
    lost = gone.select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key"), "gone", F.xxhash64("doc_id", "key").alias("gone_name"))
    touched = sieve(rows, "row_name", lost, "gone_name")
    untouched = sieve(rows, "row_name", lost, "gone_name", keep=False)
    joined = touched.join(lost, (F.col("row_name") == F.col("gone_name")) & (F.col("row_key") == F.col("gone_key")) & F.col("row.doc_id").eqNullSafe(F.col("gone_id")), "left")
    left = F.filter(F.split("row.text", "\n", -1), lambda _, i: ~F.array_contains("gone", i))
    cut = F.col("gone").isNotNull()
    joined = joined.select("row", cut.alias("cut"), F.when(cut, F.array_join(left, "\n")).otherwise(F.col("row.text")).alias("left_text"))
    joined = joined.unionAll(untouched.select("row", F.lit(False).alias("cut"), F.col("row.text").alias("left_text")))
    columns = [F.col("left_text").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in rest]
    # a letter or digit decides whether a line with words is left
    return joined.select(*columns, (F.col("cut") & ~F.col("left_text").rlike(r"[\p{L}\p{N}]")).alias(emptied))
