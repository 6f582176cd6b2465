"""Fill-in-the-middle, mixing and conversation repair against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marketloom.llm import dialogue, infill, mixing

# ---- fill-in-the-middle


def plain_infill(i, t):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    n = len(units)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_infill(spark, docs, empty):
    more = spark.createDataFrame([(100 + k, t) for k, t in enumerate(["a<P>b", "<S", "x<" * 40, "é" * 50, "\x00\x7f\x80ÿ日本", "a\nb\r\n\tc", "😀word😀" * 9, "<M" + ">" * 3])], "doc_id long, text string")
    frame = docs.unionByName(more, allowMissingColumns=True).withColumn("infill", F.lit("old")).withColumn("n", F.lit(0))
    made = infill.transform(frame)
    assert made.columns == [c for c in frame.columns if c != "infill"] + ["infill"]
    before = defaultdict(list)
    for r in frame.collect():
        before[r.doc_id].append(r.text)
    forms = set()
    for r in made.withColumn("again", infill.restore(F.col("text"), F.col("infill.form"))).collect():
        text = before[r.doc_id][0]
        n, form, p, m, out = plain_infill(r.doc_id, text or "")
        assert (r.infill.n, r.infill.form, r.infill.prefix_chars, r.infill.middle_chars, r.text or "") == (n, form, p, m, out), r.doc_id
        assert r.again == text
        forms.add(form)
    assert forms == {"plain", "psm", "spm"}
    assert infill.transform(empty).count() == 0


def test_infill_signs_may_differ(spark):
    rule = infill.Rule(prefix="[pre]", suffix="[suf]", middle="[mid]", plain=0, spm=50, seed="7")
    frame = spark.createDataFrame([(k, f"word{k} and more, <P> is no sign here") for k in range(40)], "doc_id long, text string")
    made = infill.transform(frame, rule=rule).withColumn("again", infill.restore(F.col("text"), F.col("infill.form"), rule)).collect()
    assert {r.infill.form for r in made} == {"psm", "spm"} and all(r.again == f"word{r.doc_id} and more, <P> is no sign here" for r in made)


# ---- mixing


def plain_targets(sizes, weights=(5, 2, 1), share=1.5):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    return target


def some_documents(spark, n=400):
    draw = random.Random(3)
    rows = [(k, " ".join(["w"] * int(draw.paretovariate(0.9))), draw.choice(["a", "a", "a", "b", "c", "d", None, "e"])) for k in range(n)]
    rows += [(None, "no id", "a"), (5000, None, "b"), (5001, "", "c"), (5002, "only one of its source", "lonely"), (5003, None, "nothing"), (5004, "twice here", "b"), (5004, "twice here", "b")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *[F.lit(1).alias(c) for c in ("key", "size", "target", "rank", "n", "copy")])


def test_mixing(spark):
    rows, docs = some_documents(spark)
    mix = mixing.sample(docs).collect()
    assert len(mix) == len(rows)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
        largest[s] = max(largest[s], len((t or "").split()))
    want = plain_targets(dict(sizes))
    for r in mix:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], abs_tol=1e-6)
        assert r.taken == r.copies * r["size"] <= 2 * r["size"] and (r.copies > 0 or True)
        taken[r.source] += r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= largest[s] / 2 + 1e-6, s
    for s in ("a", "b", "c"):
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 5
    again = mixing.sample(docs.repartition(7)).collect()
    assert sorted(map(str, mix)) == sorted(map(str, again))
    assert mixing.sample(docs.where("false")).count() == 0
    assert mixing.sample(docs.where("text is null")).where("taken > 0").count() == 0


def test_larger_documents_are_likelier_and_factors_meet_targets(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), F.when(F.col("id") % 2 == 0, 4).otherwise(64)).alias("text"), F.concat(F.lit("s"), (F.col("id") % 6 < 2).cast("string")).alias("source"))
    mix = mixing.sample(docs, rule=mixing.Rule(weights=(1, 1), share=0.5)).groupBy("source", "size").agg(F.avg("copies").alias("mean"), F.first("target").alias("target"), F.sum("size").alias("all")).collect()
    by = {(r.source, r["size"]): r for r in mix}
    for s in ("sfalse", "strue"):
        ratio = by[s, 64]["mean"] / by[s, 4]["mean"]
        assert 3 < ratio < 5.5  # the square root of 16, unless capped


def test_mixed_rows(spark):
    rows, docs = some_documents(spark, 60)
    mix = mixing.sample(docs)
    out = mixing.mixed(docs)
    assert out.count() == mix.agg(F.sum("copies")).first()[0] and out.columns == docs.columns
    assert {r.doc_id: r[1] for r in out.groupBy("doc_id").count().collect()} == {r.doc_id: r[1] for r in mix.where("copies > 0").groupBy("doc_id").agg(F.sum("copies")).collect()}


def test_bad_weights():
    with pytest.raises(ValueError):
        mixing.Rule(weights=(1, 0))


# ---- conversation repair

TAIL = re.compile(r"[^\x20\x09-\x0D]")


def marked(rows):
    """(role, text, fault) of rows in order."""
    seen, out = set(), []
    for role, text in rows:
        signs = TAIL.findall(text)
        fault = "blank" if not signs else "duplicate" if (role, text) in seen else "truncated" if signs[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def plain_repair(rows):
    """Cheapest edits by listing all sequences (at most two inserted rows in a gap)."""
    best = None
    gaps = ["", "u", "a", "ua", "au"]

    def go(i, roles, cost, audit, made):
        nonlocal best
        if best and cost > best[0]:
            return
        for gap in gaps:
            r2, c2, a2 = roles + gap, cost + 5 * len(gap), audit + "I" * len(gap)
            m2 = made + [("user:" if g == "u" else "assistant:") for g in gap]
            if not re.fullmatch(r"s?(ua)*u?", r2):
                continue
            if i == len(rows):
                if re.fullmatch(r"(s?(ua)+)?", r2) and (best is None or (c2, a2) < best[:2]):
                    best = (c2, a2, m2)
                continue
            role, text, fault = rows[i]
            go(i + 1, r2, c2 + 2, a2 + "D", m2)
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                if role[:1] in "sua" and role:
                    go(i + 1, r2 + role[0], c2 + extra, a2 + "K", m2 + [f"{role}:{text}"])
                for x, full in (("u", "user"), ("a", "assistant")):
                    go(i + 1, r2 + x, c2 + extra + 1, a2 + "R", m2 + [f"{full}:{text}"])

    go(0, "", 0, "", [])
    return best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest()


def report_of(turned):
    rows = marked([(r, t) for _, r, t in turned])
    turns = [k for k, _, _ in turned if k is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    count = lambda f: sum(x[2] == f for x in rows)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, *plain_repair(rows))


def conversations(seed=5, n=60):
    draw = random.Random(seed)
    out = {}
    for c in range(n):
        out[c] = sorted((k, draw.choice(["system", "user", "user", "assistant", "assistant", "tool"]), draw.choice(["Good.", "Fine!", "cut", "", "  \n", f"Say {k}.", f"Say {k % 2}? \t"])) for k in draw.sample(range(9), draw.randint(1, 5)))
    out[200] = [(None, " ", " "), (None, "user", "Hello."), (3, "assistant", "Yes.")]
    out[201] = [(1, "", "Without a role.")]
    out[None] = [(0, "user", "No id."), (1, "assistant", "None")]
    return out


def test_repair(spark):
    given = conversations()
    rows = [(c, k, r, t) for c, found in given.items() for k, r, t in found]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *[F.lit(1).alias(x) for x in ("pos", "part", "chunk", "digest", "first", "cost")])
    for r in dialogue.repair(frame).collect():
        turned = sorted(given[r.conv_id], key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).hexdigest()))
        assert tuple(r)[1:] == report_of(turned), r
    assert dialogue.repair(frame.where("false")).count() == 0


def test_repaired_rows_alternate(spark):
    rows = [(c, k, r, t) for c, found in conversations(9).items() for k, r, t in found]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = defaultdict(list)
    for r in sorted(dialogue.repaired(frame).collect(), key=lambda r: (r.pos, r.place)):
        found[r.conv_id].append(r)
    digests = {r.conv_id: r.repaired_sha256 for r in dialogue.repair(frame).collect()}
    for c, lines in found.items():
        assert re.fullmatch(r"s?(ua)+", "".join(x.role[0] for x in lines))
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in lines).encode()).hexdigest() == digests[c]


def test_a_conversation_over_many_parts(spark):
    draw = random.Random(11)
    long_one = [(7, k, draw.choice(["user", "user", "assistant", "system"]), draw.choice([f"Say {k}.", f"Say {k % 5}.", "cut", ""])) for k in range(3000)]
    frame = spark.createDataFrame(long_one + [(1, 0, "user", "Hi."), (9, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stored = dialogue._ordered(frame)
        assert stored.where("conv_id = 7").select("part").distinct().count() > 1
        got = {r.conv_id: r for r in dialogue.repair(frame).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = marked([(r, t) for _, _, r, t in long_one])
    symbols = "".join((dialogue.GONE if f in ("blank", "duplicate") else dialogue.TRUNCATED if f else dialogue.CLEAN)["suax".index(r[0])] for r, _, f in rows)
    signs, cost, _ = dialogue.plan(symbols, 0, dialogue.END)
    assert (got[7].cost, got[7].audit) == (cost, "".join(signs).translate(dialogue.INITIALS))
    lines = []
    for (role, text, _), s in zip(rows, signs, strict=True):
        for x in s:
            lines += {"K": [f"{role}:{text}"], "D": [], "u": ["user:"], "a": ["assistant:"], "U": [f"user:{text}"], "A": [f"assistant:{text}"]}[x]
    assert got[7].repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()
    assert got[1].audit == got[9].audit == "D"


def test_damage_by_hand(spark):
    rows = [(c, k, "assistant", "One. Two!") for c in range(60) for k in range(3)] + [(None, None, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, k, r, t in rows:
        c2, k2, r, t = (" " if x is None else x for x in (c, k, r, t))
        kind = zlib.crc32(f"{c2}:{k2}".encode()) % 20
        new = (c, k, "user" if kind == 4 else r, "" if kind == 1 else re.sub("[.!?]", "", t) if kind == 2 else t)
        want += [new] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert sorted(map(tuple, dialogue.damage(frame).collect()), key=str) == sorted(want, key=str)
    lost = {c for c in range(60)} - {c for c, *_ in want}
    report = {r.conv_id: r for r in dialogue.report(frame, dialogue.damage(frame)).collect()}
    assert set(report) == {c for c, *_ in rows}
    assert all(tuple(report[c])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in lost)
