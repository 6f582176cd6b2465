"""The ingest chain and edit distances against plain loops over the given tables."""

import re

from pyspark.sql import functions as F

from marketloom.functions import scoring
from marketloom.plans import catalog
from marketloom.plans import reports as plans
from marketloom.plans.desk import articles


def test_ingest_chain(spark, data):
    rows = articles(spark, data)
    c = scoring.credibility(F.col("title"), F.col("summary"), F.lit(0.8), F.col("age_hours"), link=F.col("link"))
    judged = rows.select("id", "title", "link", "ts", scoring.relevant(F.col("title"), F.col("summary")).alias("relevant"), c.alias("c")).collect()
    seen_titles, seen_links, want = set(), set(), {}
    for r in sorted((r for r in judged if r.relevant and r.c["valid"]), key=lambda r: (-r.ts, r.id)):
        title = re.sub(r"[^a-z0-9]", "", (r.title or "").lower())[:128]
        link = re.sub(r"[?#].*$", "", r.link)
        if (title and title in seen_titles) or link in seen_links:
            continue
        seen_titles |= {title} - {""}
        seen_links.add(link)
        want[r.id] = r.c["score"]
    got = {r.id: r.score for r in plans.ingest_chain(spark, data).collect()}
    assert got == want and 0 < len(want) < len(judged)


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def test_edit_distances(spark, data):
    texts = {r.item_id: r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    got = {r.item_id: r.distance for r in catalog.edit_distance(spark, data).collect()}
    assert got == {k: distance(t, texts[k + 1]) for k, t in texts.items() if k + 1 in texts}


def test_archive(spark, data):
    from marketloom.plans import desk

    ids, prints, want = set(), set(), []
    for r in sorted(desk.archive_rows(spark, data).collect(), key=lambda r: r.place):
        f = ((r.link or "").split("?")[0], re.sub("[^a-z0-9]", "", r.title.lower())[:90])
        if r.id not in ids and f not in prints:
            ids.add(r.id)
            prints.add(f)
            want.append((r.id, r.place))
    assert sorted((r.id, r.place) for r in desk.archive_merge(spark, data).collect()) == sorted(want[-1000:])
