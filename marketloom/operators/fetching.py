"""Failures of sources: stable reasons, the ladder of second tries, and the circuit breaker, from a log of cycles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cycles that fail before a source is left alone, seconds of the first pause and of the longest.
CIRCUIT, PAUSE, LONGEST = 4, 900, 21_600

RESULT = "source string, ts bigint, reason string, tried array<string>, recovered string, failures int, open_until bigint"


def reason(http: Column, error: Column, entries: Column) -> Column:
    """Why a fetch failed, null if it did not: of its error, else its status, else its lack of entries."""
    e = F.lower(error)
    has = lambda *ws: e.rlike("|".join(ws))
    by_error = F.when(has("ssl", "cert"), "ssl_error").when(has("timeout", "timed out"), "timeout").when(has("connection", "getaddrinfo", "name or service", "failed to resolve"), "dns_or_network").when(has("too many redirects"), "redirect_loop").otherwise("exception")
    by_status = F.when(http == 401, "auth_required").when(http.isin(403, 418), "bot_blocked").when(http == 404, "not_found").when(http == 429, "rate_limited").when(http.isin(500, 502, 503, 504), "server_error").when(http != 200, "http_error")
    return F.when(error.isNotNull(), by_error).otherwise(F.coalesce(by_status, F.when(F.coalesce(entries, F.lit(0)) == 0, "empty_feed")))


def ladder(why: Column, http: Column) -> Column:
    """The second tries that a failure calls for, in order."""
    steps = lambda when, *names: F.when(F.coalesce(when, F.lit(False)), F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>"))
    blocked = why.isin("bot_blocked", "auth_required")
    return F.concat(
        steps(http.isin(415, 429, 503) | (why == "rate_limited"), "backoff-3s", "feedfetcher", "telegrambot"),
        steps(http.isin(401, 403, 418) | blocked, "feedreader", "inoreader"),
        steps(why == "ssl_error", "ssl-lenient"),
        steps(why.isin("not_found", "empty_feed") | blocked | ((why == "http_error") & http.isin(401, 403, 415, 418)), "gn-mirror"),
        steps(F.lit(True), "googlebot-UA"),
    )


def _fold(frames):
    """One row after the other, sorted by source and time; a source's state is two numbers."""
    source, failures, until = None, 0, 0
    for f in frames:
        out = []
        for r in f.itertuples(index=False):
            if r.source != source:
                source, failures, until = r.source, 0, 0
            if until > r.ts:
                out.append((source, r.ts, "circuit_open", [], None, failures, until))
                continue
            if r.reason is None:
                failures, until = 0, 0
                out.append((source, r.ts, None, [], None, failures, until))
                continue
            tried, works, won = [], set(r.works if r.works is not None else []), None
            for step in r.steps:
                tried.append(step)
                if step in works:
                    won = step
                    break
            if not won:  # a recovered cycle leaves the count as it is
                failures += 1
                if failures >= CIRCUIT:
                    until = r.ts + min(LONGEST, PAUSE * 2 ** min(20, failures - CIRCUIT))
            out.append((source, r.ts, r.reason, tried, won, failures, until))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])


def cycles(log: DataFrame) -> DataFrame:
    """What each cycle of each source did, from a log (source, ts, http, error, entries, works).

    ``works`` names the second tries that succeed in that cycle.  Rows are
    sorted by source and time and folded one by one, so a source may have any
    number of cycles; they must follow each other, so one source is one task's.
    """
    why = reason(F.col("http"), F.col("error"), F.col("entries"))
    rows = log.where("source is not null and ts is not null").select("source", F.col("ts").cast("bigint").alias("ts"), why.alias("reason"), ladder(why, F.col("http")).alias("steps"), "works")
    return rows.repartition("source").sortWithinPartitions("source", "ts").mapInPandas(_fold, RESULT)
