"""Registered queries of the newsroom's ranking and its drafts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.functions import scoring, text
from marketloom.operators import newsroom, office
from marketloom.plans.catalog import BARS, bars, query
from marketloom.plans.desk import ART, NOW, articles

LEXICON = {
    "gold": {"weight": 1.0, "assets": ("XAU", "GOLD"), "words": ("gold", "ounce", "طلا")},
    "global": {"weight": 0.95, "assets": ("SPX",), "words": ("fed", "inflation", "interest rate", "oil", "نفت")},
    "currency": {"weight": 0.9, "assets": ("DXY",), "words": ("us dollar", "dollar", "euro"), "ambiguous": ("dollar",)},
    "crypto": {"weight": 0.95, "assets": ("BTC", "ETH"), "words": ("bitcoin", "crypto", "بیت کوین")},
    "tech": {"weight": 1.0, "assets": ("NVDA",), "words": ("nvidia", "ai", "هوش مصنوعی")},
}
HEADLINES = ("Bitcoin surge", "Gold at a record, 2,100 dollars an ounce", "Fed warns of inflation and recession after a massive crash in oil", "The dollar", "Free giveaway of crypto", "Nvidia and AI shock", "Quiet day", "رکورد تاریخی طلا در ۵ هزار دلار", "Billion dollar ath", "بیت کوین سقوط کرد")
SYMBOLS = {"view": "BTC", "click": "ETH", "purchase": "GOLD", "signup": "SPX", "error": "XAU"}


def stories(s: SparkSession, d: str) -> DataFrame:
    """Articles under the headlines, with times in seconds, milliseconds or missing ones, and scores of social ones."""
    i = F.col("id")
    head = F.element_at(F.array(*map(F.lit, HEADLINES)), (i % len(HEADLINES) + 1).cast("int"))
    ts = F.when(i % 29 != 0, F.when(i % 3 == 0, F.col("ts") * 1000).otherwise(F.col("ts")))
    return articles(s, d).select("id", F.concat_ws(" ", head, "title").alias("title"), "summary", "source", "link", "kind", "assets", F.when(i % 31 != 0, F.col("cred")).alias("credibility"), ts.alias("ts"), F.when(F.col("kind") == "social", F.col("views")).alias("social"))


def market(s: SparkSession, d: str) -> DataFrame:
    """Price, change over six bars and the last thirty closes of every symbol; one has four closes, one no change."""
    rn = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("bucket")))
    most = F.when(F.col("symbol") == "click", 4).otherwise(30)
    kept = bars(s, d).select("symbol", "bucket", F.col("close").cast("double").alias("close")).withColumn("rn", rn).where(F.col("rn") <= most)
    rows = kept.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "close"))), lambda r: r["close"]).alias("closes"))
    names = F.create_map(*[F.lit(x) for kv in SYMBOLS.items() for x in kv])
    price = F.element_at("closes", -1)
    change = F.when(F.col("symbol") != "purchase", (price / F.get("closes", F.greatest(F.size("closes") - 7, F.lit(0))) - 1) * 100)
    return rows.select(F.element_at(names, F.col("symbol")).alias("symbol"), price.alias("price"), change.alias("change_24h"), "closes")


def hit(w: str, on: str = "t") -> str:
    """Whether a folded text holds a word, in SQL."""
    w = newsroom.text_fold(w)
    ends = f"([^a-z0-9؀-ۿ]|$|{'|'.join(scoring.ENDINGS)})"
    return f"regexp_matches({on}, '(^|[^a-z0-9]){w}([^a-z0-9]|$)')" if newsroom._latin(w) else f"regexp_matches({on}, '(^|[^a-z0-9؀-ۿ]){w}{ends}')"


def _listed(ws) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {hit(w)} THEN '{newsroom.text_fold(w)}' END" for w in ws) + "], lambda x: x IS NOT NULL)" if ws else "CAST([] AS VARCHAR[])"


def _pick(values, key: str) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


_FOLD = lambda x: f"trim(regexp_replace(translate(lower({x}), '{text.PERSIAN_DIGITS}', '0123456789'), '\\s+', ' ', 'g'))"
_ROUND = newsroom.ROUND
_SAT = lambda x: f"CASE WHEN {x} > 0 THEN 1 - exp(-({x})) ELSE 0 END"
_UP = lambda x: f"floor(({x}) * 10 + 0.5::DOUBLE + 1e-9::DOUBLE) / 10"
_FADE = lambda h: f"CASE WHEN age_hours <= 0 THEN 1 ELSE greatest(0.05::DOUBLE, pow(0.5::DOUBLE, age_hours / {h})) END"
_AMBIGUOUS = {k: [w for w in v["words"] if w in v.get("ambiguous", ())] for k, v in LEXICON.items()}
_SURE = {k: [w for w in v["words"] if w not in v.get("ambiguous", ())] for k, v in LEXICON.items()}
_OWN = lambda k: f"list_filter(coalesce(assets, []), lambda a: a IN ({', '.join(repr(a) for a in LEXICON[k]['assets'])}))"
_NOTHING = " AND ".join(f"len(s_{k}) = 0" for k in LEXICON)
_EVIDENCE = ", ".join(f"CASE WHEN {_NOTHING} THEN w_{k} ELSE s_{k} END AS d_{k}" for k in LEXICON)  # one desk alone has ambiguous words
_WEIGHTS = "list_sort(list_filter([" + ", ".join(f"CASE WHEN len(d_{k}) > 0 THEN {v['weight']}::DOUBLE END" for k, v in LEXICON.items()) + "], lambda x: x IS NOT NULL), 'DESC')"
_BEST = "list_sort(list_filter([" + ", ".join(f"CASE WHEN len(d_{k}) > 0 THEN {{'w': {v['weight']}::DOUBLE, 'n': len(d_{k}), 'p': -{i}, 'k': '{k}'}} END" for i, (k, v) in enumerate(LEXICON.items())) + "], lambda x: x IS NOT NULL), 'DESC')[1].k"
STORIES = f"""{ART}, st AS (SELECT id, {_pick(HEADLINES, 'id')} || ' ' || title AS title, summary, kind, assets, CASE WHEN id % 31 <> 0 THEN cred ELSE 0.7 END::DOUBLE AS credibility, CASE WHEN id % 29 <> 0 THEN id * 450 / 3600.0::DOUBLE ELSE 12 END::DOUBLE AS age_hours, CASE WHEN kind = 'social' THEN views END AS social FROM art),
fo AS (SELECT *, {_FOLD("title || ' ' || summary")} AS t, {_FOLD('title')} AS ft, title || ' ' || summary AS claims FROM st),
hi AS (SELECT *, array_to_string(list_filter(string_split(ft, ' '), lambda w: w <> '' AND w NOT IN ({', '.join(repr(w) for w in newsroom.KEYLESS)}))[1:6], ' ') AS key,
  len(list_distinct(regexp_extract_all(translate(claims, '{text.PERSIAN_DIGITS}', '0123456789'), '[0-9]+(?:[.,][0-9]+)?'))[1:12]) AS numbers, {', '.join(f"({_OWN(k)} || {_listed(_SURE[k])})[1:6] AS s_{k}, ({_listed(_AMBIGUOUS[k])})[1:6] AS w_{k}" for k in LEXICON)},
  {' OR '.join(hit(w) for ws in office.OFF_PROFILE.values() for w in ws)} AS off, {' + '.join(hit(w) + '::INT' for w in scoring.IMPACT)} AS impacts, {' + '.join(hit(w) + '::INT' for w in dict.fromkeys(map(newsroom.text_fold, newsroom.VIRAL)))} AS drama, {' + '.join(hit(w) + '::INT' for w in newsroom.BUZZ)} AS buzzing,
  {' OR '.join(hit(w) for w in newsroom.TECH)} AS tech, len(regexp_extract_all(t, '{_ROUND}')) AS rounds FROM fo), ev AS (SELECT *, {_EVIDENCE} FROM hi),
fa AS (SELECT *, least(1, list_sum({_WEIGHTS}[1:2]) / 1.7::DOUBLE) AS topic, least(1, 0.35::DOUBLE + CASE WHEN numbers > 0 THEN 0.25 ELSE 0 END::DOUBLE + CASE WHEN impacts >= 1 THEN 0.25 ELSE 0 END::DOUBLE + CASE WHEN impacts >= 3 THEN 0.15 ELSE 0 END::DOUBLE) AS impact, {_FADE(12)} AS freshness,
  CASE WHEN len(d_tech) > 0 AND tech THEN 'tech' WHEN len(d_crypto) > 0 THEN 'crypto' ELSE {_BEST} END AS "primary", CASE WHEN credibility < 0.55 THEN 'low_credibility' WHEN off THEN 'off_profile' WHEN {' AND '.join(f'len(d_{k}) = 0' for k in LEXICON)} THEN 'no_desk' END AS reject,
  {_SAT('(drama / 2.0::DOUBLE + rounds / 3.0::DOUBLE)')} AS novelty, {_SAT('(buzzing / 1.5::DOUBLE)')} AS buzz, CASE WHEN coalesce(social, 0) <> 0 THEN {_SAT('(social / 1500.0::DOUBLE)')} ELSE 0.2 END::DOUBLE AS demand, {_FADE(8)} AS recency FROM ev),
ass AS (SELECT *, CASE WHEN reject IS NOT NULL THEN 0 ELSE {_UP('greatest(0, least(1, (0.35::DOUBLE * topic + 0.30::DOUBLE * impact + 0.20::DOUBLE * freshness + 0.15::DOUBLE * credibility) * CASE WHEN kind = ' + "'social'" + ' THEN 0.92 ELSE 1 END::DOUBLE)) * 100')} END AS fit FROM fa)"""
MOVES = f"""{BARS}, cl AS (SELECT symbol, list(close::DOUBLE ORDER BY bucket) AS l FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bucket DESC) AS rn FROM c) WHERE rn <= CASE symbol WHEN 'click' THEN 4 ELSE 30 END GROUP BY symbol),
ch AS (SELECT CASE symbol {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in SYMBOLS.items())} END AS symbol, l, CASE WHEN symbol <> 'purchase' THEN (l[-1] / l[greatest(len(l) - 7, 0) + 1] - 1) * 100 END AS chg FROM cl),
sr AS (SELECT *, list_filter(list_transform(range(1, len(l)), lambda i: CASE WHEN l[i] <> 0 THEN abs((l[i + 1] - l[i]) / l[i]) * 100 END), lambda x: x IS NOT NULL) AS r FROM ch),
mo AS (SELECT symbol, CASE WHEN chg IS NULL THEN 0 WHEN len(l) >= 6 THEN abs(chg) / greatest(0.35::DOUBLE, coalesce(list_sum(r) / len(r), 1)) + CASE WHEN l[-1] >= list_max(l) * 0.999::DOUBLE AND chg > 0 THEN 0.8 WHEN l[-1] >= list_max(l) * 0.999::DOUBLE AND chg < 0 THEN 0.5 ELSE 0 END::DOUBLE ELSE abs(chg) / 3 END AS z FROM sr)"""
VIRAL = f"""{STORIES}, {MOVES}, nm AS (SELECT id, unnest(assets) AS symbol, generate_subscripts(assets, 1) AS nth FROM ass), be AS (SELECT id, symbol AS mover, z FROM nm JOIN mo USING (symbol) QUALIFY row_number() OVER (PARTITION BY id ORDER BY z DESC, nth) = 1),
sh AS (SELECT ass.*, mover, CASE WHEN mover IS NULL THEN 0.35 ELSE {_SAT('(z / 1.8::DOUBLE)')} END::DOUBLE AS shock FROM ass LEFT JOIN be USING (id)), vi AS (SELECT *, {_UP('(0.30::DOUBLE * shock + 0.30::DOUBLE * novelty + 0.20::DOUBLE * buzz + 0.10::DOUBLE * demand + 0.10::DOUBLE * recency) * 100')} AS viral FROM sh)"""
JUDGED = f"""{VIRAL}, ju AS (SELECT *, CASE WHEN reject IS NULL AND key <> '' AND row_number() OVER (PARTITION BY key, reject IS NULL ORDER BY age_hours, id) > 1 THEN 'duplicate' ELSE reject END AS why, {_UP('0.55::DOUBLE * viral + 0.45::DOUBLE * fit')} AS rank FROM vi)"""


def judged(s: SparkSession, d: str) -> DataFrame:
    return newsroom.judged(newsroom.assessed(stories(s, d), LEXICON, NOW), market(s, d), [F.col("age_hours")])


@query(f"""WITH {STORIES} SELECT id, fit, reject, CASE WHEN {' AND '.join(f'len(d_{k}) = 0' for k in LEXICON)} THEN NULL ELSE "primary" END AS desk, round(topic, 6) AS topic, impact, round(freshness, 6) AS freshness, numbers::BIGINT AS numbers, {', '.join(f"array_to_string(d_{k}, ',') AS {k}" for k in LEXICON)} FROM ass""")
def newsroom_fit(s, d):
    """How well every story fits the desks, on what evidence, and what is against it."""
    rows = newsroom.assessed(stories(s, d), LEXICON, NOW)
    evidence = [F.coalesce(F.array_join(F.try_element_at("desks", F.lit(k)), ","), F.lit("")).alias(k) for k in LEXICON]
    topic = F.when(F.size("desks") > 0, F.round("topic", 6))
    return rows.select("id", "fit", "reject", F.col("primary").alias("desk"), topic.alias("topic"), "impact", F.round("freshness", 6).alias("freshness"), F.size("numbers").cast("long").alias("numbers"), *evidence)


@query(f"WITH {VIRAL} SELECT id, mover, round(shock, 6) AS shock, round(novelty, 6) AS novelty, round(buzz, 6) AS buzz, round(demand, 6) AS demand, round(recency, 6) AS recency, viral FROM vi")
def story_virality(s, d):
    """How likely every story is to spread, by its factors."""
    rows = newsroom.viral(newsroom.assessed(stories(s, d), LEXICON, NOW), market(s, d))
    return rows.select("id", "mover", *[F.round(c, 6).alias(c) for c in newsroom.SPREAD], "viral")


@query(f"""WITH {MOVES} SELECT symbol, round(z, 6) AS z FROM mo""")
def market_moves(s, d):
    """The size of every symbol's move in its usual steps."""
    return newsroom.moves(market(s, d)).select("symbol", F.round("z", 6).alias("z"))


@query(f"""WITH {JUDGED} SELECT id, rank, fit, viral, "primary" AS desk FROM ju WHERE why IS NULL AND fit >= 12 ORDER BY rank DESC, age_hours, id LIMIT 150""")
def newsroom_channel(s, d):
    """The channel's 150 best stories by virality and fit, each once."""
    return newsroom.channel(judged(s, d), limit=150).select("id", "rank", "fit", "viral", F.col("primary").alias("desk"))


@query(f"WITH {JUDGED} SELECT coalesce(why, 'taken') AS reason, count(*) AS n FROM ju GROUP BY ALL")
def newsroom_rejections(s, d):
    """Why stories are not taken."""
    return newsroom.rejections(judged(s, d))


@query(f"""WITH {JUDGED}, ta AS (SELECT *, row_number() OVER (PARTITION BY "primary" ORDER BY rank DESC, age_hours, id) AS rn FROM ju WHERE why IS NULL AND fit >= 12) SELECT "primary" AS desk, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY rn) FILTER (rn <= 3) AS leads FROM ta GROUP BY "primary" """)
def newsroom_lanes(s, d):
    """Stories of every desk in the whole channel, and its leads."""
    rows = newsroom.lanes(newsroom.channel(judged(s, d)))
    return rows.select(F.col("primary").alias("desk"), "n", F.array_join(F.transform("leads", lambda i: i.cast("string")), ",").alias("leads"))
