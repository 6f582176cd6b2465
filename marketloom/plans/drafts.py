"""Registered queries of drafts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions import text
from marketloom.operators import drafts
from marketloom.plans.catalog import query
from marketloom.plans.desk import ART, articles
from marketloom.plans.newsroom import HEADLINES, _pick


def stories(s, d):
    head = F.element_at(F.array(*map(F.lit, HEADLINES)), (F.col("id") % len(HEADLINES) + 1).cast("int"))
    more = F.concat(F.when(F.col("id") % 4 == 0, "Prices rose 12.5% to 2,100 . ").otherwise(""), F.col("summary"))
    return articles(s, d).select("id", F.concat_ws(" ", head, "title").alias("title"), more.alias("summary"), "source", "link", "assets", F.col("cred").alias("credibility"))


def replies(s, d):
    """A reply to every story: whole, without its wrapper, with empty parts, or none."""
    t, b, i = F.col("title"), F.coalesce(F.substring("summary", 1, 300), F.lit("")), F.col("id") % 5
    slides = F.concat(F.lit('<slides>\n<slide title=" One ">'), t, F.lit('</slide><slide title="">\n</slide><slide>'), b, F.lit("</slide></slides>"))
    script = F.concat(F.lit('<script><scene sec="0-3" on_screen="'), F.col("source"), F.lit('">'), b, F.lit('</scene><scene sec="3-9" on_screen=""> </scene></script>'))
    whole = F.concat(F.lit("<caption>\n"), t, F.lit("\n</caption>"), slides, script, F.lit("<hashtags>#gold, plain #XAU</hashtags>"))
    reply = F.when(i == 0, whole).when(i == 1, F.concat(t, F.lit("\n"), b)).when(i == 2, slides).when(i == 3, script)
    return stories(s, d).withColumn("reply", reply)


STORIES = f"{ART}, st AS (SELECT id, {_pick(HEADLINES, 'id')} || ' ' || title AS title, CASE WHEN id % 4 = 0 THEN 'Prices rose 12.5% to 2,100 . ' ELSE '' END || summary AS summary, source, link, assets, cred FROM art)"
_ANY = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
_SIGN = "CASE " + " ".join(f"WHEN {_ANY('low', words)}" + (f" OR list_has_any(coalesce(assets, []), {list(symbols)})" if symbols else "") + f" THEN '{sign}'" for sign, symbols, words in drafts.SIGNS)
_SIGN += f" WHEN {_ANY('lower(title)', drafts.TITLE_SIGN[1])} THEN '{drafts.TITLE_SIGN[0]}' " + " ".join(f"WHEN {_ANY('low', words)} THEN '{sign}'" for sign, words in drafts.LATER_SIGNS) + f" ELSE '{drafts.OTHER_SIGN}' END"
_BAG = lambda c: f"list_distinct(list_filter(string_split(regexp_replace(lower({c}), '{drafts.NOT_WORD}', ' ', 'g'), ' '), lambda w: w <> ''))"
_ORIGIN = f"source || ' · اعتبار ' || tr || '٪ — {drafts.FOOTER}'"
TEMPLATES = f"""{STORIES}, se AS (SELECT *, lower(title || ' ' || summary) AS low, round_even(cred * 100, 0)::INT::VARCHAR AS tr, {_BAG('title')} AS bag, list_filter(list_transform(string_split(regexp_replace(regexp_replace(summary, '([.!?؟])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 12) AS sents,
  regexp_extract_all(translate(summary, '{text.PERSIAN_DIGITS}', '0123456789'), '{drafts.CLAIM}')[1:8] AS n FROM st),
bo AS (SELECT *, list_filter(sents, lambda x: NOT (len(bag) > 0 AND len({_BAG('x')}) > 0 AND len(list_intersect(bag, {_BAG('x')})) >= 0.6::DOUBLE * least(len(bag), len({_BAG('x')})))) AS body FROM se),
te AS (SELECT *, {_SIGN} || ' **' || title || '**' || chr(10) || chr(10) || CASE WHEN len(body) > 0 THEN array_to_string(body[1:3], ' ') ELSE summary END || CASE WHEN len(n) > 0 THEN chr(10) || chr(10) || '{drafts.KEY_POINT}' || array_to_string(n[1:4], ' · ') ELSE '' END || chr(10) || chr(10) || 'منبع: ' || {_ORIGIN} AS caption,
  [{{'title': '{drafts.HEADLINE}', 'body': title}}] || list_transform(body[1:4], lambda x: {{'title': substr(x, 1, 40), 'body': x}}) || CASE WHEN len(n) > 0 THEN [{{'title': '{drafts.FIGURES}', 'body': array_to_string(n[1:5], ' · ')}}] ELSE [] END || [{{'title': '{drafts.ORIGIN}', 'body': {_ORIGIN}}}] AS slides,
  list_filter([{{'sec': '0-4', 'on_screen': substr(title, 1, 48), 'narration': title}}, {{'sec': '4-14', 'on_screen': '', 'narration': CASE WHEN len(body) > 0 THEN body[1] ELSE substr(summary, 1, 120) END}}, {{'sec': '14-25', 'on_screen': '', 'narration': coalesce(body[2], '')}}, {{'sec': '25-35', 'on_screen': 'منبع: ' || source, 'narration': coalesce(n[1], '') || ' — {drafts.FOOTER}'}}], lambda x: x.on_screen <> '' OR x.narration <> '') AS scenes,
  list_transform(coalesce(assets, [])[1:4], lambda a: '#' || a) AS hashtags FROM bo)"""
_STRIP = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_FLAT = lambda c: _STRIP(f"regexp_replace({c}, '\\s+', ' ', 'g')")
_BLOCK = lambda n: _STRIP(f"regexp_extract(reply, '(?s)<{n}>(.*?)</{n}>', 1)")
_ATTR = lambda c, n: _STRIP(f"regexp_extract({c}, '{n}=\"([^\"]*)\"', 1)")
_HEAD = lambda tag: f"regexp_extract(x, '^<{tag}([^>]*)>', 1)"
_INSIDE = lambda tag: _FLAT(f"regexp_extract(x, '(?s)^<{tag}[^>]*>(.*)</{tag}>$', 1)")
_EVERY = lambda name, tag: f"regexp_extract_all({_BLOCK(name)}, '(?s)<{tag}[^>]*>.*?</{tag}>')"
_SLIDES = "'<slides>' || chr(10) || '<slide title=\" One \">' || title || '</slide><slide title=\"\">' || chr(10) || '</slide><slide>' || substr(summary, 1, 300) || '</slide></slides>'"
_SCRIPT = "'<script><scene sec=\"0-3\" on_screen=\"' || source || '\">' || substr(summary, 1, 300) || '</scene><scene sec=\"3-9\" on_screen=\"\"> </scene></script>'"
REPLIES = f"""re AS (SELECT id, CASE id % 5 WHEN 0 THEN '<caption>' || chr(10) || title || chr(10) || '</caption>' || {_SLIDES} || {_SCRIPT} || '<hashtags>#gold, plain #XAU</hashtags>' WHEN 1 THEN title || chr(10) || substr(summary, 1, 300) WHEN 2 THEN {_SLIDES} WHEN 3 THEN {_SCRIPT} END AS reply FROM st),
pp AS (SELECT id, reply, {_BLOCK('caption')} AS caption, list_filter(list_transform({_EVERY('slides', 'slide')}, lambda x: {{'title': {_ATTR(_HEAD('slide'), 'title')}, 'body': {_INSIDE('slide')}}}), lambda x: x.title <> '' OR x.body <> '') AS slides,
  list_filter(list_transform({_EVERY('script', 'scene')}, lambda x: {{'sec': {_ATTR(_HEAD('scene'), 'sec')}, 'on_screen': {_ATTR(_HEAD('scene'), 'on_screen')}, 'narration': {_INSIDE('scene')}}}), lambda x: x.on_screen <> '' OR x.narration <> '') AS scenes,
  list_filter(regexp_split_to_array({_BLOCK('hashtags')}, '[\\s,]+'), lambda h: starts_with(h, '#')) AS hashtags FROM re),
pa AS (SELECT * REPLACE (CASE WHEN caption = '' AND len(slides) = 0 AND len(scenes) = 0 THEN substr({_FLAT('reply')}, 1, 1200) ELSE caption END AS caption) FROM pp)"""
_SHOW = "array_to_string(list_transform(slides, lambda x: x.title || '=' || x.body), '|') AS slides, array_to_string(list_transform(scenes, lambda x: x.sec || '=' || x.on_screen || '=' || x.narration), '|') AS scenes, array_to_string(hashtags, ' ') AS hashtags"


def shown(draft):
    """A draft's parts as texts."""
    join = lambda name, *parts: F.array_join(F.transform(draft[name], lambda x: F.concat_ws("=", *[x[p] for p in parts])), "|").alias(name)
    return [draft["caption"].alias("caption"), join("slides", "title", "body"), join("scenes", "sec", "on_screen", "narration"), F.array_join(draft["hashtags"], " ").alias("hashtags")]


@query(f"WITH {TEMPLATES} SELECT id, caption, {_SHOW} FROM te")
def template_drafts(s, d):
    """Drafts of all stories by template."""
    return drafts.template(stories(s, d)).select("id", *shown(F.col("draft")))


@query(f"WITH {STORIES}, {REPLIES} SELECT id, caption, {_SHOW} FROM pa WHERE reply IS NOT NULL")
def parsed_replies(s, d):
    """What replies in tagged blocks say."""
    rows = replies(s, d).select("id", drafts.parsed(F.col("reply")).alias("p")).where("p is not null")
    return rows.select("id", *shown(F.col("p")))


@query(f"""WITH {TEMPLATES}, {REPLIES}, bo2 AS (SELECT te.id, coalesce(pa.caption <> '' OR len(pa.slides) > 0, FALSE) AS ok, te.caption AS c0, te.slides AS l0, te.scenes AS e0, te.hashtags AS h0, pa.caption AS c1, pa.slides AS l1, pa.scenes AS e1, pa.hashtags AS h1 FROM te JOIN pa USING (id)),
me AS (SELECT id, CASE WHEN ok AND c1 <> '' THEN c1 ELSE c0 END AS caption, CASE WHEN ok AND len(l1) > 0 THEN l1 ELSE l0 END AS slides, CASE WHEN ok AND len(e1) > 0 THEN e1 ELSE e0 END AS scenes, CASE WHEN ok AND len(h1) > 0 THEN h1 ELSE h0 END AS hashtags, CASE WHEN ok THEN 'reply' ELSE 'template' END AS method FROM bo2) SELECT id, method, caption, {_SHOW} FROM me""")
def merged_drafts(s, d):
    """Drafts with what their replies say instead."""
    rows = drafts.template(replies(s, d)).withColumn("p", drafts.parsed(F.col("reply")))
    return rows.select("id", drafts.merged(F.col("draft"), F.col("p")).alias("m")).select("id", "m.method", *shown(F.col("m")))


@query(f"""WITH {STORIES} SELECT id, '<news id="' || id || '" source="' || source || '" credibility="' || round_even(cred * 100, 0)::INT || '" assets="' || array_to_string(coalesce(assets, []), ',') || '">' || chr(10) || '  <title>' || {_STRIP("translate(title, '<>', '‹›')")} || '</title>' || chr(10) || '  <title_fa></title_fa>' || chr(10) || '  <summary_fa></summary_fa>' || chr(10) || '  <summary>' || {_STRIP("translate(summary, '<>', '‹›')")} || '</summary>' || chr(10) || '  <link>' || link || '</link>' || chr(10) || '</news>' AS request FROM st""")
def draft_requests(s, d):
    """Every story as the block that a writer gets."""
    return drafts.request(stories(s, d)).select("id", "request")
