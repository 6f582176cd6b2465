"""Lexicon builds: a packed dump against a plain parser, entities, names."""

import bz2
import re
import xml.etree.ElementTree as ET
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marketloom.sources import lexicons

PAGES = [
    ("0", "یک", "قیمت {{جعبه|a={{ب|c={{پ}}}}}} طلا &lt;ref name=x&gt;منبع&lt;/ref&gt; و [[نفت|نفت خام]] و [[دلار]] است"),
    ("0", "دو", "&lt;!-- پنهان\nپنهان --&gt; كتاب يك {| جدول | خانه |} [[پرونده:عکس.jpg|بند]] https://x.example/طلا می‌رود\nطلا"),
    ("1", "سه", "طلا طلا طلا"),
    ("0", "چهار", "  #redirect [[یک]] طلا"),
    ("0", "پنج", ""),
    ("0", "شش", "latin only, x و ‌ی‌ و &lt;b&gt;نقره&lt;/b&gt;"),
]


def plain_count(path):
    counts = Counter()
    with bz2.open(path) as f:
        for _, e in ET.iterparse(f):
            if e.tag != "page":
                continue
            text = e.findtext("revision/text") or ""
            if e.findtext("ns") != "0" or not text or text.lstrip().upper().startswith("#REDIRECT"):
                continue
            text = re.sub(r"<!--.*?-->", " ", text, flags=re.S)
            text = re.sub(r"<ref[^>]*/>|<ref[^>]*>.*?</ref>", " ", text, flags=re.S)
            text = re.sub(r"\{\|.*?\|\}", " ", text, flags=re.S)
            while "{{" in text and (new := re.sub(r"\{\{[^{}]*\}\}", " ", text)) != text:
                text = new
            text = re.sub(r"\[\[(?:فایل|پرونده|image|file|رده|category):[^\]]*\]\]", " ", text, flags=re.I)
            text = re.sub(r"\[\[([^\]|]+)\|([^\]]+)\]\]", r"\2", text)
            text = re.sub(r"\[\[([^\]]+)\]\]", r"\1", text)
            text = re.sub(r"</?[a-zA-Z][^>]*>", " ", re.sub(r"https?://\S+|www\.\S+", " ", text))
            text = text.replace("ي", "ی").replace("ى", "ی").replace("ك", "ک").replace("ـ", "")
            for w in re.findall("[ء-غف-يپچژکگی‌]+", text):
                w = w.strip("‌")
                if len(w) >= 2:
                    counts[w] += 1
    return counts


@pytest.mark.parametrize("times", [1, 400])
def test_dump(spark, tmp_path, times):
    page = "<page>\n  <title>{1}</title>\n  <ns>{0}</ns>\n  <revision>\n    <id>3</id>\n    <text xml:space=\"preserve\">{2}</text>\n  </revision>\n</page>\n"
    path = str(tmp_path / "dump.xml.bz2")
    with bz2.open(path, "wt") as f:
        f.write("<mediawiki>\n<siteinfo><x>1</x></siteinfo>\n" + "".join(page.format(*p) for p in PAGES) * times + "</mediawiki>\n")
    feeds = spark.createDataFrame([("تازه",), (None,), ("طلا",)], "text string")
    got = {r.word: (r.wiki_count, r.feed_count, r.total) for r in lexicons.word_frequencies(lexicons.wiki_pages(spark, path), feeds).collect()}
    wiki = plain_count(path)
    feed = Counter(["تازه", "طلا"])
    want = {w: (wiki[w], feed[w], wiki[w] + feed[w]) for w in wiki | feed if wiki[w] + feed[w] >= 2 or feed[w]}
    assert got == want and "خانه" not in got and "پنهان" not in got


def test_entities(spark):
    rows = [(1, "Q1", "bank", "The  Bank", "بانک", "Bank", "(بنک)", "a"), (2, "Q1", "org", "Other", "دیگر", "Bank", None, "b"), (3, "Q2", "x", "", "بی", None, None, "c"), (4, "Q1", "bank", "The Bank", "بانک", "The Bank", "بانک", "a"), (5, None, "x", "a", "b", None, None, "c"), (6, "Q1", "bank", "The Bank", "بانک", "Bnk", "", "a")]
    got = lexicons.entities(spark.createDataFrame(rows, "place long, qid string, kind string, en string, fa string, en_alt string, fa_alt string, source string")).collect()
    assert [tuple(r) for r in got] == [("Q1", "bank", "The Bank", "بانک", ["Bank", "Bnk"], ["بنک"], "a")]


def test_names(spark):
    rows = [("Apple Inc.", "Apple", True), ("The World Bank", "World Bank Group", True), ("Jerome Powell", "Jerome H. Powell", True), ("Gold", "Silver", False), ("Gold", None, False), ("Inc.", "Inc.", False), ("U.S. Steel", "Nippon Steel", True)]
    frame = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert all(r.got == r.want for r in frame.withColumn("got", lexicons.names_match(F.col("a"), F.col("b"))).collect())


def test_pages_of_other_namespaces_are_not_parsed(spark, tmp_path):
    """every page was parsed, then most were dropped by their namespace."""
    heads = {"<ns>1</ns>": True, "<ns> 14\n</ns>": True, "<ns>-2</ns>": True, "<ns>0</ns>": False, "<ns> 0 </ns>": False, "<ns>00</ns>": False, "": False, "<ns/>": False, "<ns><!-- 1 -->0</ns>": False, "<ns><![CDATA[0]]></ns>": False, "<!-- <ns>1</ns> --><ns>0</ns>": False, "<x><ns>1</ns></x><ns>0</ns>": False, "<ns a='b'>0</ns>": False}
    page = lambda h: f"<page><title>t</title>{h}<revision><text>&lt;ns&gt;1&lt;/ns&gt; <![CDATA[<ns>1</ns>]]></text></revision></page>"
    rows = spark.createDataFrame([(h, page(h)) for h in heads], "head string, page string")
    assert {r["head"]: r.e for r in rows.select("head", lexicons.elsewhere(F.col("page")).alias("e")).collect()} == heads
    ns = rows.select("head", F.trim(F.from_xml("page", lexicons.PAGE, {"rowTag": "page"})["ns"]).alias("ns")).collect()
    assert all(r.ns != "0" for r in ns if heads[r["head"]]) and sum(r.ns == "0" for r in ns) >= 4
    (tmp_path / "d.xml").write_text("<mediawiki>" + "\n".join(map(page, heads)) + "</mediawiki>")
    assert lexicons.wiki_pages(spark, str(tmp_path / "d.xml")).count() == sum(r.ns == "0" for r in ns)
    plan = lexicons.wiki_pages(spark, str(tmp_path / "d.xml"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("from_xml(") == 1  # 4 before: conditions parsed it too
