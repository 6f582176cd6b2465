"""The Persian post-editor: own examples, a plain loop, joined and broadcast lexicons, and idempotence."""

import random

import pytest
from pyspark.sql import functions as F

from marketloom.functions import persian
from marketloom.functions.persian import ZWNJ
from marketloom.operators import postedit
from marketloom.plans import translation

TERMS = [
    ("Ethereum", "اتریوم", 0.9, True),
    ("central bank", "بانک مرکزی", 0.9, False),
    ("bank", "بانک", 0.9, False),
    ("coin", "کوین", 0.9, False),
    ("coin", "سکه", 0.9, False),
    ("bitcoin", f"بیت{ZWNJ}کوین", 0.9, True),
    ("bit coin", "بیت کوین", 0.95, False),
    ("Acme Gold", "اکمی طلا", 0.9, True),
    ("weak", "ضعیف", 0.1, False),
]


@pytest.fixture(scope="module")
def terms(spark):
    return postedit.lexicon(spark.createDataFrame(TERMS, "en string, fa string, confidence double, entity boolean"))


@pytest.fixture(scope="module")
def tries(terms):
    return persian.Terms([tuple(r) for r in terms.collect()])


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("كتاب يك", "کتاب یک"),
        ("بـانـک", "بانک"),
        ("ما می خوانیم", f"ما می{ZWNJ}خوانیم"),
        ("خانه هایشان", f"خانه{ZWNJ}هایشان"),
        ("گفت هاشم", "گفت هاشم"),
        ("بلند ترین", f"بلند{ZWNJ}ترین"),
        ("بیش تر", "بیشتر"),
        ("سال 1404 https://x.example/2024?a=5 ", "سال ۱۴۰۴ https://x.example/2024?a=5"),
        ("نشانی me5@mail.example و 3", "نشانی me5@mail.example و ۳"),
        ("رشد Ethereum امروز", "رشد اتریوم امروز"),
        ("ETH و BANK", "ETH و BANK"),
        ("the Central Bank said", "the بانک مرکزی said"),
        ("یک coin دیگر", "یک coin دیگر"),
        ("بیت کوین", f"بیت{ZWNJ}کوین"),
        ("بیتکوین", "بیتکوین"),
        ("Acme Gold Trust", "اکمی طلا Trust"),
        ("Bitcoin Growth Fund", "Bitcoin Growth Fund"),
        ("weak", "weak"),
        ("سلام ، دنیا  .", "سلام، دنیا."),
        ("", ""),
        (None, None),
    ],
)
def test_examples(tries, given, want):
    assert persian.edited(given, tries) == want
    assert persian.edited(want, tries) == want


def test_terms_of_the_source(tries):
    assert persian.edited("بازار گاوی رمزارزها", tries, "the bull market of crypto") == "بازار صعودی ارزهای دیجیتال"
    assert persian.edited("بازار گاوی رمزارزها", tries) == "بازار گاوی رمزارزها"
    assert persian.edited("پشتیبانی شکست", tries, "support level broke") == "حمایت شکست"
    assert persian.edited("پشتیبانی خوب", tries, "good customer support") == "پشتیبانی خوب"
    assert persian.edited("دوج کوین", tries, "Dogecoin") == f"دوج{ZWNJ}کوین"


def some_texts(n=300, seed=2):
    draw = random.Random(seed)
    bits = ["Ethereum", "bit", "coin", "bitcoin", "central", "bank", "ETF", "Gold", "Acme", "Trust", "بیت", "کوین", "می", "رود", "کتاب", "ها", "تر", "کم", "12", "x.com", "،", ".", "  ", ZWNJ, "ي", "BTC", "1win", "a-b", "\n"]
    return ["".join(draw.choice(bits) + draw.choice(["", " ", " "]) for _ in range(draw.randint(0, 14))) for _ in range(n)]


def plain_persian(part, terms):
    """Windows of three, two and one word, tried one after the other."""
    known = {k: v[None][0] for k, v in terms.persian.items()}
    words = [(m.start(), m.end()) for m in persian.PERSIAN_WORD.finditer(part)]
    out, done, i = "", 0, 0
    while i < len(words):
        for k in (3, 2, 1):
            inside = words[i : i + k]
            if len(inside) < k or any(part[a[1] : b[0]].strip(" ") for a, b in zip(inside, inside[1:], strict=False)):
                continue
            shown = part[inside[0][0] : inside[-1][1]]
            value = known.get(persian.separated(shown))
            if value is not None and value != shown:
                out, done, i = out + part[done : inside[0][0]] + value, inside[-1][1], i + k
                break
        else:
            i += 1
    return out + part[done:]


def test_windows_and_idempotence(tries):
    for t in some_texts(2000):
        assert persian.replace_persian(t, tries) == plain_persian(t, tries)
        once = persian.edited(t, tries)
        assert persian.edited(once, tries) == once, repr(t)


def test_joined_lexicon_is_the_broadcast_one(spark, terms):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate([*some_texts(120, 7), None, ""])], "id long, text string").withColumn("key", F.lit(1))
    one = {r.id: r.edited for r in postedit.edit(rows, terms).collect()}
    two = {r.id: r.edited for r in postedit.edit(rows, terms, most=1).collect()}
    assert one == two and one[120] is None and one[121] == ""
    assert postedit.edit(rows.where("false"), terms).count() == 0


def test_query_on_documents(spark, data):
    got = translation.post_edited(spark, data).collect()
    terms = translation.conversation_terms(spark, data)
    tries = persian.Terms([tuple(r) for r in postedit.lexicon(terms).collect()])
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert len(got) == len(texts) and any(r.changed for r in got)
    import hashlib

    for r in got:
        want = persian.edited(texts[r.doc_id], tries)
        assert r.edited_md5 == (hashlib.md5(want.encode()).hexdigest() if want is not None else None)


@pytest.mark.parametrize("most", [1, 1 << 19])
def test_any_number_of_lookups_gives_what_the_whole_lexicon_gives(spark, most):
    """the join looked keys up twice, so a large lexicon's terms that met after two renderings were not known."""
    rows = [("latin", "gold", "طلا", False), *[("persian", f"{a}{ZWNJ}{b}", c, False) for a, b, c in (("طلا", "ب", "پ"), ("پ", "ت", "ث"), ("ث", "ج", "چ"), ("چ", "ح", "خ"))]]
    known = spark.createDataFrame(rows, "kind string, key string, value string, entity boolean")
    texts = spark.createDataFrame([(1, "gold ب ت ج ح"), (2, "a1gold gold ب"), (3, None), (4, ""), (5, "none")], "id long, text string")
    tries = persian.Terms(rows)
    got = {r.id: r.edited for r in postedit.edit(texts, known, most=most).collect()}
    assert got == {r.id: persian.edited(r.text, tries) for r in texts.collect()} and got[1] == "خ"
