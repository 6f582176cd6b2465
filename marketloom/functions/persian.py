"""Deterministic editing of one Persian text: letters, known terms, digits, joiners, spaces.

``Terms`` holds a lexicon, or what is known of it, by key.  ``edited`` repeats its rules
until nothing changes, so editing twice gives what editing once gives.  Spans
of addresses, mail and domains are never touched; runs of Latin words that look
like the name of a product stay, unless a known entity stands in them.
"""

from __future__ import annotations

import re
import unicodedata
import zlib

ZWNJ = "‌"

#: Persian letters, Arabic forms of them, digits, and words that take a comparative ending without a joiner.
LETTERS = r"ء-غف-يپچژکگی"
FORMS = str.maketrans({"ي": "ی", "ى": "ی", "ك": "ک", "ـ": ""})
DIGITS = str.maketrans("0123456789", "۰۱۲۳۴۵۶۷۸۹")
JOINED = ("بیش", "کم", "به")

#: Spans that stay as they are, and words of product names.
PROTECTED = re.compile(r"https?://\S+|www\.\S+|[\w.+-]+@[\w-]+\.[\w.-]+|\b[\w-]+\.(?:com|net|org|io|ir|co|gov|edu|app|xyz|crypto|me|tv|us|uk|de|ru|cn|jp|in|br|tr)\b")
PRODUCT = re.compile(r"\b(?:ETF|ETN|Fund|Trust|Notes)\b", re.IGNORECASE)

#: Terms that an English source decides: its pattern, a second one, and pairs of Persian variants and the term.
SOURCE_TERMS = (
    (r"", r"", ((r"(بیت|دوج|لایت|استیبل|آلت|میم|بایننس|فایل|شیت|پپه) +کوین", rf"\1{ZWNJ}کوین"),)),
    (
        r"\b(?:crypto[\s-]?currenc(?:y|ies)|crypto|digital\s+assets?)\b",
        r"",
        (
            (rf"(?:رمزارز|رمز ارز|ارزهای رمزنگاری[{ZWNJ} ]?شده)هایی|ارزهای رمزنگاری[{ZWNJ} ]?شده{ZWNJ}ای", "ارزهای دیجیتالی"),
            (rf"(?:رمزارز|رمز ارز|ارزهای رمزنگاری[{ZWNJ} ]?شده)(?:ها|های)|ارزهای رمزنگاری[{ZWNJ} ]?شده", "ارزهای دیجیتال"),
            (rf"ارز رمزنگاری[{ZWNJ} ]?شده{ZWNJ}ای|(?:رمزارز|رمز ارز)ی", "ارز دیجیتالی"),
            (rf"رمزارز|رمز ارز|ارز رمزنگاری[{ZWNJ} ]?شده", "ارز دیجیتال"),
        ),
    ),
    (r"\bbull\s+markets?\b", r"", (("بازارهای گاوی", "بازارهای صعودی"), ("بازار گاوی", "بازار صعودی"))),
    (r"\bbear\s+markets?\b", r"", (("بازارهای خرسی", "بازارهای نزولی"), ("بازار خرسی", "بازار نزولی"))),
    (
        r"\bsupport\b",
        r"\b(?:resistance|level|levels|break|breakout|breaks|chart|charts|price|prices|trend|bounce|zone|zones|floor|ceiling|technical|ta|moving average|rsi|indicator)\b",
        ((f"پشتیبانی{ZWNJ}های", f"حمایت{ZWNJ}های"), (f"پشتیبانی{ZWNJ}ها", f"حمایت{ZWNJ}ها"), ("پشتیبانی", "حمایت")),
    ),
    (r"\bstaking\b", r"", ((f"سهامداری{ZWNJ}های", f"استیکینگ{ZWNJ}های"), (f"سهامداری{ZWNJ}ها", f"استیکینگ{ZWNJ}ها"), ("سهامداری", "استیکینگ"))),
    (r"\boversold\b", r"", (("فروش بیش از حد", "اشباع فروش"),)),
    (r"\byields?\b", r"\b(?:treasury|bond|bonds|note|notes|10-year|2-year|rate|rates|curve|basis points|bps|dividend|dividends)\b", (("بازدهی", "بازده"),)),
)
SOURCE_RULES = [(re.compile(a, re.I), re.compile(b, re.I), [(re.compile(rf"(?<![{LETTERS}{ZWNJ}])(?:{v})" + ("" if v.startswith("(بیت") else rf"(?![{LETTERS}{ZWNJ}])")), t) for v, t in pairs]) for a, b, pairs in SOURCE_TERMS]

LATIN_SPAN = re.compile(r"[A-Za-z0-9][A-Za-z0-9.'\"&/-]*(?:\s+[A-Za-z0-9][A-Za-z0-9.'\"&/-]*)*")
BLANKS, SIGNS = re.compile(r"(\s+)"), ".'\"&/-"
PERSIAN_WORD = re.compile(rf"[{LETTERS}]+(?:{ZWNJ}+[{LETTERS}]+)*")

#: Joiners before endings and after the verb's prefix, then spaces; (what texts need to fit, pattern, replacement).
TYPOGRAPHY = [
    (ZWNJ, re.compile(rf" *{ZWNJ}+(?: *{ZWNJ}*)*"), ZWNJ),
    ("می ", re.compile(rf"(?<![{LETTERS}\w])(ن?می) (?=[{LETTERS}])"), rf"\1{ZWNJ}"),
    (" ها", re.compile(rf"(?<=[{LETTERS}]) (?=ها(?:ی(?:نمان|شان|ش|ی)?)?(?![{LETTERS}]))"), ZWNJ),
    (" تر", re.compile(rf"(?<![{LETTERS}])({'|'.join(JOINED)}) (?=تر(?:ین)?(?![{LETTERS}]))"), r"\1"),
    (" تر", re.compile(rf"(?<=[{LETTERS}]) (?=تر(?:ین)?(?![{LETTERS}]))"), ZWNJ),
    (" ", re.compile(r" +([،؟؛,.!?:])(?![A-Za-z0-9])"), r"\1"),
    ("  ", re.compile(r" {2,}"), " "),
]

#: Words of a term at most; names of entities inside product names may be longer.
WIDEST, WIDEST_ENTITY = 3, 6
ROUNDS = 6


def separated(term: str) -> str:
    """A Persian term with joiners for spaces: variants of its typography share it, variants of its words don't."""
    return re.sub(rf"[ {ZWNJ}]+", ZWNJ, term.strip(f" {ZWNJ}"))


class Table(dict):
    """Terms of one kind by key; a key without one has None."""

    def __missing__(self, key: str) -> None:
        return None


class Asking(Table):
    """Some of a lexicon's terms of one kind; keys that the lexicon may hold besides are noted in ``asked``.

    ``bits`` has the bit of every key's CRC-32, so a key whose bit is not set
    is no term.  Keys known to be none have the value None.
    """

    def __init__(self, kind: str, bits: bytes) -> None:
        super().__init__()
        self.bits, self.mask, self.start = bits, len(bits) * 8 - 1, zlib.crc32(kind.encode())
        self.asked: set[str] = set()
        self.touched = False

    def __missing__(self, key: str) -> None:
        if key not in self.asked:
            at = zlib.crc32(key.encode("utf-8", "surrogatepass"), self.start) & self.mask
            if not self.bits[at >> 3] >> (at & 7) & 1:
                self[key] = None
                return
            self.asked.add(key)
        self.touched = True


class Terms:
    """Latin and Persian terms by key: (kind, key, value, entity) with kind latin or persian; keys in lower case or ``separated``.

    With ``bits`` these are some terms of a lexicon only, see ``Asking``;
    ``widest`` are the numbers of words of the lexicon's longest Latin and Persian keys.
    """

    def __init__(self, rows, bits: bytes | None = None, widest: tuple[int, int] = (0, 0)):
        self.latin: Table = Asking("latin", bits) if bits else Table()
        self.persian: Table = Asking("persian", bits) if bits else Table()
        self.widest, self.widest_persian = widest
        for kind, key, value, entity in rows:
            if value is None:
                (self.latin if kind == "latin" else self.persian)[key] = None
            elif kind == "latin":
                self.latin[key] = (value, bool(entity))
                self.widest = max(self.widest, key.count(" ") + 1)
            else:
                self.persian[key] = {None: (value, bool(entity))}
                self.widest_persian = max(self.widest_persian, key.count(ZWNJ) + 1)

    def find(self, words: list[str], most: int, entity: bool = False) -> tuple[int, str] | None:
        """(how many words, term) of the longest Latin term at the front of some words."""
        best = None
        for k in range(1, min(most, len(words), self.widest) + 1):
            found = self.latin[" ".join(words[:k]) if k > 1 else words[0]]
            if found is not None and (found[1] or not entity):
                best = (k, found[0])
        return best

    def is_entity(self, span: str) -> bool:
        words = re.sub(r"\s+", " ", span).strip().lower()
        found = self.latin[words] if words.count(" ") < self.widest else None
        return found is not None and found[1]

    def unanswered(self) -> bool:
        """Whether keys were asked for, since this was last called, of which nothing is known."""
        out = self.latin.touched or self.persian.touched
        self.latin.touched = self.persian.touched = False
        return out


def _ticker(word: str) -> bool:
    return word.isupper() and 2 <= len(word) <= 5


def _is_product(span: str) -> bool:
    """Three words or more, all with capitals, or a word of products' names."""
    if span[0].isupper():
        named = re.findall(r"[A-Za-z0-9]+", span)
        if len(named) >= 3 and all(w[0].isupper() for w in named):
            return True
    return PRODUCT.search(span) is not None


def _replace_span(span: str, terms: Terms) -> str:
    # a token of a span begins with a letter or digit; signs that follow end its run, as other blanks than one space do
    product = _is_product(span) and not terms.is_entity(span)
    most = min(WIDEST_ENTITY if product else WIDEST, terms.widest)
    latin, parts = terms.latin, BLANKS.split(span)
    i, n, changed = 0, len(parts), False
    while i < n:
        first = parts[i] if parts[i].isalpha() else parts[i].rstrip(SIGNS)
        if not first.isalpha() or _ticker(first):
            i += 2
            continue
        word, key, k, found = first, first.lower(), i, None
        while True:
            node = latin[key]
            if node is not None and (node[1] or not product):
                found = (k, node[0], len(key), len(word))
            if (k - i) // 2 + 1 >= most or k + 2 >= n or len(word) != len(parts[k]) or parts[k + 1] != " ":
                break
            word = parts[k + 2] if parts[k + 2].isalpha() else parts[k + 2].rstrip(SIGNS)
            if not word.isalpha() or _ticker(word):
                break
            k, key = k + 2, f"{key} {word.lower()}"
        if found and (product and found[0] == i and span.strip() != first or found[2] < 3):
            found = None
        if found:
            last, changed = found[0], True
            parts[i : last + 1] = [found[1] + parts[last][found[3] :], *[""] * (last - i)]
            i = last
        i += 2
    return "".join(parts) if changed else span


def replace_latin(part: str, terms: Terms) -> str:
    """Latin words with one known rendering, longest first; tickers and unknown words stay."""
    return LATIN_SPAN.sub(lambda m: _replace_span(m.group(), terms), part)


def replace_persian(part: str, terms: Terms) -> str:
    """Spellings of a known term that differ by spaces and joiners only become one; of one to three words in a row the widest window counts."""
    found = [m.span() for m in PERSIAN_WORD.finditer(part)]
    if not found:
        return part
    keys = [part[a:b] for a, b in found]
    if ZWNJ in part:
        keys = [separated(w) if ZWNJ in w else w for w in keys]
    known, most = terms.persian, min(WIDEST, terms.widest_persian)
    out, done, i, n = [], 0, 0, len(found)
    while i < n:
        last = i
        while last + 1 < n and last + 1 - i < most and not part[found[last][1] : found[last + 1][0]].strip(" "):
            last += 1
        start = found[i][0]
        for k in range(last, i - 1, -1):
            node = known[ZWNJ.join(keys[i : k + 1]) if k > i else keys[i]]
            if node and node[None][0] != part[start : found[k][1]]:
                out += [part[done:start], node[None][0]]
                done, i = found[k][1], k
                break
        i += 1
    return "".join([*out, part[done:]])


def source_terms(part: str, source: str | None) -> str:
    """Terms that the English source decides; texts without a source keep theirs."""
    if source:
        for pattern, context, pairs in SOURCE_RULES:
            if pattern.search(source) and context.search(source):
                for variant, term in pairs:
                    part = variant.sub(term, part)
    return part


def outside(text: str, change) -> str:
    """Changes everything outside protected spans."""
    out, last = [], 0
    for m in PROTECTED.finditer(text):
        out += [change(text[last : m.start()]), m.group()]
        last = m.end()
    return "".join([*out, change(text[last:])])


def _mapped(text: str, table: dict[int, str | int]) -> str:
    """What ``translate`` gives, faster for few characters."""
    for code, by in table.items():
        text = text.replace(chr(code), by if isinstance(by, str) else chr(by))
    return text


def _once(text: str, terms: Terms, source: str | None) -> str:
    text = unicodedata.normalize("NFC", text)
    text = outside(text, lambda p: _mapped(source_terms(replace_persian(replace_latin(_mapped(p, FORMS), terms), terms), source), DIGITS))
    for mark, pattern, by in TYPOGRAPHY:
        if mark in text:
            text = pattern.sub(by, text)
    return text.strip(f" \t\r\n{ZWNJ}")


def edited(text: str | None, terms: Terms, source: str | None = None) -> str | None:
    """The edited text; null stays null."""
    for _ in range(ROUNDS):
        before, text = text, _once(text, terms, source) if text else text
        if text == before:
            break
    return text


def edited_on(text: str | None, terms: Terms, source: str | None, done: int) -> tuple[str | None, int, bool]:
    """(text, rounds, whether it is edited) of a text after ``done`` rounds: goes on up to the round for which a term may be missing."""
    terms.unanswered()
    while done < ROUNDS:
        now = _once(text, terms, source) if text else text
        if terms.unanswered():
            return text, done, False
        if now == text:
            break
        text, done = now, done + 1
    return text, done, True
