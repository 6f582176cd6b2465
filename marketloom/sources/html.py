"""Article bodies from HTML pages, as one Arrow pass over the pages.

A page is parsed once into a small tree of elements with text.  Its body is
looked for in this order: JSON-LD ``articleBody`` or the app's own payload
(whichever is longer), known containers, the longest ``article``, the parent
with the most paragraph text, all paragraphs, the meta description.  A later
pass counts only where the earlier ones found fewer than three paragraphs, and
only if it has more text.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements whose text is no prose, words of lines that are none, keys and containers of bodies.
SKIPPED = frozenset({"script", "style", "nav", "footer", "header", "aside", "iframe", "noscript", "form", "button"})
JUNK = ("subscribe", "newsletter", "sign up", "sign in", "log in", "cookie", "advertisement", "advertise with us", "follow us", "share this", "read more:", "read more", "related articles", "terms of service", "privacy policy", "all rights reserved", "disclaimer", "download our app", "watch now", "click here", "join our", "topics:", "tags:", "منتشر شده در")
PAYLOAD = frozenset({"articlebody", "longdescription", "fulldescription", "articletext", "bodytext", "articlecontent", "htmlbody", "contenthtml"})
CONTAINERS = (".entry-content", ".post-content", ".article-content", ".article-body", ".story-body", ".post-body", ".content-body", ".rich-text", "#content", "article", "main")
SCRIPTY = ("function(", "=>", "window.", "undefined", ".css", ".js", "http://", "https://t")
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})


@dataclass
class Rule:
    """Least characters of a paragraph, paragraphs kept (None: all), characters that make two paragraphs equal (None: all), words below which a text is partial."""

    least: int = 60
    most: int | None = 150
    same: int | None = 120
    partial: int = 120


@dataclass
class Node:
    tag: str
    attrs: dict
    parent: Node | None = None
    parts: list = field(default_factory=list)  # texts and nodes in order

    def walk(self):
        """This node and all below it, in document order, without recursion."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [p for p in reversed(node.parts) if isinstance(p, Node)]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack += reversed(x.parts)
        return " ".join(" ".join(out).split())

    def matches(self, selector: str) -> bool:
        if selector[0] == ".":
            return selector[1:] in (self.attrs.get("class") or "").split()
        return self.attrs.get("id") == selector[1:] if selector[0] == "#" else self.tag == selector


class _Tree(HTMLParser):
    """Builds the tree without skipped elements; keeps scripts, meta values and the title beside it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {})
        self.scripts, self.metas, self.title = [], {}, []
        self.hidden, self.script, self.in_title = 0, None, False

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in attrs}
        if tag == "script":
            self.script = [attrs, []]
        elif tag == "meta":
            self.metas.setdefault((attrs.get("property") or attrs.get("name") or "").lower(), attrs.get("content", ""))
        elif tag == "title":
            self.in_title = True
        if tag in SKIPPED:
            self.hidden += 1
        elif tag not in VOID and not self.hidden:
            if tag == "p" and self.at.tag == "p":
                self.at = self.at.parent
            node = Node(tag, attrs, self.at)
            self.at.parts.append(node)
            self.at = node

    def handle_endtag(self, tag):
        if tag == "script" and self.script:
            self.scripts.append((self.script[0], "".join(self.script[1])))
            self.script = None
        self.in_title = self.in_title and tag != "title"
        if tag in SKIPPED:
            self.hidden = max(0, self.hidden - 1)
        elif not self.hidden:
            node = self.at
            while node.parent is not None and node.tag != tag:
                node = node.parent
            if node.parent is not None:  # a stray end tag closes nothing
                self.at = node.parent

    def handle_data(self, data):
        if self.script:
            self.script[1].append(data)
        elif self.in_title:
            self.title.append(data)
        elif not self.hidden:
            self.at.parts.append(data)


def _strings(value):
    """(key, text) of all strings of a JSON document, in order."""
    stack = [("", value)]
    while stack:
        key, v = stack.pop()
        if isinstance(v, str):
            yield key.lower(), v
        elif isinstance(v, dict):
            stack += [(str(k), x) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            stack += [(key, x) for x in reversed(v)]


def _json(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def _linked_data(scripts) -> str:
    """The first articleBody of more than 300 characters."""
    for attrs, text in scripts:
        if attrs.get("type") == "application/ld+json":
            for key, value in _strings(_json(text) or {}):
                if key == "articlebody" and len(value) > 300:
                    return value
    return ""


def _payload(scripts, rule: Rule) -> list[str]:
    """Paragraphs of the page's own data: the keys of bodies, else a field that repeats as prose, else the first prose."""
    found = []
    for attrs, text in scripts:
        data = _json(text) if "json" in " ".join(attrs.values()).lower() or text.lstrip()[:1] in ("{", "[") else None
        if data is not None:
            found += _strings(data)
        elif any(k in text for k in ("self.__next_f", "__INITIAL_STATE__", "__NUXT__")):
            found += [("", s) for raw in re.findall(r'"((?:[^"\\]|\\.){160,})"', text) if isinstance(s := _json(f'"{raw}"'), str)]
    named: dict[str, str] = {}
    for key, value in found:
        if key in PAYLOAD and len(value.strip()) >= rule.least:
            named.setdefault(key, value)
    blocks = _lines(named.values(), rule)
    if sum(len(b.split()) for b in blocks) >= 100:
        return blocks
    prose = [(k, v) for k, v in found if _prose(v)]
    if not prose:
        return blocks
    keys = [k for k, _ in prose]
    often = max(keys, key=keys.count)
    return _lines([v for k, v in prose if k == often] if keys.count(often) >= 3 else [prose[0][1]], rule) or blocks


def _prose(s: str) -> bool:
    s = s.strip()
    if len(s) < 200 or len(s.split()) < 30 or any(j in s[:400].lower() for j in SCRIPTY):
        return False
    good = sum(c.isalpha() or c.isspace() or c in ".,;:!?-'\"()[]$/&%0123456789" for c in s)
    return sum(s.count(e) for e in (". ", "? ", "! ")) >= 2 and good / len(s) >= 0.8


def _lines(texts, rule: Rule) -> list[str]:
    """Lines that read as paragraphs, links reduced to their words, each once."""
    out: dict[str, str] = {}
    for text in texts:
        for line in text.splitlines():
            line = " ".join(re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", line).split())
            if len(line) >= rule.least and not (line.startswith("http") and " " not in line[:80]) and sum(c.isalpha() or c.isspace() or c in ".,;:!?-'\"()[]/&%" for c in line) / len(line) >= 0.75:
                out.setdefault(line[: rule.same], line)
    return list(out.values())


def _paragraphs(node: Node, rule: Rule) -> list[str]:
    """Paragraphs and middle headings of some length, without short lines of junk."""
    texts = [n.text() for n in node.walk() if n.tag in ("p", "h2", "h3")]
    return [t for t in texts if len(t) >= rule.least and not (len(t) < 220 and any(j in t.lower() for j in JUNK))]


def body(html: str | None, rule: Rule = Rule()) -> dict:
    """Title, site, paragraphs, word count, and whether the text is only partial."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    size = lambda texts: sum(map(len, texts))
    best = [p.strip() for p in _linked_data(tree.scripts).split("\n") if len(p.strip()) > rule.least]
    passes = [lambda: _payload(tree.scripts, rule)]
    if size(found := passes[0]()) > size(best):
        best = found
    nodes = list(tree.root.walk())
    for selector in CONTAINERS:
        if len(best) >= 3:
            break
        first = next((n for n in nodes if n.matches(selector)), None)
        if first is not None and size(found := _paragraphs(first, rule)) > size(best):
            best = found
    if len(best) < 3:
        best = max([_paragraphs(n, rule) for n in nodes if n.tag == "article"] + [best], key=size)
    if len(best) < 3:
        parents: dict[int, list[str]] = {}
        for n in nodes:
            if n.tag == "p" and n.parent.tag not in ("", "body", "html") and len(t := n.text()) >= rule.least:
                parents.setdefault(id(n.parent), []).append(t)
        best = max([best, *parents.values()], key=size)
    if len(best) < 2:
        best = max([best, _paragraphs(tree.root, rule)], key=size)
    if not best:
        best = [v for v in (tree.metas.get(k, "").strip() for k in ("og:description", "description")) if v][:1]
    seen: dict[str, str] = {}
    for text in best:
        seen.setdefault(text[: rule.same], text)
    kept = list(seen.values())[: rule.most]
    count = sum(len(t.split()) for t in kept)
    return {"title": tree.metas.get("og:title") or " ".join("".join(tree.title).split()), "site": tree.metas.get("og:site_name", ""), "published": tree.metas.get("article:published_time", ""), "paragraphs": kept, "word_count": count, "partial": count < rule.partial}


def extract(pages: DataFrame, key: str = "page_id", html: str = "html", rule: Rule = Rule()) -> DataFrame:
    """(key, title, site, published, paragraphs, word_count, partial) of every page."""
    names = ["title", "site", "published", "paragraphs", "word_count", "partial"]

    def run(batches):
        kind = pa.struct([("title", pa.string()), ("site", pa.string()), ("published", pa.string()), ("paragraphs", pa.list_(pa.string())), ("word_count", pa.int32()), ("partial", pa.bool_())])
        for batch in batches:
            rows = pa.array([body(x, rule) for x in batch.column(1).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), *rows.flatten()], [key, *names])

    return pages.select(key, html).mapInArrow(run, f"{key} {dict(pages.dtypes)[key]}, title string, site string, published string, paragraphs array<string>, word_count int, partial boolean")
