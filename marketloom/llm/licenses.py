"""License scans: exact phrases, and short notices within a bounded number of edits.

Texts are normalised to words (digits, a-z with A-Z lower-cased, non-ASCII)
joined by one space.  A phrase counts at every place where its words stand
consecutively.  A notice is searched within ``edits`` insertions, deletions
and substitutions: cut into edits + 1 pieces, at least one piece is unharmed
in any such match (pigeonhole), so exact hits of the pieces locate every
candidate.  Of twice as many pieces at least edits + 2 must be unharmed, which
rules most candidates out; the regex library then matches the whole notice
with that error bound in the candidate's surroundings and reports the span and
its edits.  The words that tell licences apart (names, versions) must stand
exactly; the errors are allowed in the wording around them.  Of overlapping
matches the one with the fewest edits counts, and the stretches before and
after it are searched again.

Defined cases: null and empty texts have no words, no labels, score 0; equal
texts get equal results; empty tables give empty results; other columns pass
through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.words import Words, buffers, letter_words, slices, windows, words

#: The exact phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Short notices searched with errors: label, normalised wording, edits allowed.
NOTICES = (
    ("mit", "released under the mit license", 3),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 8),
    ("apache-2", "licensed under the apache license version 2 0", 4),
    ("cc-by-nc", "licensed under cc by nc 4 0", 2),
    ("gpl-3", "licensed under the gnu general public license version 3", 5),
    ("bsd", "redistribution and use in source and binary forms with or without modification", 8),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", 5),
)

#: Words of a notice that no error may touch: the names and versions that tell licences apart.
DISTINCT = frozenset(("mit", "apache", "nc", "gnu", "mozilla", "2", "3"))

KEEP = letter_words()
RESULT = pa.struct([("n_words", pa.int64()), ("places", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))), ("notices", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int64()), ("length", pa.int64())])))])
RESULT_SQL = "struct<n_words:bigint,places:array<struct<label:string,word:bigint>>,notices:array<struct<label:string,first_word:bigint,last_word:bigint,edits:bigint,length:bigint>>>"


def pieces(notice: str, edits: int) -> list[tuple[int, bytes]]:
    """The notice in edits + 1 pieces of nearly equal length, each with its place."""
    cuts = [round(k * len(notice) / (edits + 1)) for k in range(edits + 2)]
    return [(a, notice[a:b].encode()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def pattern_of(notice: str, edits: int) -> regex.Pattern:
    """The notice with at most ``edits`` errors in each stretch between words of DISTINCT, which match as whole words; callers bound the sum."""
    out, loose = [], ""
    for word in regex.split("( )", notice):
        if word in DISTINCT:
            before = "(?<![0-9])(?<![0-9] )" if word.isdigit() else "(?<![0-9a-z])"
            out += [f"(?:{regex.escape(loose)}){{e<={edits}}}"] * bool(loose) + [before + word + ("(?![0-9])" if word.isdigit() else "(?![0-9a-z])")]
            loose = ""
        else:
            loose += word
    return regex.compile("(?b)" + "".join(out) + f"(?:{regex.escape(loose)}){{e<={edits}}}" * bool(loose))


def best(pattern: regex.Pattern, edits: int, view: str) -> list[regex.Match]:
    """Matches that do not overlap, in order: the best of a stretch, then those before and after it."""
    found, open_ = [], [(0, len(view))]
    while open_:
        lo, hi = open_.pop()
        m = pattern.search(view, lo, hi) if lo < hi else None
        if m and m.end() > m.start() and sum(m.fuzzy_counts) <= edits:
            found.append(m)
            open_ += [(lo, m.start()), (m.end(), hi)]
    return sorted(found, key=lambda m: m.start())


def joined(w: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words of a slice with one space after each (a line feed after a document's last); byte starts of words and documents."""
    width = w.end - w.start
    starts = np.concatenate([[0], np.cumsum(width + 1)])
    out = np.full(int(starts[-1]), 32, dtype=np.uint8)
    source = np.repeat(w.start - starts[:-1], width + 1) + np.arange(len(out))
    body = np.ones(len(out), dtype=bool)
    body[starts[1:] - 1] = False
    out[body] = w.data[source[body]]
    last = w.first[1:][np.diff(w.first) > 0]
    out[starts[last] - 1] = 10
    return out.tobytes(), starts, starts[w.first]


class Scanner:
    def __init__(self, phrases: dict[str, str], notices):
        self.phrases = [(len(p.split()), p.encode(), label) for p, label in phrases.items()]
        self.notices = [(label, len(text), k, pieces(text, k), [p.decode() for _, p in pieces(text, 2 * k + 1)], pattern_of(text, k)) for label, text, k in notices]
        self.hashes = {}
        for n, text, _ in self.phrases:
            w = words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), KEEP)
            self.hashes[text] = windows(w, n)[1][0]

    def exact(self, w: Words):
        """(document, label, word in the document) of every phrase."""
        for n in sorted({n for n, _, _ in self.phrases}):
            at, h = windows(w, n)
            for length, text, label in self.phrases:
                if length == n:
                    for i in at[h == self.hashes[text]].tolist():
                        if w.text(i, i + n) == text:
                            d = int(np.searchsorted(w.first, i, side="right")) - 1
                            yield d, label, i - int(w.first[d])

    def fuzzy(self, w: Words):
        """(document, label, first word, last word, edits, length) of every notice."""
        text, starts, docs = joined(w)
        for label, length, k, parts, halves, pattern in self.notices:
            spots = []
            for offset, piece in parts:
                at = text.find(piece)
                while at >= 0:
                    spots.append((max(0, at - offset - k), at - offset + length + k))
                    at = text.find(piece, at + 1)
            done = -1
            for a, b in self._merged(sorted(spots)):
                for lo, hi in self._in_documents(a, b, docs):
                    view = text[lo:hi].decode("latin-1")  # a byte is a character: edits count bytes
                    if sum(h in view for h in halves) < k + 2:
                        continue
                    for m in best(pattern, k, view):
                        s, e = lo + m.start(), lo + m.end()
                        if s < done or e <= s:
                            continue
                        done = e
                        d = int(np.searchsorted(docs, s, side="right")) - 1
                        i = int(np.searchsorted(starts, s, side="right")) - 1
                        j = int(np.searchsorted(starts, e - 1, side="right")) - 1
                        yield d, label, i - int(w.first[d]), j - int(w.first[d]), sum(m.fuzzy_counts), length

    @staticmethod
    def _merged(spots):
        out: list[list[int]] = []
        for a, b in spots:
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return out

    @staticmethod
    def _in_documents(a: int, b: int, docs: np.ndarray):
        """A byte range cut at the documents' bounds."""
        first, last = int(np.searchsorted(docs, a, side="right")) - 1, int(np.searchsorted(docs, b, side="left"))
        for d in range(max(first, 0), min(last, len(docs) - 1)):
            lo, hi = max(a, int(docs[d])), min(b, int(docs[d + 1]) - 1)
            if lo < hi:
                yield lo, hi


def _run(text: str, into: str, phrases, notices):
    def run(batches):
        scanner = Scanner(phrases, notices)
        for whole in batches:
            for batch in slices(whole, text):
                w = words(*buffers(batch.column(batch.schema.get_field_index(text))), KEEP)
                rows = [{"n_words": n, "places": [], "notices": []} for n in np.diff(w.first).tolist()]
                for d, label, i in scanner.exact(w):
                    rows[d]["places"].append({"label": label, "word": i})
                for d, label, i, j, edits, length in scanner.fuzzy(w):
                    rows[d]["notices"].append({"label": label, "first_word": i, "last_word": j, "edits": edits, "length": length})
                for r in rows:
                    r["places"].sort(key=lambda x: (x["word"], x["label"]))
                    r["notices"].sort(key=lambda x: (x["first_word"], x["label"]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, RESULT)], [*batch.schema.names, into])

    return run


def scan(docs: DataFrame, text: str = "text", into: str = "licenses", phrases: dict[str, str] = PHRASES, notices=NOTICES) -> DataFrame:
    """Adds ``into``: word count, places of exact phrases, and fuzzy notices with span and edits; an earlier column of that name gives way."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != into])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{into}` {RESULT_SQL}"
    return docs.mapInArrow(_run(text, into, dict(phrases), tuple(notices)), schema)
