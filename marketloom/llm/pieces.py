"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is normalised as an identity model does (one word-boundary mark in
front, spaces as marks) and cut where a mark follows another character: no
piece of such a vocabulary spans that place, so segments merge independently.
Within a segment an agenda holds the adjacent symbol pairs that form a piece;
the pair with the best score, leftmost on ties, merges first.  Many short
segments advance together, one row of a matrix of pair ranks each; long ones
use a heap.  Characters outside the vocabulary become byte pieces.  Every segment that is new to a
task's bounded memory is checked against the sentencepiece library, many at a
time, and a difference stops the task.

Defined cases: null and empty texts have the end id only and decode to the
empty text; equal texts get equal ids; very long segments take time n log n;
empty tables give empty results; other columns pass through.
"""

from __future__ import annotations

import gc
import heapq
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.words import slices

MARK = "▁"
SEGMENT = re.compile(f"{MARK}+[^{MARK}]*")
#: Segments kept in a task's memory; older ones are encoded anew when met again.
MEMORY = 1 << 21
#: Widths of the matrices for short segments; rows of one matrix at most.
WIDTHS, ROWS = (8, 12, 16, 24, 32), 1 << 14
NEVER = np.int32(1 << 30)


class Vocabulary:
    """Pieces, scores and byte pieces of a sentencepiece model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        sp, n = self.library, self.library.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.rank = {}
        self.ids = {sp.id_to_piece(i): i for i in plain}
        order = sorted(plain, key=lambda i: -sp.get_score(i))
        place, last = -1, None
        for i in order:  # equal scores rank alike
            if sp.get_score(i) != last:
                place, last = place + 1, sp.get_score(i)
            self.rank[sp.id_to_piece(i)] = place
        self.byte = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.end, self.unknown = sp.eos_id(), sp.unk_id()
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece spans a word boundary: segments would not be independent")

        self._pair_table()

    def _pair_table(self) -> None:
        """An open hash table of all pairs of pieces that form a piece: key left * size + right, merged id, rank."""
        size = self.library.get_piece_size()
        pairs = [(self.ids[p[:k]] * size + self.ids[p[k:]], i, self.rank[p]) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift, self.size = np.uint64(64 - bits), size
        self.slots = np.full((1 << bits) + 64, -1, dtype=np.int64)
        self.made, self.ranks = np.full(len(self.slots), -1, np.int32), np.full(len(self.slots), NEVER, np.int32)
        self.probes = 1
        for key, i, r in pairs:
            at = first = ((key * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)) >> (64 - bits)
            while self.slots[at] >= 0:
                at += 1
            self.slots[at], self.made[at], self.ranks[at] = key, i, r
            self.probes = max(self.probes, at - first + 1)
        self.char = np.full(0x110000, -1, dtype=np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of pairs; the last slot, which is empty, for pairs that form no piece."""
        key = left.astype(np.int64) * self.size + right
        at = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)
        out = np.full(len(key), len(self.slots) - 1)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        for k in range(self.probes):
            slot = at[todo] + k
            held = self.slots[slot]
            same = held == key[todo]
            out[todo[same]] = slot[same]
            todo = todo[~same & (held >= 0)]
            if not len(todo):
                break
        return out

    def merge_rows(self, symbols: np.ndarray, lengths: np.ndarray) -> None:
        """Runs the agendas of all rows of symbol ids (-1 beyond a row's length, less for foreign characters) to their end, in place."""
        n, width = symbols.shape
        row, col = np.nonzero(np.arange(width - 1) < lengths[:, None] - 1)
        ranks = np.full((n, width), NEVER, dtype=np.int32)
        ranks[row, col] = self.ranks[self._find(symbols[row, col], symbols[row, col + 1])]
        live, s, r = np.arange(n), symbols.copy(), ranks
        cols = np.arange(width)
        while True:
            best = r.argmin(axis=1)
            go = r[np.arange(len(r)), best] < NEVER
            if not go.all():
                symbols[live[~go]] = s[~go]
                live, s, r, best = live[go], s[go], r[go], best[go]
            if not len(live):
                return
            i = np.arange(len(live))
            merged = self.made[self._find(s[i, best], s[i, best + 1])]
            source = np.minimum(cols + (cols > best[:, None]), width - 1)
            s, r = np.take_along_axis(s, source, 1), np.take_along_axis(r, source, 1)
            s[:, -1], r[:, -1] = -1, NEVER
            s[i, best] = merged
            lengths[live] -= 1
            r[i, best] = self.ranks[self._find(merged, s[i, np.minimum(best + 1, width - 1)])]
            inner = np.flatnonzero(best > 0)
            r[inner, best[inner] - 1] = self.ranks[self._find(s[inner, best[inner] - 1], merged[inner])]

    def encode_segments(self, segments: list[str]) -> list[list[int]]:
        """The ids of many segments."""
        out: list = [None] * len(segments)
        size = np.array([len(s) for s in segments], dtype=np.int64)
        for low, width in zip((0, *WIDTHS), WIDTHS, strict=False):
            chosen = np.flatnonzero((size > low) & (size <= width))
            for a in range(0, len(chosen), ROWS):
                part = chosen[a : a + ROWS]
                points = np.frombuffer("".join([segments[i] for i in part.tolist()]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                lengths = size[part]
                inside = np.arange(width) < lengths[:, None]
                symbols = np.full((len(part), width), -1, dtype=np.int32)
                found = self.char[points]
                symbols[inside] = np.where(found < 0, -2 - points.astype(np.int32), found)
                self.merge_rows(symbols, lengths)
                foreign = (symbols < -1).any(axis=1).tolist()
                for i, ids, n, odd in zip(part.tolist(), symbols.tolist(), lengths.tolist(), foreign, strict=True):
                    out[i] = [*chain.from_iterable([x] if x >= 0 else self.foreign(chr(-2 - x)) for x in ids[:n])] if odd else ids[:n]
        return [self.encode_segment(s) if got is None else got for s, got in zip(segments, out, strict=True)]

    def merge(self, segment: str) -> list[str]:
        """The symbols of a segment after all merges, by the agenda of adjacent pairs."""
        rank = self.rank
        symbols: list[str | None] = list(segment)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(r, i, p) for i in range(n - 1) if (r := rank.get(p := segment[i : i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, piece = heapq.heappop(agenda)
            left = symbols[i]
            if left is None or (j := after[i]) >= n or len(left) + len(symbols[j]) != len(piece) or left + symbols[j] != piece:
                continue  # one of the two has merged meanwhile
            symbols[i], symbols[j] = piece, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(p := piece + symbols[k])) is not None:
                    heapq.heappush(agenda, (r, i, p))
            if (h := before[i]) >= 0 and (r := rank.get(p := symbols[h] + piece)) is not None:
                heapq.heappush(agenda, (r, h, p))
        return [s for s in symbols if s is not None]

    def encode_segment(self, segment: str) -> list[int]:
        got = self.ids.get(segment) if len(segment) < 3 else None
        if got is not None:
            return [got]
        out: list[int] = []
        for s in self.merge(segment):
            i = self.ids.get(s)
            if i is not None:
                out.append(i)
            else:
                out += self.foreign(s)
        return out

    def foreign(self, character: str) -> list[int]:
        """Byte pieces of a character outside the vocabulary, or the unknown id."""
        return [self.byte[b] for b in character.encode()] if self.byte else [self.unknown]

    def segments(self, text: str) -> list[str]:
        return SEGMENT.findall(MARK + text.replace(" ", MARK)) if text else []

    def check(self, segments: list[str], ids: list[list[int]]) -> None:
        """Compares with the library; a lone mark has no text of its own there."""
        if self.library.encode([s[1:] for s in segments], num_threads=1) != [[] if s == MARK else i for s, i in zip(segments, ids, strict=True)]:
            bad = next(s for s, i in zip(segments, ids, strict=True) if s != MARK and self.library.encode(s[1:]) != i)
            raise ValueError(f"ids differ from the library's for {bad!r}")


class Encoder:
    """Encodes texts with a memory of segments that holds ``memory`` characters at most, beside those of the slice at hand."""

    def __init__(self, path: str, memory: int = MEMORY):
        self.vocabulary, self.memory = Vocabulary(path), memory
        self.known: dict[str, tuple[int, ...]] = {}
        self.held = 0

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        v = self.vocabulary
        cut = [v.segments(t or "") for t in texts]
        new = list(set(chain.from_iterable(cut)).difference(self.known))
        self.held += sum(map(len, new))
        if self.held > self.memory:
            self.known.clear()
            new = list(set(chain.from_iterable(cut)))
            self.held = sum(map(len, new))
        found = v.encode_segments(new)
        v.check(new, found)
        known = self.known
        known.update(zip(new, map(tuple, found), strict=True))
        return [[*chain.from_iterable(map(known.__getitem__, c)), v.end] for c in cut]

    def decode(self, ids: list[list[int]]) -> list[str]:
        """The texts of id lists, as the library joins pieces and bytes."""
        return self.vocabulary.library.decode(ids, num_threads=1)


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the ids (with the end id) and the text decoded from them; ``model`` is the path of the vocabulary file on every executor.

    Earlier columns of the results' names give way.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (ids, decoded)])

    def run(batches):
        encoder = Encoder(model)
        gc.disable()  # many small tuples and no cycles: collections would only walk the memory of segments
        try:
            for whole in batches:
                for batch in slices(whole, text):
                    found = encoder.encode(batch.column(batch.schema.get_field_index(text)).to_pylist())
                    back = encoder.decode(found)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32())), pa.array(back, pa.string())], [*batch.schema.names, ids, decoded])
        finally:
            gc.enable()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, `{ids}` array<int>, `{decoded}` string")


def ids_digest(ids):
    """SHA-256 of the decimal ids joined by one space."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)
