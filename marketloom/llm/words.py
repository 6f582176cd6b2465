"""Vectorised UTF-8 word kernels shared by the text operators.

All kernels work on the raw UTF-8 buffer of an Arrow string column, so a batch
of documents is tokenised with a constant number of numpy calls.  Null texts
count as empty.  Words are maximal runs of accepted bytes and never span two
documents.  A word is identified by a 64-bit hash of its (lower-cased) bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MASK = (1 << 64) - 1
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1B54A32D192ED03

#: Bytes at most in one slice of a batch (a longer single text is one slice).
SLICE_BYTES = 1 << 21

SPACES = bytes([0x20, *range(0x09, 0x0E)])


def fold_table(lower: bool = True) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    return table


def space_words() -> np.ndarray:
    """Accepts every byte but space and 0x09-0x0D."""
    keep = np.ones(256, dtype=bool)
    keep[list(SPACES)] = False
    return keep


def letter_words() -> np.ndarray:
    """Accepts digits, lower-case a-z and every non-ASCII byte."""
    keep = np.zeros(256, dtype=bool)
    keep[0x30:0x3A] = True
    keep[0x61:0x7B] = True
    keep[0x80:] = True
    return keep


_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64 (of its inverse), kept between calls."""
    got = _POWERS.get((base, inverse))
    if got is None or len(got) < n:
        step = pow(base, -1, 1 << 64) if inverse else base
        size = max(1 << 16, 1 << (n - 1).bit_length())
        got = np.full(size, step, dtype=np.uint64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        if size > 4 * SLICE_BYTES:  # of a very long text; not kept
            return got[:n]
        _POWERS[base, inverse] = got
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n+1 offsets, from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n, wide = len(column), pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES):
    """Cuts a batch into runs of rows whose texts together have ``most`` bytes at most."""
    _, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, batch.num_rows
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


@dataclass
class Words:
    """Words of a slice: byte spans, 64-bit hashes, and each document's first word (n+1 values)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def text(self, i: int, j: int) -> bytes:
        """Words i..j-1 joined by one space."""
        raw = self.data
        return b" ".join(raw[self.start[k] : self.end[k]].tobytes() for k in range(i, j))

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def token_classes() -> np.ndarray:
    """0 for white space, 1 for letters, digits and non-ASCII bytes, 2 for other signs."""
    kinds = np.full(256, 2, dtype=np.uint8)
    kinds[list(SPACES)] = 0
    for a, b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
        kinds[a:b] = 1
    return kinds


def words(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray, lower: bool = True) -> Words:
    """Splits every document of a buffer into maximal runs of bytes of one class; ``keep`` gives each byte's class, 0 for separators."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    data = fold_table(lower)[data] if lower else data
    kind = keep.view(np.uint8)[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    edge[1:n] |= kind[1:] != kind[:-1]
    begins, ends = edge[:n] & (kind > 0), edge[1:] & (kind > 0)
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum((data + np.uint64(1)) * powers(BYTE_BASE, n), out=total[1:])
    h = (total[end] - total[start]) * powers(BYTE_BASE, n, True)[start]
    return Words(data, start, end, mix(h ^ (end - start).astype(np.uint64)), np.searchsorted(start, offsets))


def windows(w: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and 64-bit hash of every run of ``length`` words inside a document."""
    n = len(w.hash)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if length == 1:
        at, h = np.arange(n), w.hash
    elif length <= 3:
        h = w.hash[: n - length + 1] * np.uint64(WORD_BASE)
        for k in range(1, length):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(WORD_BASE) + w.hash[k : n - length + 1 + k]
        at = np.arange(n - length + 1)
    else:
        total = np.empty(n + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(w.hash * powers(WORD_BASE, n), out=total[1:])
        at = np.arange(n - length + 1)
        h = (total[length:] - total[:-length]) * powers(WORD_BASE, n, True)[at]
    inside = np.ones(len(at), dtype=bool)
    for k in range(1, length):  # a window that begins in the last words of a document leaves it
        last = w.first[1:] - k
        last = last[(last >= w.first[:-1]) & (last < len(at))]
        inside[last] = False
    return at[inside], mix(h[inside] + np.uint64(length))


def spans_cover(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in any of the spans."""
    depth = np.zeros(n + 1, dtype=np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    return np.cumsum(depth[:-1]) > 0
