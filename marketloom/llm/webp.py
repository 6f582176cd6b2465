"""Lossless WebP (VP8L): a decoder for the whole bitstream, an encoder, and media columns over them.

The decoder reads prefix codes (simple, normal, grouped by an entropy image),
back-references, colour-cache codes, and inverts the predictor, cross-colour,
subtract-green and palette transforms (with pixel bundling).  Images coded with
one group whose only varying channel is green, as grey images are after
subtract-green, are decoded with numpy: the step from each bit position to the
next token is looked up everywhere at once, and the path of real tokens is
followed through composed steps.  All other images take the symbol-by-symbol
path; both give the same pixels.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
GREEN, RED, BLUE, ALPHA, DISTANCE = range(5)
LENGTHS = 24

#: Fixed values of the format: order in which the lengths of the code-length code are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)

#: Fixed values of the format: pixel offsets (left, up) of the first 120 distance codes.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)

MIRROR = np.array([int(f"{i:08b}"[::-1], 2) for i in range(256)], dtype=np.uint32)
CHUNK_BITS = 1 << 20


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def pixel_distance(code: int, width: int) -> int:
    """Pixels to go back for a distance code (from 1)."""
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def bundle_bits(colours: int) -> int:
    """How many times a row of palette indices halves by bundling."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


# ---- reading


class Bits:
    """Bits of a stream, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def read(self, n: int) -> int:
        if self.at + n > self.end:
            raise ValueError("bitstream ends early")
        a = self.at
        self.at += n
        return (int.from_bytes(self.data[a >> 3 : (a >> 3) + 5], "little") >> (a & 7)) & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        return (int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 4], "little") >> (self.at & 7)) & ((1 << n) - 1)


class Code:
    """A canonical prefix code: symbols in code order and their lengths; one symbol alone takes no bits."""

    def __init__(self, symbols: list[int], lengths: list[int]):
        order = sorted(range(len(symbols)), key=lambda i: (lengths[i], symbols[i]))
        self.symbols, self.lengths = [symbols[i] for i in order], [lengths[i] for i in order]
        if not self.symbols:
            raise ValueError("empty prefix code")
        self.single = len(self.symbols) == 1
        self.most = 0 if self.single else self.lengths[-1]
        if not self.single and sum(1 << (15 - n) for n in self.lengths) != 1 << 15:
            raise ValueError("prefix code is not complete")
        self._table: list[tuple[int, int]] | None = None

    def table(self) -> list[tuple[int, int]]:
        """(symbol, length) for the next ``most`` bits as read."""
        if self._table is None:
            out: list = [None] * (1 << self.most)
            code, last = 0, self.lengths[0]
            for s, n in zip(self.symbols, self.lengths, strict=True):
                code <<= n - last
                last = n
                for i in range(int(f"{code:0{n}b}"[::-1], 2), 1 << self.most, 1 << n):
                    out[i] = (s, n)
                code += 1
            self._table = out
        return self._table

    def read(self, bits: Bits) -> int:
        if self.single:
            return self.symbols[0]
        symbol, n = self.table()[bits.peek(self.most)]
        bits.at += n
        if bits.at > bits.end:
            raise ValueError("bitstream ends early")
        return symbol


def read_code(bits: Bits, size: int) -> Code:
    """One stored prefix code over ``size`` symbols."""
    if bits.read(1):
        two = bits.read(1)
        found = [bits.read(8 if bits.read(1) else 1)]
        if two:
            found.append(bits.read(8))
        if len(set(found)) == 1:
            found = found[:1]
        return Code(found, [1] * len(found))
    held = [0] * 19
    for k in range(4 + bits.read(4)):
        held[LENGTH_ORDER[k]] = bits.read(3)
    used = [s for s in range(19) if held[s]]
    lengths_code = Code(used, [held[s] for s in used])
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    symbols, lengths, at, previous = [], [], 0, 8
    while at < size and left:
        left -= 1
        n = lengths_code.read(bits)
        if n < 16:
            if n:
                symbols.append(at)
                lengths.append(n)
                previous = n
            at += 1
        elif n == 16:
            for _ in range(3 + bits.read(2)):
                symbols.append(at)
                lengths.append(previous)
                at += 1
        else:
            at += 3 + bits.read(3) if n == 17 else 11 + bits.read(7)
    if at > size:
        raise ValueError("code lengths run over the alphabet")
    return Code(symbols, lengths)


def read_value(prefix: int, bits: Bits) -> int:
    """A length or distance from its prefix symbol and extra bits."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def cache_slot(pixel: int, cache_bits: int) -> int:
    return ((0x1E35A7BD * pixel) & 0xFFFFFFFF) >> (32 - cache_bits)


def read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """The entropy-coded pixels of an image or sub-image: height x width ARGB."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache is too large")
    tile, groups_of, count = 0, None, 1
    if main and bits.read(1):
        tile = bits.read(3) + 2
        groups_of = (read_image(bits, ceil_div(width, 1 << tile), ceil_div(height, 1 << tile), False) >> 8) & 0xFFFF
        count = int(groups_of.max()) + 1
    sizes = (256 + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    groups = [[read_code(bits, n) for n in sizes] for _ in range(count)]
    if count == 1 and not cache_bits and all(c.single for c in groups[0][1:]):
        return _read_green(bits, groups[0], width, height)
    return _read_symbols(bits, groups, groups_of, tile, cache_bits, width, height)


def _read_symbols(bits: Bits, groups, groups_of, tile: int, cache_bits: int, width: int, height: int) -> np.ndarray:
    total = width * height
    out: list[int] = []
    cache, cached = [0] * (1 << cache_bits), 0
    group = groups[0]
    while len(out) < total:
        if groups_of is not None:
            y, x = divmod(len(out), width)
            group = groups[groups_of[y >> tile, x >> tile]]
        s = group[GREEN].read(bits)
        if s < 256:
            red, blue, alpha = group[RED].read(bits), group[BLUE].read(bits), group[ALPHA].read(bits)
            out.append(alpha << 24 | red << 16 | s << 8 | blue)
        elif s < 256 + LENGTHS:
            length = read_value(s - 256, bits)
            back = pixel_distance(read_value(group[DISTANCE].read(bits), bits), width)
            if back > len(out) or len(out) + length > total:
                raise ValueError("back-reference leaves the image")
            for _ in range(length):
                out.append(out[-back])
        else:
            for p in out[cached:]:
                cache[cache_slot(p, cache_bits)] = p
            cached = len(out)
            out.append(cache[s - 256 - LENGTHS])
    return np.array(out, dtype=np.uint32).reshape(height, width)


def _read_green(bits: Bits, group, width: int, height: int) -> np.ndarray:
    """Pixels of an image in which only green varies, by steps between all bit positions."""
    total, green = width * height, group[GREEN]
    base = group[ALPHA].symbols[0] << 24 | group[RED].symbols[0] << 16 | group[BLUE].symbols[0]
    if green.single and green.symbols[0] < 256:
        return np.full((height, width), base | green.symbols[0] << 8, dtype=np.uint32)
    far = group[DISTANCE].symbols[0]
    most = max(green.most, 1)
    symbols, lengths = np.array(green.symbols), np.array(green.lengths)
    copies = symbols - 256
    after = np.where(symbols < 256, 0, np.where(copies < 4, 0, (copies - 2) >> 1) + (0 if far < 4 else (far - 2) >> 1))
    wide = 1 << (most - lengths) if not green.single else np.array([2])
    of_window, step = np.repeat(symbols, wide), np.repeat((0 if green.single else lengths) + after, wide).astype(np.int32)
    data = np.frombuffer(bits.data, dtype=np.uint8)
    found, places, covered, at = [], [], 0, bits.at
    while covered < total:
        if at >= bits.end:
            raise ValueError("bitstream ends early")
        low = at >> 3
        part = MIRROR[data[low : low + CHUNK_BITS // 8 + 2]]
        n = 8 * max(1, min(len(part) - 2, CHUNK_BITS // 8)) if low + CHUNK_BITS // 8 + 2 < len(data) else 8 * len(part)
        part = np.concatenate([part, np.zeros(4, np.uint32)])
        triple = part[:-2] << np.uint32(16) | part[1:-1] << np.uint32(8) | part[2:]
        window = ((triple[: n // 8, None] >> (24 - most - np.arange(8)).astype(np.uint32)) & np.uint32((1 << most) - 1)).ravel()
        hop = np.arange(n + 64, dtype=np.int32)
        hop[:n] += step[window]
        hops = [hop]
        for _ in range(4):
            hops.append(hops[-1][hops[-1]])
        path, here, far_hop = [], at - 8 * low, memoryview(hops[4])
        while here < n:
            path.append(here)
            here = far_hop[here]
            if here == path[-1]:  # a code of one symbol without bits never moves
                raise ValueError("bitstream does not advance")
        track = np.array(path, dtype=np.int32)[:, None]
        for h in (hops[3], hops[2], hops[1], hops[0]):
            track = np.stack([track, h[track]], axis=2).reshape(len(track), -1)
        track = track.ravel()
        track = track[track < n]
        track = track[hop[track] <= bits.end - 8 * low]
        kinds = of_window[window[track]]
        sizes = np.ones(len(kinds), dtype=np.int64)
        for i in np.flatnonzero(kinds >= 256).tolist():
            bits.at = 8 * low + int(track[i]) + (0 if green.single else green.lengths[green.symbols.index(int(kinds[i]))])
            sizes[i] = read_value(int(kinds[i]) - 256, bits)
            places.append((len(found), i, pixel_distance(read_value(far, bits), width)))
        ends = covered + np.cumsum(sizes)
        if not len(ends):
            raise ValueError("bitstream ends early")
        cut = int(np.searchsorted(ends, total)) + 1
        found.append((kinds[:cut], sizes[:cut]))
        places = [p for p in places if p[0] < len(found) - 1 or p[1] < cut]
        covered = int(ends[min(cut, len(ends)) - 1])
        at = 8 * low + here if cut > len(ends) else 8 * low + int(track[cut - 1] + step[window[track[cut - 1]]])
    bits.at = at
    if covered != total or at > bits.end:
        raise ValueError("back-reference leaves the image")
    kinds, sizes = (np.concatenate([f[i] for f in found]) for i in range(2))
    ends = np.cumsum(sizes)
    values = np.where(kinds < 256, kinds, 0).astype(np.uint8)
    out = np.repeat(values, sizes)
    shift = np.cumsum([0] + [len(f[0]) for f in found])
    for k, i, back in places:
        end = int(ends[shift[k] + i])
        start = end - int(sizes[shift[k] + i])
        if back > start:
            raise ValueError("back-reference leaves the image")
        if back >= end - start:
            out[start:end] = out[start - back : end - back]
        else:
            out[start:end] = np.resize(out[start - back : start], end - start)
    return (np.uint32(base) | out.astype(np.uint32) << np.uint32(8)).reshape(height, width)


# ---- transforms


def channels(argb: np.ndarray) -> np.ndarray:
    """... x (alpha, red, green, blue) as int32."""
    return np.stack([(argb >> np.uint32(s)) & np.uint32(255) for s in (24, 16, 8, 0)], axis=-1).astype(np.int32)


def joined(parts: np.ndarray) -> np.ndarray:
    p = (parts & 255).astype(np.uint32)
    return p[..., 0] << np.uint32(24) | p[..., 1] << np.uint32(16) | p[..., 2] << np.uint32(8) | p[..., 3]


def predict(mode: int, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """A prediction of every channel from left, top, top-right and top-left pixels."""
    mean = lambda a, b: (a + b) >> 1
    if mode == 0:
        return np.zeros_like(left) + np.array([255, 0, 0, 0], dtype=np.int32)
    if mode <= 4:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return mean(mean(left, right), top)
    if mode in (6, 7, 8, 9):
        a, b = ((left, corner), (left, top), (corner, top), (top, right))[mode - 6]
        return mean(a, b)
    if mode == 10:
        return mean(mean(left, corner), mean(top, right))
    if mode == 11:
        guess = left + top - corner
        nearer = np.abs(guess - left).sum(axis=-1, keepdims=True) < np.abs(guess - top).sum(axis=-1, keepdims=True)
        return np.where(nearer, left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    a = mean(left, top)
    d = a - corner
    return np.clip(a + np.where(d < 0, -(-d >> 1), d >> 1), 0, 255)


def _mode_of(modes: np.ndarray, bits: int, y: int, x: int) -> int:
    if y == 0:
        return 0 if x == 0 else 1
    return 2 if x == 0 else int(modes[y >> bits, x >> bits])


def undo_predictor(argb: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """Pixels from residuals; a row whose modes don't need the left pixel is done at once."""
    height, width = argb.shape
    out = channels(argb)
    for y in range(height):
        row = out[y]
        spans = [(x, min(width, x + (1 << bits))) for x in range(0, width, 1 << bits)]
        for a, b in spans:
            mode = int(modes[y >> bits, a >> bits]) if y else 1
            if y and a and mode in (0, 2, 4, 8) or y and a and b < width and mode in (3, 9):
                above = out[y - 1]
                row[a:b] = (row[a:b] + predict(mode, row[a:b], above[a:b], above[a + 1 : b + 1] if b < width else above[a:b], above[a - 1 : b - 1])) & 255
                continue
            for x in range(a, b):
                m = _mode_of(modes, bits, y, x)
                left = row[x - 1] if x else row[x]
                top = out[y - 1, x] if y else row[x]
                right = (out[y - 1, x + 1] if x + 1 < width else row[0]) if y else row[x]
                corner = out[y - 1, x - 1] if y and x else row[x]
                row[x] = (row[x] + predict(m, left, top, right, corner)) & 255
    return joined(out)


def do_predictor(argb: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """Residuals from pixels."""
    height, width = argb.shape
    p = channels(argb)
    flat = np.concatenate([p.reshape(-1, 4), np.zeros((1, 4), np.int32)])
    at = np.arange(height * width).reshape(height, width)
    left, top, right, corner = (flat[np.maximum(at - d, 0)] for d in (1, width, width - 1, width + 1))
    which = np.repeat(np.repeat(modes, 1 << bits, axis=0), 1 << bits, axis=1)[:height, :width].copy()
    which[0, :], which[:, 0] = 1, 2
    which[0, 0] = 0
    out = p.copy()
    for mode in np.unique(which).tolist():
        here = which == mode
        out[here] = p[here] - predict(mode, left[here], top[here], right[here], corner[here])
    return joined(out)


def cross(argb: np.ndarray, elements: np.ndarray, bits: int, undo: bool) -> np.ndarray:
    """Adds (or takes away) the share of red and blue that green and red foretell."""
    height, width = argb.shape
    e = np.repeat(np.repeat(channels(elements), 1 << bits, axis=0), 1 << bits, axis=1)[:height, :width]
    signed = lambda v: ((v & 255) ^ 128) - 128
    share = lambda t, c: (signed(t) * signed(c)) >> 5
    p = channels(argb)
    red, green, blue = p[..., 1], p[..., 2], p[..., 3]
    red_to_blue, green_to_blue, green_to_red = e[..., 1], e[..., 2], e[..., 3]
    if undo:
        red = (red + share(green_to_red, green)) & 255
        blue = blue + share(green_to_blue, green) + share(red_to_blue, red)
    else:
        blue = blue - share(green_to_blue, green) - share(red_to_blue, red)
        red = red - share(green_to_red, green)
    return joined(np.stack([p[..., 0], red, green, blue], axis=-1))


def add_green(argb: np.ndarray, sign: int) -> np.ndarray:
    green = (argb >> np.uint32(8)) & np.uint32(255)
    both = green << np.uint32(16) | green
    rest, keep = argb & np.uint32(0x00FF00FF), argb & np.uint32(0xFF00FF00)
    return keep | ((rest + both if sign > 0 else rest + np.uint32(0x01000100) - both) & np.uint32(0x00FF00FF))


def undo_palette(argb: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    bits = bundle_bits(len(palette))
    index = (argb >> np.uint32(8)) & np.uint32(255)
    if bits:
        each = 8 >> bits
        index = ((index[..., None] >> (each * np.arange(1 << bits)).astype(np.uint32)) & np.uint32((1 << each) - 1)).reshape(len(argb), -1)[:, :width]
    return np.concatenate([palette, np.zeros(256, np.uint32)])[index]


def decode(media: bytes) -> np.ndarray:
    """The ARGB pixels (height x width, uint32) of a lossless WebP file."""
    if len(media) < 21 or media[:4] != b"RIFF" or media[8:16] != b"WEBPVP8L" or struct.unpack("<I", media[4:8])[0] + 8 > len(media) + 1:
        raise ValueError("not a lossless WebP file")
    size = struct.unpack("<I", media[16:20])[0]
    bits = Bits(media[20 : 20 + size])
    if bits.read(8) != 0x2F:
        raise ValueError("no VP8L signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown VP8L version")
    todo, coded = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in [t[0] for t in todo]:
            raise ValueError("a transform is given twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            tile = bits.read(3) + 2
            todo.append((kind, read_image(bits, ceil_div(coded, 1 << tile), ceil_div(height, 1 << tile), False), tile))
        elif kind == SUBTRACT_GREEN:
            todo.append((kind, None, 0))
        else:
            colours = bits.read(8) + 1
            deltas = channels(read_image(bits, colours, 1, False))[0]
            todo.append((kind, joined(np.cumsum(deltas, axis=0)), coded))
            coded = ceil_div(coded, 1 << bundle_bits(colours))
    argb = read_image(bits, coded, height, True)
    for kind, extra, value in reversed(todo):
        if kind == PREDICTOR:
            argb = undo_predictor(argb, (extra >> np.uint32(8)) & np.uint32(15), value)
        elif kind == CROSS_COLOUR:
            argb = cross(argb, extra, value, True)
        elif kind == SUBTRACT_GREEN:
            argb = add_green(argb, 1)
        else:
            argb = undo_palette(argb, extra, value)
    return argb


# ---- writing


def code_lengths(counts: np.ndarray, limit: int = 15) -> np.ndarray:
    """Huffman code lengths of at most ``limit`` bits for the symbols that occur."""
    out, used = np.zeros(len(counts), dtype=np.int64), np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    least = 1
    while True:
        heap = [(max(int(c), least), i) for i, c in enumerate(counts[used])]
        heapq.heapify(heap)
        parent, at = [0] * (2 * len(used) - 1), len(used)
        while len(heap) > 1:
            (a, i), (b, j) = heapq.heappop(heap), heap[0]
            heapq.heapreplace(heap, (a + b, at))
            parent[i] = parent[j] = at
            at += 1
        depth = [0] * at
        for i in range(at - 2, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth[: len(used)]) <= limit:
            out[used] = depth[: len(used)]
            return out
        least *= 2


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes, mirrored for a stream that starts with the lowest bit; 0 where a single symbol takes no bits."""
    out, code, last = np.zeros(len(lengths), dtype=np.uint64), 0, 0
    used = np.flatnonzero(lengths)
    if len(used) < 2:
        return out
    for s in used[np.argsort(lengths[used], kind="stable")].tolist():
        n = int(lengths[s])
        code <<= n - last
        last = n
        out[s] = int(f"{code:0{n}b}"[::-1], 2)
        code += 1
    return out


class Writer:
    """Collects bits, lowest first."""

    def __init__(self):
        self.value, self.bits = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.bits
        self.bits += n

    def code(self, lengths: np.ndarray) -> None:
        """Stores one prefix code; lengths of the code-length code are fixed (13 symbols of 4 bits, 6 of 5)."""
        used = np.flatnonzero(lengths).tolist()
        if len(used) <= 2 and (not used or used[-1] < 256):
            self.put(1, 1)
            self.put(max(0, len(used) - 1), 1)
            first = used[0] if used else 0
            self.put(int(first > 1), 1)
            self.put(first, 8 if first > 1 else 1)
            if len(used) == 2:
                self.put(used[1], 8)
            return
        self.put(0, 1)
        self.put(19 - 4, 4)
        for s in LENGTH_ORDER:
            self.put(int(STORED[s]), 3)
        self.put(0, 1)
        last = -1
        for s in [*used, len(lengths)]:
            gap = s - last - 1
            while gap:
                if gap >= 11:
                    n = min(gap, 138)
                    self.put(int(STORED_CODES[18]) | (n - 11) << int(STORED[18]), int(STORED[18]) + 7)
                elif gap >= 3:
                    n = gap
                    self.put(int(STORED_CODES[17]) | (n - 3) << int(STORED[17]), int(STORED[17]) + 3)
                else:
                    n = 1
                    self.put(int(STORED_CODES[0]), int(STORED[0]))
                gap -= n
            if s < len(lengths):
                self.put(int(STORED_CODES[lengths[s]]), int(STORED[lengths[s]]))
            last = s


STORED = np.array([4 if s < 11 or s in (17, 18) else 5 for s in range(19)], dtype=np.int64)
STORED_CODES = codes(STORED)


def prefix_of(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, number of extra bits and their value for lengths or distances from 1."""
    v = np.asarray(value, dtype=np.int64) - 1
    n = np.where(v > 3, np.floor(np.log2(np.maximum(v, 1))).astype(np.int64), 0)
    extra = np.maximum(n - 1, 0)
    small = v < 4
    return np.where(small, v, 2 * n + ((v >> extra) & 1)), np.where(small, 0, extra), np.where(small, 0, v & ((1 << extra) - 1))


def packed(writer: Writer, values: np.ndarray, sizes: np.ndarray) -> bytes:
    """The writer's bits and then all values (of at most 32 bits) in order, as bytes."""
    ends = writer.bits + np.cumsum(sizes)
    starts = ends - sizes
    total = int(ends[-1]) if len(ends) else writer.bits
    n = total // 32 + 2
    shifted = values << (starts & 31).astype(np.uint64)
    word = starts >> 5
    out = np.bincount(word, weights=(shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n + 1)
    out += np.bincount(word + 1, weights=(shifted >> np.uint64(32)).astype(np.float64), minlength=n + 1)[: len(out)]
    words = out.astype(np.uint64).astype(np.uint32)
    head = np.frombuffer(writer.value.to_bytes(4 * (writer.bits // 32 + 1), "little"), dtype=np.uint32)
    words[: len(head)] |= head
    return words.tobytes()[: ceil_div(total, 8)]


def references(pixels: np.ndarray, width: int, distances: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy tokens of a flat image: first pixel, length (0: a literal) and distance code, for copies from fixed distance codes."""
    n = len(pixels)
    best, code = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for d in distances:
        back = pixel_distance(d, width)
        if back >= n:
            continue
        differs = np.flatnonzero(np.concatenate([[True], pixels[back:] != pixels[:-back], [True]])) - 1
        run = np.zeros(n, dtype=np.int64)  # equal pixels from here on
        at = np.arange(n - back)
        run[back:] = differs[np.searchsorted(differs, at)] - at
        better = run > best
        best[better], code[better] = run[better], d
    starts, lengths = [], []
    copies = np.flatnonzero(best >= 4)
    at = 0
    for i in _jumps(copies, best):
        starts.append(np.arange(at, i))
        lengths.append(np.zeros(i - at, dtype=np.int64))
        size = int(min(best[i], 4096))
        starts.append(np.array([i]))
        lengths.append(np.array([size]))
        at = i + size
    starts.append(np.arange(at, n))
    lengths.append(np.zeros(n - at, dtype=np.int64))
    first = np.concatenate(starts)
    return first, np.concatenate(lengths), code[first]


def _jumps(copies: np.ndarray, best: np.ndarray):
    at = 0
    k = 0
    while k < len(copies):
        i = int(copies[k])
        if i < at:
            k = int(np.searchsorted(copies, at))
            continue
        yield i
        at = i + int(min(best[i], 4096))
        k += 1


def write_image(writer: Writer, argb: np.ndarray, main: bool, distances: tuple[int, ...] = (), cache_bits: int = 0, tile: int = 0) -> None:
    """Appends an entropy-coded image; ``tile`` gives the main image one group of codes for each half of its tiles."""
    height, width = argb.shape
    flat = argb.ravel()
    first, length, code = references(flat, width, distances)
    rest = flat & np.uint32(0xFFFF00FF)
    if not cache_bits and not tile and (rest == rest[0]).all() and _write_green(writer, flat, int(rest[0]), first, length, code, main):
        return
    copy = length > 0
    prefix, extra_bits, extra = prefix_of(np.maximum(length, 1))
    far, far_bits, far_extra = prefix_of(np.maximum(code, 1))
    p = channels(flat[first])
    green = np.where(copy, 256 + prefix, p[:, 2])
    cached = np.zeros(len(first), dtype=bool)
    if cache_bits:
        cache, done = [0] * (1 << cache_bits), 0
        for i, (at, c) in enumerate(zip(first.tolist(), copy.tolist(), strict=True)):
            for q in flat[done:at].tolist():
                cache[cache_slot(q, cache_bits)] = q
            done = at
            q = int(flat[at])
            if not c and cache[cache_slot(q, cache_bits)] == q:
                cached[i], green[i] = True, 256 + LENGTHS + cache_slot(q, cache_bits)
    group = np.zeros(len(first), dtype=np.int64)
    writer.put(int(cache_bits > 0), 1)
    if cache_bits:
        writer.put(cache_bits, 4)
    if main:
        writer.put(int(tile > 0), 1)
        if tile:
            tiles = np.indices((ceil_div(height, 1 << tile), ceil_div(width, 1 << tile))).sum(axis=0) % 2
            writer.put(tile - 2, 3)
            write_image(writer, (tiles << 8).astype(np.uint32), False)
            group = tiles[(first // width) >> tile, (first % width) >> tile]
    literal = ~copy & ~cached
    sizes = (256 + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    parts = [(green, np.ones(len(first), bool)), (p[:, 1], literal), (p[:, 3], literal), (p[:, 0], literal), (far, copy)]
    values, bits = np.zeros(len(first), dtype=np.uint64), np.zeros(len(first), dtype=np.int64)
    book = []
    for g in range(int(group.max()) + 1):
        for (symbol, used), n in zip(parts, sizes, strict=True):
            lengths = code_lengths(np.bincount(symbol[used & (group == g)], minlength=n))
            writer.code(lengths)
            book.append((codes(lengths), np.where(np.count_nonzero(lengths) > 1, lengths, 0)))
    pieces = []
    for k, (symbol, used) in enumerate(parts):
        for g in range(int(group.max()) + 1):
            here = used & (group == g)
            words, sizes_ = book[5 * g + k]
            if not sizes_.any():
                continue
            values[here] |= words[symbol[here]] << bits[here].astype(np.uint64)
            bits[here] += sizes_[symbol[here]]
        if k == GREEN:
            values[copy] |= extra[copy].astype(np.uint64) << bits[copy].astype(np.uint64)
            bits[copy] += extra_bits[copy]
        if k == ALPHA or k == DISTANCE:
            pieces.append((values, bits))
            values, bits = np.zeros(len(first), dtype=np.uint64), np.zeros(len(first), dtype=np.int64)
    values, bits = pieces[0]
    if copy.any():
        more, n = pieces[1]
        more[copy] |= far_extra[copy].astype(np.uint64) << n[copy].astype(np.uint64)
        n[copy] += far_bits[copy]
        values = np.stack([values & np.uint64(0xFFFFFFFF), values >> np.uint64(32), more], axis=1).ravel()
        bits = np.stack([np.minimum(bits, 32), np.maximum(bits - 32, 0), n], axis=1).ravel()
    elif (bits > 32).any():
        values = np.stack([values & np.uint64(0xFFFFFFFF), values >> np.uint64(32)], axis=1).ravel()
        bits = np.stack([np.minimum(bits, 32), np.maximum(bits - 32, 0)], axis=1).ravel()
    data = packed(writer, values, bits)
    writer.bits += int(bits.sum())
    writer.value = data if main else int.from_bytes(data, "little")


def _write_green(writer: Writer, flat: np.ndarray, rest: int, first: np.ndarray, length: np.ndarray, code: np.ndarray, main: bool) -> bool:
    """Appends an image in which only green varies; False, with nothing written, where its copies need several distance codes."""
    copies = np.flatnonzero(length)
    green = ((flat[first] >> np.uint32(8)) & np.uint32(255)).astype(np.int64)
    far = 0
    if len(copies):
        prefix, extra_bits, extra = prefix_of(length[copies])
        far, far_bits, far_extra = (int(x) for x in prefix_of(code[copies[0]]))
        if (code[copies] != code[copies[0]]).any() or far_bits > 5:
            return False
        green[copies] = 256 + prefix
    writer.put(0, 2 if main else 1)
    lengths = code_lengths(np.bincount(green, minlength=256 + LENGTHS))
    writer.code(lengths)
    for symbol in (rest >> 16 & 255, rest & 255, rest >> 24, far):
        writer.put(1 | (symbol > 1) << 2, 3)
        writer.put(symbol, 8 if symbol > 1 else 1)
    values, bits = codes(lengths)[green], np.where(np.count_nonzero(lengths) > 1, lengths, 0)[green]
    if len(copies):
        both = (extra | far_extra << extra_bits).astype(np.uint64)
        values[copies] |= both << bits[copies].astype(np.uint64)
        bits[copies] += extra_bits + far_bits
    data = packed(writer, values, bits)
    writer.bits += int(bits.sum())
    writer.value = data if main else int.from_bytes(data, "little")
    return True


def encode(argb: np.ndarray, transforms: tuple = (), distances: tuple[int, ...] = (2,), cache_bits: int = 0, tile: int = 0) -> bytes:
    """A lossless WebP file.  ``transforms`` are (kind, image, tile bits) in the order applied: modes, cross-colour elements, None, or a palette."""
    height, width = argb.shape
    if not (0 < width <= 1 << 14 and 0 < height <= 1 << 14):
        raise ValueError("an image has 1 to 16,384 rows and columns")
    w = Writer()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (int(bool(((argb >> np.uint32(24)) != 255).any())), 1), (0, 3)):
        w.put(value, n)
    for kind, image, bits in transforms:
        w.put(1 | kind << 1, 3)
        if kind == PREDICTOR:
            w.put(bits - 2, 3)
            argb = do_predictor(argb, image, bits)
            write_image(w, (image.astype(np.uint32) << np.uint32(8)) | np.uint32(0xFF000000), False)
        elif kind == CROSS_COLOUR:
            w.put(bits - 2, 3)
            argb = cross(argb, image, bits, False)
            write_image(w, image, False)
        elif kind == SUBTRACT_GREEN:
            argb = add_green(argb, -1)
        else:
            w.put(len(image) - 1, 8)
            parts = channels(image)
            write_image(w, joined(np.diff(parts, axis=0, prepend=np.zeros((1, 4), np.int32)))[None], False)
            order = np.argsort(image)
            index = order[np.searchsorted(image[order], argb)]
            shrink = bundle_bits(len(image))
            each = 8 >> shrink
            index = np.pad(index, ((0, 0), (0, -width % (1 << shrink)))).reshape(height, -1, 1 << shrink)
            argb = (np.uint32(0xFF000000) | ((index << (each * np.arange(1 << shrink))).sum(axis=2) << 8).astype(np.uint32)).astype(np.uint32)
    w.put(0, 1)
    write_image(w, argb, True, distances, cache_bits, tile)
    data = w.value
    pad = b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(data) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data + pad


# ---- grey images of bytes

ROW = 64


def shape_of(n: int) -> tuple[int, int]:
    """Height and width of the image of n samples (a multiple of 64): rows of 64, wider where more than 16,384 rows were needed."""
    width = ROW
    while n > width << 14:
        width *= 2
    return ceil_div(n, width), width


def encode_bytes(samples: bytes) -> bytes:
    """Stores 8-bit samples as a grey image: by palette with bundling for up to 16 values, else by subtract-green."""
    height, width = shape_of(len(samples))
    grey = np.zeros(height * width, dtype=np.uint32)
    grey[: len(samples)] = np.frombuffer(samples, dtype=np.uint8)
    grey = (np.uint32(0xFF000000) | grey * np.uint32(0x00010101)).reshape(height, width)
    present = np.flatnonzero(np.bincount(np.frombuffer(samples, np.uint8), minlength=256)).astype(np.uint32)
    if len(present) <= 16:
        if height * width > len(samples) and present[0]:
            present = np.concatenate([np.zeros(1, np.uint32), present])
        return encode(grey, ((PALETTE, np.uint32(0xFF000000) | present * np.uint32(0x00010101), 0),))
    return encode(grey, ((SUBTRACT_GREEN, None, 0),))


def decode_bytes(media: bytes, n: int) -> np.ndarray:
    """The first n samples of a stored grey image."""
    return ((decode(media) >> np.uint32(8)) & np.uint32(255)).astype(np.uint8).ravel()[:n]
