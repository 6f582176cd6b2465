"""The codec against itself in every mode, and media columns against hashes."""

import hashlib
import zlib

import numpy as np
import pytest

from marketloom.llm import media, webp
from marketloom.llm.webp import CROSS_COLOUR, PALETTE, PREDICTOR, SUBTRACT_GREEN

rng = np.random.default_rng(0)
IMAGE = webp.joined((rng.integers(0, 4, (37, 45, 4)) * 20 + np.indices((37, 45)).sum(axis=0)[..., None]).astype(np.int32))


def again(image, **options):
    assert (webp.decode(webp.encode(image, **options)) == image).all(), options


@pytest.mark.parametrize("mode", range(14))
def test_predictor(mode):
    again(IMAGE, transforms=((PREDICTOR, np.full((10, 12), mode), 2),))


def test_modes_together():
    again(IMAGE)
    again(IMAGE, tile=3, cache_bits=5, distances=(1, 2, 3, 130))
    modes, elements = rng.integers(0, 14, (5, 6)), rng.integers(0, 2**24, (10, 12)).astype(np.uint32)
    again(IMAGE, transforms=((PREDICTOR, modes, 3), (CROSS_COLOUR, elements, 2), (SUBTRACT_GREEN, None, 0)), cache_bits=7, tile=2)


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 100, 256])
def test_palette(colours):
    palette = np.unique(rng.integers(0, 2**32, colours * 2).astype(np.uint32))[:colours]
    again(palette[rng.integers(0, len(palette), (20, 33))], transforms=((PALETTE, palette, 0),), cache_bits=3)


@pytest.mark.parametrize("data", [bytes(64), b"a" * 64, bytes(range(256)) * 4, b"ab" * 64_000, b"x" * (64 * 20_000), rng.integers(0, 256, 64 * 3000).astype(np.uint8).tobytes(), ("text of some kind " * 4000).encode()[: 64 * 1000]])
def test_bytes(data):
    assert webp.decode_bytes(webp.encode_bytes(data), len(data)).tobytes() == data


def test_both_paths_agree():
    """The stepwise reader of green images against the symbol reader."""
    data = bytes(rng.choice([32, 97, 98, 99, 100, 101, 0, 200, 201, 202, 203, 204, 205, 206, 207, 208, 209, 210], 6400).astype(np.uint8)) + bytes(64)
    file = webp.encode_bytes(data)
    fast = webp.decode(file)
    held, webp._read_green = webp._read_green, lambda bits, group, w, h: webp._read_symbols(bits, [group], None, 0, 0, w, h)
    try:
        assert (webp.decode(file) == fast).all()
    finally:
        webp._read_green = held


def test_broken_files():
    file = webp.encode_bytes(b"some text to store " * 64)
    for bad in (b"", file[:30], b"RIFX" + file[4:], file[: len(file) // 2]):
        with pytest.raises(ValueError):
            webp.decode(bad)


def test_media_columns(spark, docs, empty):
    stored = media.store(docs)
    rows = media.features(stored).collect()
    texts = [t or "" for t in sorted((r.text or "" for r in docs.select("text").collect()))]
    assert len(rows) == len(texts)
    want = {hashlib.sha256(media.padded(t.encode())).hexdigest(): t for t in texts}
    for r in rows:
        data = want[r.payload_sha256].encode()
        assert (r.n_bytes, r.payload_bytes) == (len(data), max(64, -(-len(data) // 64) * 64))
        assert r.tail_crc32 == zlib.crc32(media.padded(data)[-64:])
    twin = [r for r in rows if r.doc_id == 8]
    assert twin[0] == twin[1]
    first = media.pixels(stored.where("doc_id = 3")).first().pixels
    assert (first.height, first.width) == (1, 64) and len(first.argb) == 64
    assert media.features(media.store(empty)).count() == 0
