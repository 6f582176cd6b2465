"""Media columns: payloads stored as lossless WebP images, and features of the images read back.

`store` turns the UTF-8 bytes of a text, padded with zeros to a positive
multiple of 64, into 8-bit grey samples, row by row, and stores the image file
in a binary column.  `pixels` decodes stored files to pixel arrays, and
`features` computes what later stages need without keeping the pixels.

Defined cases: null and empty texts are one row of 64 zeros; equal texts give
equal files and features; a text of more than 256 MiB is refused by the
format's size; an unreadable file stops the task; empty tables give empty
results.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marketloom.llm import webp
from marketloom.llm.frames import pick
from marketloom.llm.store import materialise
from marketloom.llm.words import buffers, slices

STEP = 64


def padded(data: bytes) -> bytes:
    """With zeros up to a positive multiple of 64."""
    return data + b"\0" * (-len(data) % STEP if data else STEP)


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, media) of every row, written in the shared folder."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                data, offsets = buffers(batch.column(1))
                raw, at = data.tobytes(), offsets.tolist()
                sizes = np.diff(offsets)
                payloads = [padded(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                media = pa.array([webp.encode_bytes(p) for p in payloads], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array([len(p) for p in payloads], pa.int64()), media], ["doc_id", "n_bytes", "payload_bytes", "media"])

    return materialise(pick(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, media binary"), "media")


def describe(grey: np.ndarray) -> str:
    """Size, mean, entropy, mean step between neighbours, and a 64-bit average hash of grey samples (rows of 64)."""
    n = len(grey)
    counts = np.bincount(grey, minlength=256)
    p = counts[counts > 0] / n
    mean = float(counts @ np.arange(256)) / n
    steps = float(np.abs(np.diff(grey.astype(np.int16))).mean()) if n > 1 else 0.0
    blocks = np.add.reduceat(grey.astype(np.int64), np.arange(64) * n // 64) / (n // 64)
    bits = int("".join("1" if b > mean else "0" for b in blocks.tolist()), 2)
    return f"{n // STEP}x{STEP} mean={mean:.3f} entropy={max(0.0, float(-(p * np.log2(p)).sum())):.3f} step={steps:.3f} hash={bits:016x}"


def features(stored: DataFrame) -> DataFrame:
    """Reads every stored image back: digests of its samples and of the file, and its features."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids, n, size, media = batch.columns
                out = []
                for file, length in zip(media.to_pylist(), size.to_pylist(), strict=True):
                    grey = webp.decode_bytes(file, length)
                    back = grey.tobytes()
                    out.append((hashlib.sha256(back).hexdigest(), zlib.crc32(back[-STEP:]), len(file), hashlib.sha256(file).hexdigest(), describe(grey)))
                columns = list(zip(*out, strict=True)) if out else [[]] * 5
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([ids, n, size, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return stored.select("doc_id", "n_bytes", "payload_bytes", "media").mapInArrow(run, schema)


def pixels(stored: DataFrame, media: str = "media") -> DataFrame:
    """Adds the decoded ARGB pixels of any lossless WebP file: (height, width, argb row by row)."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # one image at a time
                row = batch.slice(i, 1)
                file = row.column(row.schema.get_field_index(media))[0].as_py()
                image = None if file is None else webp.decode(file)
                value = None if image is None else {"height": image.shape[0], "width": image.shape[1], "argb": image.ravel().view(np.int32)}
                kind = pa.struct([("height", pa.int32()), ("width", pa.int32()), ("argb", pa.list_(pa.int32()))])
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([value], kind)], [*row.schema.names, "pixels"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema)
    return stored.mapInArrow(run, f"{schema}, pixels struct<height:int,width:int,argb:array<int>>")
