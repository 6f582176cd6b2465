"""WARC archives: one gzip member per record, written and read sequentially.

Writing groups records into archives of about ``archive_bytes``; an archive is
one binary value of a table in the shared folder (`export` writes plain
``.warc.gz`` files where a mounted path is at hand).  Reading inflates members
incrementally, frames each record by its Content-Length, and verifies block
and payload digests.

Of records with equal payloads of ``least`` bytes or more, the one with the
largest id is stored as response and the others as revisits of it.  Digests
are grouped with partial aggregates and joined back without the payloads'
bytes as keys; a digest that very many rows share is split by the engine's
skew join.

Defined cases: a null payload is empty; a null id is written as ``null`` and
never a revisit's target; rows that repeat a group's largest id are all
responses; a group of null ids only is all responses; empty tables give no
archive.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.store import materialise

RECORD_SQL = "page_id bigint, record_type string, url string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary, verified boolean"
CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # fixed, so that archives are reproducible


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record with its closing blank lines, not compressed.

    ``refers_to`` makes it a revisit: its block has the HTTP headers only, and
    ``digest`` and the HTTP Content-Length still speak of the whole payload.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = "".join(c if 33 <= ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {DATE}", *([f"WARC-Target-URI: {uri}"] if uri else [])]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: {digest}", f"WARC-Block-Digest: {_sha1(block)}", f"Content-Length: {len(block)}"]
    return CRLF.join(x.encode() for x in head) + CRLF * 2 + block + CRLF * 2


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member without a time stamp."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Members:
    """Inflates gzip members one after another from chunks of an archive, in pieces of bounded size."""

    def __init__(self, chunks: Iterator[bytes], piece: int = 1 << 16):
        self.chunks, self.rest, self.piece = iter(chunks), b"", piece

    def __iter__(self) -> Iterator[Iterator[bytes]]:
        while self._more():
            yield self._member()

    def _more(self) -> bool:
        while not self.rest:
            got = next(self.chunks, None)
            if got is None:
                return False
            self.rest = got
        return True

    def _member(self) -> Iterator[bytes]:
        z = zlib.decompressobj(31)
        while not z.eof:
            if not self._more():
                raise ValueError("archive ends inside a gzip member")
            out = z.decompress(self.rest, self.piece)
            self.rest = z.unused_data if z.eof else z.unconsumed_tail
            if out:
                yield out


class Framed:
    """Lines and counted bytes from pieces of one member."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.buffer = pieces, bytearray()

    def line(self) -> bytes:
        while (at := self.buffer.find(CRLF)) < 0:
            got = next(self.pieces, None)
            if got is None:
                raise ValueError("record ends inside a header")
            self.buffer += got
        out = bytes(self.buffer[:at])
        del self.buffer[: at + 2]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            got = next(self.pieces, None)
            if got is None:
                raise ValueError("record is shorter than its Content-Length")
            self.buffer += got
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def end(self) -> None:
        for got in self.pieces:
            self.buffer += got
        if self.buffer != CRLF * 2:
            raise ValueError("record is longer than its Content-Length")


def headers(framed: Framed) -> dict[str, str]:
    out = {}
    while text := framed.line():
        name, _, value = text.decode().partition(":")
        out[name.lower()] = value.strip()
    return out


def read_records(chunks: Iterator[bytes]) -> Iterator[dict]:
    """The records of an archive in order, each checked against its lengths and digests."""
    for pieces in Members(chunks):
        framed = Framed(pieces)
        if framed.line() != b"WARC/1.1":
            raise ValueError("not a WARC/1.1 record")
        head = headers(framed)
        block = framed.take(int(head["content-length"]))
        framed.end()
        http = Framed(iter([block]))
        http.line()
        length = int(headers(http)["content-length"])
        payload = bytes(http.buffer)
        revisit = head["warc-type"] == "revisit"
        good = head["warc-block-digest"] == _sha1(block) and (revisit or (len(payload) == length and head["warc-payload-digest"] == _sha1(payload)))
        page = head["warc-record-id"].removeprefix("<urn:page:").removesuffix(">")
        refers = head.get("warc-refers-to", "").removeprefix("<urn:page:").removesuffix(">")
        yield {
            "page_id": None if page == "null" else int(page),
            "record_type": head["warc-type"],
            "url": head.get("warc-target-uri"),
            "payload_bytes": length,
            "payload_digest": base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex(),
            "refers_to": int(refers) if refers else None,
            "payload": None if revisit else payload,
            "verified": good,
        }


def assign(pages: DataFrame, least: int = 1000) -> DataFrame:
    """(page_id, url, html, digest, refers_to): which page each record revisits, null for responses."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("html")).withColumn("digest", F.sha1("html")).withColumn("n", F.length("html"))
    large = rows.where(F.col("n") >= least)
    target = large.groupBy("digest").agg(F.max("page_id").alias("target"), F.count("*").alias("copies")).where("copies > 1").select(F.col("digest").alias("key"), "target")
    # a small payload has no group: its key is its own id, which spreads such rows evenly
    key: Column = F.when(F.col("n") >= least, F.col("digest")).otherwise(F.concat(F.lit("page "), F.coalesce(F.col("page_id").cast("string"), F.col("url"), F.lit(""))))
    joined = rows.withColumn("key", key).join(target, "key", "left")
    refers = F.when(F.col("target") != F.coalesce(F.col("page_id"), F.col("target") - 1), F.col("target"))
    return joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def _write(archive_bytes: int, level: int):
    def run(batches):
        parts, size = [], 0
        for batch in batches:
            for page, url, html, digest, refers in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                parts.append(member(record(page, url, html, "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(), refers), level))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary()), pa.array([len(parts)], pa.int64())], ["archive", "records"])
                    parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary()), pa.array([len(parts)], pa.int64())], ["archive", "records"])

    return run


def write(pages: DataFrame, least: int = 1000, archive_bytes: int = 8 << 20, level: int = 6) -> DataFrame:
    """Writes pages (page_id, url, html) into archives of about ``archive_bytes``: a stored table (archive, records)."""
    rows = assign(pages, least).select("page_id", "url", "html", "digest", "refers_to")
    return materialise(rows.mapInArrow(_write(archive_bytes, level), "archive binary, records bigint"), "warc")


def read(archives: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """The records of all archives in column ``archive`` (of `write`, or of files read as binaryFile)."""

    def run(batches):
        kind = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("verified", pa.bool_())])
        for batch in batches:
            for value in batch.column(0):
                data = memoryview(value.as_buffer())
                rows, size = [], 0
                for r in read_records(bytes(data[i : i + chunk]) for i in range(0, len(data), chunk)):
                    rows.append(r)
                    size += r["payload_bytes"]
                    if size > 1 << 21:
                        yield pa.RecordBatch.from_pylist(rows, kind)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, kind)

    return archives.select("archive").mapInArrow(run, RECORD_SQL)


def export(archives: DataFrame, folder: str) -> DataFrame:
    """Writes each archive as a ``.warc.gz`` file below a path that all executors mount; returns path and records."""

    def run(batches):
        import pathlib

        for batch in batches:
            names = []
            for data in batch.column(0).to_pylist():
                at = pathlib.Path(folder) / f"{hashlib.sha1(data).hexdigest()}.warc.gz"
                at.write_bytes(data)
                names.append(str(at))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), batch.column(1)], ["path", "records"])

    return archives.select("archive", "records").mapInArrow(run, "path string, records bigint")
