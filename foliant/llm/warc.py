"""WARC archives: one gzip member per record, written and read in sequence.

Payloads are equal if their SHA-1 and length are.  Of each group of equal payloads of
at least ``min_bytes`` bytes, the record with the largest page id is a response and the
others are revisit records that refer to it; they carry no payload, but its digest and
length.  The reader decompresses incrementally, frames records by Content-Length and
holds each response's payload against its digest.

Null pages have an empty payload.  Rows with one id and one payload are all of one
kind: responses if the id is the group's largest.  A null id is less than any other
and written as ``null``; a group of null ids alone is all responses.  Other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import textbatch as tb
from .shared import filesystem, fresh, put, written

CHUNK = 1 << 16
FILE_BYTES = 64 << 20
LEVEL = 1
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MOST_HEADER = 1 << 20


class WarcError(ValueError):
    pass


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, uri: str, payload: bytes, full: tuple[int, str], more: dict[str, str], level: int = LEVEL) -> bytes:
    """One record as a gzip member.  ``full``: length and digest of the full payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % full[0]
    if kind == "response":
        block += payload
    uri = uri.replace("\r", "%0D").replace("\n", "%0A")
    head = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": DATE, "WARC-Target-URI": uri, "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{full[1]}", "WARC-Block-Digest": f"sha1:{digest(block)}", **more, "Content-Length": str(len(block))}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(text.encode() + block + b"\r\n\r\n") + squeeze.flush()


def _members(stream) -> Iterator[Iterator[bytes]]:
    """The gzip members of a stream, each as an iterator of decompressed pieces that has to be used up."""
    rest = b""

    def member():
        nonlocal rest
        inflate = zlib.decompressobj(31)
        while not inflate.eof:
            rest = rest or stream.read(CHUNK)
            ended = not rest
            piece = inflate.decompress(rest, CHUNK)
            rest = inflate.unconsumed_tail or inflate.unused_data
            if piece:
                yield piece
            elif ended and not inflate.eof:
                raise WarcError("the archive ends inside a record")

    while rest or (rest := stream.read(CHUNK)):
        yield member()


class _Block:
    """Reads headers and exact lengths from an iterator of pieces."""

    def __init__(self, pieces: Iterator[bytes], most_header: int | None = MOST_HEADER):
        self.pieces, self.held, self.most = pieces, b"", most_header

    def line(self) -> bytes:
        held, at = bytearray(self.held), 0
        while (end := held.find(b"\r\n", at)) < 0:
            if self.most is not None and len(held) > self.most:
                raise WarcError("a header line is too long")
            piece = next(self.pieces, None)
            if piece is None:
                raise WarcError("a record ends inside its header")
            at = max(0, len(held) - 1)
            held += piece
        self.held = bytes(held[end + 2 :])
        return bytes(held[:end])

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and (piece := next(self.pieces, None)) is None:
                raise WarcError("a record is shorter than its Content-Length")
            elif not self.held:
                self.held = piece
            out, self.held = self.held[:n], self.held[n:]
            n -= len(out)
            yield out

    def header(self) -> dict[str, str]:
        out = {}
        while line := self.line():
            k, _, v = line.partition(b":")
            out[k.strip().decode().lower()] = v.strip().decode()
        return out


def read(stream, most_header: int | None = MOST_HEADER) -> Iterator[tuple[dict[str, str], int | None, str | None]]:
    """Of each record: its header, and its payload's length and digest (None for a revisit).

    Raises WarcError where framing, block digest or payload digest do not hold, or a header line is longer than
    ``most_header`` (None: no limit, for archives written here).  Holds one piece of a record, or a header line, at a time."""
    for pieces in _members(stream):
        block = _Block(pieces, most_header)
        if block.line() not in (b"WARC/1.0", b"WARC/1.1"):
            raise WarcError("no WARC version line")
        head = block.header()
        whole = hashlib.sha1()
        left = int(head["content-length"])
        body = block.take(left)
        inner, payload, n = b"", hashlib.sha1(), 0
        open_head = True
        for piece in body:
            whole.update(piece)
            if open_head:
                inner += piece
                if b"\r\n\r\n" in inner:
                    open_head = False
                    piece = inner.split(b"\r\n\r\n", 1)[1]
                elif len(inner) > MOST_HEADER:
                    raise WarcError("no end of the HTTP header")
                else:
                    continue
            payload.update(piece)
            n += len(piece)
        if b"".join(block.take(4)) != b"\r\n\r\n" or block.held or next(pieces, None) is not None:
            raise WarcError("a record is longer than its Content-Length")
        if (want := head.get("warc-block-digest")) and want != "sha1:" + base64.b32encode(whole.digest()).decode():
            raise WarcError(f"block digest of {head.get('warc-record-id')} does not hold")
        got = base64.b32encode(payload.digest()).decode()
        if head["warc-type"] == "revisit":
            yield head, None, None
        elif (want := head.get("warc-payload-digest")) and want != f"sha1:{got}":
            raise WarcError(f"payload digest of {head.get('warc-record-id')} does not hold")
        else:
            yield head, n, got


def _id(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(record_id: str) -> int | None:
    text = record_id.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "null" else int(text)


def deduplicated(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The pages with ``refers_to``: null for responses.

    The groups' largest ids are found on digests alone, after partial aggregation; only groups of two rows or more are joined back. """
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumns({"sha": F.unhex(F.sha1("html")), "size": F.octet_length("html").cast("long")})
    groups = keyed.filter(F.col("size") >= min_bytes).groupBy("sha", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("sha", "size", "first")
    return keyed.join(written(groups, "payload-groups"), ["sha", "size"], "left").select("page_id", "url", "html", F.when(F.col("page_id").isNull() | (F.col("first") > F.col("page_id")), F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the archives; returns their paths and numbers of records."""
    folder = folder or fresh(pages.sparkSession, "warc")

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def close():
            nonlocal held, size, seq
            path = f"{folder}/{part:08d}-{seq:06d}.warc.gz"
            put(path, held)
            row = pa.record_batch([pa.array([path]), pa.array([len(held)])], names=["path", "records"])
            held, size, seq = [], 0, seq + 1
            return row

        for batch in tb.slices(batches, "html"):
            for page, url, html, to in zip(*(c.to_pylist() for c in batch.columns)):
                payload = html.encode()
                full = len(payload), digest(payload)
                more = {"WARC-Profile": REVISIT, "WARC-Refers-To": _id(to), "WARC-Payload-Length": str(full[0])} if to is not None else {}
                held.append(record("revisit" if more else "response", _id(page), url or "", payload, full, more))
                size += len(held[-1])
                if size >= file_bytes:
                    yield close()
        if held:
            yield close()

    return written(deduplicated(pages, min_bytes).mapInArrow(run, "path string, records long"), "warc-files")


def read_archives(files: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of every record of the archives."""
    tasks = max(1, min(files.count(), int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()])))

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = filesystem(path)
                rows = []
                with store.open_input_stream(name, compression=None) as f:
                    for head, n, sha in read(f, None):
                        kind = head["warc-type"]
                        to = _page(head["warc-refers-to"]) if kind == "revisit" else None
                        if kind == "revisit":
                            n, sha = int(head["warc-payload-length"]), head["warc-payload-digest"].removeprefix("sha1:")
                        rows.append((_page(head["warc-record-id"]), head["warc-target-uri"], n, sha, kind, to))
                        if len(rows) >= 5000:
                            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return files.select("path").repartition(tasks, "path").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def report(records: DataFrame) -> DataFrame:
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
