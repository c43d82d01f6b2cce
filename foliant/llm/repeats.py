"""Repeated-substring removal: every byte that a repeated 200-byte string covers.

A string counts as repeated if it starts anywhere else, in the same document or
another.  Each window of ``LENGTH`` bytes has an anchor: the least hash among its
``GRAM``-byte grams, the leftmost of equals.  Equal windows have equal anchors at the
same offset, so windows can only be equal if their anchors' grams are.  Consecutive
windows with one anchor are a run, and runs, about one in ninety bytes, are what is
shuffled:

1. Runs whose anchor's gram occurs once hold no repeated window.
2. A run whose whole text (all its windows) occurs again is repeated throughout.
3. What is left are runs that differ from all others of their gram: where copies begin
   and end, or were edited.  For these grams each distinct run sends its bytes once,
   and its windows are compared by offset and hash.  Grams with more than ``CROWD``
   distinct runs are compared by a distributed aggregation over single windows instead
   of in one task.

Equality is decided on a window's 64-bit hash together with its anchor's 64-bit gram
hash and the offset.

Null and empty texts have no bytes; texts shorter than a window lose nothing.  A row is
known by its id and its text's hash, so rows with equal ids are told apart by their
texts; rows equal in both are copies of each other.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textbatch as tb
from .shared import written

LENGTH = 200
GRAM = 24
CROWD = 200
BLOCK = 16
#: Bytes of text looked at together; the temporaries take about a hundred times as much.
SLICE = 1 << 19
_ROW = ["doc_id", "h"]


_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _tables(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, SLICE + 1)
        with np.errstate(over="ignore"):
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]), dtype=np.uint64)
            _inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, inverse)]), dtype=np.uint64)


class Prefix:
    """Prefix sums over a slice's bytes, from which the hash of any byte range follows.

    A polynomial modulo 2^64 over the bytes: ranges of about a thousand bytes can be made to collide whatever its base, but
    none here is longer than two windows."""

    def __init__(self, data: np.ndarray):
        _tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return tb.mix((self.sums[end] - self.sums[start]) * _inverse[start])


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive entries, by minima from both ends of blocks of w."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    blocks = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def runs(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Of each run: row, anchor, first and last window start (places in the row), hash of the gram, hash of the whole run."""
    none = np.zeros(0, np.int64)
    size = np.diff(off)
    if not len(data) or size.max() < length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    prefix = Prefix(data)
    at = np.arange(len(data) - gram + 1)
    bits = np.uint64(int(len(data)).bit_length())
    packed = prefix(at, at + gram) >> bits << bits | at.astype(np.uint64)
    least = sliding_least(packed, length - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))
    full = np.flatnonzero(size >= length)
    many = size[full] - length + 1
    row = np.repeat(full, many)
    start = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + off[row]
    anchor = least[start].astype(np.int64)
    new = np.ones(len(row), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    row, a, lo, hi = row[first], anchor[first], start[first], start[last]
    with np.errstate(over="ignore"):
        shape = (a - lo).astype(np.uint64) * np.uint64(1009) + (hi - lo).astype(np.uint64)
        whole = tb.mix(prefix(lo, hi + length) + shape * _BASE)
    return row, a - off[row], lo - off[row], hi - off[row], prefix(a, a + gram), whole


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def find_runs(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    def run(part):
        row, a, lo, hi, key, whole = runs(*tb.raw(part.column(2)), length)
        take = pa.array(row)
        return pa.record_batch([part.column(0).take(take), part.column(1).take(take), *(pa.array(x.astype(np.int32)) for x in (a, lo, hi)), _signed(key), _signed(whole)], names=["doc_id", "h", "a", "lo", "hi", "key", "whole"])

    return tb.mapped(rows, run, "doc_id long, h long, a int, lo int, hi int, key long, whole long", ("doc_id", "h", "text"), most=SLICE)


def _windows(context: list[bytes], first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of runs given by their bytes: the run's number, the offset to the anchor, the hash.  ``first``: the first window's offset."""
    data = np.frombuffer(b"".join(context), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(c) for c in context])]).astype(np.int64)
    many = np.diff(off) - length + 1
    which = np.repeat(np.arange(len(context)), many)
    inner = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
    start = off[which] + inner
    return which, first[which] - inner, Prefix(data)(start, start + length)


def _stretches(which: np.ndarray, offset: np.ndarray, first: np.ndarray, lo: np.ndarray):
    """Runs of consecutive windows: number of the run they belong to, first and last window start."""
    if not len(which):
        return which, which, which
    start = lo[which] + first[which] - offset
    new = np.concatenate([[True], (np.diff(which) != 0) | (np.diff(start) != 1)])
    at = np.flatnonzero(new)
    return which[at], start[at], start[np.append(at[1:], len(which)) - 1]


def repeated_spans(rows: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """(doc_id, h, lo, hi): stretches of starts of repeated windows.  ``rows`` has doc_id, h, text."""
    every = written(find_runs(rows, length), "runs")
    keys = every.groupBy("key").agg(F.count("*").alias("n"), (F.min("whole") != F.max("whole")).alias("mixed")).filter("n > 1").select("key", "mixed")
    keys = written(keys, "repeated-grams")  # so that the join's sides are both dealt anew and a hot gram can be split
    again = written(every.join(keys, "key"), "repeated-runs")
    same = again.filter("NOT mixed").select(*_ROW, "lo", "hi")
    mixed = again.filter("mixed").drop("mixed")
    wholes = written(mixed.groupBy("key", "whole").agg(F.count("*").alias("n"), F.min(F.struct(*_ROW, "a", "lo", "hi")).alias("rep")), "whole-runs")
    same = same.unionByName(mixed.join(wholes.filter("n > 1").select("key", "whole"), ["key", "whole"]).select(*_ROW, "lo", "hi"))

    # grams with a run that occurs once: their distinct runs send their bytes
    crowds = wholes.groupBy("key").agg(F.count("*").alias("d"), F.sum((F.col("n") == 1).cast("int")).alias("alone")).filter("d > 1 AND alone > 0")
    asked = wholes.join(crowds, "key").select("key", "rep.*", (F.col("n") == 1).alias("alone"), (F.col("d") > crowd).alias("crowded"))
    lists = asked.groupBy(*_ROW).agg(F.collect_list(F.struct("key", "a", "lo", "hi", "alone", "crowded")).alias("asked"))
    met = rows.join(lists.hint("shuffle_hash"), [rows.doc_id.eqNullSafe(lists.doc_id), rows.h == lists.h]).select(rows.doc_id, rows.h, rows.text, "asked")

    def send(batches):
        for part in tb.slices(batches):
            out = []
            for doc, h, text, asked in zip(*(part.column(k).to_pylist() for k in (0, 1)), part.column(2).cast(pa.binary()).to_pylist(), part.column(3).to_pylist()):
                out += [(x["key"], doc, h, x["a"], x["lo"], x["alone"], x["crowded"], text[x["lo"] : x["hi"] + length]) for x in asked]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), sent)] if out else [pa.array([], f.type) for f in sent], schema=sent)

    sent = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("h", pa.int64()), ("a", pa.int32()), ("lo", pa.int32()), ("alone", pa.bool_()), ("crowded", pa.bool_()), ("bytes", pa.binary())])
    contexts = written(met.mapInArrow(send, "key long, doc_id long, h long, a int, lo int, alone boolean, crowded boolean, bytes binary"), "contexts")

    few = contexts.filter("NOT crowded")
    detail = few.groupBy("key").applyInArrow(lambda t: pa.Table.from_batches(list(_compared(t, length)), _SPAN), "doc_id long, h long, lo int, hi int")

    return same.unionByName(detail).unionByName(_crowded(contexts.filter("crowded"), length))


def _blocks(t: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """Runs cut into blocks of ``BLOCK`` windows, aligned by their offset to the anchor.

    All windows of a block hold its core; a window is the core with ``BLOCK`` - 1 bytes in a row of the block's edges, those before and after the core."""
    a, lo = t.column(3).to_numpy().astype(np.int64), t.column(4).to_numpy().astype(np.int64)
    data, off = tb.raw(t.column(6))
    hi = lo + np.diff(off) - length
    first, last = (a - hi) // BLOCK, (a - lo) // BLOCK
    many = last - first + 1
    run = np.repeat(np.arange(len(a)), many)
    b = first[run] + np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many)
    start = a[run] - (BLOCK * b + BLOCK - 1)
    at = off[run] - lo[run]
    edge = BLOCK - 1
    core = Prefix(data)(start + edge + at, start + length + at)
    place = np.concatenate([np.arange(edge), length + np.arange(edge)])[None, :] + start[:, None]
    inside = (place >= lo[run][:, None]) & (place < (hi[run] + length)[:, None])
    edges = np.where(inside, data[np.clip(place + at[:, None], 0, len(data) - 1)], 0).astype(np.uint8)
    packed = pa.Array.from_buffers(pa.binary(), len(run), [None, pa.py_buffer((np.arange(len(run) + 1) * 2 * edge).astype(np.int32)), pa.py_buffer(edges)])
    take = pa.array(run)
    low, high = np.maximum(0, lo[run] - start), np.minimum(edge, hi[run] - start)
    numbers = [pa.array(x.astype(np.int32)) for x in (b, start, low, high)]
    return pa.record_batch([t.column(0).take(take), _signed(core), packed, *numbers, *(t.column(k).take(take) for k in (1, 2, 5))], names=["key", "core", "edges", "b", "start", "low", "high", "doc_id", "h", "alone"])


_SPLIT = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("doc_id", pa.int64()), ("h", pa.int64()), ("a", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("alone", pa.bool_()), ("bytes", pa.binary())])


def _against_representatives(contexts: DataFrame, length: int) -> DataFrame:
    """Each gram has one or two representatives, the runs whose bytes after or before the anchor are the most frequent.

    kind 0: windows of a run that a representative has too, and those of the representative; kind 1: the rest of a run, as a context of its own."""
    me = F.struct(*_ROW, "a", "lo", "alone", "bytes")
    at = F.col("a") - F.col("lo")
    half = length // 2
    sides = F.array(F.struct(F.lit("after").alias("side"), F.xxhash64(F.substring("bytes", at + 1, F.lit(half))).alias("x")), F.struct(F.lit("before").alias("side"), F.when(at >= half, F.xxhash64(F.substring("bytes", at - half + 1, F.lit(half)))).otherwise(F.lit(0)).alias("x")))
    often = contexts.select("key", me.alias("me"), F.explode(sides).alias("s")).groupBy("key", "s.side", "s.x").agg(F.count("*").alias("n"), F.min("me").alias("me"))
    reps = written(often.groupBy("key", "side").agg(F.max_by("me", "n").alias("me")).groupBy("key").agg(F.collect_set("me").alias("reps")), "representatives")
    met = contexts.join(reps, "key")

    def run(batches):
        for part in tb.slices(batches, "bytes", SLICE):
            out, shown = [], set()
            for key, doc, h, a, lo, alone, mine, reps in zip(*(c.to_pylist() for c in part.columns)):
                others = [r for r in reps if (r["doc_id"], r["h"], r["a"]) != (doc, h, a)]
                at, hi = a - lo, lo + len(mine) - length
                data, cover = np.frombuffer(mine, np.uint8), []
                for r in others:
                    there, rat = np.frombuffer(r["bytes"], np.uint8), r["a"] - r["lo"]
                    n, m = min(at, rat), min(len(data) - at, len(there) - rat)
                    left, right = np.flatnonzero(data[at - n : at][::-1] != there[rat - n : rat][::-1]), np.flatnonzero(data[at : at + m] != there[rat : rat + m])
                    left, right = (int(x[0]) if len(x) else k for x, k in ((left, n), (right, m)))
                    first, last = max(lo, a - left), min(hi, a + right - length)
                    if first <= last:
                        cover.append((first, last))
                        shown.add((key, r["doc_id"], r["h"], r["a"], r["a"] - (a - first), r["a"] - (a - last), r["alone"]))
                at = lo
                for first, last in sorted(cover):
                    out.append((0, key, doc, h, a, first, last, alone, None))
                    if at < first and len(others) == len(reps):
                        out.append((1, key, doc, h, a, at, first - 1, alone, mine[at - lo : first - 1 + length - lo]))
                    at = max(at, last + 1)
                # what a representative has left is nowhere else: the others are compared with it
                if at <= hi and len(others) == len(reps):
                    out.append((1, key, doc, h, a, at, hi, alone, mine[at - lo :]))
            out += [(0, key, doc, h, a, first, last, alone, None) for key, doc, h, a, first, last, alone in shown]
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), _SPLIT)], schema=_SPLIT)

    rows = met.select("key", *_ROW, "a", "lo", "alone", "bytes", "reps").mapInArrow(run, "kind int, key long, doc_id long, h long, a int, lo int, hi int, alone boolean, bytes binary")
    return written(rows, "crowds")


def _crowded(contexts: DataFrame, length: int) -> DataFrame:
    """Spans in the lonely runs of crowded grams: what agrees with a representative, then the rest among itself.

    A window that differs from the representative's can only equal windows that differ from it too.  The rest is compared
    by aggregations over blocks of windows that get smaller where they differ.  Blocks with one core are the same throughout, or differ in their edges; the latter are cut into blocks of a quarter of the windows, whose cores take in the bytes that their windows share."""
    keep = ["start", "low", "high", *_ROW, "alone"]
    split = _against_representatives(contexts, length)
    known, contexts = split.filter("kind = 0 AND alone").select(*_ROW, "lo", "hi"), split.filter("kind = 1")
    blocks = tb.mapped(contexts, lambda t: _blocks(t, length), "key long, core long, edges binary, b int, start int, low int, high int, doc_id long, h long, alone boolean", ("key", "doc_id", "h", "a", "lo", "alone", "bytes"), "bytes", SLICE)
    rows = blocks.select(F.xxhash64("key", "b").alias("place"), "core", "edges", *keep)
    spans, size = [known], BLOCK
    while True:
        rows = written(rows, f"blocks-{size}")
        shape = F.xxhash64("edges", "low", "high")
        met = written(rows.groupBy("place", "core").agg(F.count("*").alias("n"), (F.min(shape) != F.max(shape)).alias("mixed")).filter("n > 1").drop("n"), "block-counts")
        again = rows.join(met, ["place", "core"])
        spans.append(again.filter("alone AND NOT mixed").select(*_ROW, (F.col("start") + F.col("low")).alias("lo"), (F.col("start") + F.col("high")).alias("hi")))
        if size == 1:
            break
        small = size // 4
        edge = F.lit(size - 1)
        first = F.col("j") * small
        last = first + (small - 1)
        part = again.filter("mixed").withColumn("j", F.explode(F.sequence(F.floor(F.col("low") / small), F.floor(F.col("high") / small))))
        rows = part.select(
            F.xxhash64("place", "j").alias("place"),
            F.xxhash64("core", F.substring("edges", (last + 1).cast("int"), (edge + first - last).cast("int"))).alias("core"),
            F.concat(F.substring("edges", (first + 1).cast("int"), F.lit(small - 1)), F.substring("edges", (edge + first + 1).cast("int"), F.lit(small - 1))).alias("edges"),
            (F.col("start") + first).cast("int").alias("start"),
            F.greatest(F.lit(0), F.col("low") - first).cast("int").alias("low"),
            F.least(F.lit(small - 1), F.col("high") - first).cast("int").alias("high"),
            *_ROW, "alone",
        )
        size = small
    out = spans[0]
    for x in spans[1:]:
        out = out.unionByName(x)
    return out


_SPAN = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])


def _compared(t: pa.Table, length: int):
    a, lo, alone = (t.column(c).to_numpy() for c in ("a", "lo", "alone"))
    which, offset, hashes = _windows(t.column("bytes").to_pylist(), a - lo, length)
    with np.errstate(over="ignore"):
        hit = tb.repeated(hashes + offset.astype(np.uint64) * _BASE) & alone.astype(bool)[which]
    run, first, last = _stretches(which[hit], offset[hit], a - lo, lo)
    take = pa.array(run)
    yield pa.record_batch([t.column("doc_id").combine_chunks().take(take), t.column("h").combine_chunks().take(take), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], schema=_SPAN)


def _merged(spans, length: int, n: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for x in sorted((s["lo"], s["hi"]) for s in spans or ()):
        if out and x[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x[1] + length)
        else:
            out.append([x[0], x[1] + length])
    return out


def remove_repeats(documents: DataFrame, length: int = LENGTH, crowd: int = CROWD, keep_text: bool = False) -> DataFrame:
    """A row per document: n_bytes, n_removed, n_spans, kept_sha256; and with ``keep_text`` the bytes that stay."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).select("doc_id", "h", "text")
    lists = repeated_spans(rows, length, crowd).groupBy(*_ROW).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    lists = written(lists, "spans").hint("shuffle_hash")
    met = rows.join(lists, [rows.doc_id.eqNullSafe(lists.doc_id), rows.h == lists.h], "left").select(rows.doc_id, rows.text, "spans")

    def run(part):
        out = []
        for text, spans in zip(part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist()):
            cut = _merged(spans, length, len(text))
            kept, at = [], 0
            for a, b in cut:
                kept.append(text[at:a])
                at = b
            kept = b"".join([*kept, text[at:]])
            out.append((len(text), len(text) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), kept))
        cols = list(zip(*out))
        arrays = [part.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3])]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        return pa.record_batch(arrays + [pa.array(cols[4], pa.binary())] * keep_text, names=names + ["kept"] * keep_text)

    return tb.mapped(met, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text, ("doc_id", "text", "spans"))
