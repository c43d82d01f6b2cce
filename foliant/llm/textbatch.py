"""Vectorised work on the UTF-8 bytes of Arrow string batches.

Everything here is per batch and bounded: a batch of rows is cut into slices of
a few MB of text (one row at least), and per-byte temporaries live only as long
as a slice.  Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_S32 = np.uint64(32)
#: Bits that keys of several numbers are packed into at most; beyond, they are numbered pair by pair.
KEY_BITS = 63


def table(inside: str | bytes | None = None, outside: bytes | None = None) -> np.ndarray:
    """A byte class as 256 booleans: the bytes ``inside`` or all but ``outside``."""
    lut = np.zeros(256, bool) if outside is None else np.ones(256, bool)
    lut[np.frombuffer(outside if outside is not None else inside, np.uint8)] = outside is None
    return lut


#: Words of the forms used by the operators: all but ASCII white space, and
#: ASCII letters and digits with everything beyond ASCII.
NON_SPACE = table(outside=bytes([0x20, *range(0x09, 0x0E)]))
WORDISH = table(outside=bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[off[0] : off[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has at most ``most`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        off = raw(batch.column(batch.schema.get_field_index(column)))[1]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def mapped(frame, fn: Callable, schema: str, columns: tuple[str, ...] = ("doc_id", "text"), text: str = "text", most: int = SLICE_BYTES):
    """``fn(record batch) -> record batch or None`` over slices of ``most`` bytes of some columns of a DataFrame."""

    def run(batches):
        for part in slices(batches, text, most):
            out = fn(part)
            if out is not None:
                yield out
        release()

    return frame.select(*(frame[c].cast("long") if c.endswith("_id") else frame[c] for c in columns)).mapInArrow(run, schema)


def rewritten(frame, fn: Callable, text: str = "text"):
    """The frame with ``fn(record batch) -> record batch`` of its own schema over bounded slices; all columns go along."""

    def run(batches):
        for part in slices(batches, text):
            yield fn(part)
        release()

    return frame.mapInArrow(run, frame.schema)


def release() -> None:
    """Hands freed memory back to the system: Spark keeps a Python worker for the stages that follow, and with it what it holds."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def text_of(part: pa.RecordBatch, text: str = "text") -> pa.Array:
    return part.column(part.schema.get_field_index(text))


def spans(data: np.ndarray, off: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of a byte class, which never cross rows, and the n + 1 run offsets by row."""
    m = lut[data]
    n = len(m)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1]
    last[:-1] &= ~m[1:]
    edge = off[:-1][off[:-1] < n]
    first[edge] = m[edge]
    edge = off[1:][off[1:] > 0] - 1
    last[edge] = m[edge]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _S32)) * _MIX
        h = (h ^ (h >> _S32)) * _MIX
        return h ^ (h >> _S32)


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct ones of some byte spans (ascending, none in another), and the number of each span among them: equal numbers are equal bytes."""
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts] = 1
    edge[ends] -= 1
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    coded = as_strings(np.compress(np.cumsum(edge[:-1], dtype=np.int8).view(bool), data), at, binary=True).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit XXH3 hashes of such spans; each distinct one is hashed once."""
    words, codes = distinct(data, starts, ends)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_pylist()), np.uint64, len(words))[codes]


def gram_codes(codes: np.ndarray, k: int) -> np.ndarray:
    """Equal numbers for equal runs of k numbers (0 or more) and for those alone; shorter input gives none.

    Runs are packed into one whole number where they fit it, and else numbered by doubling their length."""
    codes = codes.astype(np.int64, copy=False)
    if len(codes) < k:
        return codes[:0]
    bits = max(1, int(codes.max()).bit_length())
    if bits * k <= KEY_BITS:
        out = codes[: len(codes) - k + 1].copy()
        for j in range(1, k):
            out = out << bits | codes[j : len(codes) - k + 1 + j]
        return out
    out, size = codes, 1
    while size < k:
        step = min(size, k - size)
        out = np.unique(out[:-step] * (int(out.max()) + 1) + out[step:], return_inverse=True)[1]
        size += step
    return out


def keyed(rows: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs of a row and a code, and for those alone."""
    if not len(codes):
        return codes.astype(np.int64)
    bits = max(1, int(codes.max()).bit_length())
    if bits + max(1, int(rows.max()).bit_length()) > KEY_BITS:
        codes = np.unique(codes, return_inverse=True)[1]
        return rows.astype(np.int64) * (int(codes.max()) + 1) + codes
    return rows.astype(np.int64) << bits | codes


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive entries of h; shorter input gives none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    with np.errstate(over="ignore"):
        for j in range(1, k):
            out = out * _BASE + h[j : j + n]
    return mix(out)


def within(off: np.ndarray, k: int) -> np.ndarray:
    """Which of the k-grams over all rows' entries lie in one row: a mask over n - k + 1 places."""
    n = int(off[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    ok = np.ones(n, bool)
    inner = off[1:-1]
    for j in range(1, k):
        bad = inner - j
        ok[bad[(bad >= 0) & (bad < n)]] = False
    return ok


def rows_of(off: np.ndarray) -> np.ndarray:
    """Row number of each entry."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Per row, the sum of the entries."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which entries have an equal one."""
    out = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys)
        same = np.diff(keys[order]) == 0
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
    return out


def later(keys: np.ndarray) -> np.ndarray:
    """Which entries have an equal one before them."""
    out = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys, kind="stable")
        out[order[1:][np.diff(keys[order]) == 0]] = True
    return out


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places lie in [s, s + length) for a given s."""
    if length == 1 or not len(starts):
        out = np.zeros(n, bool)
        out[starts] = True
        return out
    step = np.zeros(n + length + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + length, -1)
    return np.cumsum(step[:n]) > 0


def ragged(values: np.ndarray, off: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists number ``codes`` of a ragged array, joined, and their offsets."""
    size = np.diff(off)[codes]
    at = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    index = np.arange(at[-1]) - np.repeat(at[:-1] - off[codes], size)
    return values[index], at


def as_strings(data: np.ndarray, off: np.ndarray, binary: bool = False) -> pa.Array:
    """A string array over bytes and offsets, without copying a row."""
    return pa.Array.from_buffers(pa.large_binary() if binary else pa.large_string(), len(off) - 1, [None, pa.py_buffer(np.ascontiguousarray(off, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
