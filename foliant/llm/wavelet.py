"""A wavelet matrix over token ids: one bit plane per id bit, with rank and select.

The file: a fixed head, the documents' ids (those without one come first, and are
counted) and token counts, and each plane with its rank directory, cut into blocks that
are compressed one by one, so a lookup opens only the blocks it touches.  All of access,
rank, select, count and locate take and give arrays.

No ids and no documents make a file too.  A file that is cut short, or not one of these,
is refused with a ValueError, as are ids that need more bits than the file's.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

MAGIC = b"FOLIWM02"
HEAD = struct.Struct("<8sQQQII")
BLOCK_WORDS = 8192
SUPER = 512


def planes(ids: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[int]]:
    """The bit planes from the highest bit down, as packed bytes, and the number of zeros in each."""
    row = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    out, zeros = [], []
    for b in range(bits - 1, -1, -1):
        ones = (row & row.dtype.type(1 << b)) != 0
        out.append(np.packbits(ones, bitorder="little"))
        low = np.compress(~ones, row)
        zeros.append(len(low))
        row = np.concatenate([low, np.compress(ones, row)])
    return out, zeros


def dump(ids: np.ndarray, doc_ids: np.ndarray, sizes: np.ndarray, bits: int = 16, nameless: int = 0) -> bytes:
    """One shard's file: its ids, and by document the id and the number of tokens; the first ``nameless`` documents have no id."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    pack = zstandard.ZstdCompressor(level=1).compress
    parts, zeros = planes(ids, bits)
    n_words = -(-len(ids) // 64)
    table, blocks = [], []
    for plane in parts:
        words = np.zeros(n_words, np.uint64)
        words.view(np.uint8)[: len(plane)] = plane
        ones = np.bitwise_count(words).astype(np.int64)
        pad = np.zeros(-(-max(1, n_words) // 8) * 8, np.int64)
        pad[:n_words] = ones
        rank = np.concatenate([[0], np.cumsum(pad.reshape(-1, 8).sum(axis=1))])
        blocks.append(pack(rank.astype("<u8").tobytes()))
        blocks += [pack(words[at : at + BLOCK_WORDS].astype("<u8").tobytes()) for at in range(0, n_words, BLOCK_WORDS)]
    docs = pack(np.asarray(doc_ids, "<i8").tobytes()), pack(np.asarray(sizes, "<i8").tobytes())
    table = np.array([len(docs[0]), len(docs[1]), *map(len, blocks)], "<u4").tobytes()
    return b"".join([HEAD.pack(MAGIC, len(ids), len(doc_ids), nameless, bits, len(blocks) + 2), np.array(zeros, "<u8").tobytes(), table, *docs, *blocks])


class Wavelet:
    """A shard's file, opened over bytes; planes are decompressed block by block as they are used."""

    def __init__(self, file: bytes):
        self.file = memoryview(file)
        magic, self.n, self.n_docs, self.nameless, self.bits, n_parts = HEAD.unpack_from(file)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix file")
        at = HEAD.size
        self.zeros = np.frombuffer(file, "<u8", self.bits, at).astype(np.int64)
        at += 8 * self.bits
        size = np.frombuffer(file, "<u4", n_parts, at).astype(np.int64)
        at += 4 * n_parts
        self.at = at + np.concatenate([[0], np.cumsum(size)])
        if self.at[-1] != len(file):
            raise ValueError("the file is cut short")
        self.per_plane = 1 + -(-(-(-self.n // 64)) // BLOCK_WORDS)
        self._open: dict[int, np.ndarray] = {}

    def _part(self, k: int, kind: str = "<u8") -> np.ndarray:
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(self.file[self.at[k] : self.at[k + 1]]), kind)

    def _block(self, k: int) -> np.ndarray:
        if k not in self._open:
            if len(self._open) > 64:
                self._open.clear()
            self._open[k] = self._part(k)
        return self._open[k]

    def docs(self) -> tuple[np.ndarray, np.ndarray]:
        return self._part(0, "<i8"), self._part(1, "<i8")

    def _words(self, plane: int, index: np.ndarray) -> np.ndarray:
        out = np.zeros(len(index), np.uint64)
        block = index // BLOCK_WORDS
        for b in np.unique(block):
            mine = block == b
            words = self._block(2 + plane * self.per_plane + 1 + int(b))
            out[mine] = words[index[mine] % BLOCK_WORDS]
        return out

    def rank1(self, plane: int, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        i = np.asarray(i, np.int64)
        total = self._block(2 + plane * self.per_plane).astype(np.int64)[i // SUPER]
        first, word = i // SUPER * 8, i // 64
        for k in range(8):
            inside = np.flatnonzero(first + k < word)
            if len(inside):
                total[inside] += np.bitwise_count(self._words(plane, first[inside] + k))
        rest = np.flatnonzero(i % 64)
        if len(rest):
            mask = (np.uint64(1) << (i[rest] % 64).astype(np.uint64)) - np.uint64(1)
            total[rest] += np.bitwise_count(self._words(plane, word[rest]) & mask)
        return total

    def select(self, plane: int, bit: int, k: np.ndarray) -> np.ndarray:
        """Places of the k-th (from 0) bits of a kind, by bisection over rank."""
        k = np.asarray(k, np.int64)
        lo, hi = np.zeros(len(k), np.int64), np.full(len(k), self.n, np.int64)
        while len(k) and (hi - lo > 1).any():
            mid = (lo + hi) // 2
            ones = self.rank1(plane, mid)
            left = (ones if bit else mid - ones) > k
            hi, lo = np.where(left, mid, hi), np.where(left, lo, mid)
        return lo

    def access(self, i: np.ndarray) -> np.ndarray:
        """Ids at places i."""
        i = np.asarray(i, np.int64)
        if len(i) and (i.min() < 0 or i.max() >= self.n):
            raise IndexError("place outside the shard")
        out = np.zeros(len(i), np.int64)
        for p in range(self.bits):
            bit = (self._words(p, i // 64) >> (i % 64).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            ones = self.rank1(p, i)
            out = out << 1 | bit
            i = np.where(bit == 1, self.zeros[p] + ones, i - ones)
        return out

    def _range(self, token: int, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = np.zeros(len(i), np.int64), np.asarray(i, np.int64)
        if token >> self.bits:
            return lo, lo
        for p in range(self.bits):
            a, b = self.rank1(p, lo), self.rank1(p, hi)
            lo, hi = (self.zeros[p] + a, self.zeros[p] + b) if token >> (self.bits - 1 - p) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: np.ndarray) -> np.ndarray:
        """Occurrences of a token among the first i ids."""
        lo, hi = self._range(token, np.atleast_1d(i))
        return hi - lo

    def count(self, token: int) -> int:
        return int(self.rank(token, np.array([self.n]))[0])

    def locate(self, token: int, k: np.ndarray | None = None) -> np.ndarray:
        """Places of the k-th (from 0) occurrences of a token, of all by default."""
        lo, hi = (int(x[0]) for x in self._range(token, np.array([self.n])))
        at = np.arange(lo, hi) if k is None else lo + np.asarray(k, np.int64)
        if len(at) and at.max() >= hi:
            raise IndexError("no such occurrence")
        for p in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - p) & 1
            at = self.select(p, bit, at - self.zeros[p] if bit else at)
        return at

    def ids(self) -> np.ndarray:
        """All ids: the planes are undone from the lowest up."""
        out = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for p in range(self.bits - 1, -1, -1):
            first = 2 + p * self.per_plane + 1
            words = np.concatenate([self._part(k) for k in range(first, first + self.per_plane - 1)]) if self.n else np.zeros(0, np.uint64)
            ones = np.unpackbits(words.view(np.uint8), count=self.n, bitorder="little").astype(bool)
            back = np.empty_like(out)
            back[np.flatnonzero(~ones)] = out[: self.zeros[p]]
            back[np.flatnonzero(ones)] = out[self.zeros[p] :] | out.dtype.type(1 << (self.bits - 1 - p))
            out = back
        return out.astype(np.uint32)
