"""Texts as codes into their distinct chunks, and a bounded memory of what chunks encode to.

Empty rows have no chunks and no ids; nulls are empty.  Equal chunks of a call are encoded once.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

from . import textbatch as tb

#: Remembered chunks, and their bytes, at most.
MOST_CHUNKS = 400_000
MOST_BYTES = 32 << 20


def cut(data: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Offsets of the chunks that the row edges and the places ``at`` make; empty rows make none."""
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    edge[off] = True
    return np.flatnonzero(edge)


def distinct(data: np.ndarray, chunk_off: np.ndarray):
    """Distinct chunks (an Arrow binary array) and the code of each chunk."""
    d = tb.as_strings(data, chunk_off, binary=True).dictionary_encode()
    return d.dictionary, d.indices.to_numpy()


def joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The lists' ids in a row, and the lists' sizes."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum())), sizes


class Memory:
    """Ids of chunks met before; ``encode`` gives the ids of new ones in a row, and how many each has.  When it is full it starts anew; that changes the cost alone."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = MOST_CHUNKS, most_bytes: int = MOST_BYTES):
        self.encode, self.most, self.most_bytes = encode, most, most_bytes
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.bytes = 0
        self.values = np.zeros(1 << 16, np.int32)
        self.off = np.zeros(1 << 14, np.int64)

    def numbers(self, chunks: list[bytes]) -> np.ndarray:
        if len(self.number) + len(chunks) > self.most or self.bytes > self.most_bytes:
            self.clear()
        number, n = self.number, len(self.number)
        new = [c for c in chunks if c not in number]
        if new:
            flat, sizes = self.encode(new)
            number.update(zip(new, range(n, n + len(new))))
            self.bytes += sum(map(len, new))
            base = self.off[n]
            if len(self.off) <= n + len(new):
                self.off = np.concatenate([self.off, np.zeros(max(len(self.off), len(new) + 1), np.int64)])
            while len(self.values) < base + len(flat):
                self.values = np.concatenate([self.values, np.zeros(len(self.values), np.int32)])
            np.cumsum(sizes, out=self.off[n + 1 : n + 1 + len(new)])
            self.off[n + 1 : n + 1 + len(new)] += base
            self.values[base : base + len(flat)] = flat
        return np.fromiter(map(number.__getitem__, chunks), np.int64, len(chunks))


def encoded(data: np.ndarray, off: np.ndarray, at: np.ndarray, memory: Memory) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows, joined, and the n + 1 offsets of the rows in them."""
    edges = cut(data, off, at)
    if len(edges) < 2:
        return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
    words, codes = distinct(data, edges)
    numbers = memory.numbers(words.to_pylist())
    ids, id_off = tb.ragged(memory.values, memory.off, numbers[codes])
    return ids, id_off[np.searchsorted(edges, off)]
