"""Burrows-Wheeler transforms of shards, merged by iterative interleave refinement.

``merge`` interleaves the transforms of several shards without looking at their texts: the interleave of order k + 1 is the
interleave of order k carried through the LF mapping.  A block of the interleave that splits in round k tells common
prefixes of k - 1 characters, so common prefixes come with it, and runs of them of at least a length are the repeated
intervals.  Rounds end when nothing moves, or at a given depth.

The measured cost (``python -m foliant.llm.bwt``) is why the repeats query does not use it; see the README.

Texts end in a 0 byte each, which is no other character; equal ends are ordered by shard and text.
"""

from __future__ import annotations

import time

import numpy as np


def transform(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The transform of a shard of texts and its suffixes (places in the joined texts), ends ordered by text.  By doubling."""
    data = np.frombuffer(b"".join(t.replace(b"\0", b"\1") + b"\0" for t in texts), np.uint8)
    n = len(data)
    ends = np.flatnonzero(data == 0)
    rank = data.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    limit = np.repeat(ends, np.diff(np.concatenate([[-1], ends])))
    step = 1
    while True:
        there = np.arange(n) + step
        second = np.where(there <= limit, rank[np.minimum(there, n - 1)] + 1, 0)
        order = np.lexsort((second, rank))
        new = np.concatenate([[0], np.cumsum((np.diff(rank[order]) != 0) | (np.diff(second[order]) != 0))]) if n else np.zeros(0, np.int64)
        rank = np.empty(n, np.int64)
        rank[order] = new
        if not n or new[-1] == n - 1:
            break
        step *= 2
    start = np.concatenate([[0], ends[:-1] + 1]) if n else ends
    before = np.where(np.isin(order, start), 0, data[order - 1]) if n else data
    return before.astype(np.uint8), order


def merge(shards: list[np.ndarray], depth: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(interleave, prefix, rounds): the shard of each place of the merged order, and the common prefix of each place with the
    one before it (``depth`` where it reaches that)."""
    sizes = [len(s) for s in shards]
    n = sum(sizes)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), 0
    z = np.repeat(np.arange(len(shards), dtype=np.uint8), sizes)
    block = np.zeros(n, bool)
    block[0] = True
    prefix = np.full(n, -1, np.int64)
    prefix[0] = 0
    rounds, depth = 0, n if depth is None else depth
    while rounds < depth:
        char = np.empty(n, np.uint8)
        for k, s in enumerate(shards):
            char[z == k] = s
        # the LF mapping: a stable sort by character.  A block's members that go to one character make one new block.
        order = np.argsort(char, kind="stable")
        number = np.cumsum(block)
        moved, where = char[order], number[order]
        new = np.ones(n, bool)
        new[1:] = (moved[1:] != moved[:-1]) | (where[1:] != where[:-1])
        ends = moved == 0
        new |= ends
        z2 = z[order]
        # ends of texts are a block each, in order of shard and text
        n_ends = int(ends.sum())
        z2[:n_ends] = np.sort(z[order][:n_ends], kind="stable")
        fresh = new & (prefix < 0)
        prefix[fresh] = rounds
        still = bool(np.array_equal(z, z2)) and not fresh.any()
        z, block = z2, new | (prefix >= 0)
        rounds += 1
        if still:
            break
    prefix[prefix < 0] = rounds if rounds >= depth else 0
    return z, prefix, rounds


def repeated(prefix: np.ndarray, length: int) -> np.ndarray:
    """Which places of the merged order share ``length`` characters or more with a neighbour."""
    long = prefix >= length
    return long | np.append(long[1:], False)


def _measure(mb: float = 4.0, shards: int = 4, rounds: int = 12) -> float:
    rng = np.random.default_rng(1)
    parts = [transform([bytes(rng.integers(97, 120, int(mb * 1e6 / shards), dtype=np.uint8))])[0] for _ in range(shards)]
    began = time.process_time()
    _, _, done = merge(parts, rounds)
    return (time.process_time() - began) / done / sum(map(len, parts)) * 1e9


if __name__ == "__main__":
    print(f"{_measure():.1f} ns a position and round")
