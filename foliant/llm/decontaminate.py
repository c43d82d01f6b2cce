"""Benchmark decontamination: a prefix-filtered set join with exact verification.

Items are cut into windows of ``width`` consecutive words (shorter items are one
window).  A window counts only when contained whole, so of its shingles ordered by
rarity in the corpus the necessary prefix is one shingle: the rarest.  The documents'
shingles meet those prefix shingles; the position of the shingle in the window gives
the only place the window could start, which must lie in the document and leave room
for its length; what passes is compared word by word.

Words are compared by their numbers in the block's vocabulary, which is a table of
their bytes: two words have one number only if they are equal.  Windows are merged by
those numbers too.  Hashes choose candidates and nothing else.

The benchmark is broadcast in blocks of at most ``BLOCK_BYTES`` of text, after a look
at its size.  A larger one takes two passes over the documents for each block; passes
write the rows with hits alone, and what they found is joined at the end.

Null texts have no words and nothing else does either; items without words are
skipped; items with equal ids are one item, a null id counts as the empty string;
repeated documents are answered row by row.  Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textbatch as tb
from .shared import written

WIDTH = 10
SHINGLE = 5
BLOCK_BYTES = 32 << 20
_SIEVE = 22


class Words:
    """The words of texts: the distinct ones, the number of each word among them, and the texts' offsets in the numbers."""

    def __init__(self, column: pa.Array):
        data, off = tb.raw(column)
        data = tb.LOWER[data]
        starts, ends, self.off = tb.spans(data, off, tb.WORDISH)
        self.distinct, self.codes = tb.distinct(data, starts, ends)


class Windows:
    """The distinct windows of a block of items."""

    def __init__(self, rows, width: int = WIDTH, shingle: int = SHINGLE):
        words = Words(pa.array([text or "" for _, text in rows], pa.large_string()))
        self.vocabulary = {w: k for k, w in enumerate(words.distinct.to_pylist())}
        self.codes = words.codes.astype(np.int32)
        names = ["" if item is None else str(item) for item, _ in rows]
        self.items = sorted(set(names))
        number = {x: i for i, x in enumerate(self.items)}
        item = np.array([number[x] for x in names], np.int64)
        n = np.diff(words.off)
        length = np.minimum(n, width)
        count = np.where(n > 0, n - length + 1, 0)
        row = np.repeat(np.arange(len(rows)), count)
        start = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + words.off[:-1][row]
        size = length[row]
        key, base = np.zeros(len(row), np.int64), 0
        for k in np.unique(size).tolist():
            at = np.flatnonzero(size == k)
            key[at] = np.unique(tb.gram_codes(words.codes, k)[start[at]], return_inverse=True)[1] + base
            base += len(at)
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        self.start, self.size = start[first], size[first]
        pairs = np.unique(np.stack([which, item[row]], 1), axis=0) if len(row) else np.zeros((0, 2), np.int64)
        self.item = pairs[:, 1]
        self.item_off = np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))
        #: By shingle length: the windows that are looked for by it, and the distinct hashes of all their shingles.
        self.shingles = {}
        for k in range(1, shingle + 1):
            mine = np.flatnonzero((self.size == k) if k < shingle else (self.size >= k))
            if len(mine):
                g, inside = tb.grams(self.hashed(self.codes), k), np.zeros(len(self.codes), bool)
                for j in range(int(self.size[mine].max()) - k + 1):
                    inside[self.start[mine][self.size[mine] - k >= j] + j] = True
                self.shingles[k] = mine, np.unique(g[np.flatnonzero(inside)])

    @staticmethod
    def hashed(codes: np.ndarray) -> np.ndarray:
        return tb.mix(codes.astype(np.int64).view(np.uint64))

    def numbers(self, words: Words) -> np.ndarray:
        """The words' numbers in this block's vocabulary; -1 for words that are not in it."""
        get = self.vocabulary.get
        known = np.fromiter((get(w, -1) for w in words.distinct.to_pylist()), np.int32, len(words.distinct))
        return known[words.codes]

    def keyed(self, counts: dict[int, np.ndarray]) -> dict[int, tuple]:
        """By shingle length: a sieve, the sorted prefix shingles, and the window and offset of each."""
        out = {}
        for k, (mine, known) in self.shingles.items():
            g, start, places = tb.grams(self.hashed(self.codes), k), self.start[mine], self.size[mine] - k
            seen = counts[k][np.minimum(np.searchsorted(known, g), len(known) - 1)]
            best = start.copy()
            for j in range(1, int(places.max()) + 1):
                at = np.minimum(start + j, len(g) - 1)
                rarer = (seen[at] < seen[best]) | (seen[at] == seen[best]) & (g[at] < g[best])
                best = np.where((places >= j) & rarer, at, best)
            order = np.argsort(g[best], kind="stable")
            out[k] = _sieve(g[best]), g[best][order], mine[order], (best - start)[order]
        return out


def _sieve(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << _SIEVE, bool)
    out[(keys >> np.uint64(64 - _SIEVE)).astype(np.int64)] = True
    return out


def _met(codes: np.ndarray, off: np.ndarray, k: int, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the k-shingles of known words that pass the sieve and lie in one text."""
    g = tb.grams(Windows.hashed(codes), k)
    at = np.flatnonzero(sieve[(g >> np.uint64(64 - _SIEVE)).astype(np.int64)])
    if len(at):
        at = at[tb.within(off, k)[at]]
        for j in range(k):
            at = at[codes[at + j] >= 0]
    return at, g[at]


def rarity(documents: DataFrame, windows: Windows) -> dict[int, np.ndarray]:
    """Occurrences in all documents of each shingle of the block's windows."""
    known = {k: x for k, (_, x) in windows.shingles.items()}
    shared = documents.sparkSession.sparkContext.broadcast(windows)

    def run(batches):
        windows = shared.value
        known = {k: x for k, (_, x) in windows.shingles.items()}
        counts = {k: np.zeros(len(x), np.int64) for k, x in known.items()}
        sieves = {k: _sieve(x) for k, x in known.items()}
        for part in tb.slices(batches):
            words = Words(part.column(0))
            codes = windows.numbers(words)
            for k, keys in known.items():
                g = _met(codes, words.off, k, sieves[k])[1]
                i = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
                counts[k] += np.bincount(i[keys[i] == g], minlength=len(keys))
        for k, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array(np.full(len(at), k)), pa.array(at), pa.array(n[at])], names=["k", "i", "n"])
        tb.release()

    out = {k: np.zeros(len(x), np.int64) for k, x in known.items()}
    if known:
        for r in documents.select("text").mapInArrow(run, "k long, i long, n long").groupBy("k", "i").agg(F.sum("n").alias("n")).collect():
            out[r.k][r.i] = r.n
    return out


def hits(words: Words, windows: Windows, keyed: dict[int, tuple]) -> tuple[np.ndarray, np.ndarray]:
    """First words and numbers of the windows that occur in the texts."""
    found_at, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    codes, off = windows.numbers(words), words.off
    for k, (sieve, keys, window, offset) in keyed.items():
        at, g = _met(codes, off, k, sieve)
        lo, hi = np.searchsorted(keys, g, "left"), np.searchsorted(keys, g, "right")
        many = hi - lo
        i = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        place, win = np.repeat(at, many), window[i]
        row = np.searchsorted(off, place, "right") - 1
        first = place - offset[i]
        room = (first >= off[row]) & (first + windows.size[win] <= off[row + 1])
        first, win, j = first[room], win[room], 0
        while len(first) and j < windows.size[win].max():
            live = windows.size[win] > j
            ok = np.ones(len(first), bool)
            ok[live] = codes[first[live] + j] == windows.codes[windows.start[win[live]] + j]
            first, win, j = first[ok], win[ok], j + 1
        found_at.append(first)
        found.append(win)
    return np.concatenate(found_at), np.concatenate(found)


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The benchmark's rows in blocks of about ``block_bytes`` of text, after a look at its size."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // block_bytes))
    return [rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) for b in range(n)]


def _opened(documents: DataFrame, block: DataFrame, width: int):
    """A block's windows with their prefix shingles, broadcast."""
    windows = Windows([(r.item_id, r.text) for r in block.collect()], width)
    return documents.sparkSession.sparkContext.broadcast((windows, windows.keyed(rarity(documents, windows))))


_FOUND = "doc_id long, h long, ranges array<long>, items array<string>"


def _hit_words(words: Words, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    step = np.zeros(len(words.codes) + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, first + size, -1)
    return np.cumsum(step[:-1]) > 0


def _ranges(mask: np.ndarray) -> list[int]:
    """From, to, from, ... of the stretches of a mask."""
    return np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]))).tolist()


def _by_row(part: pa.RecordBatch, opened) -> tuple[Words, dict[int, tuple[list[int], list[str]]]]:
    """The words of a slice's texts, and by row with hits the ranges of hit words and the sorted ids of the items."""
    windows, keyed = opened
    words = Words(tb.text_of(part))
    first, win = hits(words, windows, keyed)
    row = np.searchsorted(words.off, first, "right") - 1
    hit = _hit_words(words, first, windows.size[win])
    many = np.diff(windows.item_off)[win]
    item = windows.item[np.repeat(windows.item_off[win], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
    items = max(1, len(windows.items))
    by: dict[int, list[str]] = {}
    for p in np.unique(np.repeat(row, many) * items + item).tolist():
        by.setdefault(p // items, []).append(windows.items[p % items])
    return words, {r: (_ranges(hit[words.off[r] : words.off[r + 1]]), names) for r, names in by.items()}


def _found(documents: DataFrame, shared) -> DataFrame:
    """The documents with hits of one block, known by id and a hash of the text: doc_id, h, ranges, items."""

    def run(part):
        _, by = _by_row(part, shared.value)
        at = list(by)
        return pa.record_batch([part.column(0).take(pa.array(at, pa.int64())), part.column(1).take(pa.array(at, pa.int64())), pa.array([by[r][0] for r in at], pa.list_(pa.int64())), pa.array([by[r][1] for r in at], pa.list_(pa.string()))], names=["doc_id", "h", "ranges", "items"])

    return tb.mapped(documents.select("doc_id", F.xxhash64("text").alias("h"), "text"), run, _FOUND, ("doc_id", "h", "text"))


def _all_found(documents: DataFrame, blocks: list[DataFrame], width: int) -> DataFrame:
    """What all blocks found, block by block: two reads of the documents for each, and the rows with hits written."""
    passes = [written(_found(documents, _opened(documents, block, width)).withColumn("block", F.lit(b)).dropDuplicates(["doc_id", "h", "block"]), "hits") for b, block in enumerate(blocks)]
    return reduce(DataFrame.unionByName, passes)


def keep_clean(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with all their columns."""
    blocks = _blocks(benchmark, block_bytes)
    if len(blocks) > 1:
        dirty = written(_all_found(documents, blocks, width).select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).distinct(), "dirty")
        return documents.join(dirty, [F.col("doc_id").cast("long").eqNullSafe(F.col("__id")), F.xxhash64(documents["text"]) == F.col("__h")], "left_anti")
    shared = _opened(documents, blocks[0], width)

    def run(part):
        words = Words(tb.text_of(part))
        first, _ = hits(words, *shared.value)
        clean = np.ones(part.num_rows, bool)
        clean[np.searchsorted(words.off, first, "right") - 1] = False
        return part.filter(pa.array(clean))

    return tb.rewritten(documents, run)


def decontaminate(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES, keep_text: bool = False) -> DataFrame:
    """A row per document: n_words, n_hit, the places of its hit words (from, to, from, ...), the ids of the items with occurring windows.

    ``keep_text``: the text goes along."""
    blocks = _blocks(benchmark, block_bytes)
    if len(blocks) == 1:
        shared = _opened(documents, blocks[0], width)
        return _rows(documents.select("doc_id", "text"), lambda part: _by_row(part, shared.value), keep_text)
    found = _all_found(documents, blocks, width).groupBy("doc_id", "h").agg(F.collect_list(F.struct("ranges", "items")).alias("found"))
    found = written(found, "hits").select(F.col("doc_id").alias("id"), "h", "found")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    met = rows.join(found, [rows.doc_id.eqNullSafe(found.id), F.xxhash64(rows["text"]) == found.h], "left").select("doc_id", "text", "found")

    def together(part):
        words, by = Words(tb.text_of(part)), {}
        for r, found in enumerate(part.column(2).to_pylist()):
            if found:
                mask = np.zeros(words.off[r + 1] - words.off[r], bool)
                for x in found:
                    for a, b in zip(*[iter(x["ranges"])] * 2):
                        mask[a:b] = True
                by[r] = _ranges(mask), sorted({name for x in found for name in x["items"]})
        return words, by

    return _rows(met, together, keep_text)


def _rows(frame: DataFrame, look, keep_text: bool) -> DataFrame:
    def run(part):
        words, by = look(part)
        ranges, items = [by[r][0] if r in by else None for r in range(part.num_rows)], [by[r][1] if r in by else None for r in range(part.num_rows)]
        n_hit = [sum(r[1::2]) - sum(r[::2]) if r else 0 for r in ranges]
        cols = [part.column(0), pa.array(np.diff(words.off)), pa.array(n_hit, pa.int64()), pa.array(ranges, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
        names = ["doc_id", "n_words", "n_hit", "ranges", "items"]
        return pa.record_batch(cols + [part.column(1)] * keep_text, names=names + ["text"] * keep_text)

    return tb.mapped(frame, run, "doc_id long, n_words long, n_hit long, ranges array<long>, items array<string>" + ", text string" * keep_text, tuple(frame.columns))


def report(hit: DataFrame) -> DataFrame:
    """The digest columns of decontaminate()."""
    items = F.coalesce("items", F.array().cast("array<string>"))
    return hit.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size(items) > 0).alias("contaminated"))
