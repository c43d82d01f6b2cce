"""Phrase collocations, level by level.

Texts are cut into pieces at punctuation and line ends, and pieces into words; all counts
are by language.  The first pass counts words.  Pass k counts runs of k words, and emits a
run only where both runs of k - 1 words in it are frequent (``min_count`` or more), for no
other can be frequent itself.  The frequent runs of the level before are broadcast as
64-bit hashes while they are ``EXACT_KEYS`` at most, and beyond that as a bit map of
``BITMAP_BITS`` bits, so what is broadcast never exceeds 32 MB.  The filter only saves
emissions: runs are counted by their words, whatever it lets pass, and so every count is
exact either way.

Scores come from the level tables.  A row of a level carries the counts of all its
beginnings and of all its ends; the next level takes them over from its first and last
k - 1 words, two joins for a level.  A cut after j words scores
floor(10^6 a^2 / (l r)), in whole decimals of 38 digits, which are exact for counts below 10^15.
A candidate goes if a longer one that holds it has at least ``share`` per cent of its
count; if any has, one of one word more has.

Null texts are empty; a null language is ``und``.  Empty texts have no words.  Repeated rows
count each time.  Other columns are ignored.  No rows, or no frequent run, make no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..shared import Scratch, written
from . import textbatch as tb

MIN_COUNT, LONGEST, TOP, SHARE = 10, 3, 2000, 50
UNKNOWN = "und"
#: Bytes of text that are counted together before their sums go to the JVM.
SLICE = 4 << 20
#: Frequent runs of a level that are broadcast as sorted hashes at most (32 MB), and bits of the map that takes their place (32 MB).
EXACT_KEYS = 1 << 22
BITMAP_BITS = 1 << 28
#: Parts of a language that are ranked by themselves before their best are ranked together.
SALTS = 32
BREAK = tb.table(b".,;:!?\n\x0b\x0c\r")
WORD = tb.table(outside=b" \t.,;:!?\n\x0b\x0c\r")
COUNTS = "lang string, phrase string, f long"


_ODD = np.uint64(0x9E3779B97F4A7C15)


def _run_hashes(lang: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    out = lang
    with np.errstate(over="ignore"):
        for w in words:
            out = tb.mix(out * _ODD + w)
    return out


def _hashes(strings: pa.Array) -> np.ndarray:
    """A number of each string: its bytes times powers of an odd number, by place, summed and mixed.  Two strings may share one; that lets too much pass, never too little."""
    data, off = tb.raw(strings)
    size = np.diff(off)
    place = np.arange(len(data)) - np.repeat(off[:-1], size)
    out = np.zeros(len(size), np.uint64)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(size.max(initial=0)) + 1, _ODD))
        full = np.flatnonzero(size)
        if len(full):
            out[full] = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * powers[place], off[full])
    return tb.mix(out)


class Runs:
    """The frequent runs of a level, asked by hash: never no for one of them."""

    def __init__(self, keys: np.ndarray | None, bitmap: np.ndarray | None):
        self.keys, self.bitmap = keys, bitmap

    def has(self, h: np.ndarray) -> np.ndarray:
        if self.bitmap is not None:
            place = h & np.uint64(len(self.bitmap) * 64 - 1)
            return (self.bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        if not len(self.keys):
            return np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return self.keys[at] == h

    @classmethod
    def of(cls, level: DataFrame, k: int) -> Runs:
        """From a level's table: the driver gets hashes, or words of the bit map that are not zero."""

        def hashed(batches):
            for part in batches:
                if part.num_rows:
                    coded = pc.list_flatten(pc.split_pattern(part.column(1), " ")).dictionary_encode()
                    words = _hashes(coded.dictionary)[coded.indices.to_numpy()].reshape(-1, k)
                    lang = part.column(0).dictionary_encode()
                    h = _run_hashes(_hashes(lang.dictionary)[lang.indices.to_numpy()], list(words.T))
                    yield pa.record_batch([pa.array(h.view(np.int64))], names=["h"])

        hashes = level.select("lang", "phrase").mapInArrow(hashed, "h long")
        if level.count() <= EXACT_KEYS:
            return cls(np.sort(hashes.toArrow()["h"].to_numpy().view(np.uint64)), None)
        place = F.col("h").bitwiseAND(F.lit(BITMAP_BITS - 1))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
        full = hashes.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
        bitmap = np.zeros(BITMAP_BITS >> 6, np.uint64)
        bitmap[full["word"].to_numpy()] = full["bits"].to_numpy().view(np.uint64)
        return cls(None, bitmap)


class Words:
    """The words of a slice: their numbers among the distinct ones, their pieces and languages."""

    def __init__(self, part: pa.RecordBatch):
        data, off = tb.raw(part.column(1))
        low = tb.LOWER[data]
        starts, ends, at = tb.spans(low, off, WORD)
        row = tb.rows_of(at)
        breaks = np.zeros(len(data) + 1, np.int64)
        np.cumsum(BREAK[data], out=breaks[1:])
        self.piece = breaks[starts] + row
        words, self.codes = tb.distinct(low, starts, ends)
        self.words = words.cast(pa.large_string())
        lang = pc.fill_null(part.column(0), UNKNOWN).dictionary_encode()
        self.langs, self.lang = lang.dictionary, lang.indices.to_numpy().astype(np.int64)[row]

    def hashed(self) -> None:
        self.word_hash = _hashes(self.words)[self.codes]
        self.lang_hash = _hashes(self.langs)[self.lang]

    def together(self, k: int) -> np.ndarray:
        """At which words a run of k begins that stays in its piece."""
        n = max(0, len(self.piece) - k + 1)
        return self.piece[:n] == self.piece[k - 1 : k - 1 + n]

    def hash_of(self, k: int) -> np.ndarray:
        n = max(0, len(self.codes) - k + 1)
        return _run_hashes(self.lang_hash[:n], [self.word_hash[j : j + n] for j in range(k)])

    def counted(self, k: int, alive: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(alive)
        keys = tb.keyed(self.lang[at], tb.gram_codes(self.codes, k)[at])
        _, first, count = np.unique(keys, return_index=True, return_counts=True)
        at = at[first]
        phrase = pc.binary_join_element_wise(*[self.words.take(pa.array(self.codes[at + j])) for j in range(k)], pa.scalar(" ", pa.large_string())) if k > 1 else self.words.take(pa.array(self.codes[at]))
        return pa.record_batch([self.langs.take(pa.array(self.lang[at])).cast(pa.string()), phrase.cast(pa.string()), pa.array(count.astype(np.int64))], names=["lang", "phrase", "f"])


def _count(documents: DataFrame, k: int, before: Runs | None) -> DataFrame:
    """Runs of k words and their counts; with the words, a row without a phrase for all words of a language."""
    held = documents.sparkSession.sparkContext.broadcast(before) if before else None

    def run(part):
        words = Words(part)
        if k == 1:
            out = words.counted(1, words.together(1))
            n = np.bincount(words.lang, minlength=len(words.langs))
            total = pa.record_batch([words.langs.cast(pa.string()), pa.nulls(len(n), pa.string()), pa.array(n.astype(np.int64))], names=["lang", "phrase", "f"])
            return pa.Table.from_batches([out, total]).combine_chunks().to_batches()[0]
        words.hashed()
        fine = words.together(k - 1)
        at = np.flatnonzero(fine)
        fine[at] = held.value.has(words.hash_of(k - 1)[at])
        together = words.together(k)
        return words.counted(k, together & fine[: len(together)] & fine[1:])

    counts = tb.mapped(documents, run, COUNTS, ("lang", "text"), most=SLICE)
    return counts.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def levels(documents: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST) -> tuple[list[DataFrame], DataFrame]:
    """Written tables (lang, phrase, f) of the frequent runs of 1 to ``longest`` words; and (lang, n), all words."""
    docs = documents.select(documents["lang"].cast("string"), documents["text"])
    one = written(_count(docs, 1, None).filter(F.col("phrase").isNull() | (F.col("f") >= min_count)), "collocations-1")
    out = [one.filter("phrase is not null")]
    for k in range(2, longest + 1):
        out.append(written(_count(docs, k, Runs.of(out[-1], k - 1)).filter(F.col("f") >= min_count), f"collocations-{k}"))
    return out, one.filter("phrase is null").select("lang", F.col("f").alias("n"))


def _score(a: F.Column, l: F.Column, r: F.Column) -> F.Column:
    """floor(10^6 a^2 / (l r)), in whole decimals."""
    whole = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(10**6).cast("decimal(7,0)") * whole(a) * whole(a), whole(l) * whole(r)).cast("long")


def scored(tables: list[DataFrame], share: int = SHARE) -> DataFrame:
    """All candidates that no longer one stands for: lang, phrase, a, l, r, score."""
    above = tables[0].select("lang", "phrase", F.array("f").alias("firsts"), F.array("f").alias("lasts"))
    out = []
    for k, level in enumerate(tables[1:], 2):
        parts = level.withColumns({"head": F.substring_index("phrase", " ", k - 1), "tail": F.substring_index("phrase", " ", 1 - k)})
        heads = above.select("lang", F.col("phrase").alias("head"), "firsts")
        tails = above.select("lang", F.col("phrase").alias("tail"), "lasts")
        known = parts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
        above = known.select("lang", "phrase", "f", F.concat("firsts", F.array("f")).alias("firsts"), F.concat("lasts", F.array("f")).alias("lasts"))
        if k < len(tables):  # the next level asks for it twice
            above = written(above, f"collocations-ladder-{k}")
        cuts = []
        for j in range(1, k):
            left, right = F.get("firsts", F.lit(j - 1)), F.get("lasts", F.lit(k - j - 1))
            cuts.append(F.struct(_score(F.col("f"), left, right).alias("score"), F.lit(j).alias("k"), left.alias("l"), right.alias("r")))
        scores = above.select("lang", "phrase", F.col("f").alias("a"), (F.least(*cuts) if len(cuts) > 1 else cuts[0]).alias("cut"))
        out.append(scores.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
        if k > 2:
            held = reduce(DataFrame.unionByName, [parts.select("lang", F.col(c).alias("phrase"), "f") for c in ("head", "tail")]).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
            out[-2] = out[-2].join(held, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True))).drop("longer")
    return reduce(DataFrame.unionByName, out)


def best(candidates: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` candidates by score, count and phrase, with the language's words.

    Every language is dealt over ``SALTS`` parts, whose own first ``top`` are ranked together: no task sorts a language whole."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = candidates.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine(documents: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """The collocations of every language: lang, rank, phrase, counts of phrase, parts and all words, score.

    The level tables are removed; the result is a written table."""
    with Scratch(documents.sparkSession) as scratch:
        tables, totals = levels(documents, min_count, longest)
        return scratch.keep(written(best(scored(tables, share), totals, top), "collocations"))
