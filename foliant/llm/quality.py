"""Quality rules as a short-circuit cascade.

``Texts`` counts, once, what rules ask for; ``RULES`` reject; ``order_rules`` measures on
a sample each rule's cost and what it rejects of the texts that the rules before it
left, and puts the rule with the most rejections for its cost next; ``cascade`` then
asks each rule about what is left only.  Each task takes its sample from its own first
slice, so nothing is read twice and nothing travels.  The order changes the cost alone:
the verdict is the conjunction of all rules.

The rules are the usual published ones (length of words, symbols, copied lines, words
without letters, stop words, capitals, bullets, ellipses, long words, one word over and
over); the contract's base rule comes before them.

Null and empty texts have no words; zero counts; they fail the base rule.  Repeated
rows are scored row by row.  Other columns are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbatch as tb

#: What a task looks at to order the rules: texts from all over its first slice, so many bytes of them (one text at least).
SAMPLE_BYTES = 1 << 18
MIN_WORDS = 50
#: The rows that are left are cut out of a slice when they are fewer than this share of it.
WORTH = 0.8
SYMBOLS = tb.table(b"#*$%&|<>")
NEWLINE = tb.table(outside=b"\n")
UPPER = tb.table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
ALPHA = tb.table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
#: ASCII letters, and all beyond ASCII.
LETTER = tb.table(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
BULLETS = ("-", "*", "•")
ELLIPSES = ("...", "…")
#: Frequent words of English, German, French and Spanish.
STOP_WORDS = "the be to of and that have with in is it for on der die das und ist von mit den zu nicht le la les et de des une est que pour el los las y en por con del un se".split()
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"


def _once(count: Callable[["Texts"], np.ndarray]) -> Callable[["Texts"], np.ndarray]:
    """A count that is made when first asked for, and kept."""
    name = count.__name__

    def get(self: "Texts") -> np.ndarray:
        if name not in self.known:
            self.known[name] = count(self)
        return self.known[name]

    return get


class Texts:
    """Counts of a slice of texts."""

    def __init__(self, column: pa.Array):
        data, off = tb.raw(column)
        self._hold(data, off, *tb.spans(data, off, tb.NON_SPACE))
        self.known: dict[str, np.ndarray] = {}

    def _hold(self, data, off, starts, ends, woff) -> None:
        self.data, self.off, self.starts, self.ends, self.woff = data, off, starts, ends, woff
        self.rows, self.n_words = len(off) - 1, np.diff(woff)

    def of(self, rows: np.ndarray) -> "Texts":
        """The same of some rows, in their order: cut out of what is there, counts included."""
        new = object.__new__(Texts)
        data, off = tb.ragged(self.data, self.off, rows)
        starts, woff = tb.ragged(self.starts, self.woff, rows)
        shift = np.repeat(off[:-1] - self.off[rows], np.diff(woff))
        new._hold(data, off, starts + shift, tb.ragged(self.ends, self.woff, rows)[0] + shift, woff)
        new.known = {k: v[rows] for k, v in self.known.items() if len(v) == self.rows and k != "words"}
        if "words" in self.known:
            new.known["words"] = tb.ragged(self.known["words"], self.woff, rows)[0]
        return new

    @_once
    def words(self) -> np.ndarray:
        """The number of each word among the distinct ones."""
        return tb.distinct(self.data, self.starts, self.ends)[1]

    @_once
    def word_chars(self) -> np.ndarray:
        return tb.sums(tb.NON_SPACE[self.data] & ((self.data & 0xC0) != 0x80), self.off)

    @_once
    def n_symbols(self) -> np.ndarray:
        return tb.sums(SYMBOLS[self.data], self.off)

    def _lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the lines with a word, and their offsets by row."""
        s, e, off = tb.spans(self.data, self.off, NEWLINE)
        has = np.searchsorted(self.starts, e) > np.searchsorted(self.starts, s)
        kept = np.zeros(len(s) + 1, np.int64)
        np.cumsum(has, out=kept[1:])
        return s[has], e[has], kept[off]

    @_once
    def n_lines(self) -> np.ndarray:
        return np.diff(self._lines()[2])

    @_once
    def n_dup_lines(self) -> np.ndarray:
        s, e, off = self._lines()
        return tb.sums(tb.later(tb.keyed(tb.rows_of(off), tb.distinct(self.data, s, e)[1])), off)

    @_once
    def n_repeat_words(self) -> np.ndarray:
        grams = tb.gram_codes(self.words(), 3)
        at = np.flatnonzero(tb.within(self.woff, 3))
        again = at[tb.repeated(tb.keyed(tb.rows_of(self.woff)[at], grams[at]))]
        return tb.sums(tb.covered(again, 3, len(self.starts)), self.woff)

    @_once
    def longest_word(self) -> np.ndarray:
        """In bytes."""
        out = np.zeros(self.rows, np.int64)
        full = np.flatnonzero(self.n_words)
        if len(full):
            out[full] = np.maximum.reduceat(self.ends - self.starts, self.woff[full])
        return out

    @_once
    def top_word(self) -> np.ndarray:
        """Occurrences of the commonest word."""
        row = tb.rows_of(self.woff)
        keys = tb.keyed(row, self.words())
        order = np.argsort(keys)
        out = np.zeros(self.rows, np.int64)
        if len(keys):
            edge = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
            np.maximum.at(out, row[order[edge]], np.diff(np.append(edge, len(keys))))
        return out

    @_once
    def n_lettered(self) -> np.ndarray:
        """Words with a letter."""
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(LETTER[self.data], out=total[1:])
        return tb.sums(total[self.ends] > total[self.starts], self.woff)

    @_once
    def n_alpha(self) -> np.ndarray:
        return tb.sums(ALPHA[self.data], self.off)

    @_once
    def n_capitals(self) -> np.ndarray:
        return tb.sums(UPPER[self.data], self.off)

    @_once
    def n_stop_words(self) -> np.ndarray:
        """Words that are a stop word in ASCII lower case, with nothing beside it."""
        size, out = self.ends - self.starts, np.zeros(len(self.starts), bool)
        low = tb.LOWER[self.data]
        for n in {len(w) for w in STOP_WORDS}:
            at = np.flatnonzero(size == n)
            if len(at):
                key = np.zeros(len(at), np.int64)
                for j in range(n):
                    key = key << 8 | low[self.starts[at] + j]
                out[at] = np.isin(key, [int.from_bytes(w.encode()) for w in STOP_WORDS if len(w) == n])
        return tb.sums(out, self.woff)

    def _edge(self, marks: tuple[str, ...], last: bool) -> np.ndarray:
        """Lines with a word that begin, or end, with one of some strings (after or before white space)."""
        s, e, off = self._lines()
        first = np.searchsorted(self.starts, s)
        a, b = self.starts[first], self.ends[np.searchsorted(self.starts, e) - 1]
        out = np.zeros(len(s), bool)
        for mark in marks:
            x = mark.encode()
            hit = b - a >= len(x)
            at = (b - len(x) if last else a)[hit]
            same = np.ones(len(at), bool)
            for j, c in enumerate(x):
                same &= self.data[at + j] == c
            out[np.flatnonzero(hit)[same]] = True
        return tb.sums(out, off)

    @_once
    def n_bullets(self) -> np.ndarray:
        return self._edge(BULLETS, False)

    @_once
    def n_ellipses(self) -> np.ndarray:
        return self._edge(ELLIPSES, True)


#: Reject where true.
RULES: dict[str, Callable[[Texts], np.ndarray]] = {
    "symbols": lambda t: t.n_symbols() * 10 > t.n_words,
    "copied_lines": lambda t: t.n_dup_lines() * 10 > t.n_lines() * 3,
    "word_length": lambda t: (t.word_chars() < 3 * t.n_words) | (t.word_chars() > 10 * t.n_words),
    "letters": lambda t: t.n_lettered() * 10 < t.n_words * 8,
    "stop_words": lambda t: t.n_stop_words() < 2,
    "capitals": lambda t: t.n_capitals() * 2 > t.n_alpha(),
    "bullets": lambda t: t.n_bullets() * 10 > t.n_lines() * 9,
    "ellipses": lambda t: t.n_ellipses() * 10 > t.n_lines() * 3,
    "long_word": lambda t: t.longest_word() > 1000,
    "one_word": lambda t: t.top_word() * 4 > t.n_words,
}


#: Counts that every row gets before the cascade: no rule pays for them.
PAID = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def order_rules(column: pa.Array, rules=RULES, sample_bytes: int = SAMPLE_BYTES, paid: tuple[str, ...] = PAID) -> list[str]:
    """Rule names, by rejections for their cost among what the rules before them leave of a sample of ``sample_bytes`` bytes, spread evenly over the column's rows.

    A rule's cost is what it takes with the counts there that the cascade begins with, and with those of no other rule."""
    off = tb.raw(column)[1]
    rows = len(column)
    step = max(1, -(-int(off[-1]) // max(1, sample_bytes)))
    some = column.take(pa.array(np.arange(0, rows, step)))
    within = np.searchsorted(tb.raw(some)[1], sample_bytes, "right") - 1
    texts = Texts(some.slice(0, max(1, int(within))))
    for name in paid:
        getattr(texts, name)()
    counted = dict(texts.known)
    bad, cost = {}, {}
    for name, rule in rules.items():
        texts.known = dict(counted)
        began = time.perf_counter()
        bad[name] = rule(texts)
        cost[name] = time.perf_counter() - began + 1e-9
    out, left = [], np.ones(texts.rows, bool)
    while len(out) < len(rules):
        best = max((n for n in rules if n not in out), key=lambda n: (int((bad[n] & left).sum()) / cost[n], -cost[n]))
        out.append(best)
        left &= ~bad[best]
    return out


def cascade(texts: Texts, alive: np.ndarray, order: list[str], rules=RULES) -> np.ndarray:
    """The name of the first rule in ``order`` that rejects each row, '' for the others; rows not ``alive`` are not asked about."""
    out = np.full(texts.rows, "", object)
    rows = np.flatnonzero(alive)  # of all texts
    here = rows  # the same rows, of the texts that are left
    for name in order:
        if not len(rows):
            break
        if len(rows) < WORTH * texts.rows:
            texts, here = texts.of(here), np.arange(len(rows))
        bad = rules[name](texts)[here]
        out[rows[bad]] = name
        rows, here = rows[~bad], here[~bad]
    return out


def quality(documents: DataFrame, order: list[str] | None = None) -> DataFrame:
    """A row per document: the counts, the base rule and the cascade's verdict.  ``order``: of the rules; measured where it is None."""

    def run(batches):
        ranked = order
        for part in tb.slices(batches):
            column = part.column(1)
            ranked = ranked or order_rules(column)
            t = Texts(column)
            repeat = t.n_repeat_words()
            failed = (t.n_words < MIN_WORDS) | (100 * repeat > 50 * t.n_words)
            counts = t.n_words, t.word_chars(), t.n_symbols(), t.n_dup_lines(), repeat, failed
            by = cascade(t, ~failed, ranked)
            yield pa.record_batch([part.column(0), *map(pa.array, (*counts, ~failed & (by == ""))), pa.array(by.tolist(), pa.string())], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"])
        tb.release()

    return documents.select(documents["doc_id"].cast("long"), documents["text"]).mapInArrow(run, SCHEMA)
