"""Fill-in-the-middle: each text cut twice at token boundaries and its parts put in another order.

Tokens are ``[A-Za-z]+|[^A-Za-z]`` over code points, so a text of n tokens has n + 1 places
to cut.  A slice of rows is worked on as one UTF-8 buffer: a table of 256 entries gives the
class of each byte, a byte and the one before it tell whether a token begins there, the
running sum of these marks starts anew in each document, and one binary search in it finds
the cuts of all rows together.  Outputs are gathered by index from the same buffer, and
``restore`` finds the three marks in them the same way.

``transform`` keeps a text as it is (form ``plain``) if it is empty, contains a mark itself,
or is drawn for it; otherwise it makes ``<P>prefix<S>suffix<M>middle`` (``psm``) or
``<S>suffix<P>prefix<M>middle`` (``spm``).  Draws depend on ``seed`` and doc_id alone.

Null texts count as empty: one row, form plain, empty output.  A null id draws as the empty
string.  Repeated rows are answered row by row.  Other columns are ignored.  No rows make
no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import textbatch as tb

#: Share of texts left plain, and of the others with the suffix first; per cent.
PLAIN_PERCENT = 10
SUFFIX_FIRST_PERCENT = 20
#: The marks before prefix, suffix and middle.
MARKS = b"<P><S><M>"
MARK = 3
FORMS = np.array(["plain", "psm", "spm"], object)
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

_LETTER, _LEAD, _TRAIL = 0, 1, 2
#: Bytes that are a letter, that begin another code point, and that go on with one.
CLASSES = np.full(256, _LEAD, np.uint8)
CLASSES[0x80:0xC0] = _TRAIL
CLASSES[0x41:0x5B] = CLASSES[0x61:0x7B] = _LETTER


def _sum(flags: np.ndarray) -> np.ndarray:
    """Running sums, a zero before them."""
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def token_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which bytes begin a token; no token reaches over two rows."""
    kind = CLASSES[data]
    begins = kind == _LEAD
    letter = kind == _LETTER
    fresh = letter.copy()
    fresh[1:] &= ~letter[:-1]
    first = off[:-1][np.diff(off) > 0]
    fresh[first] = letter[first]
    return begins | fresh


def draws(ids: list, seed: int) -> np.ndarray:
    """The first four groups of eight digits of the digest of ``seed:id``, by row."""
    raw = b"".join(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).digest()[:16] for k in ids)
    return np.frombuffer(raw, ">u4").reshape(-1, 4).astype(np.int64)


def marks_in(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of marks inside a row, and which mark each is."""
    if len(data) < MARK:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero((data[:-2] == MARKS[0]) & (data[2:] == MARKS[2]))
    which = np.full(len(at), -1)
    for k in range(3):
        which[data[at + 1] == MARKS[MARK * k + 1]] = k
    keep = (which >= 0) & (np.searchsorted(off, at, "right") == np.searchsorted(off, at + MARK - 1, "right"))
    return at[keep], which[keep]


def _gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of a buffer one after another, and the offsets of the rows: starts and sizes have a column for each piece of a row."""
    at = _sum(sizes.ravel())
    index = np.arange(at[-1]) - np.repeat(at[:-1] - starts.ravel(), sizes.ravel())
    return pool[index], at[:: sizes.shape[1]]


def cut(column: pa.Array, ids: list, seed: int) -> dict[str, np.ndarray | pa.Array]:
    """The columns of ``SCHEMA`` but doc_id, of all rows of a slice together."""
    data, off = tb.raw(column)
    total = _sum(token_starts(data, off))
    base = total[off]
    n = base[1:] - base[:-1]
    h = draws(ids, seed)
    marked = np.zeros(len(n), bool)
    marked[np.searchsorted(off, marks_in(data, off)[0], "right") - 1] = True
    form = np.where(h[:, 3] % 100 < SUFFIX_FIRST_PERCENT, 2, 1)
    form[(n == 0) | marked | (h[:, 2] % 100 >= 100 - PLAIN_PERCENT)] = 0
    places = h[:, :2] % (n + 1)[:, None]
    # the k-th token of a row begins where the row's sum becomes k + 1; the end of the last one is the row's
    wanted = np.stack([places.min(axis=1), places.max(axis=1)], 1)
    cuts = np.where(wanted < n[:, None], np.searchsorted(total[1:], base[:-1, None] + wanted + 1), off[1:, None])
    chars = _sum((data & 0xC0) != 0x80)
    lo, hi, (a, b) = off[:-1], off[1:], cuts.T
    pool, mark = np.concatenate([data, np.frombuffer(MARKS, np.uint8)]), len(data) + MARK * np.arange(3)
    three = np.full(len(n), MARK)
    pieces = {"P": [(mark[0] + 0 * a, three), (lo, a - lo)], "S": [(mark[1] + 0 * a, three), (b, hi - b)], "M": [(mark[2] + 0 * a, three), (a, b - a)]}
    plain = [(lo, hi - lo), *[(lo, 0 * a)] * 5]
    ways = [plain, pieces["P"] + pieces["S"] + pieces["M"], pieces["S"] + pieces["P"] + pieces["M"]]
    starts, sizes = (np.choose(form[:, None], [np.stack([p[k] for p in way], 1) for way in ways]) for k in (0, 1))
    whole = form == 0
    return {
        "n": n, "form": pa.array(FORMS[form], pa.string()), "prefix_chars": pa.array(chars[a] - chars[lo], mask=whole), "middle_chars": pa.array(chars[b] - chars[a], mask=whole),
        "output": tb.as_strings(*_gathered(pool, starts, sizes)).cast(pa.string()),
    }


def joined(column: pa.Array, forms: pa.Array) -> pa.Array:
    """The texts that outputs and their forms were made of."""
    data, off = tb.raw(column)
    form = np.array([{"plain": 0, "psm": 1, "spm": 2}[f] for f in forms.to_pylist()], np.int64)
    at, which = marks_in(data, off)
    row = np.searchsorted(off, at, "right") - 1
    at, which, row = (x[form[row] > 0] for x in (at, which, row))
    place = np.zeros((len(form), 3), np.int64)
    place[row, which] = at
    lo, hi, (p, s, m) = off[:-1], off[1:], place.T
    psm = form == 1
    parts = [(p + MARK, np.where(psm, s, m)), (m + MARK, hi), (s + MARK, np.where(psm, m, p))]
    starts = np.where(form[:, None] == 0, lo[:, None], np.stack([a for a, _ in parts], 1))
    ends = np.where(form[:, None] == 0, np.stack([hi, lo, lo], 1), np.stack([b for _, b in parts], 1))
    return tb.as_strings(*_gathered(data, starts, ends - starts)).cast(pa.string())


def transform(documents: DataFrame, seed: int = 1) -> DataFrame:
    """A row per document: tokens, form, lengths of prefix and middle in code points (null if plain), and the output text."""

    def run(part):
        out = cut(part.column(1), part.column(0).to_pylist(), seed)
        return pa.record_batch([part.column(0), *map(lambda v: v if isinstance(v, pa.Array) else pa.array(v), out.values())], names=["doc_id", *out])

    return tb.mapped(documents, run, SCHEMA)


def restore(transformed: DataFrame, column: str = "restored") -> DataFrame:
    """``transform``'s rows with the text that each output was made of, from output and form alone."""
    schema = StructType([*transformed.schema.fields, StructField(column, StringType())])

    def run(batches):
        for part in tb.slices(batches, "output"):
            names = part.schema.names
            yield pa.record_batch([*part.columns, joined(tb.text_of(part, "output"), tb.text_of(part, "form"))], names=[*names, column])
        tb.release()

    return transformed.mapInArrow(run, schema)


def report(restored: DataFrame) -> DataFrame:
    """Counts, and digests of output and restored text."""
    return restored.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
