"""Near duplicates by word shingles: a similarity of ``SIMILAR`` or more, with an exact check.

The pipeline's form of the SimHash stage.  A text is the set of its shingles of
``SHINGLE`` words (ASCII lower case, by 64-bit hash); two texts are near copies if the
Jaccard similarity of their sets is at least ``SIMILAR``, and groups are the components
of near copies; one document of a group stays.  Texts of fewer words than a shingle take
all of them as one; null, empty and blank texts have the empty set and are copies of one
another.  Ties of ids are settled by the text's hash; null ids stay only where no other
id of the group is there; repeated rows are one document.

Texts with one set are one node.  A node has a SimHash fingerprint of ``WORDS`` times 64
bits: at the threshold two sets differ in 15 % of the bits (in 18.75 % at most, where one
has four shingles and the other one more), so they are beyond ``RADIUS`` with a
probability of one in a billion at most.  Fingerprints are searched around vantage points
as in simhash.py, shard by shard.  What differs is how shards are made: at this radius
rings around a vantage point leave out nothing (figures in the README), so a shard is a
bucket of nodes of which ``ROWS`` min-hashes agree in one of ``BANDS`` bands: a pair at
the threshold is missed with a probability of (1 - SIMILAR^ROWS)^BANDS, under one in ten
million, and a closer one with less.

A shard passes on the components of what is within the radius, and only these sets
travel, once for each distinct component.  There every pair is settled on the sets
themselves (48 bits a shingle): those that a node reaches are set aside, so a component
of near copies costs its size, not its square, and nothing is capped or sampled.
Shards of the same nodes are searched once; shards beyond ``PART`` nodes are cut into
parts, and each pair of parts is searched.  A task streams its shards one after another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textbatch as tb
from .graph import components
from .shared import written
from .simhash import Forest, folded, meet, representatives

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 32, 4
#: Words of 64 bits of a fingerprint, and the bits in which those of near copies differ at most.
WORDS, RADIUS = 4, 88
PART = 10_000
#: Rows of sets that a task compares, and of fingerprints that a task searches, about; a single shard or pair of parts may have more.
TASK_ROWS, SEARCH_ROWS = 2_000, 20_000
#: Bits for each text whose set is asked for, and bits in all at most (32 MB), of the map by which the texts are picked; it never leaves out one of them.
ASK_BITS, MOST_BITS = 32, 1 << 28
#: Bytes of a shingle's hash that travel and are compared: two shingles of two texts of 20,000 words have one in common by chance once in a million pairs of texts.
BYTES = 6
#: Values compared at once.
PIECE = 1 << 18
_random = np.random.default_rng(5)
_XOR = _random.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_ODD = _random.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingles(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles' hashes in ascending order, and the offsets of the texts in them."""
    data, off = tb.raw(column)
    data = tb.LOWER[data]
    starts, ends, woff = tb.spans(data, off, tb.NON_SPACE)
    words = tb.hashes(data, starts, ends)
    n = np.diff(woff)
    full = tb.grams(words, size)
    ok = tb.within(woff, size)
    values, rows = [full[ok]], [tb.rows_of(woff)[: len(full)][ok]]
    for k in range(1, size):
        short = np.flatnonzero(n == k)
        if len(short):
            values.append(tb.grams(words[woff[short][:, None] + np.arange(k)].ravel(), k)[::k])
            rows.append(short)
    values, rows = np.concatenate(values), np.concatenate(rows)
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[new], np.searchsorted(rows[new], np.arange(len(off)))


def bands(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A key for each band of each set (rows by bands); no set may be empty."""
    out = np.zeros((len(off) - 1, BANDS), np.uint64)
    if not len(out):
        return out
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            key = np.full(len(out), band + 1, np.uint64)
            for k in range(band * ROWS, (band + 1) * ROWS):
                key = tb.mix(key * _ODD[0] + np.minimum.reduceat((values ^ _XOR[k]) * _ODD[k], off[:-1]))
            out[:, band] = key
    return out


def _node(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A hash of each set; zero for the empty one."""
    out = np.zeros(len(off) - 1, np.uint64)
    some = np.flatnonzero(np.diff(off))
    if len(some):
        with np.errstate(over="ignore"):
            a = np.add.reduceat(tb.mix(values ^ _XOR[0]), off[some])
            b = np.bitwise_xor.reduceat(tb.mix(values ^ _XOR[1]), off[some])
            out[some] = tb.mix(a * _ODD[1] + b)
    return out


def sign(documents: DataFrame, key) -> DataFrame:
    """(doc_id, h, node, bands, fp) of every document; h is ``key``, bands are 64-bit numbers, fp is the fingerprint's bytes."""

    def run(part):
        values, off = shingles(part.column(2))
        node, some = _node(values, off), np.flatnonzero(np.diff(off))
        keys = np.zeros((len(off) - 1, BANDS), np.uint64)
        keys[some] = bands(values, off[np.append(some, len(off) - 1)])
        width = np.where(np.diff(off) > 0, BANDS, 0)
        list_off = np.concatenate([[0], np.cumsum(width)])
        lists = pa.ListArray.from_arrays(pa.array(list_off, pa.int32()), pa.array(keys[some].ravel().view(np.int64)))
        fp = tb.as_strings(folded(values, off, WORDS).view(np.uint8).ravel(), np.arange(len(off)) * 8 * WORDS, binary=True).cast(pa.binary())
        return pa.record_batch([part.column(0), part.column(1), pa.array(node.view(np.int64)), lists, fp], names=["doc_id", "h", "node", "bands", "fp"])

    return tb.mapped(documents.select("doc_id", key.alias("h"), "text"), run, "doc_id long, h long, node long, bands array<long>, fp binary", ("doc_id", "h", "text"))


def _asked(reps: DataFrame) -> np.ndarray:
    """A map of bits (in 64-bit words, a power of two of them) by the hash of (id, h) of ``reps``; the driver gets the words that are not zero."""
    bits = min(MOST_BITS, 1 << max(6, (ASK_BITS * reps.count()).bit_length()))
    place = F.xxhash64("id", "h").bitwiseAND(F.lit(bits - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    full = reps.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[full["word"].to_numpy()] = full["bits"].to_numpy().view(np.uint64)
    return out


def sets_of(documents: DataFrame, reps: DataFrame, key) -> DataFrame:
    """(node, shingles): the sets of the nodes of ``reps`` (node, id, h), from the text that each names, and of few others; ``packed``.

    Texts are picked where they are by a map of bits and are not shuffled; a set names its node itself."""
    asked = documents.sparkSession.sparkContext.broadcast(_asked(reps))
    rows = documents.select(F.xxhash64(F.col("doc_id").cast("long"), key).alias("mark"), "text")

    def run(part):
        place = part.column(0).to_numpy().view(np.uint64) & np.uint64(64 * len(asked.value) - 1)
        part = part.filter(pa.array((asked.value[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)))
        if not part.num_rows:
            return None
        values, off = shingles(part.column(1))
        return pa.record_batch([pa.array(_node(values, off).view(np.int64)), tb.as_strings(*packed(values, off), binary=True).cast(pa.binary())], names=["node", "shingles"])

    return tb.mapped(rows, run, "node long, shingles binary", ("mark", "text")).dropDuplicates(["node"]).join(reps.select("node"), "node", "left_semi")


def packed(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sets as they travel: the upper ``BYTES`` bytes of each hash, in order, each once; and the sets' offsets in them."""
    low = np.uint64(8 * (8 - BYTES))
    row = tb.rows_of(off)
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] >> low != values[:-1] >> low) | (row[1:] != row[:-1])
    kept = np.ascontiguousarray(values[new], "<u8").view(np.uint8).reshape(-1, 8)[:, 8 - BYTES :]
    return np.ascontiguousarray(kept).ravel(), np.searchsorted(row[new], np.arange(len(off))) * BYTES


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // BYTES, 8), np.uint8)
    out[:, 8 - BYTES :] = np.frombuffer(data, np.uint8).reshape(-1, BYTES)
    return out.view("<u8").ravel()


def common(one: np.ndarray, values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many values of each sorted set are in the sorted set ``one``; temporaries of ``PIECE`` values or one set."""
    out, at = np.zeros(len(off) - 1, np.int64), 0
    while at < len(out):
        to = max(at + 1, int(np.searchsorted(off, off[at] + PIECE, "right")) - 1)
        some = values[off[at] : off[to]]
        place = np.searchsorted(one, some)
        place[place == len(one)] = 0
        out[at:to] = np.add.reduceat(one[place] == some, off[at:to] - off[at], dtype=np.int64)
        at = to
    return out


def search(nodes: np.ndarray, values: np.ndarray, off: np.ndarray, similar: float = SIMILAR) -> tuple[list[int], list[int]]:
    """Edges that have the components of all pairs of sets (none empty) whose similarity is ``similar`` or more."""
    size = np.diff(off)
    left, a, b = np.arange(len(nodes)), [], []
    rest, roff = values, off
    while len(left) > 1:
        # what is left is held without what was reached, so that no search walks over it again
        queue, left, rest, roff = [left[0]], left[1:], rest[roff[1] :], roff[1:] - roff[1]
        while queue and len(left):
            q = queue.pop()
            shared = common(values[off[q] : off[q + 1]], rest, roff)
            near = shared >= similar * (size[left] + size[q] - shared) - 1e-9
            if near.any():
                a += [int(nodes[q])] * int(near.sum())
                b += nodes[left[near]].tolist()
                queue += left[near].tolist()
                rest = rest[np.repeat(~near, np.diff(roff))]
                left = left[~near]
                roff = np.concatenate([[0], np.cumsum(size[left])])
    return a, b


def _cells(batches):
    """The rows (cell, node, bytes) of each cell of sorted rows, a cell at a time however the batches cut them."""
    held: list[tuple[int, int, bytes]] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[0] != held[0][0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def alike(prints: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """The place that names each fingerprint's component, over all pairs within the radius; found around vantage points."""
    forest = Forest(len(prints))

    def found(i: np.ndarray, j: np.ndarray) -> None:
        once = i < j
        forest.link(i[once], j[once])

    meet(prints, prints, radius, found)
    return forest.root


def _once(groups: DataFrame, *by: str) -> DataFrame:
    """(``by``, n) of the groups of two nodes or more, those of the same nodes once."""
    mark = F.xxhash64("node")
    sized = groups.groupBy(*by).agg(F.count("*").alias("n"), F.min("node").alias("least"), F.bit_xor(mark).alias("mark")).filter("n > 1")
    return sized.groupBy("n", "least", "mark").agg(F.min(F.struct(*by)).alias("by")).select("by.*", "n")


def shards(signed: DataFrame) -> DataFrame:
    """(cell, node): the nodes that meet in a bucket, by bucket or pair of parts of it."""
    held = signed.groupBy("node").agg(F.first("bands").alias("bands"))
    keyed = written(held.select("node", F.explode("bands").alias("key")), "bands")
    buckets = written(_once(keyed, "key").select("key", F.ceil(F.col("n") / PART).cast("int").alias("parts")), "buckets")
    part, other = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int"), F.col("other")
    members = keyed.join(buckets, "key").select("key", "node", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    return members.select(F.xxhash64("key", F.least("part", other), F.greatest("part", other)).alias("cell"), "node")


def candidates(members: DataFrame, prints: DataFrame) -> DataFrame:
    """(cell, node): the components, each a cell of its own, of fingerprints within the radius of one another in the cells of ``members``.

    ``prints`` has node and fp.  Cells of one node are left out, and cells of the same nodes are there once."""

    def run(batches):
        for rows in _cells(batches):
            root = alike(np.frombuffer(b"".join(x for _, _, x in rows), "<u8").reshape(len(rows), WORDS))
            kept = np.flatnonzero(np.bincount(root, minlength=len(rows))[root] > 1)
            if len(kept):
                node = np.array([n for _, n, _ in rows], np.int64)
                yield pa.record_batch([pa.array(np.full(len(kept), rows[0][0])), pa.array(node[kept]), pa.array(node[root[kept]])], names=["cell", "node", "root"])

    tasks = max(1, members.count() // SEARCH_ROWS)
    met = members.join(prints, "node").select("cell", "node", "fp")
    near = written(met.repartition(tasks, "cell").sortWithinPartitions("cell").mapInArrow(run, "cell long, node long, root long"), "near-cells")
    return near.join(written(_once(near, "cell", "root"), "near-shards"), ["cell", "root"]).select(F.xxhash64("cell", "root").alias("cell"), "node")


def links(signed: DataFrame, documents: DataFrame, key) -> DataFrame:
    """(a, b): edges whose components are those of all near copies."""
    members = written(shards(signed), "bucket-members")
    met = signed.select("node", "doc_id", "h", "fp").join(members.select("node").distinct(), "node", "left_semi")
    reps = written(met.groupBy("node").agg(F.min(F.struct("doc_id", "h", "fp")).alias("x")).select("node", F.col("x.doc_id").alias("id"), "x.h", "x.fp"), "bucket-nodes")
    near = written(candidates(members, reps.select("node", "fp")), "candidates")
    reps = written(reps.join(near.select("node").distinct(), "node", "left_semi").select("node", "id", "h"), "candidate-nodes")
    tasks = max(1, near.count() // TASK_ROWS)

    def run(batches):
        for rows in _cells(batches):
            sets = [unpacked(x) for _, _, x in rows]
            a, b = search(np.array([n for _, n, _ in rows], np.int64), np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])]))
            if a:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        tb.release()

    # sorted by cell and streamed: a task holds one cell's sets at a time
    met = near.join(sets_of(documents, reps, key), "node").select("cell", "node", "shingles")
    return met.repartition(tasks, "cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def keep_one(documents: DataFrame) -> DataFrame:
    """One document of each group of near copies, chosen as simhash.keep_one does, with all its columns."""
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    signed = written(sign(documents, key), "shingle-sets")
    joined = written(components(links(signed, documents, key)), "near-copies")
    rows = signed.select("doc_id", "h", "node")
    groups = rows.join(joined, "node", "left").select("doc_id", "h", F.coalesce("root", "node").alias("root"))
    return representatives(documents, groups, key)
