"""SimHash near-duplicates through vantage-point trees.

A fingerprint is folded from the XXH64 values of a text's word shingles.  Distinct
fingerprints are placed in a vantage-point tree over Hamming distance.  A node has a
vantage point, and its children are told apart by their distances from it over disjoint
blocks of bits; so the triangle bounds |d(x, v) - d(y, v)| <= d(x, y) of the blocks add
up, and a child is left out as soon as their sum exceeds the radius.

The upper levels cut the fingerprints into shards.  The root's children are rings over
the two halves of the bits; a child of more than ``NODE`` fingerprints is cut again, by
a vantage point of its own and over the four quarters.  A fingerprint lives in one shard
and is a query in every shard that its radius overlaps (within a node in one of the two
directions, so a pair meets once).  The lower levels are searched within a shard, around
a vantage point of the shard, byte by byte of the distance, and small leaves are compared
outright, so the pairs are exact.

Equal fingerprints are one node, so groups of exact copies cost nothing.  Groups of
near copies do not become lists of pairs: a shard passes on a star per component of
what it found.  Crowded shards are cut into parts of bounded size.

Null and empty texts have fingerprint zero; texts of fewer words than a shingle take
all of them as one.  Repeated rows are answered row by row; null ids never name a
component unless no other id is there.  Other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import textbatch as tb
from .graph import components
from .shared import written

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Fingerprints of a part of a shard: a fiftieth of them all, within these bounds.
PART = (1_000, 500_000)
#: Blocks of bits of the levels that cut shards, and the fingerprints beyond which a shard of the level before is cut again.
BLOCKS = (2, 4)
NODE = 100_000
LEAF_PAIRS = 1 << 20
SAMPLE = 1024
_CHUNK = 1 << 16
_WORDS = np.random.default_rng(6).integers(0, 1 << 64, 16, np.uint64)
_BYTES = np.uint64(0x0101010101010101)


def _fold(hashes: np.ndarray) -> np.ndarray:
    """Per bit, in how many of the hashes it is set."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprints(column: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    data, off = tb.raw(column)
    data = tb.LOWER[data]
    starts, ends, woff = tb.spans(data, off, tb.NON_SPACE)
    out = np.zeros(len(off) - 1, np.uint64)
    if not len(starts):
        return out
    keep = tb.NON_SPACE[data]
    gap = ends[ends < len(data)]
    gap = gap[~keep[gap]]
    keep[gap] = True
    data[gap] = 0x20
    place = np.cumsum(keep) - 1
    text = np.compress(keep, data).tobytes()
    starts, ends = place[starts], place[ends - 1] + 1
    digest, weights = xxhash.xxh64_intdigest, np.uint64(1) << np.arange(64, dtype=np.uint64)
    for row in np.flatnonzero(np.diff(woff)):
        lo, hi = int(woff[row]), int(woff[row + 1])
        n = max(1, hi - lo - shingle + 1)
        last = ends[lo + min(shingle, hi - lo) - 1 : hi]
        ones = np.zeros(64, np.int64)
        for at in range(0, n, _CHUNK):
            s, e = starts[lo + at : lo + min(n, at + _CHUNK)].tolist(), last[at : at + _CHUNK].tolist()
            ones += _fold(np.fromiter((digest(text[i:j], SEED) for i, j in zip(s, e)), np.uint64, len(s)))
        out[row] = weights[2 * ones > n].sum(dtype=np.uint64)
    return out


def sign(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every document; fp is the fingerprint as a signed long."""
    return tb.mapped(documents, lambda part: pa.record_batch([part.column(0), pa.array(fingerprints(part.column(1), shingle).view(np.int64))], names=["doc_id", "fp"]), "doc_id long, fp long")


def sign_keyed(documents: DataFrame, key, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, h, fp): as sign(), with a hash of the text."""
    rows = documents.select("doc_id", key.alias("h"), "text")
    return tb.mapped(rows, lambda part: pa.record_batch([part.column(0), part.column(1), pa.array(fingerprints(part.column(2), shingle).view(np.int64))], names=["doc_id", "h", "fp"]), "doc_id long, h long, fp long", ("doc_id", "h", "text"))


def folded(values: np.ndarray, off: np.ndarray, words: int) -> np.ndarray:
    """Fingerprints of ``words`` times 64 bits (sets by words) of sets of hashes; zero for an empty set.

    Each word is folded from a mix of its own; a bit is 1 if set in over half of them."""
    size = np.diff(off)
    some = np.flatnonzero(size)
    out = np.zeros((len(size), words), np.uint64)
    if not len(some):
        return out
    # a byte of a sum counts one bit, over pieces of 255 hashes at most
    pieces = -(-size[some] // 255)
    first = np.cumsum(pieces) - pieces
    starts = np.repeat(off[some], pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    for word in range(words):
        mixed = tb.mix(values ^ _WORDS[word])
        for bit in range(8):
            sums = np.add.reduceat((mixed >> np.uint64(bit)) & _BYTES, starts)
            ones = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int64)
            out[some, word] |= ((2 * ones > size[some][:, None]).astype(np.uint64) << (8 * np.arange(8, dtype=np.uint64) + np.uint64(bit))).sum(axis=1, dtype=np.uint64)
    return out


def _bytewise(rows: np.ndarray) -> np.ndarray:
    """Bits set in each byte of fingerprints (rows by words)."""
    return np.bitwise_count(np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)).astype(np.int8)


def _vantage(sample: np.ndarray) -> np.ndarray:
    """Of a few sampled fingerprints (rows by words), that from which the sample's distances over the bytes spread most."""
    if not len(sample):
        return np.zeros(sample.shape[1], np.uint64)
    some = sample[:: max(1, len(sample) // 16)]
    spread = [_bytewise(sample ^ v).var(axis=0).sum() for v in some]
    return some[int(np.argmax(spread))]


class Forest:
    """Components of numbered nodes, by least number."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def meet(home: np.ndarray, query: np.ndarray, radius: int, found) -> None:
    """``found(q, h)`` is given the places of all pairs of a query and a home fingerprint (rows by words) within the radius, some at a time."""
    vantage = _vantage(home[:SAMPLE])
    d_h, d_q = _bytewise(home ^ vantage), _bytewise(query ^ vantage)

    def leaf(q: np.ndarray, h: np.ndarray) -> None:
        step = max(1, LEAF_PAIRS // len(h))
        for at in range(0, len(q), step):
            part = q[at : at + step]
            apart = np.bitwise_count(query[part, 0][:, None] ^ home[h, 0][None, :])
            for word in range(1, home.shape[1]):
                apart = np.add(apart, np.bitwise_count(query[part, word][:, None] ^ home[h, word][None, :]), dtype=np.int16)
            i, j = np.nonzero(apart <= radius)
            found(part[i], h[j])

    def node(level: int, q: np.ndarray, h: np.ndarray, spent: np.ndarray) -> None:
        if not len(q) or not len(h):
            return
        if level == d_h.shape[1] or len(q) * len(h) <= LEAF_PAIRS:
            leaf(q, h)
            return
        ring = d_h[h, level]
        for r in np.unique(ring):
            cost = spent + np.abs(d_q[q, level] - r)
            near = cost <= radius
            node(level + 1, q[near], h[ring == r], cost[near])

    node(0, np.arange(len(query)), np.arange(len(home)), np.zeros(len(query), np.int16))


def search(home: np.ndarray, query: np.ndarray, own: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links a star each: members and centres of the components that pairs within the radius make.

    Pairs are of a query and a home fingerprint; where the query is of the same shard (``own``), the lesser is the query."""
    nodes, where = np.unique(np.concatenate([home, query]), return_inverse=True)
    node_h, node_q = where[: len(home)], where[len(home) :]
    forest = Forest(len(nodes))

    def found(i: np.ndarray, j: np.ndarray) -> None:
        once = ~own[i] | (query[i] < home[j])
        forest.link(node_q[i[once]], node_h[j[once]])

    meet(home[:, None], query[:, None], radius, found)
    member = np.flatnonzero(forest.root != np.arange(len(nodes)))
    return nodes[member], nodes[forest.root[member]]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _rings(vantage, blocks: int) -> F.Column:
    """The distances of ``fp`` from a vantage point over blocks of bits, as an array."""
    width = 64 // blocks
    apart = F.col("fp").bitwiseXOR(vantage)
    return F.array(*[F.bit_count(apart.bitwiseAND(F.lit(_signed(((1 << width) - 1) << (width * k))).cast("long"))).cast("int") for k in range(blocks)])


def _child(rings: F.Column, blocks: int) -> F.Column:
    """The number of a child, unique among the children of all nodes of its level."""
    number = F.col("node")
    for k in range(blocks):
        number = number * (64 // blocks + 1) + rings[k]
    return number


def _cut(visits: DataFrame, blocks: int, radius: int) -> DataFrame:
    """From visits (fp, node, own, vantage) to nodes those (fp, node, own) to their children that the radius overlaps.

    own: the fingerprint lives there.  Of two children of one node that see each other's fingerprints, only the one that is
    lesser asks; what comes from outside the node asks all that it overlaps."""
    zero = (0,) * blocks
    steps = [to for to in itertools.product(range(-radius, radius + 1), repeat=blocks) if sum(map(abs, to)) <= radius]
    some = lambda chosen: F.array(*[F.array(*map(F.lit, to)) for to in chosen])
    at = visits.select("fp", "node", "own", _rings(F.col("vantage"), blocks).alias("rings"))
    at = at.withColumn("to", F.explode(F.when(F.col("own"), some([to for to in steps if to >= zero])).otherwise(some(steps))))
    there = F.zip_with("rings", "to", lambda a, b: a + b)
    at = at.select("fp", "node", (F.col("own") & (F.col("to") == F.array(*map(F.lit, zero)))).alias("own"), there.alias("rings"))
    return at.filter(F.forall("rings", lambda r: (r >= 0) & (r <= 64 // blocks))).select("fp", _child(F.col("rings"), blocks).alias("node"), "own")


def shards(distinct: DataFrame, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """(visits, sizes): fp, node, own; and of each shard with fingerprints of its own their number and that of its visits."""
    sample = np.array([r.fp for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    crowded, done = distinct.select("fp", F.lit(0).cast("long").alias("node"), F.lit(True).alias("own"), F.lit(_signed(int(_vantage(sample[:, None])[0]))).cast("long").alias("vantage")), []
    for level, blocks in enumerate(BLOCKS):
        visits = _cut(crowded, blocks, radius)
        if level:
            visits = visits.withColumn("node", -F.col("node") - 1)  # apart from the numbers of the level before
        sizes = written(visits.groupBy("node").agg(F.sum(F.col("own").cast("long")).alias("homes"), F.count("*").alias("asked")).filter("homes > 0"), "shards")
        big = sizes.filter(F.col("homes") > NODE).select("node")
        if level == len(BLOCKS) - 1 or not big.limit(1).count():
            done.append((visits, sizes))
            break
        done.append((visits.join(big, "node", "left_anti"), sizes.filter(F.col("homes") <= NODE)))
        crowded = written(visits.join(big, "node", "left_semi"), "crowded-shards")
        # a node's vantage point is the one of its own fingerprints whose hash is least
        points = written(crowded.filter("own").groupBy("node").agg(F.min_by("fp", F.xxhash64("fp")).alias("vantage")), "vantage-points")
        crowded = crowded.join(points, "node")
    visits, sizes = done[0]
    for more, rest in done[1:]:
        visits, sizes = visits.unionByName(more), sizes.unionByName(rest)
    return visits, sizes


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): edges whose components are those of all pairs of fingerprints within the radius.

    The driver sees a sample of ``SAMPLE`` fingerprints, which chooses the root's vantage point, and the number of them all."""
    visits, sizes = shards(distinct, radius)
    # the parts grow with the input, so that rows are repeated for no more parts than on a small one
    part = int(min(PART[1], max(PART[0], distinct.count() // 50)))
    parts = sizes.select("node", F.ceil(F.col("homes") / part).cast("int").alias("homes"), F.greatest(F.lit(1), F.ceil(F.col("asked") / (2 * part))).cast("int").alias("queries"))
    rows = visits.join(parts, "node")
    salt = F.xxhash64("fp", F.lit(1))
    asks = rows.select("fp", "node", "own", F.explode(F.sequence(F.lit(0), F.col("homes") - 1)).alias("hs"), F.pmod(salt, F.col("queries")).cast("int").alias("qs"), F.lit(False).alias("home"))
    lives = rows.filter("own").select("fp", "node", "own", F.pmod(salt, F.col("homes")).cast("int").alias("hs"), F.explode(F.sequence(F.lit(0), F.col("queries") - 1)).alias("qs"), F.lit(True).alias("home"))

    def run(t: pa.Table) -> pa.Table:
        fp, home, own = (t.column(c).to_numpy() for c in ("fp", "home", "own"))
        fp = fp.astype(np.int64).view(np.uint64)
        a, b = search(fp[home], fp[~home], own[~home].astype(bool), radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    # dealt by range, so that a task has its share of the rows and not of the shards
    dealt = lives.unionByName(asks).repartitionByRange("node", "hs", "qs")
    return dealt.groupBy("node", "hs", "qs").applyInArrow(run, "a long, b long")


def _roots(signed: DataFrame, radius: int) -> DataFrame:
    """(fp, least, root) of the distinct fingerprints: the least id that has it, and the fingerprint that names its group."""
    distinct = written(signed.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    joined = components(links(distinct, radius))
    return distinct.join(joined, distinct.fp == joined.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(documents: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): the least doc_id that can be reached from the document over linked fingerprints."""
    signed = written(sign(documents, shingle), "simhash")
    root = _roots(signed, radius)
    name = root.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = written(root.join(name, "root").select("fp", "component_id"), "components")
    return signed.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def representatives(documents: DataFrame, groups: DataFrame, key) -> DataFrame:
    """Of ``groups`` (doc_id, h, root), h being ``key`` of the text: the document of the least id of each root (null ids last, then by text), with all its columns."""
    stay = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("x"))
    # met and made unique by the same three columns, so that the texts are shuffled once
    by = ["__stay_none", "__stay_id", "__stay_h"]
    stay = written(stay.select(F.col("x.none").alias(by[0]), F.coalesce("x.doc_id", F.lit(0)).alias(by[1]), F.col("x.h").alias(by[2])), "representatives")
    names, own = documents.columns, F.col("doc_id").cast("long")
    rows = documents.select("*", own.isNull().alias(by[0]), F.coalesce(own, F.lit(0)).alias(by[1]), key.alias(by[2]))
    return rows.join(stay.hint("shuffle_hash"), by).dropDuplicates(by).select(*names)


def keep_one(documents: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One document of each group, that of the least id (null ids last, then by text), with all its columns.

    Texts are known by a hash here, and whole rows that are equal in id and text are one document."""
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    signed = written(sign_keyed(documents, key, shingle), "simhash")
    groups = signed.join(written(_roots(signed, radius).select("fp", "root"), "roots"), "fp")
    return representatives(documents, groups, key)


def report(grouped: DataFrame) -> DataFrame:
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
