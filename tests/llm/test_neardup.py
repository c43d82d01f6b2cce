import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from foliant.llm import neardup, simhash, textbatch as tb

from . import plain


def shingled(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(plain.ASCII))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def groups_of(rows):
    """Group of each row, over all pairs of a similarity of 0.8 or more."""
    sets, label = [shingled(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(rows))]


def edited(r, words, n):
    out = list(words)
    for at in r.sample(range(len(out)), n):
        out[at] = f"other{r.randrange(10**6)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def copies():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    out = []
    for k in range(40):
        words = [word() for _ in range(300)]
        out += [" ".join(words), *(edited(r, words, n) for n in (1, 3, 5, 6, 8, 12))]
    return list(enumerate(out)) + [(900, ""), (901, None), (902, " \n"), (903, "a b"), (904, "A  b"), (905, "a b c"), (None, "a b c"), (None, "a lone text")]


@pytest.mark.parametrize("part", [10_000, 3])
def test_stage_drops_near_copies_with_edited_words(spark, copies, monkeypatch, part):
    monkeypatch.setattr(neardup, "PART", part)
    docs = spark.createDataFrame(copies, "doc_id long, text string").repartition(5)
    groups = {}
    for (d, t), g in zip(copies, groups_of(copies)):
        groups.setdefault(g, []).append((d is None, d or 0))
    assert len(groups) < len(copies) // 2
    kept = P.drop_near_duplicates(spark, docs, "")
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted(map(min, groups.values()))


def test_stage_on_the_common_rows(spark, documents, rows, nothing):
    kept = neardup.keep_one(documents)
    assert kept.columns == documents.columns and kept.count() == len(set(groups_of(rows)))
    assert neardup.keep_one(nothing).count() == 0


def test_shingles_are_sets(rows):
    values, off = neardup.shingles(pa.array([t for _, t in rows]))
    assert np.diff(off).tolist() == [len(shingled(t)) for _, t in rows]


def test_packed_sets_are_the_sets():
    import numpy as np

    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)) for n in (0, 1, 5, 300)] + [np.array([7 << 20, (7 << 20) + 1, 9 << 20, (1 << 64) - 1], np.uint64)]
    off = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    data, at = neardup.packed(np.concatenate(sets), off)
    for k, s in enumerate(sets):
        assert neardup.unpacked(data[at[k] : at[k + 1]].tobytes()).tolist() == sorted({int(x) >> 16 << 16 for x in s})


def test_wide_fingerprints_are_majorities():
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 1 << 64, n, np.uint64) for n in (0, 1, 4, 255, 256, 700, 0)]
    off = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    got = simhash.folded(np.concatenate(sets), off, 2)
    for row, s in zip(got, sets):
        for word in range(2):
            mixed = [int(x) for x in tb.mix(s ^ simhash._WORDS[word])]
            assert int(row[word]) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in mixed) > len(s))


@pytest.mark.parametrize("pairs", [1 << 20, 16])
def test_vantage_points_find_all_pairs_of_wide_fingerprints(monkeypatch, pairs):
    monkeypatch.setattr(simhash, "LEAF_PAIRS", pairs)
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 1 << 64, (60, 4), np.uint64)
    for row in range(20, 60):  # from a few bits to twice the radius away from another
        for bit in rng.choice(256, rng.integers(0, 176), replace=False):
            prints[row, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        prints[row] ^= prints[row % 20] ^ prints[row] if row % 7 == 0 else np.uint64(0)
    apart = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2, dtype=int)
    found = set()
    simhash.meet(prints, prints, neardup.RADIUS, lambda i, j: found.update(zip(i.tolist(), j.tolist())))
    assert found == set(zip(*(x.tolist() for x in np.nonzero(apart <= neardup.RADIUS))))


def test_near_copies_are_within_the_radius(copies):
    texts = [t for d, t in copies if d is not None and d < 900]
    values, off = neardup.shingles(pa.array(texts))
    prints, sets = simhash.folded(values, off, neardup.WORDS), [shingled(t) for t in texts]
    apart = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2, dtype=int)
    near = [(i, j) for i, a in enumerate(sets) for j in range(i) if 5 * len(a & sets[j]) >= 4 * len(a | sets[j])]
    assert near and max(apart[i, j] for i, j in near) <= neardup.RADIUS
    assert min(apart[i, j] for i in range(len(texts)) for j in range(i) if i // 7 != j // 7) > neardup.RADIUS


@pytest.mark.parametrize("part", [10_000, 3])
def test_only_what_fingerprints_bring_together_is_compared(spark, monkeypatch, part):
    """in a bucket of unlike nodes the search by vantage points leaves only the near ones, in cells of their own."""
    monkeypatch.setattr(neardup, "PART", part)
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 1 << 64, (12, 4), np.uint64)
    prints[3], prints[7] = prints[0] ^ np.uint64(5), prints[4]
    signed = spark.createDataFrame([(k, k, k + 100, [1, 2], prints[k].tobytes()) for k in range(12)], "doc_id long, h long, node long, bands array<long>, fp binary")
    cells = {}
    for r in neardup.candidates(neardup.shards(signed), signed.select("node", "fp")).collect():
        cells.setdefault(r.cell, set()).add(r.node)
    assert sorted(map(sorted, cells.values())) == [[100, 103], [104, 107]]


def test_texts_are_picked_in_place_and_shuffled_once(spark, copies):
    """The texts of sets are not shuffled, and those that stay are met and made unique by one shuffle."""
    docs = spark.createDataFrame(copies, "doc_id long, text string").withColumn("source", F.lit("s"))
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    signed = neardup.sign(docs, key)
    reps = signed.filter("doc_id % 9 = 0 AND doc_id < 900").selectExpr("node", "doc_id AS id", "h")
    groups = signed.selectExpr("doc_id", "h", "node AS root")
    plan = lambda frame: frame._jdf.queryExecution().optimizedPlan().toString() + frame._jdf.queryExecution().executedPlan().toString()
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(before, ("false", "1b")):
            spark.conf.set(k, v)
        sets, stay = neardup.sets_of(docs, reps, key), simhash.representatives(docs, groups, key)
        shuffled = lambda frame: [x for x in plan(frame).splitlines() if "Exchange hashpartitioning" in x]
        # the sets and the nodes asked for; the documents and what stays
        assert len(shuffled(sets)) == 2 and len(shuffled(stay)) == 2
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    wanted = {r.node for r in reps.collect()}
    assert {r.node for r in sets.collect()} == wanted and len(wanted) > 20
    assert {len(neardup.unpacked(bytes(r.shingles))) for r in sets.collect()} <= {len(shingled(t)) for _, t in copies}
