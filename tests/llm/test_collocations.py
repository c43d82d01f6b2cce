import collections
import random
import re

import duckdb
import numpy as np
import pytest

from foliant.llm import collocations, queries

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def plainly(rows, min_count, longest=3, top=2000, share=50):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(ASCII)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    cand = {p: c for p, c in f.items() if len(p) > 2 and c >= min_count}
    gone = {(p[0], *p[i : i + k]) for p, c in cand.items() for k in range(2, len(p) - 1) for i in range(1, len(p) - k + 1) if 100 * c >= share * cand[(p[0], *p[i : i + k])]}
    out = collections.defaultdict(list)
    for p, a in cand.items():
        if p not in gone:
            score, _, l, r = min((10**6 * a * a // (f[p[: j + 1]] * f[(p[0], *p[j + 1 :])]), j, f[p[: j + 1]], f[(p[0], *p[j + 1 :])]) for j in range(1, len(p) - 1))
            out[p[0]].append((-score, -a, " ".join(p[1:]).encode(), l, r))
    return collections.Counter((lang, k, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for k, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1))


def some_rows():
    r = random.Random(12)
    words = "new york city of the And é漢 São-Paulo x y z new york City don't".split()
    text = lambda n: "".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " \x0b"]) for _ in range(n))
    rows = [(r.choice(["en", "en", "en", "de", None, "und", ""]), text(r.randint(0, 60))) for _ in range(150)]
    return rows + [("en", None), ("en", ""), (None, None), ("fr", "  \t\n"), ("hot", "a a a a a a. a a " * 200), ("one", "q " * 500_000), ("long", "w" * 3_000_000 + " w"), ("en", rows[0][1]), ("en", rows[0][1])]


@pytest.fixture(scope="module")
def frame(spark):
    from pyspark.sql import functions as F

    out = spark.createDataFrame(some_rows(), "lang string, text string").repartition(5)
    return out.withColumns({c: F.lit("clash") for c in ("phrase", "f", "n", "h", "head", "tail", "firsts", "salt", "rank", "doc_id")})


@pytest.mark.parametrize("keys, bits, slice_bytes, salts", [(1 << 22, 1 << 28, 4 << 20, 32), (3, 256, 900, 2), (0, 1 << 20, 200, 1)])
def test_as_counted_plainly(frame, monkeypatch, keys, bits, slice_bytes, salts):
    monkeypatch.setattr(collocations, "EXACT_KEYS", keys)
    monkeypatch.setattr(collocations, "BITMAP_BITS", bits)
    monkeypatch.setattr(collocations, "SLICE", slice_bytes)
    monkeypatch.setattr(collocations, "SALTS", salts)
    got = collocations.mine(frame, min_count=4)
    assert collections.Counter(tuple(r[c] for c in COLUMNS) for r in got.collect()) == plainly(some_rows(), 4)


@pytest.mark.parametrize("longest, top, share", [(2, 5, 50), (4, 9, 80), (5, 2000, 50)])
def test_other_lengths(frame, longest, top, share):
    got = collocations.mine(frame, min_count=3, longest=longest, top=top, share=share)
    assert collections.Counter(tuple(r[c] for c in COLUMNS) for r in got.collect()) == plainly(some_rows(), 3, longest, top, share)


def test_products_beyond_64_bits(spark):
    one = spark.createDataFrame([("en", "x", 999_999_999_999_937), ("en", "y", 999_999_999_999_001)], collocations.COUNTS)
    two = spark.createDataFrame([("en", "x y", 999_999_999_998_999)], collocations.COUNTS)
    row = collocations.scored([one, two]).first()
    assert (row.l, row.r, row.score) == (999_999_999_999_937, 999_999_999_999_001, 10**6 * 999_999_999_998_999**2 // (999_999_999_999_937 * 999_999_999_999_001))


def test_frequent_runs_are_never_missed():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    exact = collocations.Runs(np.sort(h[:2000]), None)
    assert exact.has(h).tolist() == [True] * 2000 + [False] * 3000
    assert not collocations.Runs(np.zeros(0, np.uint64), None).has(h).any()


def test_nothing(nothing):
    assert collocations.mine(nothing).collect() == []


def test_sql_agrees(spark):
    sf = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got, want = queries.QUERIES["op12_collocations"](spark, sf), duck.sql(queries.ORACLE_SQL["op12_collocations"])
    assert got.columns == want.columns and got.count() > 100
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want.fetchall())
