import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from foliant.operators import register
from foliant.plans import bindings


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def near_names(r, n):
    parts = ["ng", "uy", "en", "an", "sø", "ren", "o", "ka", "for", "tran", "mac", "son", "ll", "aa", "é"]
    names = {"".join(r.choice(parts) for _ in range(r.randint(1, 6))) for _ in range(n)} | {"a", "ab", "abc", "abcd", "annannan", "anananan", "x" * 40}
    for name in sorted(names):
        for _ in range(2):
            k = r.randrange(len(name))
            names.add(r.choice([name[:k] + name[k + 1 :], name[:k] + r.choice("aeno") + name[k:], name[:k] + "z" + name[k + 1 :], name + "s"]) or "q")
    return sorted(names)


@pytest.mark.parametrize("seed", range(3))
def test_near_names_against_all_pairs(spark, seed):
    r = random.Random(seed)
    ours, theirs = near_names(r, 120), near_names(r, 120)
    ours += theirs[::3]
    got = register.near(spark.createDataFrame([([x],) for x in ours] + [([],), (None,), ([""],)], "surnames array<string>"), spark.createDataFrame([([x, x],) for x in theirs], "surnames array<string>"))
    want = {(p, c): ratio(p, c) for p in set(ours) for c in set(theirs) if ratio(p, c) >= register.NEAR_RATIO}
    assert {(x.p, x.c): x.ratio for x in got.collect()} == want and len(want) > 150


def test_common_pairs_of_letters_bring_nobody_together(spark):
    """1,000 names a side that all hold the same three pairs of letters: a million pairs if those were joined on."""
    names = [f"anna{a}{b}{c}{a}{c}{b}{a}" for a in "bcdfghjklm" for b in "npqrstvwxz" for c in "bdfhjlnprt"]
    frame = spark.createDataFrame([([x],) for x in names], "surnames array<string>")
    probes = register._probes(frame.select(F.explode("surnames").alias("p")), frame.select(F.explode(register._pairs_of_letters(F.col("surnames")[0])).alias("g")).groupBy("g").agg(F.count("*").alias("f")), "p")
    assert probes.filter("g.g IN ('an', 'nn', 'na')").count() < 100  # of 3,000
    assert register.near(frame.limit(50), frame).filter("p = c").count() == 50


def test_one_person_in_many_documents_is_matched_once(spark):
    """A surname of 30,000 documents and 300 folders: 9 x 10^6 pairs if every document were matched."""
    people = spark.range(30_000).selectExpr("id AS k", "array('nguyen') AS surnames", "CASE WHEN id % 3 = 0 THEN array('linh') ELSE array('bao') END AS given")
    reg = spark.range(300).selectExpr("concat('Nguyen, ', id) AS folder_name", "array('nguyen') AS surnames", "CASE WHEN id = 7 THEN array('linh') ELSE array('other') END AS given")
    got = {(x.verdict, x.folder_name, x["count"]) for x in register.match(people, reg, "k").groupBy("verdict", "folder_name").count().collect()}
    assert got == {("matched", "Nguyen, 7", 10_000), ("ambiguous", None, 20_000)}


def plainly(names):
    """Names of one surname each against the same ones less their fifth letter, no given names."""
    folders = {n: n.replace(" ", "")[:4] + n.replace(" ", "")[5:] for n in names}
    out = {}
    for name in names:
        p = name.replace(" ", "")
        scores = sorted(((-(0.85 if p == c else min(0.95, ratio(p, c)) if ratio(p, c) >= 0.85 else 0.0), f) for f, c in folders.items() if p == c or ratio(p, c) >= 0.85))
        first, second = (-scores[0][0], scores[0][1]) if scores else (0.0, None), -scores[1][0] if len(scores) > 1 else 0.0
        verdict = "new" if first[0] < 0.55 else "ambiguous" if first[0] - second < 0.12 and second > 0 else "matched" if first[0] >= 0.8 else "uncertain"
        out[name] = (verdict, first[1] if verdict in ("matched", "uncertain") else None, first[0], second, "; ".join(f"{f} {-s:.4f}" for s, f in scores[1:4]))
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_the_bound_query_against_all_pairs(spark, sf):
    got = bindings.QUERIES["q17_register_fuzzy"](spark, f"/root/testdata/{sf}").collect()
    want = plainly([r.p_name for r in spark.read.parquet(f"/root/testdata/{sf}/part.parquet").select("p_name").distinct().collect()])
    assert {x.p_name: (x.verdict, x.folder_name, x.score, x.second, x.runners) for x in got} == want
