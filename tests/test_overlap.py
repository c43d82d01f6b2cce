import collections
import random

import pytest

from foliant.operators import keys


def plainly(left, right, distinct):
    """All pairs: key, then (best, shared, tied) by scope."""
    out = {}
    for scope, l, a in left:
        shared = {}
        for scope2, r, o, b in right:
            if scope == scope2 and not (distinct and l == r) and (n := len(set(a) & set(b))):
                shared[o, r] = n
        if shared:
            top = max(shared.values())
            ties = sorted(k for k, n in shared.items() if n == top)
            out[scope, l] = (ties[0][1], top, len(ties))
    return out


def some(r, n, words, hottest=()):
    rows = []
    for k in range(n):
        own = [w for w in words if r.random() < 0.25][: r.randint(0, 6)] + [w for w in hottest if r.random() < 0.9]
        rows.append((r.choice("ab"), k, own))
    return rows


@pytest.mark.parametrize("hot", [0, 1, 3, 8, 1000])
@pytest.mark.parametrize("distinct", [False, True])
def test_against_all_pairs(spark, hot, distinct):
    r = random.Random(hot * 2 + distinct)
    words = [f"w{k}" for k in range(14)]
    left = some(r, 50, words, ["the", "of"]) + [("a", 90, ["the"]), ("a", 91, []), ("b", 92, ["nowhere"]), ("c", 93, ["the"])]
    right = left if distinct else some(r, 60, words, ["the", "of"])
    right = [(s, k, r.randint(0, 3), p) for s, k, p in right]
    got = keys.best_overlap(spark.createDataFrame(left, "s string, l int, t array<string>").repartition(3), spark.createDataFrame(right, "s string, r int, o int, t array<string>"), "l", "r", "t", order=["o", "r"], scope=["s"], distinct_keys=distinct, hot=hot)
    assert {(x.s, x.l): (x.r, x.shared, x.tied) for x in got.collect()} == plainly(left, right, distinct)


def test_a_part_that_every_row_has_makes_no_pairs(spark):
    """20,000 rows on both sides that share one part: 4 x 10^8 pairs if it were joined on."""
    n = 20_000
    left = spark.range(n).selectExpr("id AS l", "array('every', concat('w', id % 5000)) AS t")
    right = spark.range(n).selectExpr("id AS r", "CASE WHEN id % 2 = 0 THEN array('every', concat('w', id % 5000)) ELSE array('every') END AS t")
    got = keys.best_overlap(left, right, "l", "r", "t")
    counts = collections.Counter((x.shared, x.tied) for x in got.collect())
    assert counts == {(2, 4): n // 2, (1, n): n // 2}


def test_repeated_rows_nulls_and_nothing(spark):
    right = spark.createDataFrame([(1, ["x", "x", "y"]), (1, ["x", "x", "y"]), (2, ["x"]), (3, None), (4, [])], "r int, t array<string>")
    left = spark.createDataFrame([(7, ["x", "y", "y"]), (7, ["x", "y", "y"]), (8, None), (9, ["z"])], "l int, t array<string>")
    for hot in (0, 1000):
        assert [tuple(x) for x in keys.best_overlap(left, right, "l", "r", "t", hot=hot).collect()] == [(7, 1, 2, 1)]
        assert keys.best_overlap(left, right.limit(0), "l", "r", "t", hot=hot).collect() == []
        assert keys.best_overlap(left.limit(0), right, "l", "r", "t", hot=hot).collect() == []
