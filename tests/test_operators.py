import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from foliant.kb import Profile
from foliant.operators import asof, evaluate, keys, plan, rank, register

D = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)


def brute_asof(own, events, direction, limit):
    if own is None or not events:
        return "none", None
    ahead, back = sorted(e for e in events if e[0] >= own), sorted((e for e in events if e[0] <= own), key=lambda e: (own - e[0], e[1]))
    pool = (ahead or back) if direction == "forward" else (back or ahead)
    if len(pool) > 1 and pool[1][0] == pool[0][0]:
        return "tie", None
    return ("far", None) if abs((pool[0][0] - own).days) > limit else ("ok", pool[0][1])


@pytest.mark.parametrize("direction", ["forward", "backward"])
@pytest.mark.parametrize("parts", [1, 7])
def test_asof_against_brute_force(spark, direction, parts):
    r = random.Random(3)
    events = [(r.choice("ab"), D(r.randint(0, 60)), k) for k in range(30)] + [("c", None, 99)]
    left = [(k, r.choice(["a", "b", "c", None]), r.choice([None, *(D(r.randint(0, 90)) for _ in range(5))])) for k in range(200)]
    got = asof.attach(spark.createDataFrame(left, "id int, by string, d date").repartition(parts), spark.createDataFrame(events, "by string, e date, k int"), ["by"], "d", "e", "k", direction, 12)
    want = {k: brute_asof(d, [(e, i) for f, e, i in events if f == by and e is not None], direction, 12) for k, by, d in left}
    assert {x.id: (x.status, x.event_key) for x in got.collect()} == want


def test_confidence_of_gap(spark):
    e = spark.createDataFrame([("a", D(12), 1)], "by string, e date, k int")
    x = asof.attach(spark.createDataFrame([("a", D(0))], "by string, d date"), e, ["by"], "d", "e", "k", "forward").first()
    assert round(x.confidence, 2) == 0.98 and not x.reversed


def test_merge_keys(spark):
    def merged(*names):
        rows = [(n, n.split("-")) for n in names]
        return {(x.narrow, x.wide) for x in keys.merge(spark.createDataFrame(rows, "k string, p array<string>"), "k", "p").collect()}

    assert merged("Tran", "Okafor-Tran") == {("Tran", "Okafor-Tran")}
    assert merged("Tran", "Okafor-Tran", "Tran-Wu") == set()


REGISTER = [("Nguyen, Linh & David", ["nguyen"], ["linh", "david"]), ("Nguyen, Bao", ["nguyen"], ["bao"]), ("Patel, Anish", ["patel"], ["anish"]), ("Sørensen, Lars", ["sorensen"], ["lars"])]


@pytest.mark.parametrize("surnames, given, verdict, folder", [
    (["nguyen"], ["linh", "david"], "matched", "Nguyen, Linh & David"), (["nguyen"], ["bao"], "matched", "Nguyen, Bao"), (["nguyen"], [], "ambiguous", None),
    (["sorensen"], ["lars"], "matched", "Sørensen, Lars"), (["okafor", "tran"], ["mei"], "new", None), (["sorenson"], ["lars"], "matched", "Sørensen, Lars"),
])
def test_register(spark, surnames, given, verdict, folder):
    reg = spark.createDataFrame(REGISTER, "folder_name string, surnames array<string>, given array<string>")
    got = register.match(spark.createDataFrame([(1, surnames, given)], "k int, surnames array<string>, given array<string>"), reg, "k").first()
    assert (got.verdict, got.folder_name) == (verdict, folder)


def test_numbered_is_row_number(spark):
    r = random.Random(1)
    rows = [(r.choice("xy"), k) for k in range(500)]
    seen = {}
    want = {}
    for key, k in rows:
        want[k] = seen[key] = seen.get(key, 0) + 1
    got = rank.numbered(spark.createDataFrame(rows, "g string, k long").repartition(5), ["g"], "k")
    assert {x.k: x.n for x in got.collect()} == want


def test_argmax_ties_go_to_the_first(spark):
    s = rank.hint_scores(F.col("t"), [("a", "x", 2.0), ("b", "x", 2.0), ("c", "y", 1.0)])
    got = spark.createDataFrame([("x y",), ("",)], "t string").select(rank.argmax(s, 4.0).alias("c")).collect()
    assert (got[0].c.type, got[0].c.runner_up, got[0].c.margin) == ("a", "b", 0.0)
    assert got[1].c.type is None and got[1].c.confidence == 0.0


def test_sweep_is_twenty_single_runs(spark):
    r = random.Random(2)
    rows = [(round(r.random(), 2), r.random() < 0.7) for _ in range(300)]
    got = {x.step: (x.n_filed, x.n_wrong) for x in evaluate.sweep(spark.createDataFrame(rows, "c double, ok boolean"), F.col("c"), F.col("ok")).collect()}
    assert got == {k: (sum(c >= k / 20 for c, _ in rows), sum(c >= k / 20 and not ok for c, ok in rows)) for k in range(20)}


@pytest.mark.parametrize("rows, step, reason", [([(0.2, False), (0.9, True)], 5, "ok"), ([(0.9, True)], None, "nothing"), ([(1.0, False), (0.5, True)], None, "something")])
def test_recommendation(spark, rows, step, reason):
    got = evaluate.recommend(evaluate.sweep(spark.createDataFrame(rows, "c double, ok boolean"), F.col("c"), F.col("ok"))).first()
    assert got.step == step and got.reason.startswith(reason)


def test_preflight_names_what_is_wrong(spark):
    rows = [("b", 1, ["A"], "x.txt"), ("b", 2, ["a"], "X.txt"), ("b", 3, [".."], "y?.txt"), ("b", 4, ["A"], "z" * 300)]
    p = spark.createDataFrame(rows, "batch_id string, doc_ord long, folder array<string>, filename string")
    there = spark.createDataFrame([("A/" + "z" * 300,)], "path string")
    sources = spark.createDataFrame([("b", 1, "s"), ("b", 2, "s"), ("b", 3, "s")], "batch_id string, doc_ord long, source string")
    got = {(x.doc_ord, x.issue, x.level) for x in plan.preflight(p, Profile({}), there, sources).collect()}
    assert got == {(1, "collision", "error"), (2, "collision", "error"), (3, "illegal character", "error"), (3, "escapes the root", "error"), (4, "too long", "error"), (4, "no source", "warning"), (4, "exists", "warning")}


def test_scope_and_last_decision(spark):
    rows = [("b", k, f"d{k}", f"{k}.pdf", ["A"], f"{k}.pdf") for k in range(3)]
    p = spark.createDataFrame(rows, "batch_id string, doc_ord long, doc_id string, name string, folder array<string>, filename string")
    a = spark.createDataFrame([(0, "d0", "approve"), (1, "d0", "reject"), (0, "d1", "reject"), (5, "d1", "approve"), (0, "d2", "approve")], "ord int, doc_id string, decision string").selectExpr("*", "cast(null as string) folder", "cast(null as string) filename")
    only = spark.createDataFrame([("d0",), ("d1",)], "doc_id string")
    assert [x.action for x in plan.decisions(p, a, only=only).orderBy("doc_ord").collect()] == ["rejected", "filed", "skipped"]
    assert [x.action for x in plan.decisions(p, a, sources=only).orderBy("doc_ord").collect()] == ["rejected", "filed", "failed"]


def test_ranged_numbers_any_order(spark):
    r = random.Random(4)
    rows = [(r.choice("xy"), f"{r.randrange(10**6):06d}") for _ in range(400)]
    want = {}
    for key in "xy":
        want |= {(key, p): k + 1 for k, p in enumerate(sorted({p for q, p in rows if q == key}))}
    got = rank.ranged(spark.createDataFrame(sorted(set(rows)), "g string, p string").repartition(4), ["g"], ["p"])
    assert {(x.g, x.p): x.n for x in got.collect()} == want


def test_runners(spark):
    reg = spark.createDataFrame(REGISTER, "folder_name string, surnames array<string>, given array<string>")
    got = register.match(spark.createDataFrame([(1, ["nguyen"], ["linh"])], "k int, surnames array<string>, given array<string>"), reg, "k").first()
    assert [(x.folder_name, x.score) for x in got.runners] == [("Nguyen, Bao", 0.55)] and got.verdict == "matched"


def test_decisions(spark):
    rows = [("b", k, f"d{k}", f"{k}.pdf", ["A"], f"{k}.pdf") for k in range(5)]
    p = spark.createDataFrame(rows, "batch_id string, doc_ord long, doc_id string, name string, folder array<string>, filename string")
    a = spark.createDataFrame([("d0", "approve", None, None), ("d1", "reject", None, None), ("d2", "approve", "../x", None), ("d3", "approve", None, None)], "doc_id string, decision string, folder string, filename string")
    filed = spark.createDataFrame([("d3",)], "doc_id string")
    assert [x.action for x in plan.decisions(p, a, filed).orderBy("doc_ord").collect()] == ["filed", "rejected", "failed", "already-filed", "skipped"]
