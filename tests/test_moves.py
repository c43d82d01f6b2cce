import json
import random

import pytest

from foliant import cli, report, sinks
from foliant.operators import moves
from foliant.plans import batch
from foliant.sources import documents as S

SCHEMA = "batch_id string, doc_id string, `from` string, `to` string"


def carried_out(rows, files):
    """The tree after the steps, turn by turn; a step must find its file and a free place, and a turn touches no path twice."""
    tree = dict(files)
    for turn in sorted({r.turn for r in rows if not r.blocked}):
        now = [r for r in rows if r.turn == turn]
        touched = [p.lower() for r in now for p in (r["from"], r["to"])]
        assert len(touched) == len(set(touched))
        for r in now:
            assert r["to"].lower() not in {p.lower() for p in tree if p != r["from"]} or r["to"].lower() == r["from"].lower()
            tree[r["to"]] = tree.pop(r["from"])
    return tree


@pytest.mark.parametrize("seed", range(4))
def test_random_permutations(spark, seed):
    r = random.Random(seed)
    names = [f"d{k % 3}/F{k}.txt" for k in range(80)]
    goers = r.sample(names, 60)
    places = goers[:]
    r.shuffle(places)
    to = {a: b for a, b in zip(goers, places) if a != b}
    for a in r.sample(sorted(to), 8):  # chains that end in new places
        to[a] = f"new/{a}"
    to[goers[0]] = goers[0].upper() if goers[0] not in to.values() else to.get(goers[0], "new/x")
    stays = [n for n in names if n not in to]
    rows = [("b", f"id {a}", a, b) for a, b in to.items()]
    got = moves.ordered(spark.createDataFrame(rows, SCHEMA).repartition(4), spark.createDataFrame([("b", p) for p in stays], "batch_id string, path string")).collect()
    assert not any(x.blocked for x in got)
    files = {n: f"id {n}" for n in names}
    want = {to.get(n, n): i for n, i in files.items()}
    assert carried_out(got, files) == want


def test_chains_behind_a_file_that_stays_are_blocked(spark):
    rows = [("b", "1", "a", "b"), ("b", "2", "b", "C"), ("b", "3", "x", "y"), ("b", "4", "p", "q"), ("b", "5", "q", "p"), ("other", "6", "a", "c"), ("b", "7", "n.txt", "N.txt")]
    got = moves.ordered(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("b", "c")], "batch_id string, path string")).collect()
    assert {x.doc_id for x in got if x.blocked} == {"1", "2"} and all((x.turn is None) == x.blocked for x in got)
    assert sorted((x.doc_id, x.turn) for x in got if not x.blocked) == [("3", 0), ("4", 0), ("4", 2), ("5", 1), ("6", 0), ("7", 0), ("7", 1)]
    assert moves.ordered(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_long_chain_takes_logarithmic_rounds(spark, monkeypatch):
    rounds = []
    keep = moves.written
    monkeypatch.setattr(moves, "written", lambda frame, what: rounds.append(what) or keep(frame, what))
    n = 5000
    got = moves.ordered(spark.range(n).selectExpr("'b' AS batch_id", "cast(id AS string) AS doc_id", "concat('f', id) AS `from`", "concat('f', id + 1) AS `to`"))
    assert {(int(x.doc_id), x.turn) for x in got.collect()} == {(k, n - 1 - k) for k in range(n)} and len(rounds) <= 18


def test_a_tree_is_reorganised_and_put_back(spark, fixtures, tmp_path, capsys):
    """Two files that each lie where the other belongs, and one more behind them."""
    root = tmp_path / "tree"
    docs = json.loads((fixtures / "samples.json").read_text())["documents"]
    for d in docs:
        (root / "in").mkdir(parents=True, exist_ok=True)
        (root / "in" / d["file"].replace("pdf", "txt")).write_text(d["text"])
    read = lambda: {str(p.relative_to(root)): p.read_text() for p in root.rglob("*.txt") if "_foliant" not in str(p)}
    result = batch.run(S.read_directory(spark, str(root), recursive=True)[0])
    place = {r.name: "/".join([*r.folder, r.filename]) for r in result.plan.filter("NOT needs_review").collect()}
    a, b, c = sorted(place)[:3]
    texts = read()
    for name in place:  # all but the three are where they belong; these are a cycle
        at = {a: place[b], b: place[c], c: place[a]}.get(name, place[name])
        (root / at).parent.mkdir(parents=True, exist_ok=True)
        (root / name).rename(root / at)
    before = read()
    register = tmp_path / "reg"
    for folder in {p.split("/")[0] for p in place.values()} - {"_Licensee"}:
        (register / folder).mkdir(parents=True, exist_ok=True)
    args = ["--reorganise", str(root), "--register", str(register)]
    assert cli.main([*args, "--approvals-out", str(tmp_path / "a.json")]) == 0
    sheet = json.loads((tmp_path / "a.json").read_text())
    for item in sheet["items"]:
        item["decision"] = "approve"
    (tmp_path / "a.json").write_text(json.dumps(sheet))
    assert cli.main([*args, "--approvals", str(tmp_path / "a.json")]) == 0 and read() == before  # a dry run
    assert cli.main([*args, "--approvals", str(tmp_path / "a.json"), "--commit"]) == 0
    after = read()
    assert sorted(after.values()) == sorted(texts.values()) and after != before and {place[n]: texts[n] for n in (a, b, c)}.items() <= after.items()
    undo = next((root / "_foliant").glob("rollback-*.json"))
    assert cli.main(["--undo", str(undo), "--commit"]) == 0 and read() == before


def test_totals_of_folders_and_their_ancestors(spark, fixtures):
    result = batch.run(S.read_samples(spark, str(fixtures / "samples.json")))
    rows = [r.asDict() for r in report.tree_totals(result).collect()]
    plan = [(tuple(r.folder), r.needs_review) for r in result.plan.collect()]
    for r in rows:
        inside = [x for f, x in plan if f[: len(r["at"])] == tuple(r["at"])]
        assert (r["n_files"], r["n_review"], r["depth"]) == (len(inside), sum(inside), len(r["at"]))
    assert len(rows) == len({f[:k] for f, _ in plan for k in range(len(f) + 1)}) and rows[0]["n_findings"] == result.flags.count()
    top = [r["at"][0] for r in rows if r["depth"] == 1]
    assert top == sorted(top, key=lambda x: (x.startswith("_"), x))
    lines = list(report.text(result))
    assert any(x.startswith("samples/ (10 files, 2 for review") for x in lines) and sinks.COLUMNS
