import os

import duckdb
import pytest

from foliant import sinks
from foliant.plans import batch, bindings
from foliant.sources import documents as S, files


def walked(root):
    """What a plain walk finds: names and contents, hidden ones and the engine's state left out."""
    out = {}
    for here, folders, names in os.walk(root):
        folders[:] = [f for f in folders if not f.startswith(".") and f != "_foliant"]
        for n in names:
            if not n.startswith("."):
                at = os.path.join(here, n)
                try:
                    out[os.path.relpath(at, root)] = open(at, "rb").read().decode("utf-8", "replace") if os.path.isfile(at) else None
                except OSError:
                    out[os.path.relpath(at, root)] = None
    return out


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "in"
    for at, text in {"a.txt": "a", "_draft.txt": "draft", "_Review/b.txt": "b", "_Review/_c/d.md": "d", "sub/c.txt": "c", "sub/deep/er/e f#%41.txt": "e", "é漢/x.txt": "é", ".dot.txt": "no", ".git/x.txt": "no", "_foliant/filed.txt": "no", "sub/_foliant/log.txt": "no", "_SUCCESS.txt": "s", "empty.txt": "", "sub/big.txt": "x" * 5000, "bad.docx": "no zip", "odd.xls": "x", "none": "x", "UP.TXT": "up"}.items():
        (root / at).parent.mkdir(parents=True, exist_ok=True)
        (root / at).write_text(text)
    os.symlink("nowhere.txt", root / "gone.txt")
    os.symlink("sub", root / "loop")
    os.mkfifo(root / "pipe.txt")
    (root / "emptied").mkdir()
    os.symlink("a.txt", root / "link.txt")
    return root


@pytest.mark.parametrize("prefixes, tasks", [(512, 128), (1, 1), (3, 2)])
def test_nothing_is_lost(spark, tree, monkeypatch, prefixes, tasks):
    monkeypatch.setattr(files, "PREFIXES", prefixes)
    monkeypatch.setattr(files, "TASKS", tasks)
    got = {r.rel: r for r in S.contents(spark, str(tree), recursive=True, most=4000).collect()}
    want = walked(tree)
    assert set(got) == set(want) | {"loop"}  # a linked folder is said to be there, and not entered
    for rel, r in got.items():
        readable = want.get(rel) is not None and os.path.splitext(rel)[1].lower() in S.TEXT and len(want[rel]) <= 4000
        assert (r.text == want[rel] and r.error is None) if readable else (r.text is None and r.error)
    why = {rel: r.error for rel, r in got.items() if r.error}
    assert why.keys() == {"gone.txt", "loop", "pipe.txt", "sub/big.txt", "bad.docx", "odd.xls", "none"}
    assert "too large: 5000" in why["sub/big.txt"] and "unsupported" in why["odd.xls"] and "FileNotFound" in why["gone.txt"] and "regular" in why["pipe.txt"]


def test_flat_listing(spark, tree):
    got = {r.rel: r.error for r in S.contents(spark, f"file://{tree}").collect()}
    assert set(got) == {n for n in walked(tree) if "/" not in n} | {"loop"} and got["_draft.txt"] is None
    with pytest.raises(FileNotFoundError):
        S.contents(spark, str(tree / "no such folder"))
    assert S.contents(spark, str(tree / "emptied"), recursive=True).count() == 0


def test_a_file_that_vanishes_and_a_name_that_is_no_text(spark, tree):
    os.close(os.open(os.fsencode(str(tree)) + b"/\xff\xfe.txt", os.O_CREAT | os.O_WRONLY))
    reader = files._Reader(files.Place(str(tree)), True)
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["error"] for r in rows if "xff" in r["rel"] or "udc" in r["rel"]] == ["the name is no UTF-8"]
    assert len({r["rel"] for r in rows}) == len(rows) == len(walked(tree)) + 1

    def shy(suffix, content):
        raise MemoryError("too much")

    got = files.opened(spark, str(tree), shy, "text string", (".txt",))
    assert got.filter("error IS NULL").count() == 0 and got.filter("error LIKE 'MemoryError%'").count() >= 3
    assert got.filter("rel = 'a.txt'").first().error == "MemoryError: too much"


def test_a_folder_of_many_files_is_several_tasks(spark, tmp_path, monkeypatch):
    frame = spark.range(400).selectExpr("concat('one/', id, '.txt') AS rel", "repeat('x', 100) AS text")
    assert sinks.write_files(frame, str(tmp_path / "out")) == 400
    monkeypatch.setattr(files, "TASK_BYTES", 2000)
    got = S.contents(spark, str(tmp_path / "out"), recursive=True)
    assert got.count() == 400 and len({f for f in os.listdir(got._foliant_path.removeprefix("file://")) if f.startswith("part")}) >= 15
    with pytest.raises(Exception, match="leaves the root"):
        sinks.write_files(spark.createDataFrame([("../x.txt", "x")], "rel string, text string"), str(tmp_path / "out"))


def test_failures_of_every_batch_are_in_its_manifest(spark, tree):
    docs, failed = S.read_directory(spark, str(tree), recursive=True)
    assert docs.filter("name = '_Review/b.txt'").count() == 1 and failed.count() == 6
    many = spark.range(12_000).selectExpr("'other' AS batch_id", "concat('f', id) AS name", "'unsupported' AS error")
    rows = {r.batch_id: r for r in sinks.manifest(batch.run(docs), unreadable=failed.unionByName(many)).collect()}
    assert len(rows["batch"].batch.unreadable) == 6 and rows["batch"].batch.documents == docs.count()
    assert len(rows["other"].batch.unreadable) == 12_000 and rows["other"].documents == [] and rows["other"].batch.documents == 0


def test_the_bound_query_is_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = duck.sql(bindings.ORACLE_SQL["q51_intake_tree"])
    got = bindings.QUERIES["q51_intake_tree"](spark, sf)
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
    assert got.filter("rel LIKE '#_Review/%' ESCAPE '#'").count() > 0 and got.filter("error IS NOT NULL").count() > 0
