import json
import random

import pytest

from foliant.plans import batch
from foliant.sources import documents as S
from foliant.streaming.intake import Memory, intake_remembering, remembered

FIELDS = ("batch_id", "path", "name", "source", "backend", "text", "page_count")


@pytest.fixture(scope="module")
def samples(spark, fixtures):
    return S.read_samples(spark, str(fixtures / "samples.json"))


@pytest.fixture(scope="module")
def whole(samples):
    return placed(batch.run(samples))


def placed(result):
    return sorted((r.name, r.kind, tuple(r.folder), r.filename, r.needs_review) for r in result.plan.collect())


def part(spark, samples, names):
    return samples.filter(samples["name"].isin(names)).select(*FIELDS)


def test_any_split_ends_in_the_one_batch_result(spark, samples, whole, tmp_path):
    names = sorted(r.name for r in samples.select("name").collect())
    r = random.Random(5)
    r.shuffle(names)
    memory = Memory(spark, f"file://{tmp_path}/memory")
    # the second advice record and what follows from it come last; one file comes twice, under another name
    late = [n for n in names if n in ("a04.pdf", "a07.pdf")]
    splits = [[n for n in names if n not in late][:4], [n for n in names if n not in late][4:], late]
    for n, some in enumerate(splits):
        docs = part(spark, samples, some)
        if n == 1:
            from pyspark.sql import functions as F

            docs = docs.unionByName(part(spark, samples, splits[0][:1]).withColumns({"path": F.lit("again.pdf"), "name": F.lit("again.pdf")}))
        result, changes = remembered(docs, n, memory)
        said = {c.name: (c.action, c.was, c.now) for c in changes.collect()}
        assert {k for k, v in said.items() if v[0] == "new"} == set(some) and "again.pdf" not in said
    assert placed(result) == whole
    moved = {k for k, v in said.items() if v[0] == "moved"}
    assert moved and all(said[k][1] != said[k][2] for k in moved)  # late advice takes what was refused
    again, changes = remembered(part(spark, samples, late), 2, memory)  # the last micro-batch once more, after a failure
    assert placed(again) == whole and {c.name for c in changes.collect() if c.action == "new"} == set(late)


def test_batches_that_are_not_touched_are_not_decided_anew(spark, samples, tmp_path):
    from pyspark.sql import functions as F

    memory = Memory(spark, str(tmp_path / "memory"))
    two = part(spark, samples, ["a04.pdf", "a02.pdf"])
    remembered(two.withColumn("batch_id", F.lit("one")).unionByName(two.withColumn("batch_id", F.lit("two"))), 0, memory)
    result, changes = remembered(part(spark, samples, ["a03.pdf"]).withColumn("batch_id", F.lit("two")), 1, memory)
    assert {r.batch_id for r in result.plan.collect()} == {"two"} and sorted((c.name, c.action) for c in changes.collect()) == [("a02.pdf", "kept"), ("a03.pdf", "new"), ("a04.pdf", "kept")]


def test_a_stream_of_files(spark, fixtures, tmp_path):
    docs = json.loads((fixtures / "samples.json").read_text())["documents"]
    (tmp_path / "in").mkdir()
    last = {}

    def sink(result, changes, n):
        last[n] = ({r.name: (r.kind, r.filename) for r in result.plan.collect()}, [c.action for c in changes.collect()])

    def arrive(some):
        for d in some:
            (tmp_path / "in" / d["file"].replace("pdf", "txt")).write_text(d["text"])
        intake_remembering(spark, str(tmp_path / "in"), sink, str(tmp_path / "ck"), str(tmp_path / "memory")).awaitTermination(300)

    arrive(docs[1:3])
    arrive(docs[3:4])
    assert sorted(last) == [0, 1] and len(last[0][0]) == 2 and len(last[1][0]) == 3 and last[1][1].count("new") == 1
    assert last[0][0]["a02.txt"][0] != "event_document" and last[1][0]["a02.txt"][0] == "event_document"
