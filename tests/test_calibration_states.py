"""What a calibration copies of the records, and that each step of it is still a run at that threshold."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from foliant.kb import KnowledgeBase
from foliant.operators import asof
from foliant.plans import batch, bindings, evaluation
from foliant.shared import written

KINDS = [("soa", "advice", True), ("roa", "advice", True), ("authority_to_proceed", "implementation", False), ("authority_to_proceed", "implementation", False), ("fact_find", "input", False), (None, None, False)]


@pytest.fixture(scope="module")
def labelled(spark):
    """Clients of ten documents, some of one type and day, some without a date, a type or a confidence; and flags that answers expect of them."""
    r, rows = random.Random(5), []
    for k in range(300):
        kind, category, advice = r.choice(KINDS)
        day = dt.date(2020, 1, 1) + dt.timedelta(days=30 * r.randrange(12)) if r.random() < 0.95 else None
        rows.append((f"b{k % 2}", k, f"n{k}", f"f{k % 30}", kind, category, advice, day, None if r.random() < 0.03 else round(r.random(), 3), r.choice([[], [], ["superseding_ambiguity"], ["roa_without_soa", "low_confidence"], ["event_ambiguous"], ["fact_find_after_soa"]])))
    frame = written(spark.createDataFrame(rows, "batch_id string, doc_ord long, name string, family_key string, doc_type string, category string, advice_record boolean, own_date date, confidence double, expect_flags array<string>"), "labelled")
    names = ("batch_id", "doc_ord", "name", "family_key", "doc_type", "category", "advice_record", "own_date", "confidence")
    records = bindings.shaped(frame, **{c: c for c in names}, requires_date=F.col("category") == "input")
    truth = frame.select("name", F.coalesce("doc_type", F.lit("soa")).alias("type"), F.col("family_key").alias("client"), F.when(F.col("advice_record"), F.col("family_key")).alias("event"), F.lit(False).alias("needs_review"), "expect_flags")
    return records, truth


@pytest.mark.parametrize("held", ["placement", "compliance"])
def test_documents_are_copied_where_their_client_changes_and_steps_are_runs(spark, labelled, held):
    """``held``: whether several documents of one kind and day hold each other back."""
    records, truth = labelled
    data = KnowledgeBase.load().data
    kb = KnowledgeBase({**data, "edge_case_flags": {"rules": [{**x, "class": held} if x["id"] == "superseding_ambiguity" else x for x in data["edge_case_flags"]["rules"]]}})
    tables = {}

    def kept(frame, name):
        tables[name] = written(frame, name)
        return tables[name]

    got = {x.step: x for x in evaluation.calibrate(records, truth, kb, materialise=kept).collect()}
    assert sorted(got) == list(range(20))
    assert tables["sweep"].count() < 7 * 300  # 8.5 copies where every document's confidence parts its client's states
    assert "message" not in tables["flags"].columns or tables["flags"].select("message").distinct().count() == 1
    for step in (2, 10):
        k = kb.with_threshold(step / 20)
        alone = evaluation.score(evaluation.compare(batch.place(records, k, bindings.Profile.load(), written), truth, k)).first()
        assert (got[step].n, got[step].n_filed, got[step].n_wrong, got[step].n_ok) == (alone.n, alone.n_filed, alone.n_confident_and_wrong, alone.n_ok)
        assert (got[step].type_accuracy, got[step].client_accuracy, got[step].event_accuracy) == tuple(alone[f"n_{c}_ok"] / alone.n for c in ("type", "client", "event"))


@pytest.mark.parametrize("direction", ["forward", "backward"])
def test_keys_of_few_and_of_many_days_attach_alike(spark, direction):
    r = random.Random(8)
    day = lambda: dt.date(2020, 1, 1) + dt.timedelta(days=r.randrange(60))
    left = spark.createDataFrame([(k, f"k{k % 9}" if k % 10 else None, day() if k % 11 else None) for k in range(300)], "id int, by string, d date")
    right = spark.createDataFrame([(f"k{k * k % 8}" if k % 13 else None, day() if k % 7 else None, k) for k in range(60)], "by string, e date, k int")
    seen = []
    for few in (0, 4, 64):
        seen.append(sorted(map(str, asof.attach(left, right, ["by"], "d", "e", "k", direction, 9, few=few).collect())))
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 300
