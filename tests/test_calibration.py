import random

import pytest
from pyspark.sql import functions as F

from foliant.kb import KnowledgeBase
from foliant.plans import batch, bindings, evaluation
from foliant.shared import written
from foliant.sources import documents as S


@pytest.fixture(scope="module")
def enriched(spark, fixtures):
    return batch.run(S.read_samples(spark, str(fixtures / "samples.json"))).records


def test_states_cover_every_step_once(spark):
    r = random.Random(9)
    kb = KnowledgeBase.load()
    frame = spark.createDataFrame([(f"b{k % 3}", k, f"f{r.randrange(4)}" if k % 3 else None, round(r.random(), 2)) for k in range(60)] + [("b1", 99, "f1", None)], "batch_id string, doc_ord long, family_key string, confidence double")
    frame = frame.withColumns({"client_specific": F.lit(True), "category": F.lit("advice")})
    rows = evaluation.sweep(frame, kb).collect()
    by = {}
    for x in rows:
        by.setdefault(x.doc_ord, []).append((x._from, x.step))
        assert all((x.confidence is not None and x.confidence >= k / 20) == (x.confidence is not None and x.confidence >= x.threshold) for k in range(x._from, x.step + 1))
    assert all(sorted(k for a, b in spans for k in range(a, b + 1)) == list(range(20)) for spans in by.values()) and len(by) == 61
    assert len(rows) < 61 * 14
    # documents of no client tie their batch together: all of batch b0 has the same states
    assert len({tuple(sorted(by[k])) for k in range(0, 60, 3)}) == 1 < len({tuple(sorted(by[k])) for k in range(1, 60, 3)})


@pytest.mark.parametrize("step", [3, 14])
def test_every_step_is_a_run_at_that_threshold(spark, enriched, fixtures, step):
    """The samples at other confidences, in two batches, one of them of a single client."""
    kb, truth = KnowledgeBase.load(), S.read_truth(spark, str(fixtures / "truth.json"))
    shaken = enriched.withColumn("confidence", F.round(F.rand(4), 2))
    shaken = written(shaken.unionByName(shaken.filter("family_key = 'Nguyen' AND client_specific").withColumn("batch_id", F.lit("two"))), "shaken")
    got = {r.step: r for r in evaluation.calibrate(shaken, truth, kb, materialise=written).collect()}
    assert sorted(got) == list(range(20))
    k = kb.with_threshold(step / 20)
    alone = evaluation.score(evaluation.compare(batch.place(shaken, k, bindings.Profile.load(), written), truth, k)).first()
    assert (got[step].n, got[step].n_filed, got[step].n_wrong, got[step].n_ok) == (alone.n, alone.n_filed, alone.n_confident_and_wrong, alone.n_ok)
