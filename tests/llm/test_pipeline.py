import collections

import corpus_pipeline as P
from foliant.llm import pii, toxicity

from . import plain
from .test_neardup import groups_of


def test_stages_against_plain_versions(spark, tmp_path):
    """Every stage on what the one before kept, at the smallest scale of the driver's tables."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    scorer = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    field = pii.train()
    for name, stage in P.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, sf)
        if name != P.STAGES[-1][0]:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        ids = sorted(r.doc_id for r in after)
        if name == "toxicity":
            s = toxicity.scores(__import__("pyarrow").array([t for _, t in before]), scorer)
            assert ids == sorted(d for (d, _), x in zip(before, s) if x < 0.5)
        elif name == "near_duplicates":
            least = {}
            for (d, _), g in zip(before, groups_of(before)):
                least[g] = min(d, least.get(g, d))
            assert ids == sorted(least.values())
        elif name == "decontamination":
            assert ids == sorted(k[0] for k in plain.decontaminate(before, bench) if not k[-1])
        elif name == "personal_data":
            want = {d: pii.redacted(t, pii.find(t, field)[1]) for d, t in before}
            assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after)
            assert not any(plain.pii(r.text) for r in after)
        else:
            import sentencepiece as library

            sp = library.SentencePieceProcessor(model_file=P.PIECES)
            assert {r.doc_id: list(r.ids) for r in after} == {d: sp.encode(t) for d, t in before}
            assert all(r.round_trip for r in after)


def test_run(spark):
    got = P.run(spark, "/root/testdata/sf0.001")
    assert got.count() and set(got.columns) == {"doc_id", "n_tokens", "ids", "round_trip"}
    assert len(P.STAGES) == 5 and collections.Counter(callable(f) for _, f in P.STAGES)[True] == 5
