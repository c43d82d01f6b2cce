"""The pipeline on odd tables: nulls, empty and long texts, repeated rows, extra columns with clashing names, and empty ones."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

from .conftest import prose


def tables(spark, folder, documents, labels, benchmark):
    for name, frame in (("documents", documents), ("labels", labels), ("benchmark", benchmark)):
        frame.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, 1, k % 2) for k in range(12)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").withColumns({"text": F.lit("clash"), "id": F.lit("clash"), "lang": F.lit("clash")})


@pytest.fixture(scope="module")
def benchmark(spark, rows):
    cut = " ".join(rows[2][1].split()[5:40])
    return spark.createDataFrame([(1, cut), (2, None), (3, ""), (4, "no such words here at all in any of these texts")], "item_id long, text string").withColumns({"doc_id": F.lit("clash"), "key": F.lit("clash")})


def test_odd_rows(spark, documents, rows, labels, benchmark, tmp_path):
    import random

    more = [(500, prose(random.Random(1), 40_000)), (501, "mail jane.roe@site.example or token = " + "a1b2c3d4" * 8)]
    docs = documents.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    sf = tables(spark, tmp_path, docs, labels, benchmark)
    kept, frame = [docs.count()], spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(P.STAGES):
        frame = stage(spark, frame, sf)
        frame.write.parquet(f"{tmp_path}/{k}")
        frame = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(frame.count())
        assert k == len(P.STAGES) - 1 or set(frame.columns) == set(docs.columns), name
        if name == "personal_data":
            text = frame.filter("doc_id = 501").first().text
            assert "jane.roe" not in text and "a1b2" not in text
    assert kept == sorted(kept, reverse=True) and 0 < kept[-1] < kept[0]
    assert frame.filter("doc_id = 500").count() == 1
    assert P.run(spark, sf).count() == kept[-1]


def test_empty_tables(spark, nothing, labels, benchmark, tmp_path):
    assert P.run(spark, tables(spark, tmp_path / "a", nothing, labels, benchmark)).count() == 0
    assert P.run(spark, tables(spark, tmp_path / "b", nothing, labels.limit(0), benchmark.limit(0))).count() == 0


def test_no_labels_and_no_benchmark(spark, documents, labels, benchmark, tmp_path):
    sf = tables(spark, tmp_path, documents, labels.limit(0), benchmark.limit(0))
    assert P.drop_toxic(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).count() == documents.count()
    assert P.drop_benchmark(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).count() == documents.count()
