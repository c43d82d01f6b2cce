"""The corpus pipeline: toxicity, near-duplicates, benchmark passages, personal data, token ids.

Each stage works on all that the one before kept; between stages the documents are
written as Parquet to the shared folder and read again, and what a stage made for itself
is removed.  All but the last stage return the columns of their documents, extra ones too.

Null and empty texts: neither toxic by default nor contaminated; all of them are copies of
one another, so one stays; nothing is redacted in them; they have no ids.  Rows that are
equal in id and text are one document from the second stage on.  No documents make no
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import decontaminate, neardup, pii, sentencepiece, toxicity
from foliant.llm.queries import PIECES
from foliant.shared import Scratch, written


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, _read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, _read(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece.encode_documents(docs, PIECES)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("personal_data", redact_personal_data),
    ("encoding", encode),
]

#: SQL expresses neither the trained models nor the segmentation; tests/llm holds every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with Scratch(spark) as scratch:
            docs = scratch.keep(written(stage(spark, docs, sf_dir), f"stage-{name}"))
    return docs
