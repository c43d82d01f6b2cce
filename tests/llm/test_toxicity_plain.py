"""Scores against a dense softmax over the same bags, letter by letter."""

import math
import re

import numpy as np
import pytest
import xxhash

from foliant.llm import toxicity

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALL = (1 << 64) - 1


def mixed(h):
    for _ in range(2):
        h = ((h ^ h >> 32) * 0xD6E8FEB86659FD93) & ALL
    return h ^ h >> 32


def buckets(word):
    """Of every n-gram of the word between two edges, and of the word."""
    edged = [1, *(ord(c) + 2 for c in word), 1]
    out = []
    for k in toxicity.NGRAMS:
        for i in range(len(edged) - k + 1):
            h = edged[i]
            for x in edged[i + 1 : i + k]:
                h = (h * 0x9E3779B97F4A7C15 + x) & ALL
            out.append(mixed((mixed(h) + k) & ALL) % toxicity.BUCKETS)
    return [*out, mixed(xxhash.xxh3_64_intdigest(word.encode())) % toxicity.BUCKETS]


def plainly(text, scorer):
    bag = np.zeros(toxicity.BUCKETS)
    for word in set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))):
        for b in buckets(word):
            bag[b] += 1
    mean = bag @ scorer.rows / (toxicity.PADDING + bag.sum())
    logits = np.array([0.0, mean + scorer.bias])
    return float(np.exp(logits[1] - np.logaddexp.reduce(logits)))


@pytest.fixture(scope="module")
def scorer():
    rng = np.random.default_rng(3)
    return toxicity.Scorer(rng.normal(0, 40, toxicity.BUCKETS), -1.25)


def test_scores_are_those_of_a_dense_softmax(spark, rows, scorer):
    rows = [r for r in rows if r[0] is not None] + [(900, "x" * 3000), (901, "ab ab AB aB"), (902, "İ \U0001f600 ß"), (903, "word " * 600_000)]
    got = toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), scorer=scorer).collect()
    want = {(d, round(plainly(t, scorer), 9)) for d, t in rows}
    assert {(r.doc_id, round(r.score, 9)) for r in got} == want and len({w for _, w in want}) > 10
    assert all(r.predicted == (r.score >= 0.5) for r in got)


def test_trained_scores_too(rows):
    texts = [f"good kind words {k} of praise" for k in range(40)] + [f"you awful nastyword {k} of spite" for k in range(40)]
    trained = toxicity.train(texts, np.array([0] * 40 + [1] * 40), 0.5)
    import pyarrow as pa

    asked = [t or "" for _, t in rows][:40] + ["nastywrd of spite", "kind words"]
    got = toxicity.scores(pa.array(asked, pa.large_string()), trained)
    assert all(math.isclose(a, plainly(t, trained), abs_tol=1e-9) for a, t in zip(got, asked)) and got[-2] > 0.5 > got[-1]


def test_the_pipeline_keeps_odd_rows(spark, documents, nothing, scorer):
    kept = toxicity.keep_clean(documents, scorer=scorer)
    assert kept.columns == documents.columns
    want = sorted(str((r.doc_id, r.text)) for r in documents.collect() if plainly(r.text, scorer) < 0.5)
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == want and toxicity.keep_clean(nothing, scorer=scorer).count() == 0
