"""Rows longer than the slices that texts are worked on in, among short ones, nulls and copies; and clashing columns of the smaller tables."""

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import decontaminate, quality, repeats, simhash, tokenfiles, warc
from foliant.llm.queries import BYTES

from . import plain
from .conftest import prose


@pytest.fixture(scope="module")
def long_rows():
    r = random.Random(17)
    once = prose(r, 9000)
    long = "\n".join(prose(r, 300) for _ in range(1400))  # more than a slice of 2 MB
    return [(1, "short one"), (2, long), (3, None), (4, once), (5, ""), (6, long + " end"), (7, once), (None, "no id")]


@pytest.fixture(scope="module")
def frame(spark, long_rows):
    out = spark.createDataFrame(long_rows, "doc_id long, text string").repartition(2)
    assert max(len((t or "").encode()) for _, t in long_rows) > 2 << 20
    return out.withColumns({c: F.lit("clash") for c in ("n_words", "fp", "ids", "start", "items", "spans", "key", "h")})


def counted(frame, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in frame.collect())


def test_decontamination_with_a_clashing_benchmark(spark, frame, long_rows):
    words = plain.bench_words(long_rows[1][1])
    bench = [(1, " ".join(words[200_000:200_040])), (2, " ".join(words[-12:])), (3, None), (4, "nothing like it at all anywhere in any text of these")]
    items = spark.createDataFrame(bench, "item_id long, text string").withColumns({c: F.lit("clash") for c in ("doc_id", "key", "items", "n_words", "lang")})
    got = decontaminate.report(decontaminate.decontaminate(frame, items))
    assert counted(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == plain.decontaminate(long_rows, bench)


def test_fingerprints(frame, long_rows):
    short = [(d, t) for d, t in long_rows if len(t or "") < 200_000]
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.report(simhash.near_duplicates(frame)).collect()}
    assert {(d, f"{plain.fingerprint(t):016x}") for d, t in short} <= set(got) and len(got) == len(long_rows)
    by = {d: c for (d, _), c in got.items()}
    assert by[2] == by[6] == 2 and by[4] == by[7] == 4 and by[3] == by[5] == 3


def test_tokens(frame, long_rows):
    from tokenizers import Tokenizer

    t, start, want = Tokenizer.from_file(BYTES), 0, collections.Counter()
    for d, x in sorted(long_rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        want[d, start, len(ids), zlib.crc32(ids.tobytes())] += 1
        start += len(ids)
    assert counted(tokenfiles.read_tokens(tokenfiles.write_tokens(frame, BYTES)), "doc_id", "start", "n_tokens", "ids_crc32") == want


def test_repeats(spark):
    r = random.Random(18)
    body = prose(r, 110_000)
    rows = [(1, body[:600_000]), (2, body[100_000:100_900]), (3, None), (4, "x" + body[599_000:599_700]), (5, prose(r, 40))]
    assert len(rows[0][1].encode()) > 1 << 19
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert counted(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == plain.repeats(rows, 200)


def test_archives_with_clashing_columns(spark, long_rows):
    pages = [(d, t) for d, t in long_rows if d is not None] + [(90, long_rows[1][1])]
    table = spark.createDataFrame(pages, "page_id long, html string").withColumns({c: F.lit("clash") for c in ("payload_digest", "record_type", "key", "doc_id", "text")} | {"url": F.concat(F.lit("http://x.example/"), "page_id")})
    got = warc.report(warc.read_archives(warc.write(table)))
    assert counted(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == plain.warc(pages)


def test_quality(frame, long_rows):
    got = counted(quality.quality(frame), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == collections.Counter((d, *plain.quality(t)) for d, t in long_rows)
