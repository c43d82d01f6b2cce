import collections
import hashlib
import random
import re

import duckdb
import pytest

from foliant.llm import fim, queries

COLUMNS = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored")


def plainly(doc, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc, n, "plain", None, None, text, text
    a, b = sorted(x % (n + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return doc, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return doc, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


def odd_rows():
    r = random.Random(11)
    bits = ["<", "P", "S", "M", ">", "<P", "S>", "ab", " ", "é", "漢", "😀", "\n", "\x00", "Z9", "<M>", "<S>"]
    out = [(k, "".join(r.choice(bits[: 15 if k % 5 else 17]) for _ in range(r.randint(0, 40)))) for k in range(400)]
    return out + [(7, None), (8, ""), (None, "no id"), (None, None), (9, "x"), (10, "é"), (11, "<"), (11, "<"), (12, "a" * 3_000_000), (13, "漢 b\n" * 1_200_000), (1 << 62, "far"), (-5, "minus")]


@pytest.mark.parametrize("parts", [1, 5])
def test_transform_and_restore(spark, rows, parts):
    rows = rows + odd_rows()
    got = fim.restore(fim.transform(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)))
    assert collections.Counter(tuple(r[c] for c in COLUMNS) for r in got.collect()) == collections.Counter(plainly(*r) for r in rows)


def test_clashing_columns_and_nothing(documents, rows, nothing):
    from pyspark.sql import functions as F

    clash = documents.withColumns({c: F.lit("clash") for c in ("n", "form", "output", "restored", "prefix_chars")})
    got = fim.report(fim.restore(fim.transform(clash)))
    want = collections.Counter((d, n, f, p, m, hashlib.sha256(o.encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, n, f, p, m, o, t in (plainly(*r) for r in rows))
    assert collections.Counter(map(tuple, got.collect())) == want
    assert fim.report(fim.restore(fim.transform(nothing))).collect() == []


def test_other_seeds_draw_otherwise(spark):
    frame = spark.createDataFrame([(k, "some words to cut in parts") for k in range(200)], "doc_id long, text string")
    one, two = ([tuple(r) for r in fim.restore(fim.transform(frame, seed)).orderBy("doc_id").collect()] for seed in (1, 2))
    assert one != two and all(r[-1] == "some words to cut in parts" for r in one + two)


def test_sql_agrees(spark, sf):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = queries.QUERIES["op11_fim"](spark, sf)
    want = duck.sql(queries.ORACLE_SQL["op11_fim"])
    assert got.columns == want.columns
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want.fetchall())
