import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from foliant.functions import names


def plain(s):
    s = "".join(names.PLAIN.get(c, c) for c in s.lower())
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return " ".join("".join(c if c.isalnum() or c in "_'-" else " " for c in s).split())


def test_every_code_point(spark):
    each = [chr(k) for k in range(sys.maxunicode + 1) if unicodedata.category(chr(k)) not in ("Cs", "Cn")]  # the JVM's tables may know newer ones
    rows = [(k, " ".join(f"x{c}y" for c in each[k : k + 100])) for k in range(0, len(each), 100)]
    got = {r.k: r.p for r in spark.createDataFrame(rows, "k int, s string").repartition(8).select("k", names.plain_name(F.col("s")).alias("p")).collect()}
    assert [(k, got[k], plain(s)) for k, s in rows if got[k] != plain(s)] == []


@pytest.mark.parametrize("s", ["Sørensen, Lars", "García", "Ó Braonáin", "ΟΔΥΣΣΕΥΣ Σ", "Nguyễn Thị", "김철수 & 박", "ﬁnch ½ ①", "O'Brien-Smith", "Straße İstanbul", "ạ́b", "  ", "", "ＦＵＬＬ　ｗｉｄｔｈ", "x y z", "and Mei and Jordan", "漢字 가각힣"])
def test_whole_names(spark, s):
    row = spark.createDataFrame([(s, [s, "B", None, "b", ""])], "s string, a array<string>").select(names.plain_name(F.col("s")).alias("p"), names.plain_words(F.col("s")).alias("w"), names.plain_all("a").alias("a")).first()
    assert row.p == plain(s)
    assert row.w == [w for w in plain(s.replace(",", " ").replace("&", " ")).split() if w != "and"]
    assert row.a == sorted({p for p in (plain(s), "b") if p})


def test_no_python_worker(spark):
    frame = spark.createDataFrame([("é",), (None,)], "s string").select(names.plain_name(F.col("s")).alias("p"), names.plain_words(F.col("s")).alias("w"), names.plain_all(F.array("s")).alias("a"))
    assert [tuple(r) for r in frame.collect()] == [("e", ["e"], ["e"]), (None, None, [])]
    assert "Python" not in frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("label, names_somebody", [
    ("Client: ", True), ("CLIENTS - ", True), ("client(s): ", True), ("Client Name: ", True), ("Client(s)  name : ", True), ("Prepared for ", True), ("prepared\nexclusively for: ", True), ("Advice for ", True), ("Advice prepared for - ", True),
    ("Client ", False), ("Client data form ", False), ("Clientele: ", False), ("Prepared by ", False), ("Advice fora ", False), ("clients's: ", False),
])
def test_labels(spark, label, names_somebody):
    row = spark.createDataFrame([(f"x. {label}Linh Nguyen. y",)], "t string").select(names.client(F.col("t")).alias("c")).first()
    assert (row.c is not None and row.c.surnames == ["Nguyen"]) == names_somebody
