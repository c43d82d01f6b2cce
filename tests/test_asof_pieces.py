import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from foliant.operators import asof, rank

D = lambda n: dt.date(1900, 1, 1) + dt.timedelta(days=n)


@pytest.mark.parametrize("pieces", [1, 3, 16])
def test_nearest_over_pieces(spark, pieces):
    """Keys in one piece, in several and in all; with events, without, and with events in some pieces only."""
    r = random.Random(pieces)
    rows = [("hot", 0, D(d), f"e{d}" if d in (7, 300, 301, 650) else None) for d in range(700)]
    rows += [(f"k{k}", 1, D(d), f"k{k}-{d}" if r.random() < 0.2 else None) for k in range(40) for d in sorted(r.sample(range(60), 9))]
    rows += [("none", 2, D(d), None) for d in range(200)] + [("lone", 3, D(5), "x")]
    want = {}
    for key, part, d, _ in rows:
        events = sorted((x, e) for k, p, x, e in rows if (k, p) == (key, part) and e)
        want[key, part, d] = (max((v for v in events if v[0] <= d), default=(None, None))[1], min((v for v in events if v[0] >= d), default=(None, None))[1])
    frame = spark.createDataFrame(rows, "a string, b int, d date, e string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(pieces))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = asof.nearest(frame, ["a", "b"], "d", "e").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(x.a, x.b, x.d): (x.back, x.ahead) for x in got} == want and len(got) == len(rows)


def test_one_key_of_many_days_is_as_fast_as_many_keys(spark):
    def took(key):
        left = spark.range(40_000).select(key.alias("by"), F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
        right = left.filter(F.dayofmonth("d") == 3).select("by", F.col("d").alias("e"), F.lit(1).alias("k"))
        best = []
        for _ in range(3):
            began = time.perf_counter()
            got = asof.attach(left, right, ["by"], "d", "e", "k", "forward", 40).agg(F.count("*").alias("n"), F.sum("gap_days"), F.count("event_key"), F.max("confidence")).first()
            assert got.n == 40_000
            best.append(time.perf_counter() - began)
        return min(best)

    many = took((F.col("id") % 100).cast("string"))
    assert took(F.lit("one")) < 2 * many + 0.5


def test_an_outlier_is_no_hot_task(spark):
    rows = spark.range(20_000).select(F.lit("a").alias("g"), F.when(F.col("id") == 19_999, 10**12).otherwise(F.col("id")).alias("k"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rank.numbered(rows, ["g"], "k")
        held = rows.repartitionByRange("g", "k").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        pieces = [x[0] for x in got.groupBy(F.floor((F.col("n") - 1) / 5000)).count().select("count").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got.filter("k = n - 1 OR n = 20000").count() == 20_000 and len(pieces) == 4
    assert held < 12_000
