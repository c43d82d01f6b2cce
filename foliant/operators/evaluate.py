"""Accuracy against known answers: scorecard, sweep of a fixed verdict over thresholds, recommendation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .rank import let

STEPS = 20


def scorecard(rows: DataFrame, filed: Column, correct: Column, *more: Column) -> DataFrame:
    """One row: n, n_filed, n_correct, n_wrong (filed and not correct), precision (null if nothing is filed), coverage; and ``more`` aggregates."""
    f, c = filed.cast("boolean"), F.coalesce(correct.cast("boolean"), F.lit(False))
    count = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0))
    return rows.agg(F.count("*").alias("n"), count(f).alias("n_filed"), count(f & c).alias("n_correct"), count(f & ~c).alias("n_wrong"), *more).withColumns({"precision": F.try_divide(F.col("n_correct").cast("double"), F.col("n_filed").cast("double")), "coverage": F.try_divide(F.col("n_filed").cast("double"), F.col("n").cast("double"))})


def differences(expected: Column, found: Column) -> tuple[Column, Column]:
    """What of one set of names is not in the other, sorted: missed and unexpected."""
    return F.array_sort(F.array_except(expected, found)), F.array_sort(F.array_except(found, expected))


def sweep(rows: DataFrame, confidence: Column, correct: Column, steps: int = STEPS) -> DataFrame:
    """(step, n_filed, n_wrong) for the thresholds step / steps: a histogram of the highest threshold each row passes, summed from above."""
    passed = let(confidence, lambda c: sum(((c >= F.lit(k / steps)).cast("int") for k in range(steps)), F.lit(0)))
    hist = rows.select(passed.alias("p"), F.coalesce(correct.cast("boolean"), F.lit(False)).alias("c")).groupBy("p").agg(F.count("*").alias("n"), F.sum((~F.col("c")).cast("long")).alias("w"))
    every = rows.sparkSession.range(0, steps, 1, 1).select(F.col("id").cast("int").alias("step"))
    # twenty rows from here on
    joined = every.join(hist, every.step == hist.p - 1, "left")
    up = Window.orderBy("step").rowsBetween(0, Window.unboundedFollowing)
    return joined.select("step", F.coalesce(F.sum("n").over(up), F.lit(0)).alias("n_filed"), F.coalesce(F.sum("w").over(up), F.lit(0)).alias("n_wrong"))


def recommend(swept: DataFrame) -> DataFrame:
    """One row: the lowest step from which on nothing filed is wrong; refused if nothing ever was wrong, or always something is."""
    up = Window.orderBy("step").rowsBetween(0, Window.unboundedFollowing)
    tail = swept.withColumn("worst", F.max("n_wrong").over(up))
    step = F.min(F.when((F.col("worst") == 0) & (F.col("n_filed") > 0), F.col("step")))
    reason = F.when(F.max("n_wrong") == 0, "nothing was wrong at any threshold").when(step.isNull(), "something is wrong at every threshold").otherwise("ok")
    return tail.agg(reason.alias("reason"), F.when(F.max("n_wrong") > 0, step).cast("int").alias("step"))
