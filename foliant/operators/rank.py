"""Scores of a declarative hint table, their argmax, and numbering within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import let
from ..shared import written


def hint_scores(text: Column, hints: list[tuple[str, str, float]]) -> Column:
    """array<struct<type, ord, score>>: a type's weights of the phrases that the lower-cased text contains.  One projection, no join."""
    types = list(dict.fromkeys(t for t, _, _ in hints))

    def scored(low: Column) -> Column:
        out = []
        for k, t in enumerate(types):
            score = F.lit(0.0)
            for name, phrase, weight in hints:
                if name == t:
                    score = score + F.when(F.contains(low, F.lit(phrase)), F.lit(float(weight))).otherwise(F.lit(0.0))
            out.append(F.struct(F.lit(t).alias("type"), F.lit(k).alias("ord"), F.greatest(F.lit(0.0), score).alias("score")))
        return F.array(*out)

    # put into lower case once, however many phrases are looked for
    return let(F.lower(text), scored)


def argmax(scores: Column, floor: float) -> Column:
    """Struct of type, top, runner_up, margin, confidence: best score, first in order of equals; no type below a quarter of the floor."""
    ranked = F.array_sort(F.transform(scores, lambda s: F.struct((-s.score).alias("m"), s.ord.alias("ord"), s.type.alias("type"))))
    return let(ranked, lambda r: _best(r, floor))


def _best(ranked: Column, floor: float) -> Column:
    top, runner = -ranked[0].m, -F.get(ranked, F.lit(1)).m
    margin = F.when(top > 0, (top - F.coalesce(runner, F.lit(0.0))) / top).otherwise(0.0)
    weak = top < floor * 0.25
    return F.struct(F.when(~weak & (top > 0), ranked[0].type).alias("type"), top.alias("top"), F.when(top > 0, F.get(ranked, F.lit(1)).type).alias("runner_up"), margin.alias("margin"), F.when(weak, 0.0).otherwise(margin * F.least(F.lit(1.0), top / F.lit(floor))).alias("confidence"))


def numbered(frame: DataFrame, keys: list[str], order: str, name: str = "n") -> DataFrame:
    """row_number over ``keys`` by one column (ties in no stated order); a hot key, or an outlier in the order, is no single task (``ranged``)."""
    return ranged(frame, keys, [order], name)


def ranged(frame: DataFrame, keys: list[str], order: list[str], name: str = "n") -> DataFrame:
    """row_number over ``keys`` by ``order``, of any types: the rows are dealt by range of both, numbered where they lie, and shifted by the counts of the ranges before.

    No group is one task, however large.  Equal rows are numbered in no stated order."""
    dealt = frame.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    inner = written(dealt.withColumn("_i", F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order))), "ranges")
    held = inner.groupBy(*keys, "_part").agg(F.count("*").alias("_c"))
    before = held.withColumn("_s", F.coalesce(F.sum("_c").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    renamed = before.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), "_s")
    on = [inner[k].eqNullSafe(renamed[f"_k{i}"]) for i, k in enumerate(keys)] + [inner["_part"] == renamed["_p"]]
    return inner.join(renamed, on).select(*[inner[c] for c in frame.columns], (F.col("_i") + F.col("_s")).cast("long").alias(name))


def copies(frame: DataFrame, keys: list[str], name: str = "copies") -> DataFrame:
    """Each row with the size of its group (nulls are equal), by a partial aggregate and an equi-join rather than a window."""
    count = frame.groupBy(*keys).agg(F.count("*").alias(name))
    renamed = count.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], name)
    return frame.join(renamed, [frame[k].eqNullSafe(renamed[f"_k{i}"]) for i, k in enumerate(keys)]).select(*[frame[c] for c in frame.columns], name)
