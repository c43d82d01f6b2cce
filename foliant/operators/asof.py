"""As-of attachment: a preferred direction, a fallback, refusal of ties, then a tolerance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..shared import written


def _so_far(value: str, *order) -> Column:
    """The last value that is not null up to and with each row of its piece."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy("_part", "_k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def nearest(days: DataFrame, by: list[str], day: str, event: str) -> DataFrame:
    """``days`` (one row for each ``by`` and day; ``event`` null where there is none) with ``back`` and ``ahead``: the last event up to each day and the first from it on.

    Keys and days are dealt by range into pieces, so that a key of many days lies in several, and each piece is swept once in
    either direction.  What a piece cannot know comes from its neighbours: of each key that lies in several pieces its
    first and last event in each, which are two rows a piece at most, swept over the pieces and carried in."""
    frame = days.withColumn("_k", F.struct(*by))
    dealt = written(frame.repartitionByRange("_k", day).withColumn("_part", F.spark_partition_id()), "asof-pieces")
    # the keys at a piece's two ends are all that can go on in another
    ends = dealt.groupBy("_part").agg(F.min("_k").alias("_lo"), F.max("_k").alias("_hi"))
    edge = dealt.join(F.broadcast(ends), "_part").filter((F.col("_k") == F.col("_lo")) | (F.col("_k") == F.col("_hi"))).filter(F.col(event).isNotNull())
    found = edge.groupBy("_k", "_part").agg(F.min_by(event, day).alias("_first"), F.max_by(event, day).alias("_last"))
    asked = ends.select("_part", F.explode(F.array_distinct(F.array("_lo", "_hi"))).alias("_k"))
    over = Window.partitionBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    carried = asked.join(found, ["_k", "_part"], "left").select(
        "_k", "_part", F.last("_last", ignorenulls=True).over(over.orderBy("_part")).alias("_before"), F.last("_first", ignorenulls=True).over(over.orderBy(F.desc("_part"))).alias("_after")
    ).filter("_before IS NOT NULL OR _after IS NOT NULL")
    swept = dealt.withColumns({"back": _so_far(event, day), "ahead": _so_far(event, F.desc(day))}).join(carried, ["_k", "_part"], "left")
    return swept.select(*days.columns, F.coalesce("back", "_before").alias("back"), F.coalesce("ahead", "_after").alias("ahead"))


def _in_arrays(dated: DataFrame, events: DataFrame, by: list[str], direction: str) -> DataFrame:
    """``dated`` with the event picked, ``_x``, and whether it lies on the other side, ``_r``: all of a key's events are at hand."""
    out = dated.join(events.groupBy(*by).agg(F.collect_list("_e").alias("_a")), by, "left")
    ahead, back = F.array_min(F.filter("_a", lambda e: e["d"] >= F.col("_d"))), F.array_max(F.filter("_a", lambda e: e["d"] <= F.col("_d")))
    first, other = (ahead, back) if direction == "forward" else (back, ahead)
    out = out.withColumn("_y", first).withColumn("_x", F.when(F.col("_y").isNotNull(), F.col("_y")).otherwise(other))
    return out.select(*dated.columns, "_x", F.col("_y").isNull().alias("_r"))


def _in_pieces(dated: DataFrame, events: DataFrame, by: list[str], direction: str) -> DataFrame:
    """The same over sorted pieces of keys and days."""
    asked = dated.filter(F.col("_d").isNotNull()).dropna(subset=by).select(*by, "_d").distinct()
    days = events.unionByName(asked, allowMissingColumns=True).groupBy(*by, "_d").agg(F.max("_e").alias("_e"))
    first, other = ("ahead", "back") if direction == "forward" else ("back", "ahead")
    picked = nearest(days, by, "_d", "_e").select(*by, "_d", F.coalesce(first, other).alias("_x"), F.col(first).isNull().alias("_r")).filter(F.col("_x").isNotNull())
    return dated.join(picked, [*by, "_d"], "left").select(*dated.columns, "_x", "_r")


def attach(left: DataFrame, right: DataFrame, by: list[str], left_date: str, right_date: str, right_key: str, direction: str = "backward", max_gap_days: int = 730, few: int = 0) -> DataFrame:
    """Left rows with status, event_key, gap_days, reversed and confidence.

    status: ok; tie (two right rows on the nearest date); far (nearest beyond the limit); none (no right row, no date or no key).
    The nearest is picked first and then held against the limit.

    Both sides are brought down to one row per key and day before anything is sorted, so a key counts by its days, not its
    rows, and a key of many days is several tasks (``nearest``); the answer goes back to the left rows by an equi-join.
    Keys with events on at most ``few`` days are not sorted: their left rows meet the events in an array."""
    if direction not in ("forward", "backward"):
        raise ValueError(direction)
    keyed = lambda frame: frame.dropna(subset=by)  # noqa: E731  no key is no other's
    events = keyed(right.filter(F.col(right_date).isNotNull())).groupBy(*by, F.to_date(right_date).alias("_d")).agg(F.struct(F.to_date(F.first(right_date)).alias("d"), F.count("*").alias("n"), F.min(right_key).alias("key")).alias("_e"))
    dated = left.withColumn("_d", F.to_date(left_date))
    many = events.groupBy(*by).agg(F.count("*").alias("_c")).filter(F.col("_c") > few).select(*by)
    if few == 0:
        out = _in_pieces(dated, events, by, direction)
    elif many.isEmpty():
        out = _in_arrays(dated, events, by, direction)
    else:
        part = lambda how: (dated.join(many, by, how), events.join(many, by, how), by, direction)
        out = _in_arrays(*part("left_anti")).unionByName(_in_pieces(*part("left_semi")))
    gap = F.abs(F.datediff(F.col("_x.d"), F.col("_d")))
    status = F.when(F.col("_x").isNull(), "none").when(F.col("_x.n") > 1, "tie").when(gap > max_gap_days, "far").otherwise("ok")
    score = F.greatest(F.lit(0.35), F.lit(1.0) - gap / F.lit(float(max(1, max_gap_days)))) * F.when(F.col("_r"), F.lit(0.6)).otherwise(F.lit(1.0))
    ok = status == "ok"
    return out.select(*[c for c in left.columns if c not in by], *by, status.alias("status"), F.when(ok, F.col("_x.key")).alias("event_key"), F.when(F.col("_x").isNotNull(), gap).alias("gap_days"), F.when(F.col("_x").isNotNull(), F.col("_r")).alias("reversed"), F.when(ok, score).alias("confidence"))
