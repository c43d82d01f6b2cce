"""Keys made of parts: containment merges and best overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def merge(keys: DataFrame, key: str, parts: str, scope: list[str] | None = None) -> DataFrame:
    """(scope, narrow, wide): keys whose parts are a proper subset of exactly one other key's.

    A candidate must hold the narrow key's rarest part, which is what the join is on; containment is checked then."""
    scope = scope or []
    distinct = keys.select(*scope, F.col(key).alias("k"), F.array_sort(F.array_distinct(parts)).alias("p")).filter("k IS NOT NULL").dropDuplicates([*scope, "k"])
    long = distinct.select(*scope, "k", "p", F.explode("p").alias("part"))
    count = long.groupBy(*scope, "part").agg(F.count("*").alias("n"))
    rare = long.join(count, [*scope, "part"]).groupBy(*scope, "k").agg(F.min(F.struct("n", "part")).alias("r"), F.first("p").alias("np")).select(*scope, F.col("k").alias("narrow"), "np", F.col("r.part").alias("part"))
    wide = long.select(*scope, F.col("k").alias("wide"), F.col("p").alias("wp"), "part")
    held = rare.join(wide, [*scope, "part"]).filter((F.size("wp") > F.size("np")) & (F.size(F.array_except("np", "wp")) == 0))
    return held.groupBy(*scope, "narrow").agg(F.count("*").alias("n"), F.first("wide").alias("wide")).filter("n = 1").select(*scope, "narrow", "wide")


#: Right rows that hold a part at which it is hot: it makes no candidates of its own while there are rarer ones to go by.
HOT = 1000


def best_overlap(left: DataFrame, right: DataFrame, left_key: str, right_key: str, parts: str, order: list[str] | None = None, scope: list[str] | None = None, distinct_keys: bool = False, hot: int = HOT) -> DataFrame:
    """(scope, left_key, right_key, shared, tied): the right row that shares most parts; of equals the first by ``order``, and how many they are.

    Parts are ordered by how many right rows hold them.  Candidates meet on parts that ``hot`` right rows hold at most;
    hot parts are only compared for candidates that can still be best.  A right row met on no rare part shares hot parts
    alone, so left rows whose best candidate shares more than they have hot parts are done.  For the others right rows are
    brought down to their distinct sets of hot parts, with counts, and met on as many of the rarest hot parts as the best
    candidate leaves open; a part that every row has is asked about last, and by sets instead of rows.

    Rows that share nothing have no row.  Repeated parts and rows count once.  With ``distinct_keys`` a right row of the left row's own key is left out (right keys are then unique)."""
    scope, order = scope or [], order or [right_key]
    mine = left.select(*scope, F.col(left_key).alias("_l"), F.explode(F.array_distinct(parts)).alias("_t")).distinct()
    row = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(right_key).alias("r"))
    theirs = right.select(*scope, row.alias("_r"), F.explode(F.array_distinct(parts)).alias("_t")).distinct()
    held = theirs.groupBy(*scope, "_t").agg(F.count("*").alias("_f"))
    mine, theirs = mine.join(held, [*scope, "_t"]), theirs.join(held, [*scope, "_t"])
    is_hot = F.col("_f") > hot
    # the hot parts of each row, the rarest first
    lefts = mine.groupBy(*scope, "_l").agg(F.transform(F.array_sort(F.collect_list(F.when(is_hot, F.struct("_f", "_t")))), lambda x: x["_t"]).alias("_h"))
    rights = theirs.groupBy(*scope, "_r").agg(F.array_sort(F.collect_list(F.when(is_hot, F.col("_t")))).alias("_g"))

    met = mine.filter(~is_hot).select(*scope, "_l", "_t").join(theirs.filter(~is_hot).select(*scope, "_r", "_t"), [*scope, "_t"])
    if distinct_keys:
        met = met.filter("_l <> _r.r")
    shared = met.groupBy(*scope, "_l", "_r").agg(F.count("*").alias("_c"))
    most = shared.groupBy(*scope, "_l").agg(F.max("_c").alias("_m"))
    alive = shared.join(lefts.join(most, [*scope, "_l"]), [*scope, "_l"]).filter(F.col("_c") + F.size("_h") >= F.col("_m")).join(rights, [*scope, "_r"])
    alive = alive.withColumn("_s", F.col("_c") + F.size(F.array_intersect("_h", "_g")))
    found = alive.groupBy(*scope, "_l", "_s").agg(F.count("*").alias("_n"), F.min("_r").alias("_b")).groupBy(*scope, "_l").agg(F.max(F.struct("_s", "_n", "_b")).alias("_x"))

    rows = lefts.join(found, [*scope, "_l"], "left").withColumn("_need", F.greatest(F.coalesce("_x._s", F.lit(0)), F.lit(1)).cast("long"))
    levels = _by_hot(rows.filter(F.size("_h") >= F.col("_need")).select(*scope, "_h", "_need").distinct(), rights.filter(F.size("_g") > 0), scope, distinct_keys)
    rows = rows.join(levels, [*scope, "_h", "_need"], "left")
    if distinct_keys:  # the row of one's own key is one of those counted at what it shares
        own = rights.select(*scope, F.col("_r.r").alias("_l"), F.col("_g").alias("_own"))
        rows = rows.join(own, [*scope, "_l"], "left")
        same = F.coalesce(F.size(F.array_intersect("_h", "_own")), F.lit(0)).cast("long")
        lone = lambda x: F.struct(x.s.alias("s"), (x.n - F.when(x.s == same, 1).otherwise(0)).alias("n"), F.when((x.s == same) & (x.b.r == F.col("_l")), x.b2).otherwise(x.b).alias("b"))
    else:
        lone = lambda x: F.struct(x.s.alias("s"), x.n.alias("n"), x.b.alias("b"))
    by_hot = F.get(F.filter(F.transform("_levels", lone), lambda x: x.n > 0), F.lit(0))
    rows = rows.withColumn("_y", by_hot).filter("_x IS NOT NULL OR _y IS NOT NULL")
    ahead = F.col("_x").isNotNull() & (F.col("_y").isNull() | (F.col("_x._s") > F.col("_y.s")))
    level = F.col("_x._s") == F.col("_y.s")
    best = F.when(ahead, F.col("_x._b")).when(level, F.least("_x._b", "_y.b")).otherwise(F.col("_y.b"))
    tied = F.when(ahead, F.col("_x._n")).when(level, F.col("_x._n") + F.col("_y.n")).otherwise(F.col("_y.n"))
    return rows.select(*scope, F.col("_l").alias(left_key), best["r"].alias(right_key), F.greatest("_x._s", "_y.s").cast("long").alias("shared"), tied.cast("int").alias("tied"))


def _by_hot(asked: DataFrame, rights: DataFrame, scope: list[str], second: bool) -> DataFrame:
    """(scope, _h, _need, _levels) of distinct sets of hot parts: for each number of them, from ``_need`` on and the highest first, that right rows share: how many rows, and the first.

    ``second``: the second row, too.  A set that shares ``_need`` of h parts has one of the h - _need + 1 rarest; it counts at the first that both have."""
    sets = rights.groupBy(*scope, "_g").agg(F.count("*").alias("_n"), F.min("_r").alias("_b"))
    if second:
        first = sets.select(*scope, "_g", "_b")
        sets = sets.join(rights.join(first, [*scope, "_g"]).filter("_r <> _b").groupBy(*scope, "_g").agg(F.min("_r").alias("_b2")), [*scope, "_g"], "left")
    probes = asked.withColumn("_t", F.explode(F.slice("_h", F.lit(1), (F.size("_h") - F.col("_need") + 1).cast("int"))))
    both = F.array_intersect("_h", "_g")
    met = probes.join(sets.withColumn("_t", F.explode("_g")), [*scope, "_t"]).filter((F.get(both, F.lit(0)) == F.col("_t")) & (F.size(both) >= F.col("_need"))).withColumn("_s", F.size(both).cast("long"))
    by = [*scope, "_h", "_need", "_s"]
    level = met.groupBy(*by).agg(F.sum("_n").alias("n"), F.min("_b").alias("b"))
    if second:
        others = met.join(level.select(*by, "b"), by).groupBy(*by).agg(F.min(F.when(F.col("_b") == F.col("b"), F.col("_b2")).otherwise(F.col("_b"))).alias("b2"))
        level = level.join(others, by)
    fields = ["n", "b", "b2"] if second else ["n", "b"]
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("_s")).alias("m"), *fields)))
    return level.groupBy(*by[:-1]).agg(ranked.alias("_l2")).select(*by[:-1], F.transform("_l2", lambda x: F.struct((-x.m).alias("s"), *[x[f].alias(f) for f in fields])).alias("_levels"))
