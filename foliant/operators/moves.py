"""An order of moves in which no move meets an occupied path.

Moves of a tree form chains (A goes where B is, B where C is) and cycles.  A move's turn is its
distance to the end of its chain, found by pointer doubling: each round joins every move with the
one that it points to and doubles how far it sees, so a chain of n moves takes log2 n rounds of
equi-joins, however the moves are dealt.  A cycle is opened at its least path, whose file steps
aside under a name of the engine's own first and goes to its place last.  Moves of one turn touch no
common path.

Paths are compared in lower case, as some file systems do: a move that changes only the case of a
name is a cycle of one.  A chain that ends at a file which stays is blocked, with every move behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..shared import written

#: Where files step aside to, below the root; listings leave it out.
ASIDE = "_foliant/moving"


def _key(batch: Column, path: Column) -> Column:
    return F.concat(batch, F.lit("\x1f"), F.lower(path))


def _ranked(links: DataFrame) -> DataFrame:
    """``links``: f, nx (null at an end).  (f, ptr, d, least, dl, last): steps to the end and the end itself; in a cycle ptr is not null, ``least`` is its least f and ``dl`` the steps to that.

    After k rounds a row has seen the 2^k moves from its own on."""
    end = F.col("nx").isNull()
    state = written(links.select("f", F.col("nx").alias("ptr"), F.when(end, 0).otherwise(1).cast("long").alias("d"), F.col("f").alias("least"), F.lit(0).cast("long").alias("dl"), F.coalesce("nx", "f").alias("last"), F.lit(True).alias("less")), "moves")
    left = None
    while True:
        active = state.filter("ptr IS NOT NULL")
        seen = active.agg(F.count("*").alias("n"), F.bool_or("less").alias("less")).first()
        # chains lose some in every round; a cycle has been seen whole when nothing less turns up in it
        if not seen.n or seen.n == left and not seen.less:
            return state
        left = seen.n
        there = state.select(F.col("f").alias("ptr"), *[F.col(c).alias(f"{c}2") for c in ("ptr", "d", "least", "dl", "last")])
        lower = F.col("least2") < F.col("least")
        further = active.join(there, "ptr").select(
            "f", F.col("ptr2").alias("ptr"), (F.col("d") + F.col("d2")).alias("d"), F.least("least", "least2").alias("least"), F.when(lower, F.col("d") + F.col("dl2")).otherwise(F.col("dl")).alias("dl"), F.col("last2").alias("last"), lower.alias("less"))
        state = written(further.unionByName(state.filter("ptr IS NULL")), "moves")


def ordered(moves: DataFrame, stays: DataFrame | None = None) -> DataFrame:
    """``moves``: batch_id, from, to and any other columns, each path at most once on either side.  Those columns with ``turn`` (from 0; lower first) and ``blocked``.

    A move that opens a cycle is two rows, by way of ``ASIDE``.  ``stays``: batch_id, path of files that do not move.  Blocked moves have no turn."""
    keyed = moves.withColumns({"f": _key(F.col("batch_id"), F.col("from")), "_t": _key(F.col("batch_id"), F.col("to"))})
    held = keyed.select(F.col("f").alias("_t"), F.col("f").alias("nx"))
    links = written(keyed.select("f", "_t").join(held, "_t", "left"), "moves-links")
    # a move that waits for nobody and that nobody waits for has turn 0 and takes no part in the doubling
    waited = links.filter("nx IS NOT NULL").select(F.col("nx").alias("f")).distinct()
    chained = links.filter("nx IS NOT NULL").select("f", "nx").unionByName(links.filter("nx IS NULL").select("f", "nx").join(waited, "f", "left_semi"))
    state = _ranked(chained)
    chains = state.filter("ptr IS NULL").select("f", F.col("d").alias("turn"), "last")
    cycles = state.filter("ptr IS NOT NULL")
    size = cycles.groupBy("least").agg(F.count("*").alias("size"))
    inside = cycles.join(size, "least").select("f", F.col("dl").alias("turn"), F.when(F.col("f") == F.col("least"), F.col("size")).alias("size"))
    if stays is not None:
        there = stays.select(_key(F.col("batch_id"), F.col("path")).alias("_t"), F.lit(True).alias("taken")).distinct()
        ends = keyed.select("f", "_t").join(there, "_t").select(F.col("f").alias("last"), "taken")
    else:
        ends = links.select(F.col("f").alias("last"), F.lit(True).alias("taken")).filter("false")
    turns = chains.unionByName(inside, allowMissingColumns=True)
    x = keyed.join(turns, "f", "left").withColumn("last", F.coalesce("last", F.when(F.col("size").isNull(), F.col("f")))).join(ends, "last", "left")
    x = x.withColumns({"turn": F.coalesce("turn", F.lit(0).cast("long")), "blocked": F.coalesce("taken", F.lit(False))})
    aside = F.concat(F.lit(f"{ASIDE}/"), F.substring(F.sha2("f", 256), 1, 16))
    step = lambda a, b, turn: F.struct(a.alias("from"), b.alias("to"), turn.alias("turn"))
    steps = F.when(F.col("size").isNotNull(), F.array(step(F.col("from"), aside, F.lit(0).cast("long")), step(aside, F.col("to"), F.col("size")))).otherwise(F.array(step(F.col("from"), F.col("to"), F.when(~F.col("blocked"), F.col("turn")))))
    rest = [c for c in moves.columns if c not in ("from", "to")]
    return x.select(*rest, "blocked", F.explode(steps).alias("s")).select(*rest, "s.from", "s.to", "s.turn", "blocked")
