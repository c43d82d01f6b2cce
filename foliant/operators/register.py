"""Matching people against a register: candidates by shared name parts, a score ladder, a verdict by the margin of the top two."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType

#: Scores by kind of surname match and given-name evidence (agree, unknown, conflict).
EXACT = (0.98, 0.85, 0.55)
SUBSET = (0.88, 0.62, 0.45)
NEAR = (0.10, 0.0, -0.25)
NEAR_RATIO = 0.85
RUNNERS = 3


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def _evidence(ours: Column, theirs: Column, values: tuple[float, float, float]) -> Column:
    agree, unknown, conflict = (F.lit(v) for v in values)
    return F.when((F.size(ours) == 0) | (F.size(theirs) == 0), unknown).when(F.arrays_overlap(ours, theirs), agree).otherwise(conflict)


def _least(total: Column) -> Column:
    """Letters that two names of so many letters together must have in common, in order, for a ratio of ``NEAR_RATIO``."""
    return F.ceil(total * F.lit(NEAR_RATIO) / 2 - F.lit(1e-9)).cast("int")


def _in_common(a: Column, b: Column) -> Column:
    """Letters that two strings have in common, in any order: no fewer than a ratio counts."""
    letters = lambda c: F.split(c, "")
    count = lambda c, x: F.size(F.filter(letters(c), lambda y: y == x))
    return F.aggregate(F.array_distinct(letters(a)), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))


def _pairs_of_letters(c: Column) -> Column:
    """A name's pairs of adjacent letters, the repeated ones told apart: "anna" has an, nn, na; "anan" has an, na, an again."""
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 1))
    pair = lambda i: F.substring(c, i, F.lit(2))
    return F.transform(at, lambda i: F.struct(pair(i).alias("g"), F.size(F.filter(at, lambda j: (j < i) & (pair(j) == pair(i)))).alias("n")))


def _probes(names: DataFrame, count: DataFrame, name: str) -> DataFrame:
    """(name, g): as many of each name's rarest pairs of letters as a near name may lack, and one.

    In names of p and c letters, M = least(p + c) in common, each letter that is left out parts one pair of the common ones:
    M - 1 - (p - M) - (c - M) pairs are shared at least.  Of p's p - 1 pairs it may lack the rest; the worst c decides."""
    p = F.length(name)
    near = F.sequence(F.greatest(F.lit(1), F.ceil(p * F.lit(NEAR_RATIO / (2 - NEAR_RATIO)) - F.lit(1e-9)).cast("int")), F.floor(p * F.lit((2 - NEAR_RATIO) / NEAR_RATIO) + F.lit(1e-9)).cast("int"))
    possible = F.filter(near, lambda c: _least(p + c) <= F.least(p, c))
    shared = F.array_min(F.transform(possible, lambda c: 3 * _least(p + c) - 1 - (p + c)))
    long = names.withColumn("g", F.explode(_pairs_of_letters(F.col(name)))).join(count, "g")
    ranked = long.groupBy(name).agg(F.array_sort(F.collect_list(F.struct("f", "g"))).alias("gs"))
    keep = F.greatest(F.lit(1), F.size("gs") - F.greatest(shared, F.lit(1)) + 1)
    return ranked.select(name, F.explode(F.slice("gs", F.lit(1), keep)).alias("x")).select(name, F.col("x.g").alias("g"))


def near(people: DataFrame, register: DataFrame) -> DataFrame:
    """(p, c, ratio) of distinct surnames with difflib's ratio of ``NEAR_RATIO`` at least.

    Candidates meet on their rarest pairs of letters, so that a common pair brings no names together that rarer ones do not;
    lengths and common letters, both bounds of the ratio from above, are compared in the plan, and what is left is weighed in
    Python, each pair of names once."""
    mine = people.select(F.explode("surnames").alias("p")).distinct().filter("p <> ''")
    theirs = register.select(F.explode("surnames").alias("c")).distinct().filter("c <> ''")
    count = mine.select("p").union(theirs).distinct().select(F.explode(_pairs_of_letters(F.col("p"))).alias("g")).groupBy("g").agg(F.count("*").alias("f"))
    met = _probes(mine, count, "p").join(_probes(theirs, count, "c"), "g").select("p", "c").filter(_least(F.length("p") + F.length("c")) <= F.least(F.length("p"), F.length("c"))).distinct()
    likely = met.filter(_in_common(F.col("p"), F.col("c")) >= _least(F.length("p") + F.length("c")))
    return likely.withColumn("ratio", _ratio("p", "c")).filter(F.col("ratio") >= NEAR_RATIO)


def scored(people: DataFrame, register: DataFrame, key: str, fuzzy: bool = True) -> DataFrame:
    """(k, folder_name, score) of the pairs that share a surname or have near ones; every other pair scores below any verdict's bound."""
    p = people.select(F.col(key).alias("k"), "surnames", F.coalesce("given", F.array().cast("array<string>")).alias("given"))
    r = register.select("folder_name", F.col("surnames").alias("rs"), F.coalesce("given", F.array().cast("array<string>")).alias("rg"))
    shared = p.select("k", F.explode("surnames").alias("s")).join(r.select("folder_name", F.explode("rs").alias("s")), "s").select("k", "folder_name", F.lit(1.0).alias("ratio"))
    if fuzzy:
        shared = shared.unionByName(p.select("k", F.explode("surnames").alias("p")).join(near(p, register), "p").join(r.select("folder_name", F.explode("rs").alias("c")), "c").select("k", "folder_name", "ratio"))
    met = shared.groupBy("k", "folder_name").agg(F.max("ratio").alias("ratio")).join(p, "k").join(r, "folder_name")
    ours, theirs = F.col("surnames"), F.col("rs")
    less, more = F.size(F.array_except(ours, theirs)) == 0, F.size(F.array_except(theirs, ours)) == 0
    close = F.greatest(F.lit(0.0), F.least(F.lit(0.95), F.col("ratio")) + _evidence(F.col("given"), F.col("rg"), NEAR))
    score = F.when(less & more, _evidence(F.col("given"), F.col("rg"), EXACT)).when(less | more, _evidence(F.col("given"), F.col("rg"), SUBSET)).when(F.lit(fuzzy), close).otherwise(0.0)
    return met.select("k", "folder_name", score.alias("score"))


def match(people: DataFrame, register: DataFrame, key: str, match_at: float = 0.80, margin: float = 0.12, new_below: float = 0.55, fuzzy: bool = True) -> DataFrame:
    """(key, verdict, folder_name, score, second, runners, reason): matched, ambiguous, uncertain or new.

    ``people``: key, surnames, given; ``register``: folder_name, surnames, given; names normalised (functions.names.plain_all).
    runners: the next three with a score, as structs of folder_name and score.  An empty register makes everybody new."""
    # people of the same names are one person to the register: each is matched once, however many documents name them
    none = F.array().cast("array<string>")
    named = lambda frame: frame.select(F.col(key).alias("k"), F.coalesce("surnames", none).alias("surnames"), F.coalesce("given", none).alias("given"))
    persons = named(people).select("surnames", "given").distinct().withColumn("k", F.struct("surnames", "given"))
    pairs = scored(persons, register, "k", fuzzy)
    # the best four of each, cut per task before they meet: a group limit, not a list of all scores
    best = Window.partitionBy("k").orderBy(F.desc("score"), "folder_name")
    four = pairs.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= RUNNERS + 1).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("n", "folder_name", "score"))).alias("four"))
    out = named(people).join(four.select("k.surnames", "k.given", "four"), ["surnames", "given"], "left")
    first, after = F.get("four", F.lit(0)), F.get("four", F.lit(1))
    top, second = F.coalesce(first.score, F.lit(0.0)), F.coalesce(after.score, F.lit(0.0))
    verdict = F.when(top < new_below, "new").when((top - second < margin) & (second > 0), "ambiguous").when(top >= match_at, "matched").otherwise("uncertain")
    two = lambda x: F.format_string("%.2f", x)
    why = (
        F.when(first.isNull(), "nobody in the register resembles them")
        .when(verdict == "new", F.concat(F.lit("nobody in the register resembles them (closest was "), first.folder_name, F.lit(" at "), two(top), F.lit(")")))
        .when(verdict == "ambiguous", F.concat(F.lit("fits both "), first.folder_name, F.lit(" ("), two(top), F.lit(") and "), after.folder_name, F.lit(" ("), two(second), F.lit(")")))
        .when(verdict == "matched", F.concat(first.folder_name, F.lit(" at "), two(top)))
        .otherwise(F.concat(F.lit("closest is "), first.folder_name, F.lit(" at "), two(top), F.lit(f", under the {match_at:.2f} needed to file on")))
    )
    rest = F.transform(F.filter(F.slice(F.coalesce("four", F.array().cast("array<struct<n:int,folder_name:string,score:double>>")), 2, RUNNERS), lambda x: x.score > 0), lambda x: F.struct(x.folder_name.alias("folder_name"), x.score.alias("score")))
    return out.select(F.col("k").alias(key), verdict.alias("verdict"), F.when(verdict.isin("matched", "uncertain"), first.folder_name).alias("folder_name"), top.alias("score"), second.alias("second"), rest.alias("runners"), why.alias("reason"))
