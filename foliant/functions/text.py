"""Scalar functions over document texts, as Columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

#: Thresholds and words of the readability score.
MIN_CHARS = 120
MIN_PER_PAGE = 80
MIN_ALPHA = 0.55
MIN_DICTIONARY = 0.35
MAX_SINGLE = 0.35
COMMON_WORDS = "the of and to in for a is are be on with this that you your we our it as at by or not from will may any has have been which if all can other more please client".split()


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))


def normalise(text: Column) -> Column:
    """Compatibility forms, line ends, typographic marks and runs of blanks made plain; lines stay.

    Spark has no NFKC; texts beyond ASCII go through one Arrow function, the others stay in the JVM's plan."""
    x = F.when(text.rlike(r"[^\x00-\x7F]"), _nfkc(text)).otherwise(text)
    x = F.regexp_replace(x, "\r\n?", "\n")
    x = F.translate(x, "’‘“”–— ", "''\"\"-- ")
    x = F.regexp_replace(F.regexp_replace(x, "[ \t]+", " "), "\n{3,}", "\n\n")
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def content_id(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def suffix(name: Column) -> Column:
    """Extension with its dot; '' for none and for names that only begin with one."""
    return F.regexp_extract(name, r"[^./](\.[^./]*)$", 1)


def pages(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 1800)).cast("int")


def quality(text: Column, page_count: Column | int = 1) -> Column:
    """Struct of readable, score (unrounded), chars, tokens, common word hits and reasons: a product of penalties."""
    n_pages = F.greatest(F.lit(1), page_count if isinstance(page_count, Column) else F.lit(page_count))
    # every count is worked out once, however often the score names it
    counted = let(F.regexp_replace(text, r"^\s+|\s+$", ""), lambda s: let(F.regexp_extract_all(F.lower(s), F.lit("[A-Za-z']+"), F.lit(0)), lambda tokens: F.struct(
        F.length(s).alias("total"), F.length(F.regexp_replace(s, r"[^\p{L}]", "")).alias("letters"), F.size(tokens).alias("n"),
        F.size(F.filter(tokens, lambda t: F.length(t) == 1)).alias("single"), F.size(F.filter(tokens, lambda t: t.isin(COMMON_WORDS))).alias("hits"))))
    return let(counted, lambda c: _scored(c, n_pages))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out, and standing in the plan, once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _scored(c: Column, n_pages: Column) -> Column:
    total, letters, n, single, hits = (c[k] for k in ("total", "letters", "n", "single", "hits"))
    per_page = total / n_pages
    alpha = letters / total
    single_ratio = F.when(n > 0, single / n).otherwise(1.0)
    dictionary = F.least(F.lit(1.0), hits / F.greatest(F.lit(1.0), n * F.lit(0.04)))
    cut = lambda bad, ratio: F.when(bad, F.greatest(F.lit(0.05), ratio)).otherwise(1.0)
    tests = {
        "too few characters": (total < MIN_CHARS, total / F.lit(float(MIN_CHARS))),
        "too few characters a page": (per_page < MIN_PER_PAGE, per_page / F.lit(float(MIN_PER_PAGE))),
        "too few letters": (alpha < MIN_ALPHA, alpha / F.lit(MIN_ALPHA)),
        "words of single characters": (single_ratio > MAX_SINGLE, F.lit(MAX_SINGLE) / F.greatest(single_ratio, F.lit(0.01))),
        "almost no common words": (dictionary < MIN_DICTIONARY, dictionary / F.lit(MIN_DICTIONARY)),
    }
    score = F.lit(1.0)
    for bad, ratio in tests.values():
        score = score * cut(bad, ratio)
    score = F.when(total > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).otherwise(0.0)
    reasons = F.when(total > 0, F.filter(F.array(*[F.when(bad, F.lit(why)) for why, (bad, _) in tests.items()]), lambda x: x.isNotNull())).otherwise(F.array(F.lit("no text")))
    return F.struct((score >= 0.5).alias("readable"), score.alias("score"), total.cast("long").alias("chars"), n.cast("long").alias("tokens"), hits.cast("long").alias("common"), reasons.alias("reasons"))
