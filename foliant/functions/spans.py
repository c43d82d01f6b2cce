"""Phrases and where they stand in a text."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, functions as F


def escaped(phrase: str) -> str:
    return "".join("\\" + c if re.match(r"[^\w\s]", c) else c for c in phrase)


def head(field: str) -> str:
    """A key field's name without its alternatives and remarks."""
    return field.lower().split(" / ")[0].split(" (")[0].strip()


def phrase_regex(phrase: str, short_max: int = 4, ascii_edges: bool = False) -> str:
    """Short alphabetic phrases are whole words in upper case; others are found anywhere, whatever their case.

    What ends a word is written out: the meaning of a bare word boundary depends on the Java version."""
    if len(phrase) <= short_max and phrase.isalpha():
        part = "[A-Za-z0-9_]" if ascii_edges else r"[\p{L}\p{N}_]"
        return f"(?<!{part}){phrase.upper()}(?!{part})"
    return "(?iu)" + escaped(phrase)


def found(text: Column, phrase: str, short_max: int = 4, low: Column | None = None) -> Column:
    """Whether the phrase occurs; ``low``: the text in lower case, if it is at hand: long phrases need no regular expression then."""
    if low is not None and not (len(phrase) <= short_max and phrase.isalpha()):
        return F.contains(low, F.lit(phrase.lower()))
    return text.rlike(phrase_regex(phrase, short_max))


def first_of(rows: list[Column]) -> Column:
    """The rows (structs of label and raw) whose raw is not empty, in their order."""
    if not rows:
        return F.array().cast("array<struct<label:string,raw:string>>")
    return F.filter(F.array(*rows), lambda x: x.raw != "")


def extracted(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """array<struct<label, raw>>: for each (name, regular expression) its first group's first match, in their order; only those that match."""
    return first_of([F.struct(F.lit(name).alias("label"), F.regexp_extract(text, p, 1).alias("raw")) for name, p in patterns])


def tokens(text: Column, pattern: str) -> Column:
    """Distinct matches of a regular expression."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


#: A phrase: itself, in lower case, as a regular expression, and whether only that finds it.
PHRASES = "array<struct<p:string,low:string,re:string,whole:boolean>>"


def rows(phrases: list[str], short_max: int = 4, ascii_edges: bool = False) -> list[dict]:
    """Phrases as values of PHRASES, for a constant table."""
    return [{"p": p, "low": p.lower(), "re": phrase_regex(p, short_max, ascii_edges), "whole": len(p) <= short_max and p.isalpha()} for p in phrases]


def hits(text: Column, low: Column, phrases: Column) -> Column:
    """Those of PHRASES that occur, in their order.  ``low``: the text in lower case."""
    return F.filter(phrases, lambda x: F.when(x.whole, F.rlike(text, x.re)).otherwise(F.contains(low, x.low)))


def matches(text: Column, regex: str | Column) -> Column:
    """All matches as array<struct<s, e>>: code point offsets from the lengths of matches and of what lies between."""
    regex = F.lit(regex) if isinstance(regex, str) else regex
    found = F.regexp_extract_all(text, F.concat(F.lit("("), regex, F.lit(")")), F.lit(1))
    between = F.split(text, regex, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))  # titles are few: the copies of out stay small
    pairs = F.zip_with(F.transform(found, lambda h: F.length(h)), F.transform(between, lambda b: F.length(b)), lambda h, b: F.struct(h.alias("h"), b.alias("b")))

    def step(acc, p):
        s = acc.at + p.b
        return F.struct((s + F.coalesce(p.h, F.lit(0))).alias("at"), F.when(p.h.isNull(), acc.out).otherwise(F.concat(acc.out, F.array(F.struct(s.alias("s"), (s + p.h).alias("e"))))).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc.out)


def in_title_position(text: Column, m: Column, head_chars: int, short_max: int) -> Column:
    """Near the top, in capitals, or most of a short line of its own."""
    own = F.substring(text, m.s + 1, m.e - m.s)
    upper = (own == F.upper(own)) & (own != F.lower(own)) & (F.length(own) > short_max)
    before = F.substring_index(F.substring(text, F.lit(1), m.s), "\n", -1)
    after = F.substring_index(F.substring(text, m.e + 1, F.length(text)), "\n", 1)
    line = F.length(F.trim(F.concat(before, own, after)))
    return (m.s < head_chars) | upper | ((line <= 80) & (F.length(own) >= 0.6 * F.greatest(F.lit(1), line)))
