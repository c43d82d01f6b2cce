"""Pseudonyms and redaction."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


_WORD = r"\p{L}[\p{L}\p{M}\p{N}_'-]*"


def pseudonym(value: Column, salt: str) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit("client-"), F.substring(F.sha2(F.concat(F.lit(salt + "|"), value), 256), 1, 10)))


def prose(text: Column, vocabulary: list[str], mark: str = "[name]") -> Column:
    """Capitalised words outside a closed vocabulary replaced by a mark; of any length, for there are names of two letters."""
    known = sorted({w.lower() for w in vocabulary})
    words = F.regexp_extract_all(text, F.lit(f"({_WORD})"), F.lit(1))
    gaps = F.split(text, _WORD, -1)
    hidden = F.transform(words, lambda w: F.when((F.substring(w, 1, 1) == F.upper(F.substring(w, 1, 1))) & (F.substring(w, 1, 1) != F.lower(F.substring(w, 1, 1))) & ~F.lower(w).isin(known or [""]), F.lit(mark)).otherwise(w))
    return F.array_join(F.zip_with(gaps, hidden, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")


def file_name(name: Column, vocabulary: list[str]) -> Column:
    """Each word of a file's name that is outside the vocabulary becomes x; digits and the extension stay."""
    known = sorted({w.lower() for w in vocabulary})
    ext = F.regexp_extract(name, r"(\.[A-Za-z0-9]{1,5})$", 1)
    stem = F.regexp_replace(name, r"\.[A-Za-z0-9]{1,5}$", "")
    tokens = F.transform(F.split(stem, r"[\s_.-]+"), lambda t: F.when(t.rlike("^[0-9]*$") | F.lower(t).isin(known or [""]), t).otherwise(F.lit("x")))
    return F.concat(F.array_join(tokens, "-"), F.lower(ext))
