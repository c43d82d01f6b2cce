"""Dates as written, day first where numbers leave it open."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .spans import escaped, first_of

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_NAMES = sorted({*MONTHS, *(m[:3] for m in MONTHS), "sept"}, key=len, reverse=True)
_ALT = "|".join(_NAMES)
_DAY, _MONTH, _YEAR, _END = "([0-9]{1,2})", f"({_ALT})", "([0-9]{4})", "(?:st|nd|rd|th)?"
#: The forms: 14 March 2024 and 14th March, 2024; March 14, 2024; 2024-03-14; 14/3/24, 14.3.2024 and 14-03-2024.
DMY = _DAY + _END + r"\s+" + _MONTH + r"\.?,?\s+" + _YEAR
MDY = _MONTH + r"\.?\s+" + _DAY + _END + r",?\s+" + _YEAR
ISO = "-".join((_YEAR, _DAY, _DAY))
NUMERIC = "[/.-]".join((_DAY, _DAY, "([0-9]{2,4})"))
ANY = "(?:" + "|".join(p.replace("(", "(?:").replace("(?:?:", "(?:") for p in (DMY, MDY, ISO, NUMERIC)) + ")"
#: Labels tried after a type's own.
LABELS = ("date of advice", "date signed", "date completed", "date of this advice", "effective date", "date issued", "date prepared", "completed on", "completed", "dated", "date")


def _month(name: Column) -> Column:
    low = F.substring(F.lower(name), 1, 3)
    out = F.lit(None).cast("int")
    for k, m in enumerate(MONTHS):
        out = F.when(low == m[:3], F.lit(k + 1)).otherwise(out)
    return out


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_timestamp(F.format_string("%04d-%02d-%02d", y, m, d), F.lit("yyyy-MM-dd")).cast("date")


def parse(raw: Column) -> Column:
    """Struct of value, style and ambiguous; null where the whole string is no date."""
    s = F.trim(raw)
    part = lambda p, k: F.regexp_extract(s, f"(?i)^{p}$", k)
    num = lambda p, k: F.expr("try_cast(null as int)") if p is None else part(p, k).try_cast("int")
    a, b, y = num(NUMERIC, 1), num(NUMERIC, 2), num(NUMERIC, 3)
    year = F.when(y < 70, y + 2000).when(y < 100, y + 1900).otherwise(y)
    swapped = (b > 12) & (a <= 12)
    forms = [
        ("dmy_word", DMY, num(DMY, 3), _month(part(DMY, 2)), num(DMY, 1), F.lit(False)),
        ("mdy_word", MDY, num(MDY, 3), _month(part(MDY, 1)), num(MDY, 2), F.lit(False)),
        ("iso", ISO, num(ISO, 1), num(ISO, 2), num(ISO, 3), F.lit(False)),
        ("numeric", NUMERIC, year, F.when(swapped, a).otherwise(b), F.when(swapped, b).otherwise(a), F.when(a > 12, F.lit(False)).when(swapped, F.lit(True)).otherwise(a != b)),
    ]
    out = F.lit(None).cast("struct<value:date,style:string,ambiguous:boolean>")
    for style, pattern, yy, mm, dd, ambiguous in reversed(forms):
        value = _date(yy, mm, dd)
        out = F.when(s.rlike(f"(?i)^{pattern}$"), F.when(value.isNotNull(), F.struct(value.alias("value"), F.lit(style).alias("style"), ambiguous.alias("ambiguous")))).otherwise(out)
    return out


def labelled(text: Column, labels: list[tuple[str, str]]) -> Column:
    """array<struct<label, raw>>: for each (name, label) what stands as a date right after the label's first occurrence that has one, in the labels' order; only those."""
    rows = [F.struct(F.lit(name).alias("label"), F.regexp_extract(text, rf"(?iu){escaped(label)}\s*[:-]?\s*({ANY})", 1).alias("raw")) for name, label in labels]
    return first_of(rows)


def dated(raws: Column) -> Column:
    """array<struct<label, value>>: the raws that are dates."""
    return F.filter(F.transform(raws, lambda x: F.struct(x.label.alias("label"), parse(x.raw).value.alias("value"))), lambda x: x.value.isNotNull())


def all_dates(text: Column) -> Column:
    """Distinct dates of the text, in order of appearance."""
    raw = F.regexp_extract_all(text, F.lit(rf"(?i)\b({ANY})\b"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(raw, lambda r: parse(r).value), lambda d: d.isNotNull()))


def own(labelled_dates: Column, loose: Column) -> tuple[Column, Column]:
    """(value, provenance) of a document's own date: the first labelled one, or the only one there is."""
    first, n = F.get(labelled_dates, F.lit(0)), F.size(loose)
    value = F.coalesce(first.value, F.when(n == 1, F.get(loose, F.lit(0))))
    why = F.coalesce(F.concat(F.lit("labelled '"), first.label, F.lit("'")), F.when(n == 1, F.lit("only date in document (unlabelled)")).when(n > 1, F.concat(n.cast("string"), F.lit(" unlabelled dates, none identifiable as the document's own"))).otherwise(F.lit("no date found")))
    return value, why


def own_date(text: Column, labels: list[str]) -> Column:
    """Struct of value and provenance; the type's own labels are tried before the general ones."""
    tried = list(dict.fromkeys([*labels, *LABELS]))
    value, why = own(dated(labelled(text, [(n, n) for n in tried])), all_dates(text))
    return F.struct(value.alias("value"), why.alias("provenance"))
