import datetime as dt

import pytest
from pyspark.sql import functions as F

from foliant.functions import dates, names, redact, spans, text as T


def one(spark, column, **values):
    return spark.createDataFrame([values]).select(column.alias("x")).first().x


@pytest.mark.parametrize("raw, value, ambiguous", [
    ("03/04/2024", dt.date(2024, 4, 3), True), ("22/04/2024", dt.date(2024, 4, 22), False), ("04/22/2024", dt.date(2024, 4, 22), True),
    ("14 March 2024", dt.date(2024, 3, 14), False), ("14th March 2024", dt.date(2024, 3, 14), False), ("March 14, 2024", dt.date(2024, 3, 14), False),
    ("2024-03-14", dt.date(2024, 3, 14), False), ("1/2/69", dt.date(2069, 2, 1), True), ("1/2/70", dt.date(1970, 2, 1), True),
])
def test_date_forms(spark, raw, value, ambiguous):
    got = one(spark, dates.parse(F.col("t")), t=raw)
    assert (got.value, got.ambiguous) == (value, ambiguous)


@pytest.mark.parametrize("raw", ["31/02/2024", "13/13/2024", "2024-13-01", "on 3 May 2024", ""])
def test_no_date(spark, raw):
    assert one(spark, dates.parse(F.col("t")), t=raw) is None


def test_own_date(spark):
    own = lambda t: one(spark, dates.own_date(F.col("t"), ["date signed"]), t=t)
    assert own("dated 14 March 2024. Date signed: 3 June 2024").value == dt.date(2024, 6, 3)
    assert own("only 3 June 2024 here").provenance.startswith("only date")
    assert own("3 June 2024 and 4 June 2024").value is None
    assert own("none").provenance == "no date found"


@pytest.mark.parametrize("text, surnames", [
    ("Client: Linh & David Nguyen.", ["Nguyen"]), ("Prepared for: Mei Tran and Jordan Okafor.", ["Okafor", "Tran"]),
    ("FACT FIND - CLIENT DATA FORM. Client: Linh Nguyen.", ["Nguyen"]), ("Client: Lars Sørensen.", ["Sørensen"]), ("Client: José García.", ["García"]),
    ("Client: Dr Mei Tran; adviser", ["Tran"]), ("Prepared by Harbour Advice", None), ("", None),
])
def test_clients(spark, text, surnames):
    got = one(spark, names.client(F.col("t")), t=text)
    assert (got.surnames if got else None) == surnames


def test_plain_names(spark):
    assert one(spark, names.plain_name(F.col("t")), t="Sørensen-O'Brién") == "sorensen-o'brien"
    assert one(spark, names.plain_words(F.col("t")), t="Nguyen, Linh & David and Co.") == ["nguyen", "linh", "david", "co"]


def test_titles_of_names(spark):
    assert one(spark, names.title(F.array(F.col("t"))), t="smith-jones")[0] == "Smith-Jones"
    assert one(spark, names.title(F.array(F.col("t"))), t="o'brien")[0] == "O'Brien"


def test_phrases(spark):
    assert not one(spark, spans.found(F.col("t"), "CAR"), t="We take care of your insurance cover")
    assert one(spark, spans.found(F.col("t"), "CAR"), t="the CAR is attached")
    assert one(spark, spans.found(F.col("t"), "fact find"), t="FACT FIND")
    got = one(spark, spans.matches(F.col("t"), spans.phrase_regex("fact find")), t="éé fact find, FACT FIND")
    assert [(m.s, m.e) for m in got] == [(3, 12), (14, 23)]


def test_quality(spark):
    good = "This is the record of what we said to you and your partner in the office, and of all that you asked us to do for you this year. " * 2
    q = one(spark, T.quality(F.col("t")), t=good)
    assert q.readable and q.score == 1.0
    bad = one(spark, T.quality(F.col("t"), 4), t="S t a t e m e n t o f A d v i c e")
    assert not bad.readable and bad.score < 0.5
    assert one(spark, T.quality(F.col("t")), t="").score == 0.0


def test_normalise(spark):
    assert one(spark, T.normalise(F.col("t")), t="  ﬁle\r\n\r\n\r\n\r\n“a”\t b ") == "file\n\n\"a\" b"


def test_suffix(spark):
    for name, want in (("a.PDF", ".PDF"), (".hidden", ""), ("a.b.txt", ".txt"), ("a", "")):
        assert one(spark, T.suffix(F.col("t")), t=name) == want


def test_redaction(spark):
    assert one(spark, redact.prose(F.col("t"), ["the"]), t="The Ng family, Wu") == "The [name] family, [name]"
    assert one(spark, redact.file_name(F.col("t"), ["soa"]), t="Nguyen SOA 2024.pdf") == "x-SOA-2024.pdf"
    assert one(spark, redact.pseudonym(F.col("t"), "s"), t="a").startswith("client-")
    assert one(spark, redact.pseudonym(F.lit(None).cast("string"), "s"), t="a") is None
