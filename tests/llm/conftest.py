import random

import pytest

WORDS = "the of and inthe eronth ablere tion a to was on at by straße été niño 漢字 x1 don't".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, shared passages, odd texts, null ids and texts, and repeated rows."""
    r = random.Random(4)
    base = [prose(r, 120) for _ in range(12)]
    shared = prose(r, 70)
    out = [(k, t) for k, t in enumerate(base)]
    for k in range(12, 60):
        t = r.choice(base)
        if k % 3 == 0:
            at = r.randrange(len(t))
            t = t[:at] + " changed " + t[at:]
        if k % 4 == 0:
            t = prose(r, 30) + "\n" + shared + "\n" + t
        out.append((k, t))
    out += [(60, ""), (61, None), (62, "   \n\t "), (63, "one"), (64, "a" * 700), (65, "ab" * 400), (66, "漢" * 300), (67, "a b"), (68, "\x00\x0b ▁x   é😀"), (None, base[0]), (None, None), (5, base[5]), (5, base[6]), (70, prose(r, 4000)), (71, "!?#$%&|<>*" * 30)]
    return out


#: Columns that operators use inside, or return.
EXTRA = "stay_id stay_h fp component_id h key whole ids score n_words n_hit items ranges spans cell hs qs own home root node a b least kept start lo hi core edges place16 canonical_sha256 license notices page_id"


@pytest.fixture(scope="session")
def documents(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    from pyspark.sql import functions as F

    return frame.withColumns({c: F.lit("clash") for c in EXTRA.split()}).withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
