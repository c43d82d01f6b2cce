"""How placements meet their events, and how paths are made safe."""

import random
import re

from pyspark.sql import functions as F

from foliant.kb import Profile
from foliant.operators import plan


def test_documents_without_an_event_are_dealt_by_their_row(spark, monkeypatch):
    """The join with the events is that of the attachments; no exchange of all documents by the event, which most have none of."""
    from foliant.plans import bindings

    plans, written = [], plan.written
    monkeypatch.setattr(plan, "written", lambda frame, what: plans.append(frame._jdf.queryExecution().optimizedPlan().toString()) or written(frame, what))
    bindings.QUERIES["q47_placements"](spark, "/root/testdata/sf0.001")
    tree = plans[0].splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    by_event = [k for k, line in enumerate(tree) if re.search(r"Join LeftOuter, .*event#\d+L? = event#\d+L?", line)]
    assert len(by_event) == 1
    under = []
    for line in tree[by_event[0] + 1 :]:
        if depth(line) <= depth(tree[by_event[0]]):
            break
        under.append(line)
    assert not any("Join" in line for line in under)


def test_safe_fragments_are_as_by_every_replacement(spark):
    r = random.Random(3)
    some = ["a", "é", " ", "  ", ".", "<", ":", "\t", "\n", "\u0085", " ", " ", "—", "x" * 30]
    values = ["", None, "C1", "2024-01 — Advice [SOA]", ".", " a ", *("".join(r.choice(some) for _ in range(r.randint(1, 9))) for _ in range(1500))]
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    profile = Profile.load()
    want = F.regexp_replace("v", rf"[{plan._class(profile.illegal)}\x00-\x1F]", " ")
    want = F.regexp_replace(F.regexp_replace(want, r"\s+", " "), r"^[ .]+|[ .]+$", "")
    want = F.regexp_replace(F.substring(want, 1, 25), r"[ .]+$", "")
    want = F.coalesce(F.nullif(want, F.lit("")), F.lit("unnamed"))
    for row in frame.select("v", plan.clean(F.col("v"), profile, 25).alias("a"), want.alias("b")).collect():
        assert row.a == row.b, row.v
