"""Advice events: anchors, and what attaches to them by citation, date or product."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..kb import KnowledgeBase
from . import asof, keys

ROW = ["batch_id", "doc_ord"]
#: Days with events of a client up to which its documents meet all of them at once; a busier client's are sorted.
FEW = 64


def confident(records: DataFrame, kb: KnowledgeBase) -> Column:
    """Whether a record passes the threshold: its own, where records carry one (calibration), or the knowledge base's."""
    return F.col("confidence") >= (F.col("threshold") if "threshold" in records.columns else F.lit(kb.threshold))


def anchors(records: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """An event for each usable advice record: batch_id, event (the record's doc_ord), family_key, event_date, subject, ..."""
    usable = records.filter(F.col("advice_record") & confident(records, kb) & F.col("family_key").isNotNull() & F.col("own_date").isNotNull())
    return usable.select("batch_id", F.col("doc_ord").alias("event"), "family_key", F.col("own_date").alias("event_date"), "subject", F.col("sub_kind.label").alias("sub_kind_label"), F.col("abbrev").alias("record_label"), F.col("doc_type").alias("anchor_type"), F.col("risks_named").alias("anchor_risks"), "products", "confidence")


def ordered(events: DataFrame) -> DataFrame:
    """Events by client, then date, then the anchor's place."""
    return events.orderBy("batch_id", "family_key", F.col("event_date").asc_nulls_first(), "event")


def inside(records: DataFrame, attached: DataFrame, events: DataFrame) -> DataFrame:
    """The records that are in an event, with its columns."""
    members = records.join(attached.filter("event IS NOT NULL").select(*ROW, "event"), ROW)
    return members.join(events.select("batch_id", "event", "event_date", "anchor_type", "anchor_risks"), ["batch_id", "event"])


def refused(records: DataFrame, attached: DataFrame) -> DataFrame:
    """The records that no event took, with the reason."""
    return records.join(attached.filter("event IS NULL").select(*ROW, "reason"), ROW)


def cite(records: DataFrame, events: DataFrame) -> DataFrame:
    """Records (batch_id, family_key, cited_date, ...) with ``event``: the first one of their client on the cited date, or null."""
    days = events.groupBy("batch_id", "family_key", F.col("event_date").alias("cited_date")).agg(F.min("event").alias("event"))
    return records.join(days, ["batch_id", "family_key", "cited_date"], "left")


def _refuse(frame: DataFrame, why: Column) -> DataFrame:
    return frame.select(*ROW, F.lit(None).cast("long").alias("event"), why.alias("reason"), F.lit(None).cast("double").alias("attach_confidence"))


def _by_product(records: DataFrame, events: DataFrame) -> DataFrame:
    linked = keys.best_overlap(records.select(*ROW, "products"), events.select("batch_id", "event", "event_date", "products"), "doc_ord", "event", "products", order=["event_date", "event"], scope=["batch_id"])
    why = F.when(F.col("tied") > 1, "names a product of several advice records; filed at the earliest").otherwise("names a product this event's advice record recommends")
    return linked.select(*ROW, "event", why.alias("reason"), F.when(F.col("tied") > 1, 0.6).otherwise(0.85).alias("attach_confidence"))


def _by_citation(records: DataFrame, events: DataFrame) -> DataFrame:
    cited = cite(records.withColumn("cited_date", F.col("cited.value")), events)
    what = F.concat(F.col("cited.label"), F.lit(" dated "), F.col("cited_date").cast("string"))
    why = F.when(F.col("event").isNotNull(), F.concat(F.lit("explicitly cites the "), what)).otherwise(F.concat(F.lit("cites a "), what, F.lit("; no such advice record in this batch")))
    return cited.select(*ROW, "event", why.alias("reason"), F.when(F.col("event").isNotNull(), 0.95).alias("attach_confidence"))


def _by_date(records: DataFrame, events: DataFrame, direction: str, kb: KnowledgeBase) -> DataFrame:
    got = asof.attach(records.select(*ROW, "family_key", "own_date"), events.select("batch_id", "family_key", "event", "event_date"), ["batch_id", "family_key"], "own_date", "event_date", "event", direction, kb.max_gap_days, few=FEW)
    days = F.concat(F.col("gap_days").cast("string"), F.lit(" days"))
    why = (
        F.when(F.col("status") == "ok", F.concat(F.lit("nearest advice event, "), days, F.lit(" away"), F.when(F.col("reversed"), F.lit("; this reverses the expected order")).otherwise("")))
        .when(F.col("status") == "tie", "two advice events on the nearest date fit equally well")
        .when(F.col("status") == "far", F.concat(F.lit("nearest advice event is "), days, F.lit(f" away, beyond the {kb.max_gap_days}-day limit")))
        .otherwise("no dated advice event to attach to")
    )
    return got.select(*ROW, F.col("event_key").alias("event"), why.alias("reason"), F.col("confidence").alias("attach_confidence"))


def group(records: DataFrame, kb: KnowledgeBase) -> tuple[DataFrame, DataFrame]:
    """(events, attachments): attachments has a row for each document that is in an event or was refused one.

    attachments: batch_id, doc_ord, event (null if refused), reason, attach_confidence."""
    events = anchors(records, kb)
    own = events.select("batch_id", F.col("event").alias("doc_ord"), "event", F.lit("anchors this event").alias("reason"), F.col("confidence").alias("attach_confidence"))
    rest = records.filter(F.col("doc_type").isNotNull() & confident(records, kb) & ~F.col("advice_record"))
    directions = {d: [t["category"] for t in kb.types if kb.direction(t["category"]) == d] for d in ("forward", "backward", "product_link")}
    of = lambda d: F.col("category").isin(directions[d] or [""])
    personal = rest.filter(~of("product_link") & F.col("client_specific"))
    families = events.select("batch_id", "family_key", F.lit(True).alias("on_file")).distinct()
    placed = personal.join(families, ["batch_id", "family_key"], "left")
    known = placed.filter("on_file")
    dated = known.filter("cited IS NULL AND own_date IS NOT NULL")
    return events, reduce(DataFrame.unionByName, [
        own,
        _by_product(rest.filter(of("product_link")), events),
        _refuse(placed.filter("family_key IS NULL"), F.lit("no client identified")),
        _refuse(placed.filter("family_key IS NOT NULL AND on_file IS NULL"), F.concat(F.lit("client "), F.col("family_key"), F.lit(" has no advice event on file"))),
        _by_citation(known.filter("cited IS NOT NULL"), events),
        _refuse(known.filter("cited IS NULL AND own_date IS NULL"), F.lit("no date, so cannot be sequenced")),
        *[_by_date(dated.filter(of(d)), events, d, kb) for d in ("forward", "backward")],
    ])
