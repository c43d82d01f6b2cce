"""Review and compliance rules: a long table of findings; rules that read others' findings come after them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..kb import KnowledgeBase
from . import events as E
from .events import ROW
from .rank import copies

RULES = ("unknown_type", "low_confidence", "multi_doc_bundle", "advice_record_label_shift", "no_date", "client_unidentified", "client_ambiguous_match", "new_client_proposed", "atp_without_advice_record", "event_ambiguous", "roa_without_soa", "fact_find_after_soa", "risk_mismatch", "fds_era_mismatch", "superseding_ambiguity")
SEVERITIES = ("high", "medium", "low")


def _raise(kb: KnowledgeBase, frame: DataFrame, rule_id: str, message: Column) -> DataFrame:
    rule = kb.rule(rule_id)
    return frame.select(*ROW, F.lit(rule_id).alias("rule_id"), F.lit(rule["severity"]).alias("severity"), F.lit(rule["class"]).alias("class"), message.alias("message"))


def _two(x: Column) -> Column:
    return F.format_string("%.2f", x)


def row_rules(records: DataFrame, kb: KnowledgeBase, batch_clients: DataFrame | None = None, rules: Sequence[str] = RULES) -> DataFrame:
    """Those of ``rules`` that need the document alone (and its batch's client, for a message), raised in one pass."""
    scores = F.map_from_entries(F.transform("scores", lambda s: F.struct(s.type, s.score)))
    t, abbrev = F.col("doc_type"), F.coalesce(F.col("abbrev"), F.col("doc_type"))
    advice = kb.ids("advice_record")
    top, run = F.try_element_at(scores, t), F.try_element_at(scores, F.col("runner_up"))
    short = F.create_map(*[F.lit(y) for x in kb.types for y in (x["id"], x["abbrev"])])
    named = lambda c: F.coalesce(F.try_element_at(short, c), c)
    if batch_clients is not None:
        records = records.join(batch_clients, "batch_id", "left")
        whose = F.when(F.col("batch_client").isNotNull(), F.concat(F.lit("every other document in this batch is "), F.col("batch_client"))).otherwise("and the intake batch does not resolve to a single client")
    else:
        whose = F.lit("and the intake batch does not resolve to a single client")
    limit = F.col("threshold") if "threshold" in records.columns else F.lit(kb.threshold)
    tests = {
        "unknown_type": (t.isNull(), F.concat(F.lit("no type has enough evidence"), F.when(F.size("quality.reasons") > 0, F.concat(F.lit("; extraction quality "), _two(F.col("quality.score")), F.lit(": "), F.array_join("quality.reasons", "; "))).otherwise(""))),
        "low_confidence": (t.isNotNull() & ~E.confident(records, kb), F.concat(F.lit("best guess "), abbrev, F.lit(" at "), _two(F.col("confidence")), F.lit(", below "), _two(limit), F.when(F.col("capped"), "; capped by extraction quality").otherwise(""), F.when(F.col("runner_up").isNotNull(), F.concat(F.lit("; runner-up "), named(F.col("runner_up")))).otherwise(""))),
        "multi_doc_bundle": (F.size("title_types") >= 2, F.concat(F.lit("wears the titles of "), F.array_join(F.transform("title_types", named), ", "))),
        "advice_record_label_shift": (t.isin(advice or [""]) & F.col("runner_up").isin(advice or [""]) & (top > 0) & (run >= 0.7 * top), F.concat(F.lit("could also be "), named(F.col("runner_up")))),
        "no_date": (F.col("requires_date") & F.col("own_date").isNull(), F.concat(abbrev, F.lit(" without a date: "), F.col("date_provenance"))),
        "client_unidentified": (t.isNotNull() & F.col("client_specific") & F.col("family_key").isNull(), F.concat(abbrev, F.lit(" without a client's name; "), whose)),
    }
    if "match_verdict" in records.columns:
        tests["client_ambiguous_match"] = (F.col("match_verdict") == "ambiguous", F.col("match_reason"))
        tests["new_client_proposed"] = (F.col("match_verdict").isin("new", "uncertain"), F.col("match_reason"))
    each = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(name).alias("rule_id"), F.lit(kb.rule(name)["severity"]).alias("severity"), F.lit(kb.rule(name)["class"]).alias("class"), F.coalesce(why, F.lit("")).alias("message"))) for name, (bad, why) in tests.items() if name in rules])
    if not any(name in rules for name in tests):
        return _none(records)
    return records.select(*ROW, F.explode(F.filter(each, lambda f: f.isNotNull())).alias("f")).select(*ROW, "f.*")


def era_mismatch(records: DataFrame, boundary: str) -> DataFrame:
    """Ongoing-service records with wording of the other fee regime alone, and ``finding``: old wording or new wording."""
    late = F.col("own_date") >= F.lit(boundary).cast("date")
    old, new = late & F.col("era_pre") & ~F.col("era_post"), ~late & F.col("era_post") & ~F.col("era_pre")
    return records.filter((F.col("category") == "ongoing_service") & F.col("own_date").isNotNull() & (old | new)).withColumn("finding", F.when(late, "old wording").otherwise("new wording"))


def without_prior(records: DataFrame, events: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """Dependent advice records (roa) whose client has no earlier full record: that some earlier one exists is that the earliest is not later."""
    first = events.filter("anchor_type <> 'roa'").groupBy("batch_id", "family_key").agg(F.min("event_date").alias("first"))
    dependent = records.filter((F.col("doc_type") == "roa") & E.confident(records, kb) & (F.col("sub_kind").isNull() | F.col("sub_kind.prior"))).join(first, ["batch_id", "family_key"], "left")
    return dependent.filter("first IS NULL OR first > own_date")


def after_anchor(inside: DataFrame) -> DataFrame:
    """Inputs dated after the advice they feed, with ``gap_days``."""
    return inside.filter("category = 'input' AND own_date > event_date").withColumn("gap_days", F.datediff("own_date", "event_date"))


def risk_unnamed(inside: DataFrame, named: Column) -> DataFrame:
    """Risk profiles in an event whose advice never names their category."""
    return inside.filter((F.col("doc_type") == "risk_profile") & F.col("risk_category").isNotNull() & ~named)


def ambiguous(refused: DataFrame) -> DataFrame:
    """Refused records other than authorities, unless a missing client or date says why already."""
    said = (F.col("client_specific") & F.col("family_key").isNull()) | (F.col("requires_date") & F.col("own_date").isNull())
    return refused.filter((F.coalesce("category", F.lit("")) != "implementation") & ~said)


def _none(records: DataFrame) -> DataFrame:
    """No flags."""
    return records.filter("false").select(*ROW, *[F.lit("").alias(c) for c in ("rule_id", "severity", "class", "message")])


def event_rules(records: DataFrame, events: DataFrame, attached: DataFrame, kb: KnowledgeBase, rules: Sequence[str] = RULES) -> DataFrame:
    """Those of ``rules`` that need the events."""
    refused, inside = E.refused(records, attached), E.inside(records, attached, events)
    day = lambda c: F.col(c).cast("string")
    tests = [
        (refused.filter("category = 'implementation'"), "atp_without_advice_record", F.concat(F.lit("authorises advice that is not in this batch: "), F.col("reason"))),
        (ambiguous(refused), "event_ambiguous", F.concat(F.lit("cannot be attached to exactly one advice event: "), F.col("reason"))),
        (without_prior(records, events, kb), "roa_without_soa", F.when(F.col("sub_kind").isNull(), "no earlier full advice record on file, and the text does not say which kind this is").otherwise(F.concat(F.col("sub_kind.label"), F.lit(" depends on an earlier full advice record, and none is on file")))),
        (after_anchor(inside), "fact_find_after_soa", F.concat(F.lit("dated "), day("own_date"), F.lit(", "), F.col("gap_days").cast("string"), F.lit(" days after the advice it feeds ("), day("event_date"), F.lit(")"))),
        (risk_unnamed(inside, F.array_contains("anchor_risks", F.col("risk_category"))), "risk_mismatch", F.concat(F.lit("assessed as "), F.col("risk_category"), F.lit(", which the advice never names"))),
    ]
    if kb.era_boundary:
        tests.append((era_mismatch(records, kb.era_boundary), "fds_era_mismatch", F.concat(F.col("finding"), F.lit(" of the fee regime for its date, "), day("own_date"))))
    out = [_raise(kb, *test) for test in tests if test[1] in rules]
    return reduce(DataFrame.unionByName, out) if out else _none(records)


def superseding(records: DataFrame, attached: DataFrame, events: DataFrame, raised: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """Of documents that no placement rule holds back: several of one client, type, subject and date.  Unknown clients are one client here, and undated is a date."""
    held = raised.filter("class = 'placement'").select(*ROW).distinct()
    free = records.join(held, ROW, "left_anti").filter("doc_type IS NOT NULL").join(attached.select(*ROW, "event"), ROW, "left").join(events.select("batch_id", "event", F.col("subject.id").alias("subject_id")), ["batch_id", "event"], "left")
    place = ["batch_id", "family_key", "doc_type", "subject_id", "own_date"]
    many = copies(free.select(*dict.fromkeys([*ROW, *place])), place).filter("copies > 1")
    what = F.concat(F.col("copies").cast("string"), F.lit(" documents of this kind for "), F.coalesce("family_key", F.lit("an unidentified client")), F.coalesce(F.concat(F.lit(", dated "), F.col("own_date").cast("string")), F.lit(", undated")), F.lit("; which is current cannot be told"))
    return _raise(kb, many, "superseding_ambiguity", what)


def raise_all(records: DataFrame, events: DataFrame, attached: DataFrame, kb: KnowledgeBase, materialise=lambda frame, name: frame, batch_clients: DataFrame | None = None, rules: Sequence[str] = RULES) -> DataFrame:
    first = row_rules(records, kb, batch_clients, rules).unionByName(event_rules(records, events, attached, kb, rules))
    if "superseding_ambiguity" not in rules:
        return first
    first = materialise(first, "first-flags")
    return first.unionByName(superseding(records, attached, events, first, kb))


def ranked(flags: DataFrame) -> DataFrame:
    """Flags, the gravest first, placement before compliance, then by document."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")), F.lit(0))
    return flags.withColumn("_s", F.when(rank == 0, len(SEVERITIES) + 1).otherwise(rank)).orderBy("_s", F.col("class") != "placement", *ROW, "rule_id").drop("_s")


def coverage(kb: KnowledgeBase, implemented: list[str] = RULES) -> dict[str, str]:
    """State of each rule: implemented, missing (in the knowledge base alone) or orphaned (here alone)."""
    return {r: _state(r in kb.rules, r in implemented) for r in sorted({*kb.rules, *implemented})}


def _state(known, found) -> str:
    return "implemented" if known and found else "missing" if known else "orphaned"


def states(known: DataFrame, found: DataFrame) -> DataFrame:
    """(rule_id, state): the same for rule ids in frames."""
    a, b = known.select(F.col("rule_id").alias("_a")).distinct(), found.select(F.col("rule_id").alias("_b")).distinct()
    state = F.when(F.col("_b").isNull(), _state(True, False)).when(F.col("_a").isNull(), _state(False, True)).otherwise(_state(True, True))
    return a.join(b, F.col("_a") == F.col("_b"), "full").select(F.coalesce("_a", "_b").alias("rule_id"), state.alias("state"))
