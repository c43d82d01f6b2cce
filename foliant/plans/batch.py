"""One run over intake batches: classify, resolve clients, group into events, flag, plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import names
from ..kb import KnowledgeBase, Profile
from ..operators import classify, events, flags, keys, plan, register
from ..shared import written


@dataclass
class Result:
    """Lazy frames; all are keyed by (batch_id, doc_ord)."""

    records: DataFrame
    events: DataFrame
    attachments: DataFrame
    flags: DataFrame
    plan: DataFrame
    batch_clients: DataFrame
    new_clients: DataFrame | None = None
    kb: KnowledgeBase | None = None
    profile: Profile | None = None

    @property
    def unanchored(self) -> DataFrame:
        """Documents that no event took: batch_id, doc_ord, reason."""
        return self.attachments.filter("event IS NULL").select(*events.ROW, "reason")

    @property
    def missing_references(self) -> DataFrame:
        """Documents that cite an advice record which is not in their batch: batch_id, doc_ord, type, date."""
        cited = self.records.filter("cited IS NOT NULL").select(*events.ROW, F.col("cited.label").alias("type"), F.col("cited.value").alias("date"))
        return cited.join(self.unanchored, events.ROW, "left_semi")

    @property
    def flagged(self) -> DataFrame:
        """Records with a flag of any kind."""
        return self.records.join(self.flags, events.ROW, "left_semi")

    @property
    def needing_review(self) -> DataFrame:
        """Records that a placement flag holds back."""
        return self.records.join(self.flags.filter("class = 'placement'"), events.ROW, "left_semi")


def resolve(records: DataFrame) -> DataFrame:
    """Narrower family keys become the one wider key that holds them; keys are parted at hyphens."""
    parts = records.select("batch_id", "family_key", F.split("family_key", "-").alias("parts")).filter("family_key IS NOT NULL")
    merged = keys.merge(parts, "family_key", "parts", scope=["batch_id"]).select("batch_id", F.col("narrow").alias("family_key"), "wide")
    out = records.join(merged, ["batch_id", "family_key"], "left")
    why = F.concat(F.lit("read as "), F.col("family_key"), F.lit(", merged into "), F.col("wide"), F.lit(" (one household, several surnames)"))
    if "client_provenance" in records.columns:
        out = out.withColumn("client_provenance", F.when(F.col("wide").isNotNull(), why).otherwise(F.col("client_provenance")))
    return out.withColumn("family_key", F.coalesce("wide", "family_key")).drop("wide").select(*records.columns)


def match_register(records: DataFrame, entries: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """``entries``: folder_name, surnames, given.  A match gives the record its folder's name as family key."""
    t = kb.matching
    asked = records.filter(F.col("family_key").isNotNull() & F.col("client_specific"))
    people = asked.select(F.struct("batch_id", "doc_ord").alias("k"), names.plain_all("surnames").alias("surnames"), names.plain_all("given").alias("given"))
    reg = entries.select("folder_name", names.plain_all("surnames").alias("surnames"), names.plain_all("given").alias("given"))
    got = register.match(people, reg, "k", t["match"], t["ambiguous_margin"], t["propose_new_below"]).select("k.batch_id", "k.doc_ord", F.col("verdict").alias("match_verdict"), F.col("folder_name").alias("match_folder"), F.col("score").alias("match_score"), F.col("runners").alias("match_runners"), F.col("reason").alias("match_reason"))
    out, matched = records.join(got, ["batch_id", "doc_ord"], "left"), F.col("match_verdict") == "matched"
    out = out.withColumn("client_provenance", F.when(matched, F.concat(F.lit("matched to the existing client "), F.col("match_reason"))).otherwise(F.col("client_provenance")))
    return out.withColumn("family_key", F.when(matched, F.col("match_folder")).otherwise(F.col("family_key")))


def new_clients(records: DataFrame) -> DataFrame:
    """(batch_id, family_key, surnames, given, confirm): of each client that the register does not know, its first document's names; to be confirmed."""
    unknown = records.filter("match_verdict IN ('new', 'uncertain')").groupBy("batch_id", "family_key").agg(F.min(F.struct("doc_ord", "surnames", "given")).alias("x"))
    return unknown.select("batch_id", "family_key", "x.surnames", "x.given", F.lit(False).alias("confirm"))


def batch_client(records: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """(batch_id, batch_client): the client of a batch that names exactly one."""
    sure = records.filter(F.col("client_specific") & events.confident(records, kb) & F.col("family_key").isNotNull())
    return sure.groupBy("batch_id").agg(F.when(F.min("family_key") == F.max("family_key"), F.min("family_key")).alias("batch_client"))


def decide(records: DataFrame, kb: KnowledgeBase, materialise=lambda frame, name: frame, clients: DataFrame | None = None, rules: Sequence[str] = flags.RULES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, attachments, flags) of enriched records; of the flags those that are asked for."""
    found, attached = events.group(records, kb)
    found, attached = materialise(found, "events"), materialise(attached, "attachments")
    return found, attached, materialise(flags.raise_all(records, found, attached, kb, materialise, clients, rules), "flags")


def place(records: DataFrame, kb: KnowledgeBase, profile: Profile, materialise=lambda frame, name: frame) -> Result:
    """From enriched records to the plan."""
    clients = batch_client(records, kb)
    found, attached, raised = decide(records, kb, materialise, clients)
    new = new_clients(records) if "match_verdict" in records.columns else None
    return Result(records, found, attached, raised, plan.placements(records, found, attached, raised, clients, kb, profile), clients, new, kb, profile)


def run(documents: DataFrame, kb: KnowledgeBase | None = None, profile: Profile | None = None, entries: DataFrame | None = None, materialise=written, classifier: classify.Classifier | None = None) -> Result:
    """``documents``: batch_id, doc_ord, name, text, page_count (and path, source, backend, where they are known).

    ``materialise`` (frame, name) cuts the lineage of what later steps read again: a written table, which also keeps their
    plans small.  The texts end here: records carry what later steps ask of them."""
    kb = kb or KnowledgeBase.load()
    return settle(classify.enrich(documents, kb, classifier).drop("text"), kb, profile, entries, materialise)


def settle(enriched: DataFrame, kb: KnowledgeBase | None = None, profile: Profile | None = None, entries: DataFrame | None = None, materialise=written) -> Result:
    """The run from enriched records (classify.enrich, without texts) on: all that a batch's documents decide together."""
    kb, profile = kb or KnowledgeBase.load(), profile or Profile.load()
    records = materialise(resolve(enriched), "records")
    if entries is not None:
        records = materialise(match_register(records, entries, kb), "matched-records")
    return place(records, kb, profile, materialise)
