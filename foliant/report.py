"""Plain-text views of a run: for eyes, not for programs."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from . import sinks
from .kb import KnowledgeBase
from .operators import evaluate, events, flags
from .operators.events import ROW
from .plans.batch import Result

EXPECTED = ("fact_find", "risk_profile", "authority_to_proceed")
#: Rows of a listing that are shown at most.
SHOWN = 40


def tree(result: Result) -> DataFrame:
    """(folder, files): the proposed tree, special folders last."""
    folder = F.concat_ws("/", "folder")
    return result.plan.groupBy("batch_id", folder.alias("folder")).agg(F.array_sort(F.collect_list("filename")).alias("files")).orderBy("batch_id", F.col("folder").rlike("(^|/)_"), "folder")


def totals(files: DataFrame) -> DataFrame:
    """(batch_id, at, depth, n_files, n_review, n_findings) of every folder and all its ancestors; the root's ``at`` is empty.

    ``files``: batch_id, folder (array), needs_review, n_findings.  Folders are summed first, and their sums then once for
    each folder that they lie in, so that the root counts folders, not files."""
    n = lambda c: F.sum(c).cast("long")
    own = files.groupBy("batch_id", "folder").agg(F.count("*").alias("n_files"), n(F.col("needs_review").cast("long")).alias("n_review"), n("n_findings").alias("n_findings"))
    above = F.transform(F.sequence(F.lit(0), F.size("folder")), lambda k: F.slice("folder", F.lit(1), k))
    return own.select("batch_id", F.explode(above).alias("at"), "n_files", "n_review", "n_findings").groupBy("batch_id", "at").agg(F.size("at").alias("depth"), *[n(c).alias(c) for c in ("n_files", "n_review", "n_findings")])


def tree_totals(result: Result) -> DataFrame:
    """``totals`` of the proposed tree, in the order of a nested listing: special folders last among their like."""
    raised = result.flags.groupBy(*ROW).agg(F.count("*").alias("n_findings"))
    files = result.plan.join(raised, ROW, "left").select("batch_id", "folder", "needs_review", F.coalesce("n_findings", F.lit(0)).alias("n_findings"))
    place = F.transform("at", lambda x: F.struct(x.startswith("_").alias("special"), x.alias("name")))
    return totals(files).orderBy("batch_id", place)


def findings(result: Result) -> DataFrame:
    """Flags with the documents' names, the gravest first, placement before compliance."""
    return flags.ranked(result.flags.join(result.plan.select(*ROW, "name"), ROW))


def completeness(result: Result) -> DataFrame:
    """Of each event, which of the usual document types are missing: a prompt for a reviewer, not a finding."""
    members = result.attachments.filter("event IS NOT NULL").join(result.records.select(*ROW, "doc_type"), ROW).groupBy("batch_id", "event").agg(F.collect_set("doc_type").alias("types"))
    return events.ordered(result.events).join(members, ["batch_id", "event"], "left").select("batch_id", "event", "family_key", "event_date", F.array_except(F.array(*map(F.lit, EXPECTED)), F.coalesce("types", F.array().cast("array<string>"))).alias("missing"))


def summary(plan: DataFrame) -> DataFrame:
    """One row: documents, those filed in an event, those for review, and the kinds of places there are."""
    n = lambda test: F.coalesce(F.sum(test.cast("long")), F.lit(0))
    return plan.agg(F.count("*").alias("n_documents"), n(F.col("kind").startswith("event")).alias("n_filed"), n(F.col("kind").startswith("review")).alias("n_review"), F.countDistinct("kind").alias("n_kinds"))


def states(docs: DataFrame) -> DataFrame:
    """Rows of sinks.documents with ``state`` (bad: needs review, warn: has findings, ok) and a short line about it."""
    n = F.size("flags")
    state = F.when(F.col("needs_review"), "bad").when(n > 0, "warn").otherwise("ok")
    line = F.when(F.col("needs_review"), "needs review").when(n == 1, "1 finding").when(n > 1, F.concat(n.cast("string"), F.lit(" findings"))).otherwise(F.coalesce(F.col("own_date").cast("string"), F.lit("")))
    return docs.withColumn("state", state).withColumn("line", line)


def coverage(kb: KnowledgeBase) -> dict[str, str]:
    return flags.coverage(kb)


def teaching(kb: KnowledgeBase, doc_type: str) -> list[str]:
    """What the knowledge base says about a type: what it is, why it exists, where it belongs, the law."""
    entry = next((d for d in kb.data["documents"] if d["id"] == doc_type), {})
    told = entry.get("teaching", {})
    stage = next((s for s in kb.data.get("advice_process_stages", []) if doc_type in s.get("typical_docs", [])), None)
    lines = [("what", told.get("what_it_is")), ("why", told.get("why_it_exists")), ("where", stage and f"stage {stage['stage']}, {stage['name']}"), ("law", entry.get("legislation", {}).get("primary")), ("note", told.get("two_weeks_in_note"))]
    return [f"{k}: {v}" for k, v in lines if v]


def vocabulary(kb: KnowledgeBase) -> list[str]:
    """Words that redaction may leave: those of the knowledge base's closed sets."""
    words: set[str] = set()
    for t in kb.types:
        words |= {t["id"], t["abbrev"], *t["name"].split(), *(t["category"] or "").split("_")}
    for s in kb.subjects:
        words |= set(s["label"].replace("&", " ").split())
    for folder in kb.data.get("filing_model", {}).get("special_folders", {}).values():
        words |= set(str(folder).replace("_", " ").split())
    for r in kb.rules.values():
        words |= set(f"{r['trigger']} {r['why']}".split())
    return sorted(w.strip(".,;") for w in words if w.strip(".,;"))


def text(result: Result, new_to_industry: bool = False) -> Iterator[str]:
    """A run as lines: scorecard, events, tree, flags, rule coverage.  Rows come one by one."""
    kb = result.kb
    yield f"knowledge base {kb.data['meta']['version']}, threshold {kb.threshold:.2f}, evidence floor {kb.floor:.1f}"
    for r in result.batch_clients.orderBy("batch_id").limit(SHOWN).toLocalIterator():
        yield f"batch {r.batch_id}: " + (f"one client, {r.batch_client}" if r.batch_client else "several clients or none; nothing inherits one")
    yield "\nDOCUMENTS"
    rows = result.records.join(result.plan.select(*ROW, "needs_review"), ROW).select(*ROW, "name", "abbrev", "doc_type", "confidence", "family_key", "needs_review", "quality").orderBy(*ROW)
    for r in rows.toLocalIterator():
        yield f"[{'review' if r.needs_review else '  ok  '}] {r.name} {r.abbrev or 'UNKNOWN'} {r.confidence:.2f} {r.family_key or '-'}"
        if r.quality.score < 1:
            yield f"    extraction quality {r.quality.score:.2f}: {'; '.join(r.quality.reasons)}"
        if new_to_industry and r.doc_type:
            yield from (f"    {line}" for line in teaching(kb, r.doc_type))
    yield "\nEVENTS"
    for r in completeness(result).orderBy("batch_id", "family_key", "event_date").toLocalIterator():
        yield f"{r.family_key}, {r.event_date}" + (f"; missing: {', '.join(r.missing)}" if r.missing else "")
    yield "\nPROPOSED TREE (nothing has been moved)"
    named = result.plan.groupBy("batch_id", F.col("folder").alias("at")).agg(F.array_sort(F.collect_list("filename")).alias("files"))
    place = F.transform("at", lambda x: F.struct(x.startswith("_").alias("special"), x.alias("name")))
    for r in tree_totals(result).join(named, ["batch_id", "at"], "left").orderBy("batch_id", place).toLocalIterator():
        more = "".join(f", {n} {what}" for n, what in ((r.n_review, "for review"), (r.n_findings, "findings")) if n)
        yield "    " * r.depth + f"{r['at'][-1] if r['at'] else r.batch_id}/ ({r.n_files} files{more})"
        yield from ("    " * (r.depth + 1) + name for name in r.files or [])
    yield "\nFLAGS"
    for r in findings(result).toLocalIterator():
        yield f"{r.severity:<6} {r.rule_id} {r.name}, {'blocks filing' if r['class'] == 'placement' else 'files anyway'}: {r.message}"
    yield "\nRULES"
    yield ", ".join(f"{k} {v}" for k, v in coverage(kb).items() if v != "implemented") or "all implemented"


def calibration(rows: DataFrame) -> Iterator[str]:
    """The table of a calibration, and what it recommends."""
    yield "threshold  types  events  filed  precision  review  wrong"
    for r in rows.orderBy("step").toLocalIterator():
        yield f"{r.threshold:9.2f}  {r.type_accuracy:5.0%}  {r.event_accuracy:6.0%}  {r.n_filed:5d}  " + (f"{r.precision:9.0%}" if r.precision is not None else "        -") + f"  {r.n_review:6d}  {r.n_wrong:5d}"
    best = evaluate.recommend(rows).first()
    yield f"recommended: {'none' if best.step is None else best.step / evaluate.STEPS} ({best.reason})"


def profiles(result_of, names: list[str]) -> dict[str, DataFrame]:
    """A manifest for each filing profile, without anything about the machine: ``result_of`` (profile name) runs a batch."""
    out = {}
    for name in names:
        m = sinks.manifest(result_of(name))
        out[name] = m.withColumn("documents", F.transform("documents", lambda d: d.withField("source_path", F.lit(None).cast("string")))).withColumn("batch", F.col("batch").dropFields("unreadable")).withColumn("generated", F.lit(None).cast("string"))
    return out
