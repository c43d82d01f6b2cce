"""The filing plan: a place and a name for every document, and what stands against it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..kb import KnowledgeBase, Profile
from ..shared import written
from .events import ROW
from .rank import copies, numbered

_FORMATS = {"%Y": "yyyy", "%m": "MM", "%d": "dd"}
#: What stands in for a missing token.
MISSING = {"client": "Unknown client", "date": "undated", "event_date": "undated", "type_label": "Document", "type_id": "document", "category": "other", "original": "document", "subject": "Advice", "record_label": "ADVICE"}


def _class(chars: str) -> str:
    """The characters as the inside of a regular expression's class."""
    return "".join("\\" + c for c in chars)


def clean(value: Column, profile: Profile, limit: int | None = None) -> Column:
    """A safe path fragment.  Most are safe as they are, which one look tells; only the others are put through the replacements."""
    x, most = value, limit or profile.max_name_chars
    if profile.charset == "ascii":
        x = F.regexp_replace(F.translate(x, "—–·’áàâäãåéèêëíìîïóòôöõøúùûüñçÁÀÂÄÉÈÊËÍÓÖØÚÜÑÇ", "--.'aaaaaaeeeeiiiioooooouuuuncAAAAEEEEIOOOUUNC"), r"[^\x20-\x7E]", "")
    fine = (F.length(x) > 0) & (F.length(x) <= most) & ~F.rlike(x, F.lit(rf"[{_class(profile.illegal)}\x00-\x1F]|  |^[ .]|[ .]$"))
    y = F.regexp_replace(x, rf"[{_class(profile.illegal)}\x00-\x1F]", " ")
    y = F.regexp_replace(F.regexp_replace(y, r"\s+", " "), r"^[ .]+|[ .]+$", "")
    y = F.regexp_replace(F.substring(y, 1, most), r"[ .]+$", "")
    return F.when(fine, x).otherwise(F.coalesce(F.nullif(y, F.lit("")), F.lit("unnamed")))


def render(template: str, profile: Profile) -> Column:
    parts = []
    for text, token, fmt in re.findall(r"([^{]*)(?:\{(\w+)(?::([^}]*))?\})?", template):
        if text:
            parts.append(F.lit(text))
        if token:
            value = F.col(f"_t_{token}")
            if fmt:
                java = "".join(_FORMATS.get(p, f"'{p}'") for p in re.findall(r"%[Ymd]|[^%]+", fmt))
                value = F.date_format(value, java)
            parts.append(F.coalesce(value.cast("string"), F.lit(MISSING.get(token, ""))))
    return clean(F.concat(*parts), profile)


def placement_kind(held: Column, event: Column, client_specific: Column, batch_client: Column, family_key: Column) -> Column:
    """Where a document belongs: review if a placement rule holds it back, its event, its client, or the licensee."""
    return (
        F.when(held.isNotNull(), F.when(family_key.isNotNull(), "review_with_client").otherwise("review_without_client"))
        .when(event.isNotNull(), "event_document")
        .when(~client_specific, F.when(batch_client.isNotNull(), "client_level_document").otherwise("licensee_document"))
        .when(family_key.isNotNull(), "client_level_document").otherwise("review_without_client")
    )


def placements(records: DataFrame, events: DataFrame, attached: DataFrame, flags: DataFrame, batch_clients: DataFrame, kb: KnowledgeBase, profile: Profile) -> DataFrame:
    """A row per document: kind, folder (array), filename, rationale, plan_confidence, family_key as filed."""
    held = flags.filter("class = 'placement'").groupBy(*ROW).agg(F.array_join(F.array_sort(F.collect_list("message")), "; ").alias("held"))
    where = attached.filter("event IS NOT NULL").select(*ROW, "event", F.col("reason"), "attach_confidence")
    ev = events.select("batch_id", "event", "event_date", F.col("subject.label").alias("subject_label"), "sub_kind_label", "record_label", F.col("family_key").alias("event_family"))
    # events are met before the records, so that documents without one are not all dealt to the task of the null event
    where = where.join(ev, ["batch_id", "event"], "left")
    x = records.join(held, ROW, "left").join(where, ROW, "left").join(batch_clients, "batch_id", "left")
    kind = placement_kind(F.col("held"), F.col("event"), F.col("client_specific"), F.col("batch_client"), F.col("family_key"))
    x = x.withColumn("kind", kind).withColumn("inherited", (F.col("kind") == "client_level_document") & ~F.col("client_specific"))
    x = x.withColumn("family_key", F.when(F.col("inherited"), F.coalesce("family_key", "batch_client")).when(F.col("kind") == "event_document", F.coalesce("family_key", "event_family")).otherwise(F.col("family_key")))
    labels = F.create_map(*[F.lit(y) for t in kb.types for y in (t["id"], profile.type_labels.get(t["id"], t["name"]))])
    tokens = {
        "client": F.col("family_key"), "date": F.col("own_date"), "event_date": F.col("event_date"), "type_label": F.try_element_at(labels, F.col("doc_type")), "type_id": F.col("doc_type"), "category": F.col("category"),
        "original": F.regexp_replace("name", r"\.[^./]*$", ""), "doc_id": F.col("doc_id"), "subject": F.col("subject_label"), "sub_kind": F.col("sub_kind_label"), "record_label": F.col("record_label"),
        "sub_kind_suffix": F.when(F.col("sub_kind_label").isNotNull(), F.concat(F.lit(" · "), F.col("sub_kind_label"))).otherwise(""),
    }
    y = x.withColumns({f"_t_{k}": v for k, v in tokens.items()})
    folder = F.array().cast("array<string>")
    for k, parts in profile.layout.items():
        folder = F.when(F.col("kind") == k, F.array(*[render(profile.folders[p], profile) for p in parts])).otherwise(folder)
    named = F.when(F.col("client_specific") & F.col("family_key").isNotNull(), render(profile.filename["client_document"], profile)).otherwise(render(profile.filename["licensee_document"], profile))
    if profile.filename.get("keep_original"):
        named = clean(F.concat(named, F.lit(" - "), F.col("_t_original")), profile)
    ext = F.lower(T.suffix(F.col("name")))
    y = y.withColumn("folder", folder).withColumn("filename", F.concat(named, ext))
    why = F.when(F.col("held").isNotNull(), F.col("held")).when(F.col("kind") == "event_document", F.col("reason")).when(F.col("inherited"), "not client-specific; assigned to the only client in this intake batch").when(F.col("kind") == "licensee_document", "licensee-wide document").when(F.col("kind") == "client_level_document", "tied to the client but not to any single advice event").otherwise("no client and no advice event")
    conf = F.when(F.col("kind") == "event_document", F.coalesce("attach_confidence", "confidence")).when(F.col("inherited"), 0.5).otherwise(F.col("confidence"))
    y = y.select(*ROW, "doc_id", "name", "kind", "folder", "filename", why.alias("rationale"), conf.alias("plan_confidence"), F.col("held").isNotNull().alias("needs_review"), "family_key", "event", F.lower(F.concat_ws("/", F.col("folder"), F.col("filename"))).alias("_p"))
    y = written(y, "plan")
    # only names that come more than once are numbered
    again = y.groupBy("batch_id", "_p").agg(F.count("*").alias("_c")).filter("_c > 1")
    order = numbered(y.select(*ROW, "_p").join(again, ["batch_id", "_p"], "left_semi"), ["batch_id", "_p"], "doc_ord", "_n")
    z = y.join(order.select(*ROW, "_n"), ROW, "left")
    return z.withColumn("filename", suffixed(F.col("filename"), F.coalesce("_n", F.lit(1)))).drop("_n", "_p")


def suffixed(filename: Column, n: Column) -> Column:
    """The n-th file of one name: "name (n).ext" from the second on."""
    tail = T.suffix(filename)
    stem = F.substring(filename, F.lit(1), F.length(filename) - F.length(tail))
    return F.when(n > 1, F.concat(stem, F.lit(" ("), n.cast("string"), F.lit(")"), tail)).otherwise(filename)


def review(plan: DataFrame) -> DataFrame:
    """The part of a plan that a person has to look at."""
    return plan.filter("needs_review")


def filed(plan: DataFrame) -> DataFrame:
    return plan.filter("NOT needs_review")


def preflight(plan: DataFrame, profile: Profile, existing: DataFrame | None = None, sources: DataFrame | None = None, root: str = "") -> DataFrame:
    """(batch_id, doc_ord, level, issue, detail): paths too long, illegal characters (and which), collisions whatever the case, paths that leave the root or exist, documents without a source.

    ``existing``: paths that are there; ``sources``: batch_id, doc_ord, source (null: none, as for samples)."""
    p = plan.select(*ROW, "folder", "filename", F.array_join(F.concat(F.array(F.lit(root)) if root else F.array().cast("array<string>"), "folder", F.array("filename")), "/").alias("path")).withColumn("k", F.lower("path"))
    p = copies(p, ["batch_id", "k"])
    bad = F.array_sort(F.array_distinct(F.regexp_extract_all(F.array_join(F.concat("folder", F.array("filename")), ""), F.lit(f"([{_class(profile.illegal)}])"), F.lit(1))))
    issue = lambda test, name, detail, level="error": F.when(test, F.struct(F.lit(level).alias("level"), F.lit(name).alias("issue"), detail.alias("detail")))
    tests = [
        issue(F.length("path") > profile.max_path_chars, "too long", F.concat(F.length("path").cast("string"), F.lit(f" characters, over the limit of {profile.max_path_chars}"))),
        issue(F.size(bad) > 0, "illegal character", F.array_join(bad, " ")),
        issue(F.col("k").isNotNull() & (F.col("copies") > 1), "collision", F.col("path")),
        issue(F.exists("folder", lambda f: f.isin("..", ".")), "escapes the root", F.col("path")),
    ]
    if sources is not None:
        p = p.join(sources.select(*ROW, "source"), ROW, "left")
        tests.append(issue(F.col("source").isNull(), "no source", F.lit("it can be exported but not filed"), "warning"))
    if existing is not None:
        p = p.join(existing.select(F.lower("path").alias("k"), F.lit(True).alias("there")).distinct(), "k", "left")
        tests.append(issue(F.col("there"), "exists", F.col("path"), "warning"))
    return p.select(*ROW, F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("x")).select(*ROW, "x.*")


def decisions(plan: DataFrame, approvals: DataFrame, filed: DataFrame | None = None, sources: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """What filing would do with each document, and why: filed, already-filed, rejected, skipped or failed.  Nothing is moved here.

    ``approvals``: doc_id, decision, folder, filename and, of several for one id, ``ord``: the last counts.  ``filed``: ids
    that are filed already; ``sources``: ids that have a source file; ``only``: ids that the operation is about."""
    said = approvals.select("doc_id", F.struct(F.col("ord") if "ord" in approvals.columns else F.lit(0).alias("ord"), "decision", "folder", "filename").alias("a"))
    x = plan.join(said.groupBy("doc_id").agg(F.max("a").alias("a")), "doc_id", "left")

    def marked(x: DataFrame, ids: DataFrame | None, name: str, default: bool) -> DataFrame:
        if ids is None:
            return x.withColumn(name, F.lit(default))
        return x.join(ids.select("doc_id", F.lit(True).alias(name)).distinct(), "doc_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))

    x = marked(marked(marked(x, filed, "_done", False), sources, "_source", True), only, "_asked", True)
    decision = F.coalesce("a.decision", F.lit("pending"))
    folder = F.coalesce(F.split(F.nullif("a.folder", F.lit("")), "/"), F.col("folder"))
    name = F.coalesce(F.nullif("a.filename", F.lit("")), F.col("filename"))
    escapes = F.exists(folder, lambda f: f.isin("..", ".") | f.rlike(r"[\\\x00]")) | name.rlike(r"[/\\]") | name.isin("..", ".")
    ladder = [
        (~F.col("_asked"), "skipped", F.lit("not in this operation's scope")), (decision == "reject", "rejected", F.lit("decision is reject")),
        (decision != "approve", "skipped", F.concat(F.lit("decision is "), decision)), (~F.col("_source"), "failed", F.lit("no source file")),
        (F.col("_done"), "already-filed", F.lit("")), (escapes, "failed", F.lit("leaves the root")),
    ]
    action, note = F.lit("filed"), F.lit("")
    for test, what, why in reversed(ladder):
        action, note = F.when(test, what).otherwise(action), F.when(test, why).otherwise(note)
    return x.select(*ROW, "doc_id", "name", F.array_join(F.filter(F.concat(folder, F.array(name)), lambda f: f != ""), "/").alias("destination"), action.alias("action"), note.alias("note"))


def counted(actions: DataFrame) -> DataFrame:
    """(action, n): how often each action was, or would be, taken."""
    return actions.groupBy("action").agg(F.count("*").alias("n"))


def reorganise(plan: DataFrame, current: DataFrame) -> DataFrame:
    """keep, move or leave for each document of a tree, whether it would change client, and why.

    ``current``: batch_id, doc_ord and the path below the root.  What needs review is left where it is."""
    x = plan.join(current.select(*ROW, "path"), ROW).withColumn("target", F.array_join(F.concat("folder", F.array("filename")), "/"))
    here = F.regexp_replace(F.regexp_replace("path", "/{2,}", "/"), r"^(\./)+", "")
    action = F.when(F.col("needs_review"), "leave").when(here == F.col("target"), "keep").otherwise("move")
    head = lambda c: F.split_part(c, F.lit("/"), F.lit(1))
    note = F.when(action == "leave", F.concat(F.lit("not confidently placed, so not disturbed: "), F.coalesce("rationale", F.lit("")))).when(action == "move", F.col("rationale")).otherwise("") if "rationale" in plan.columns else F.lit("")
    return x.select(*ROW, "doc_id", "path", "target", action.alias("action"), ((action == "move") & (head(here) != head(F.col("target")))).alias("crosses_client"), note.alias("note"))


def approved_moves(moves: DataFrame, approvals: DataFrame) -> DataFrame:
    """The moves of a reorganisation that a person approved, in order: also the entries of its rollback file."""
    last = approvals.groupBy("doc_id").agg(F.max_by("decision", F.col("ord") if "ord" in approvals.columns else F.lit(0)).alias("decision")).filter("decision = 'approve'")
    return moves.filter("action = 'move'").join(last.select("doc_id"), "doc_id", "left_semi").select(*ROW, "doc_id", F.col("path").alias("from"), F.col("target").alias("to"))
