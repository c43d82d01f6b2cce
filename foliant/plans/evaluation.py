"""A run held against known answers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..kb import KnowledgeBase, Profile
from ..operators import evaluate, events, flags
from ..operators.events import ROW
from ..operators.rank import copies
from . import batch
from .batch import Result

#: What parts a batch's id from the step of a sweep.
_STEP = "\x1f"


def compare(result: Result, truth: DataFrame, kb: KnowledgeBase | None = None) -> DataFrame:
    """A row per labelled document: what was right, flags missed and unexpected, confident and wrong, and why.

    An event is right if the labels of the document and of its event's anchor are the same (both none counts)."""
    kb = kb or result.kb or KnowledgeBase.load()
    rows = result.plan.select(*ROW, "name", "event", "needs_review").join(_read(result.records, kb), ROW).join(_got(result.records, result.attachments, truth, kb).drop("event"), ROW, "left")
    return _judged(rows, result.flags, truth)


def _read(records: DataFrame, kb: KnowledgeBase, *more: str) -> DataFrame:
    """What was read of each record, as far as answers are known."""
    return records.select(*ROW, *more, "doc_type", "confidence", events.confident(records, kb).alias("confident"), F.col("family_key").alias("read_client"), "client_specific")


def _got(records: DataFrame, attached: DataFrame, truth: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """The documents in an event (ROW, event) with the label of its anchor, ``got_event``.  Those in none are left out: they would all meet in the task of the null event."""
    anchor = records.filter(F.col("advice_record") & events.confident(records, kb)).select("batch_id", F.col("doc_ord").alias("event"), "name").join(truth.select("name", F.col("event").alias("got_event")), "name").drop("name")
    return attached.filter("event IS NOT NULL").select(*ROW, "event").join(anchor, ["batch_id", "event"], "left")


def _judged(rows: DataFrame, raised: DataFrame, truth: DataFrame) -> DataFrame:
    t = truth.select("name", F.col("type").alias("t_type"), F.col("client").alias("t_client"), F.col("event").alias("t_event"), F.coalesce("needs_review", F.lit(False)).alias("t_review"), "expect_flags")
    raised = raised.groupBy(*ROW).agg(F.array_sort(F.collect_set("rule_id")).alias("raised"))
    x = rows.join(raised, ROW, "left").join(t, "name")
    none = F.array().cast("array<string>")
    missed, unexpected = evaluate.differences(F.coalesce("expect_flags", none), F.coalesce("raised", none))
    x = x.withColumns({
        "type_ok": F.col("doc_type").eqNullSafe(F.col("t_type")),
        "client_ok": F.when(F.col("client_specific"), F.col("read_client").eqNullSafe(F.col("t_client"))).otherwise(F.col("t_client").isNull()),
        "event_ok": F.col("got_event").eqNullSafe(F.col("t_event")),
        "review_ok": F.col("needs_review") == F.col("t_review"),
        "missed": missed, "unexpected": unexpected,
    })
    x = x.withColumn("confident_and_wrong", F.col("doc_type").isNotNull() & F.col("confident") & ~F.col("type_ok"))
    said = lambda what, got, want: F.concat(F.lit(f"{what}: said "), F.coalesce(got, F.lit("none")), F.lit(", is "), F.coalesce(want, F.lit("none")))
    queue = lambda c: F.when(c, "queued").otherwise("filed")
    why = F.concat_ws(" | ",
        F.when(~F.col("type_ok"), said("type", F.col("doc_type"), F.col("t_type"))), F.when(~F.col("client_ok"), said("client", F.col("read_client"), F.col("t_client"))),
        F.when(~F.col("event_ok"), said("event", F.col("got_event"), F.col("t_event"))), F.when(~F.col("review_ok"), F.concat(F.lit("review: "), queue(F.col("needs_review")), F.lit(", should be "), queue(F.col("t_review")))),
        F.when(F.size("missed") > 0, F.concat(F.lit("missed "), F.array_join("missed", ", "))))
    return x.withColumn("why", why).withColumn("ok", F.col("why") == "")


def failures(compared: DataFrame, run_id: str, kb: KnowledgeBase, classifier: str = "keyword") -> DataFrame:
    """Rows of the append-only failure log: only what was not right."""
    return compared.filter("NOT ok").select(F.lit(run_id).alias("run_id"), F.lit(kb.data["meta"]["version"]).alias("kb_version"), F.lit(classifier).alias("classifier"), F.col("name").alias("input"), F.col("doc_type").alias("tool_type"), F.col("t_type").alias("correct_type"), "confidence", F.col("read_client").alias("tool_client"), F.col("t_client").alias("correct_client"), F.col("got_event").alias("tool_event"), F.col("t_event").alias("correct_event"), F.col("needs_review").alias("queued_for_review"), F.col("t_review").alias("should_be_queued"), F.col("raised").alias("flags_raised"), F.col("missed").alias("flags_missed"), "confident_and_wrong", "why")


def run_id(now: datetime | None = None) -> str:
    return (now or datetime.now()).strftime("%Y%m%dT%H%M%S")


def score(compared: DataFrame) -> DataFrame:
    """One row: filing's scorecard (filed and right in type and event), and how many are right in each respect."""
    n = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(f"n_{c}")
    right = [n(c) for c in ("type_ok", "client_ok", "event_ok", "review_ok", "ok", "confident_and_wrong")]
    return evaluate.scorecard(compared, ~F.col("needs_review"), F.col("type_ok") & F.col("event_ok"), *right)


def sweep(records: DataFrame, kb: KnowledgeBase, steps: int = evaluate.STEPS, moves: Column | None = None) -> DataFrame:
    """The records once for each state that a threshold can leave them in, with the steps ``_from`` to ``step`` at which it holds; the state becomes part of their batch's id, and every later operator keeps batches apart.

    What a client's documents come to changes only at a step where one of them drops out, so they are there as often as
    they have different confidences (to the step), and once more; not once for every step.  Documents that look beyond
    their client (linked by product, of no client, or not specific to one) tie the clients of their batch together.

    ``moves``: the documents whose dropping out changes what others come to, where that is known.  A client's states then change where
    these drop out; each document is there in those up to its own confidence, and once more, apart from the others, for all steps above it."""
    passed = sum(((F.col("confidence") >= F.lit(k / steps)).cast("int") for k in range(steps)), F.lit(0))
    linked = [t["category"] for t in kb.types if kb.direction(t["category"]) == "product_link"]
    apart = F.col("family_key").isNotNull() & F.coalesce("client_specific", F.lit(False)) & ~F.coalesce(F.col("category").isin(linked or [""]), F.lit(False))
    known = records.withColumn("_last", F.coalesce(passed, F.lit(0)) - 1)
    alone = known.groupBy("batch_id").agg(F.bool_and(apart).alias("_apart"))
    known = known.join(alone, "batch_id").withColumn("_unit", F.when(F.col("_apart"), F.col("family_key")))
    telling = F.lit(True) if moves is None else ~F.col("_apart") | F.coalesce(moves, F.lit(False))
    at = known.filter(F.col("_last").between(0, steps - 2) & telling).groupBy("batch_id", "_unit").agg(F.collect_set("_last").alias("_e"))
    span = lambda begin, end: F.struct(begin.cast("int").alias("_from"), end.cast("int").alias("step"))
    ends = F.array_sort(F.array_union("_e", F.array(F.lit(steps - 1))))
    spans = F.transform("_ends", lambda e, k: span(F.when(k == 0, 0).otherwise(F.get("_ends", k - 1) + 1), e))
    # a row for each unit, so the records need not be sorted; the last span of all, at no step, is for what is above a document's own confidence
    none, only = F.array(span(F.lit(steps), F.lit(-1))), F.array(span(F.lit(0), F.lit(steps - 1)))
    states = at.withColumn("_ends", ends).select(F.col("batch_id").alias("_b"), F.col("_unit").alias("_u"), F.concat(spans, none).alias("_spans")).hint("shuffle_hash")
    rows = known.join(states, (F.col("batch_id") == F.col("_b")) & F.col("_unit").eqNullSafe(F.col("_u")), "left").withColumn("_s", F.explode(F.coalesce("_spans", F.concat(only, none))))
    own = F.lit(False) if moves is None else F.col("_apart") & F.col("confidence").isNotNull()
    above, state = F.col("_s.step") < 0, F.col("_s.step")
    rows = rows.filter(F.when(above, own & (F.col("_last") < steps - 1)).otherwise(~own | (F.col("_s._from") <= F.col("_last"))))
    begin = F.when(above, F.col("_last") + 1).otherwise(F.col("_s._from")).cast("int")
    end = F.when(above, F.lit(steps - 1)).when(own, F.least(state, "_last")).otherwise(state).cast("int")
    rows = rows.select(*[c for c in records.columns if c != "batch_id"], "batch_id", begin.alias("_from"), end.alias("step"), state.cast("string").alias("_state"))
    return rows.withColumn("batch_id", F.concat(F.col("batch_id"), F.lit(_STEP), F.col("_state"))).drop("_state").withColumn("threshold", F.col("_from") / F.lit(float(steps)))


def _states(records: DataFrame, kb: KnowledgeBase, steps: int, rules: list[str]) -> DataFrame:
    """``sweep``, with the documents that others depend on as far as ``rules`` ask: anchors, and several of one client, type and day."""
    moves = F.col("advice_record") & F.col("own_date").isNotNull()
    if "superseding_ambiguity" not in rules:
        return sweep(records, kb, steps, moves)
    if kb.rule("low_confidence")["class"] != "placement":  # what is below the threshold is then held against the others all the same
        return sweep(records, kb, steps)
    return sweep(copies(records, ["batch_id", "family_key", "doc_type", "own_date"], "_copies"), kb, steps, moves | (F.col("_copies") > 1)).drop("_copies")


#: What a calibration reads of the records, and what only the rules named do; of the rest, which messages and names are made of, no copies are written.
_READS = ("name", *ROW, "doc_type", "confidence", "runner_up", "scores", "title_types", "family_key", "own_date", "cited", "products", "advice_record", "client_specific", "requires_date", "category", "match_verdict")
_RULE_READS = {"superseding_ambiguity": ("subject",), "roa_without_soa": ("sub_kind",), "risk_mismatch": ("risk_category", "risks_named"), "fds_era_mismatch": ("era_pre", "era_post")}
#: Columns of temporary tables that say why; a calibration counts and does not say.
_SAID = {"message": "", "reason": "", "attach_confidence": 0.0}


def calibrate(records: DataFrame, truth: DataFrame, kb: KnowledgeBase, profile: Profile | None = None, steps: int = evaluate.STEPS, materialise=lambda frame, name: frame) -> DataFrame:
    """A row per threshold: step, threshold, n, accuracies, n_filed, precision, n_review, n_wrong (confident and wrong), n_ok.

    Everything that reads the threshold is done again in each state that it leads to (``sweep``): an advice record below it
    anchors no event, and what would have attached to that event moves with it.  A state counts at all steps at which it holds.

    Places and names are not worked out, and of the rules only those that hold documents back or that some answer expects: nothing else counts."""
    expected = [r[0] for r in truth.select(F.explode("expect_flags").alias("r")).filter(F.col("r").isin(*flags.RULES)).distinct().collect()]
    rules = [r for r in flags.RULES if r in kb.rules and (r in expected or kb.rule(r)["class"] == "placement")]
    reads = {*_READS, *(c for r in rules for c in _RULE_READS.get(r, ()))}
    swept = materialise(_states(records.select(*[c for c in records.columns if c in reads]), kb, steps, rules), "sweep")
    swept = swept.withColumns({f.name: F.lit(None).cast(f.dataType) for f in records.schema if f.name not in reads})
    lean = lambda frame, name: materialise(frame.withColumns({c: F.lit(v) for c, v in _SAID.items() if c in frame.columns}), name)
    _, attached, raised = batch.decide(swept.drop("_from", "step"), kb, lean, rules=rules)
    held = raised.filter("class = 'placement'").select(*ROW, F.lit(True).alias("_held")).distinct()
    x = _read(swept, kb, "name", "_from", "step").join(_got(swept, attached, truth, kb), ROW, "left").join(held, ROW, "left").withColumn("needs_review", F.col("_held").isNotNull())
    x = _judged(x, raised.filter(F.col("rule_id").isin(*expected) if expected else F.lit(False)), truth)
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    filed = ~F.col("needs_review")
    counts = {
        "n": F.lit(1), "type": F.col("type_ok"), "client": F.col("client_ok"), "event": F.col("event_ok"), "n_filed": filed, "right": filed & F.col("type_ok") & F.col("event_ok"),
        "n_review": ~filed, "n_wrong": F.col("confident_and_wrong"), "n_ok": F.col("ok"),
    }
    # no more rows than there are spans of steps, each counted at its steps
    by_span = materialise(x.groupBy("_from", "step").agg(*[n(c).alias(k) for k, c in counts.items()]), "spans").withColumn("step", F.explode(F.sequence("_from", "step")))
    total = by_span.groupBy("step").agg(*[F.sum(k).alias(k) for k in counts])
    share = lambda k, of="n": F.try_divide(F.col(k).cast("double"), F.col(of).cast("double"))
    return total.select(
        F.col("step").cast("int").alias("step"), (F.col("step") / F.lit(float(steps))).alias("threshold"), "n", share("type").alias("type_accuracy"), share("client").alias("client_accuracy"), share("event").alias("event_accuracy"),
        "n_filed", share("right", "n_filed").alias("precision"), "n_review", "n_wrong", "n_ok")
