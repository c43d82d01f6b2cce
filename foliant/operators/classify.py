"""Document types by a declarative table of phrases: where a title stands counts, not that it occurs."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import automaton, dates, names, spans, text as T
from ..kb import KnowledgeBase
from .rank import let


class Classifier(ABC):
    """Adds quality, scores, doc_type, confidence, runner_up, title_types, capped and evidence to documents; nothing after it asks which one did."""

    name = "abstract"

    @abstractmethod
    def apply(self, documents: DataFrame) -> DataFrame: ...


class Keywords(Classifier):
    """The knowledge base's phrases, weighed."""

    name = "keyword"

    def __init__(self, kb: KnowledgeBase):
        self.kb = kb

    def apply(self, documents: DataFrame) -> DataFrame:
        return classify(documents, self.kb)


def _cues(hints: dict) -> list[str]:
    return [c for c in (spans.head(f) for f in hints.get("key_fields", [])) if len(c) >= 4]


#: How many of a type's hits are named as evidence, and what weighs them.
_KINDS = (("structural", "structural_signal", 4), ("fields", "key_field", 3), ("against", "negative_signal", 1000))


def _types(kb: KnowledgeBase) -> Column:
    """The knowledge base's types with their phrases, as one constant."""
    of = lambda ps: spans.rows(ps, kb.short_max, kb.ascii_edges)
    table = [{"type": t["id"], "ord": t["ord"], "titles": of(h.get("title_patterns", [])), "cited": of(h.get("reference_patterns", [])), "structural": of(h.get("structural_signals", [])), "fields": of(_cues(h)), "against": of(h.get("negative_signals", []))} for t in kb.types for h in (t["hints"],)]
    return F.from_json(F.lit(json.dumps(table)), f"array<struct<type:string,ord:int,titles:{spans.PHRASES},cited:{spans.PHRASES},structural:{spans.PHRASES},fields:{spans.PHRASES},against:{spans.PHRASES}>>")


def type_scores(text: Column, kb: KnowledgeBase) -> Column:
    """array<struct<type, ord, score, worn, why>> in the knowledge base's order; why: what speaks for and against.

    A title counts as worn if it stands in title position outside every citation.  One projection, written once for all
    types; their table is a plan-time constant.  The text is put into lower case once and each phrase is looked for once;
    scores are rounded to two places, which is what they are ranked by."""
    w = kb.weights

    def scored(x: Column, t: Column) -> Column:
        found = F.struct(spans.hits(x.text, x.low, t.titles).alias("titles"), spans.hits(x.text, x.low, t.cited).alias("cited"), *[F.transform(spans.hits(x.text, x.low, t[name]), lambda y: y.p).alias(name) for name, _, _ in _KINDS])
        places = lambda ps: F.flatten(F.transform(ps, lambda y: spans.matches(x.text, y.re)))
        placed = lambda f: F.struct(places(f.titles).alias("titles"), places(f.cited).alias("cited"), F.get(f.titles, F.lit(0)).p.alias("phrase"), *[f[name].alias(name) for name, _, _ in _KINDS])
        worn = lambda f: F.exists(f.titles, lambda m: ~F.exists(f.cited, lambda r: (r.s <= m.s) & (m.s < r.e)) & spans.in_title_position(x.text, m, kb.head_chars, kb.short_max))
        judged = lambda f: F.struct(worn(f).alias("worn"), f.phrase.alias("phrase"), *[f[name].alias(name) for name, _, _ in _KINDS])
        return let(let(let(found, placed), judged), lambda f: summed(t, f))

    def summed(t: Column, f: Column) -> Column:
        score = F.when(f.worn, w["title_in_title_position"]).when(f.phrase.isNotNull(), w["title_mentioned_in_body"]).otherwise(0.0)
        why = [F.when(f.phrase.isNotNull(), F.concat(F.lit("title "), f.phrase, F.when(f.worn, " in title position").otherwise(" only mentioned in body")))]
        for name, weight, most in _KINDS:
            score = score + F.size(f[name]) * w[weight]
            why.append(F.when(F.size(f[name]) > 0, F.concat(F.lit(f"{name}: "), F.array_join(F.slice(f[name], 1, most), ", "))))
        return F.struct(t.type.alias("type"), t.ord.alias("ord"), F.round(F.greatest(F.lit(0.0), score), 2).alias("score"), f.worn.alias("worn"), F.concat_ws("; ", *why).alias("why"))

    return let(F.struct(text.alias("text"), F.lower(text).alias("low")), lambda x: F.transform(_types(kb), lambda t: scored(x, t)))


#: Phrases of a knowledge base from which on they are looked for in one walk.
WALK_FROM = 300


def walked_scores(text: Column, kb: KnowledgeBase) -> Column:
    """``type_scores`` by an automaton over all phrases of all types, in one Arrow function: a text costs its length and its matches, however many phrases there are."""
    uses, number = [], {}

    def numbered(phrases: list[str]) -> list[int]:
        return [number.setdefault((p, len(p) <= kb.short_max and p.isalpha()), len(number)) for p in phrases]

    for t in kb.types:
        h = t["hints"]
        uses.append((t["id"], t["ord"], numbered(h.get("title_patterns", [])), numbered(h.get("reference_patterns", [])), [numbered(x) for x in (h.get("structural_signals", []), _cues(h), h.get("negative_signals", []))]))
    phrases, w, head_chars, short_max, ascii_edges = tuple(number), dict(kb.weights), kb.head_chars, kb.short_max, kb.ascii_edges

    @F.pandas_udf("array<struct<type:string,ord:int,score:double,worn:boolean,why:string>>")
    def walked(texts: pd.Series) -> pd.Series:
        found = automaton.automaton(phrases, ascii_edges)
        return texts.map(lambda x: None if x is None else _weighed(x, found, uses, phrases, w, head_chars, short_max))

    return walked(text)


def _weighed(text: str, found: automaton.Phrases, uses: list, phrases: tuple, w: dict, head_chars: int, short_max: int) -> list[dict]:
    at, lines, out = found.found(text), automaton.Lines(text), []
    for kind, place, titles, cited, others in uses:
        titles = [k for k in titles if k in at]
        worn, why, score = False, [], 0.0
        if titles:
            quoted = automaton.Covered([m for k in cited for m in at.get(k, ())])
            worn = any(not quoted.holds(a) and automaton.in_title_position(text, lines, a, b, head_chars, short_max) for k in titles for a, b in at[k])
            score = w["title_in_title_position"] if worn else w["title_mentioned_in_body"]
            why.append(f"title {phrases[titles[0]][0]}" + (" in title position" if worn else " only mentioned in body"))
        for (name, weight, most), wanted in zip(_KINDS, others):
            there = [phrases[k][0] for k in wanted if k in at]
            score = score + len(there) * w[weight]
            if there:
                why.append(f"{name}: " + ", ".join(there[:most]))
        out.append({"type": kind, "ord": place, "score": float(Decimal(repr(max(0.0, float(score)))).quantize(Decimal("0.01"), ROUND_HALF_UP)), "worn": worn, "why": "; ".join(why)})
    return out


def scores(text: Column, kb: KnowledgeBase) -> Column:
    """``type_scores`` in the plan, or by one walk where phrases are many."""
    n = sum(len(h.get(k, [])) for t in kb.types for h in (t["hints"],) for k in ("title_patterns", "reference_patterns", "structural_signals", "negative_signals", "key_fields"))
    return walked_scores(text, kb) if n >= WALK_FROM else type_scores(text, kb)


def decided(scores: Column, quality: Column, kb: KnowledgeBase) -> Column:
    """Struct of doc_type, confidence (unrounded), runner_up, title_types and capped, of a text's scores and its quality score.

    Ranked by score, then in the knowledge base's order; no type below a quarter of the evidence floor."""
    ranked = F.array_sort(F.transform(scores, lambda s: F.struct((-s.score).alias("m"), s.ord.alias("ord"), s.type.alias("type"))))

    def of(x: Column) -> Column:
        top, run = -x.r[0].m, F.coalesce(-F.get(x.r, F.lit(1)).m, F.lit(0.0))
        raw = F.when(top > 0, (top - run) / top * F.least(F.lit(1.0), top / F.lit(float(kb.floor)))).otherwise(0.0)
        none = (top <= 0) | (top < kb.floor * 0.25)
        return F.struct(
            F.when(~none, x.r[0].type).alias("doc_type"), F.when(none, 0.0).otherwise(F.least(raw, x.q)).alias("confidence"),
            F.when(top > 0, F.get(x.r, F.lit(1)).type).alias("runner_up"),
            F.transform(F.filter(x.s, lambda s: s.worn & (s.score >= kb.floor)), lambda s: s.type).alias("title_types"),
            ((top > 0) & (x.q < raw)).alias("capped"))

    return let(F.struct(ranked.alias("r"), scores.alias("s"), quality.alias("q")), of)


def evidence(scores: Column, doc_type: Column) -> Column:
    """One line of what speaks for the winning type."""
    why = F.get(F.filter(scores, lambda s: s.type == doc_type), F.lit(0)).why
    return F.when(doc_type.isNull(), "nothing scored above the evidence floor").otherwise(F.coalesce(F.nullif(why, F.lit("")), F.lit("no evidence recorded")))


def classify(documents: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """Adds quality, scores, doc_type, confidence, runner_up, title_types, capped and evidence."""
    q = documents.withColumn("quality", T.quality(F.col("text"), F.col("page_count"))).withColumn("scores", scores(F.col("text"), kb))
    q = q.withColumn("_d", decided(F.col("scores"), F.col("quality.score"), kb))
    return q.select(*documents.columns, "quality", "scores", "_d.*", evidence(F.col("scores"), F.col("_d.doc_type")).alias("evidence"))


def _per_type(kb: KnowledgeBase, value, default: Column) -> Column:
    out = default
    for t in kb.types:
        if (v := value(t)) is not None:
            out = F.when(F.col("doc_type") == t["id"], v).otherwise(out)
    return out


def subject(text: Column, kb: KnowledgeBase) -> Column:
    """Struct of id and label: the first subject with a phrase that the text contains; else the one without phrases."""
    pair = lambda i, label: F.struct(F.lit(i).alias("id"), F.lit(label).alias("label"))
    out = pair("general", "Advice")
    for s in kb.subjects:
        if not s.get("patterns"):
            out = pair(s["id"], s["label"])
    for s in reversed([s for s in kb.subjects if s.get("patterns")]):
        out = F.when(mentions(text, s["patterns"]), pair(s["id"], s["label"])).otherwise(out)
    return out


def mentions(text: Column, phrases: list[str]) -> Column:
    """Whether the text contains one of the phrases, whatever their case."""
    out, low = F.lit(False), F.lower(text)
    for p in phrases:
        out = out | F.contains(low, F.lit(p.lower()))
    return out


def sub_kind(text: Column, kb: KnowledgeBase) -> Column:
    """Struct of id, label and prior (whether it needs an earlier record) of the document's type's sub-kinds: the first that the text names."""
    out = F.lit(None).cast("struct<id:string,label:string,prior:boolean>")
    for t in kb.types:
        for k in reversed(t["hints"].get("sub_kinds", [])):
            one = F.struct(F.lit(k["id"]).alias("id"), F.lit(k["label"]).alias("label"), F.lit(bool(k.get("requires_prior_soa"))).alias("prior"))
            out = F.when((F.col("doc_type") == t["id"]) & mentions(text, k["patterns"]), one).otherwise(out)
    return out


def risk_category(text: Column, cues: list[str], categories: list[str]) -> Column:
    """The category that follows a cue, longer names first, or the first that occurs as a whole word."""
    low = F.lower(text)
    after = [F.when(low.rlike(rf"{spans.escaped(cue.lower())}\s*[:-]?\s*{spans.escaped(r)}"), F.lit(r)) for cue in cues for r in categories]
    return F.coalesce(*after, *[F.when(low.rlike(rf"\b{spans.escaped(r)}\b"), F.lit(r)) for r in categories], F.lit(None).cast("string"))


def products(text: Column) -> Column:
    """Distinct brand words: two or more capitalised parts in one."""
    return spans.tokens(text, r"\b(?:[A-Z][a-z]{2,}){2,}\b")


def cited_dates(text: Column, kb: KnowledgeBase) -> Column:
    """array<struct<label, value>>: the types that the text cites with a date, in the knowledge base's order, each with its first one."""
    raws = dates.dated(dates.labelled(text, [(t["id"], p) for t in kb.types for p in t["hints"].get("reference_patterns", [])]))
    return let(raws, lambda all_of: F.transform(F.array_distinct(F.transform(all_of, lambda x: x.label)), lambda name: F.get(F.filter(all_of, lambda x: x.label == name), F.lit(0))))


def eras(text: Column, kb: KnowledgeBase) -> tuple[Column, Column]:
    """Whether the text has wording of its type's fee regime before, and after, the boundary."""
    of = lambda key: _per_type(kb, lambda t: mentions(text, t["hints"]["era_signals"].get(key, [])) if t["hints"].get("era_signals") else None, F.lit(False))
    return of("pre_dbfo_t1"), of("post_dbfo_t1")


def enrich(documents: DataFrame, kb: KnowledgeBase, classifier: Classifier | None = None) -> DataFrame:
    """Classified documents with client, dates, products, subject and the type's properties: one narrow stage.

    What later stages ask of a text is worked out here; they need no text."""
    x = F.col("text")
    c = (classifier or Keywords(kb)).apply(documents)
    labels = lambda t: [spans.head(f) for f in t["hints"].get("key_fields", []) if any(k in f.lower() for k in ("date", "completed", "effective"))]
    none = F.array().cast("array<struct<label:string,raw:string>>")
    raws = F.concat(_per_type(kb, lambda t: dates.labelled(x, [(n, n) for n in labels(t)]) if labels(t) else None, none), dates.labelled(x, [(n, n) for n in dates.LABELS]))
    has = lambda key: F.coalesce(F.col("doc_type").isin(kb.ids(key) or [""]), F.lit(False))
    c = c.withColumn("client", names.client(x)).withColumn("_dated", dates.dated(raws)).withColumn("_loose", dates.all_dates(x)).withColumn("_cited", cited_dates(x, kb))
    value, why = dates.own(F.col("_dated"), F.col("_loose"))
    pre, post = eras(x, kb)
    return c.select(
        *c.columns[: c.columns.index("client")],
        T.content_id(x).alias("doc_id"),
        F.col("client.raw").alias("client_raw"), F.coalesce("client.surnames", F.array().cast("array<string>")).alias("surnames"), F.coalesce("client.given", F.array().cast("array<string>")).alias("given"), F.col("client.key").alias("family_key"),
        F.when(F.col("client.key").isNotNull(), "read from document").alias("client_provenance"),
        value.alias("own_date"), why.alias("date_provenance"),
        F.map_from_entries(F.transform("_cited", lambda e: F.struct(e.label, e.value))).alias("cited_dates"),
        F.get(F.filter("_cited", lambda e: e.label.isin(kb.ids("advice_record") or [""])), F.lit(0)).alias("cited"),
        _per_type(kb, lambda t: risk_category(x, t["hints"]["category_patterns"], kb.risk_categories) if t["hints"].get("category_patterns") else None, F.lit(None).cast("string")).alias("risk_category"),
        F.filter(F.array(*map(F.lit, kb.risk_categories)).cast("array<string>"), lambda r: F.contains(F.lower(x), r)).alias("risks_named"),
        products(x).alias("products"), sub_kind(x, kb).alias("sub_kind"), subject(x, kb).alias("subject"), pre.alias("era_pre"), post.alias("era_post"),
        has("advice_record").alias("advice_record"), (F.col("doc_type").isNull() | has("client_specific")).alias("client_specific"), has("requires_date").alias("requires_date"),
        _per_type(kb, lambda t: F.lit(t["category"]), F.lit(None).cast("string")).alias("category"),
        _per_type(kb, lambda t: F.lit(t["abbrev"]), F.lit(None).cast("string")).alias("abbrev"),
    )
