"""Sinks: manifest, flat table, decision sheet, script, logs; filing itself only on approval and never over a file."""

from __future__ import annotations

import csv
import hashlib
import json
import os
import shutil
import time
import uuid
from abc import ABC, abstractmethod
from collections.abc import Iterable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .functions import redact
from .operators.events import ROW
from .plans.batch import Result
from .sources.files import Place

MANIFEST, APPROVALS, ROLLBACK = "foliant.manifest@1", "foliant.approvals@1", "foliant.rollback@1"
COLUMNS = ("doc_id", "source_name", "source_path", "type", "type_label", "confidence", "client", "date", "event_id", "destination_folder", "destination_filename", "needs_review", "flags", "rationale")
#: Regions in which a backup may lie unless another is allowed by name.
REGIONS = ("ap-southeast-2", "ap-southeast-4", "australiaeast", "australiasoutheast", "australia-southeast1", "australia-southeast2", "au", "australia")
INSTRUCTIONS = "Set decision to approve for each document to be filed; folder and filename may be corrected. Fields that begin with an underscore are for reading. Nothing is written for what stays pending or rejected."
_LOST = "array<struct<name:string,error:string>>"
_FLAGS = "array<struct<rule_id:string,severity:string,class:string,message:string,blocks_filing:boolean>>"


def event_id(batch: Column, family: Column, date: Column, subject: Column, anchor: Column) -> Column:
    return F.concat(F.lit("evt-"), F.substring(F.sha1(F.concat_ws("|", batch, family, date.cast("string"), subject, anchor.cast("string")).cast("binary")), 1, 10))


def _event_id(events: DataFrame) -> Column:
    return event_id(F.col("batch_id"), F.col("family_key"), F.col("event_date"), F.col("subject.id"), F.col("event"))


def documents(result: Result) -> DataFrame:
    """A row per document with everything that is exported."""
    ev = result.events.select("batch_id", "event", _event_id(result.events).alias("event_id"))
    flag = F.struct("rule_id", "severity", "class", "message", (F.col("class") == "placement").alias("blocks_filing"))
    raised = result.flags.groupBy(*ROW).agg(F.array_sort(F.collect_list(flag)).alias("flags"))
    attached = result.attachments.select(*ROW, F.col("reason").alias("attachment_reason"), "attach_confidence")
    known = [c for c in ("source", "backend", "page_count", "quality", "evidence", "client_provenance", "date_provenance", "category", "abbrev") if c in result.records.columns]
    rec = result.records.select(*ROW, "doc_type", "confidence", "own_date", "runner_up", "client_raw", *known)
    x = result.plan.join(rec, ROW).join(ev, ["batch_id", "event"], "left").join(raised, ROW, "left").join(attached, ROW, "left")
    return x.withColumn("flags", F.coalesce("flags", F.array().cast(_FLAGS)))


def document_structs(docs: DataFrame) -> Column:
    """A document as the manifest has it."""
    col = lambda c, default="string": F.col(c) if c in docs.columns else F.lit(None).cast(default)
    place = F.struct("folder", "filename", F.array_join(F.concat("folder", F.array("filename")), "/").alias("path"), "kind", "rationale")
    return F.struct(
        "doc_ord", "doc_id", F.col("name").alias("source_name"), col("source").alias("source_path"), col("backend").alias("extracted_by"), col("page_count", "int").alias("pages"),
        F.col("doc_type").alias("type"), col("abbrev").alias("type_label"), col("category").alias("category"), F.round("confidence", 2).alias("confidence"), col("evidence").alias("classification_evidence"),
        (F.col("quality.score") if "quality" in docs.columns else F.lit(None).cast("double")).alias("extraction_quality"), (F.col("quality.reasons") if "quality" in docs.columns else F.lit(None).cast("array<string>")).alias("extraction_issues"),
        F.col("family_key").alias("client"), col("client_provenance").alias("client_provenance"), F.col("own_date").cast("string").alias("date"), col("date_provenance").alias("date_provenance"),
        "event_id", "attachment_reason", F.round("attach_confidence", 2).alias("attachment_confidence"), "needs_review", "flags", place.alias("destination"))


def event_rows(events: DataFrame, members: DataFrame) -> DataFrame:
    """A row per event as the manifest has it: its id, and the ids of the documents in it (``members``: batch_id, event, doc_id), sorted."""
    inside = members.filter("event IS NOT NULL").groupBy("batch_id", "event").agg(F.array_sort(F.collect_list("doc_id")).alias("members"))
    kind = members.schema["doc_id"].dataType.simpleString()
    return events.join(inside, ["batch_id", "event"], "left").select(
        "batch_id", _event_id(events).alias("event_id"), F.col("family_key").alias("client"), F.col("event_date").cast("string").alias("date"), F.col("subject.label").alias("subject"),
        F.col("anchor_type").alias("record_type"), "record_label", F.col("sub_kind_label").alias("sub_kind"), F.coalesce("members", F.array().cast(f"array<{kind}>")).alias("member_doc_ids"))


def manifest(result: Result, generated: str | None = None, classifier: str = "keyword", unreadable: DataFrame | None = None) -> DataFrame:
    """One row a batch: what it is about, nested events, documents and failures under a schema tag; an intake batch is what one person looks through.

    ``unreadable``: batch_id, name, error of all that could not be read."""
    docs = documents(result)
    batch = F.struct(F.max("batch_client").alias("client"), F.count("*").alias("documents"), F.sum((~F.col("needs_review")).cast("long")).alias("auto_filed"), F.sum(F.col("needs_review").cast("long")).alias("needs_review"))
    d = docs.join(result.batch_clients, "batch_id", "left").groupBy("batch_id").agg(batch.alias("batch"), F.array_sort(F.collect_list(document_structs(docs))).alias("documents"))
    rows = event_rows(result.events, docs.select("batch_id", "event", "doc_id"))
    e = rows.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in rows.columns if c != "batch_id"]))).alias("events"))
    kb, profile = result.kb, result.profile
    lost = F.array().cast(_LOST)
    d = d.join(e, "batch_id", "left")
    if unreadable is not None:  # each batch has its own; a batch of nothing else has a row, too
        d = d.join(unreadable.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("name", "error"))).alias("_lost")), "batch_id", "full")
        lost = F.coalesce("_lost", lost)
        nobody = F.struct(F.lit(None).cast("string").alias("client"), *[F.lit(0).cast("long").alias(k) for k in ("documents", "auto_filed", "needs_review")])
        d = d.withColumns({"batch": F.coalesce("batch", nobody), "documents": F.coalesce("documents", F.array().cast(d.schema["documents"].dataType))})
    return d.select(
        F.lit(MANIFEST).alias("schema"), F.lit(generated).cast("string").alias("generated"), F.lit(kb.data["meta"]["version"] if kb else None).cast("string").alias("knowledge_base_version"), F.lit(classifier).alias("classifier"),
        F.lit(profile.id if profile else None).cast("string").alias("filing_profile"), F.lit(kb.threshold if kb else None).cast("double").alias("confidence_threshold"),
        "batch_id", F.col("batch").withField("unreadable", lost).alias("batch"), F.coalesce("events", F.array().cast(e.schema["events"].dataType)).alias("events"), "documents")


def redacted(frame: DataFrame, salt: str, vocabulary: list[str]) -> DataFrame:
    """The exported documents without names: clients as pseudonyms, prose and file names by a closed vocabulary."""
    return frame.withColumns({c: v for c in frame.columns if (v := _hidden(c, F.col(c), frame.schema[c].dataType, salt, vocabulary)) is not None})


#: What a field's name says about how it is hidden: people, paths, names of files and folders, prose.
_PEOPLE = ("client", "family_key", "client_raw", "batch_client", "tool_client", "correct_client")
_PATHS = ("source", "source_path")
_FILES = ("name", "input", "filename", "path", "source_name", "target", "from", "to", "destination_folder", "destination_filename")
_PROSE = ("message", "rationale", "attachment_reason", "client_provenance", "why", "error", "note", "classification_evidence", "evidence", "folder", "match_reason")
_LABELS = ("tool_event", "correct_event")


def _hidden(name: str, value: Column, kind, salt: str, vocabulary: list[str]) -> Column | None:
    """The field without names, by its name, through structs and arrays; None where nothing is to be done."""
    if kind.typeName() == "struct":
        fields = {f.name: _hidden(f.name, value[f.name], f.dataType, salt, vocabulary) for f in kind.fields}
        if all(v is None for v in fields.values()):
            return None
        return F.when(value.isNotNull(), F.struct(*[(value[k] if v is None else v).alias(k) for k, v in fields.items()]))
    if kind.typeName() == "array":
        probe = _hidden(name, F.lit(None).cast(kind.elementType), kind.elementType, salt, vocabulary)
        return None if probe is None else F.transform(value, lambda x: _hidden(name, x, kind.elementType, salt, vocabulary))
    if kind.typeName() != "string":
        return None
    if name in _PEOPLE or name in _LABELS:
        return redact.pseudonym(value, salt)
    if name in _PATHS:
        return F.when(value.isNotNull(), F.lit("[path]"))
    if name in _FILES:
        return F.array_join(F.transform(F.split(value, r"[/\\]"), lambda x: redact.file_name(x, vocabulary)), "/")
    return redact.prose(value, vocabulary) if name in _PROSE else None


def write_files(frame: DataFrame, root: str, rel: str = "rel", text: str = "text") -> int:
    """A file below a local, shared root for each row; tasks write them under other names and move them, so a repeated task leaves no half file."""

    def put(batches):
        n = 0
        for part in batches:
            for at, content in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                path = os.path.normpath(os.path.join(base, at))
                if not path.startswith(f"{base}/"):
                    raise ValueError(f"{at} leaves the root")
                os.makedirs(os.path.dirname(path), exist_ok=True)
                half = f"{path}.{uuid.uuid4().hex}.part"
                with open(half, "wb") as f:
                    f.write((content or "").encode())
                os.replace(half, path)
                n += 1
        yield pa.record_batch([pa.array([n])], names=["n"])

    base = Place(root).root
    os.makedirs(base, exist_ok=True)
    return frame.select(rel, text).mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0


def flat(result: Result) -> DataFrame:
    """The fourteen columns of the flat export, all strings."""
    d = documents(result)
    col = lambda c: F.col(c) if c in d.columns else F.lit(None).cast("string")
    values = [F.col("doc_id"), F.col("name"), col("source"), F.col("doc_type"), col("abbrev"), F.format_string("%.2f", "confidence"), F.col("family_key"), F.col("own_date").cast("string"), F.col("event_id"), F.concat_ws("/", "folder"), F.col("filename"), F.when(F.col("needs_review"), "yes").otherwise("no"), F.array_join(F.transform("flags", lambda f: f.rule_id), "; "), F.col("rationale")]
    return d.orderBy(*ROW).select(*[F.coalesce(v, F.lit("")).alias(c) for v, c in zip(values, COLUMNS)])


def approvals(result: Result) -> DataFrame:
    """A decision sheet: what needs review starts as reject, all else as pending.  Fields with an underscore are for reading."""
    d = documents(result)
    return d.select(*ROW, "doc_id", F.col("name").alias("source_name"), F.when(F.col("needs_review"), "reject").otherwise("pending").alias("decision"), F.concat_ws("/", "folder").alias("folder"), "filename", F.col("doc_type").alias("_type"), F.round("confidence", 2).alias("_confidence"), F.col("rationale").alias("_why"), F.transform("flags", lambda f: f.rule_id).alias("_flags"))


def _owned(path: Path) -> Path:
    """Restricted to its owner, as far as the file system goes along."""
    try:
        os.chmod(path, 0o700 if path.is_dir() else 0o600)
    except (OSError, NotImplementedError):
        pass
    return path


def owned_tree(root: str) -> None:
    for folder, folders, files in os.walk(root):
        for p in (Path(folder), *(Path(folder) / x for x in folders + files)):
            _owned(p)


def _parent(path: str | Path) -> Path:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    return Path(path)


def write_json(frame: DataFrame, path: str, tag: str | None = None, field: str = "items", **more) -> None:
    """A small report as one JSON file, row by row, on the driver; large exports are written with DataFrame.write."""
    at = _parent(path)
    with open(at, "w") as f:
        if tag:
            f.write("{" + "".join(f"{json.dumps(k)}: {json.dumps(v, ensure_ascii=False)},\n " for k, v in {"schema": tag, **more}.items()) + f"{json.dumps(field)}: ")
        f.write("[")
        for k, row in enumerate(frame.toJSON().toLocalIterator()):
            f.write((",\n " if k else "\n ") + row)
        f.write("\n]" + ("}\n" if tag else "\n"))
    _owned(at)


def write_csv(flat_rows: DataFrame, path: str) -> None:
    """The flat export as one CSV file, row by row, on the driver."""
    at = _parent(path)
    with open(at, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(flat_rows.columns)
        out.writerows(flat_rows.toLocalIterator())
    _owned(at)


def append_log(rows: DataFrame, path: str) -> int:
    """Appends rows to a JSON-lines file, a history that is never written over; returns how many."""
    at, n = _parent(path), 0
    with open(at, "a") as f:
        for n, row in enumerate(rows.toJSON().toLocalIterator(), 1):
            f.write(row + "\n")
    _owned(at)
    return n


def write_register(register: DataFrame, path: str) -> None:
    """A register as a JSON file that only its owner can read: a list of clients is itself sensitive."""
    write_json(register.select("folder_name", "surnames", F.col("given").alias("given_names")), path, "foliant.register@1", "clients")


def script(plan: DataFrame, root: str, shell: str = "bash") -> DataFrame:
    """(part, doc_ord, line): the copies as a script; what needs review, or has no source, stays a comment; each folder is made once.

    ``plan`` has a column source, or the names are taken for the sources."""
    if shell == "bash":
        quote = lambda c: F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("'\\''")), F.lit("'"))
        head, make, copy, to, end = ["#!/usr/bin/env bash", "set -euo pipefail"], "mkdir -p -- ", "cp -n -- ", " ", ""
    elif shell == "powershell":
        quote = lambda c: F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))
        head, make, copy, to, end = ["$ErrorActionPreference = 'Stop'"], "New-Item -ItemType Directory -Force -Path ", "Copy-Item -LiteralPath ", " -Destination ", " | Out-Null"
    else:
        raise ValueError(f"shell is bash or powershell, not {shell!r}")
    plan = plan if "source" in plan.columns else plan.withColumn("source", F.col("name"))
    safe = lambda c: F.regexp_replace(c, r"[\r\n]+", " ")
    go = plan.filter("NOT needs_review AND source IS NOT NULL")
    dest = F.array_join(F.concat(F.array(F.lit(root)), "folder"), "/")
    first = plan.sparkSession.createDataFrame([(-1, k, line) for k, line in enumerate(head)], "part int, doc_ord long, line string")
    dirs = go.select(dest.alias("d")).distinct().select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("doc_ord"), F.concat(F.lit(make), quote(F.col("d")), F.lit(end)).alias("line"))
    moves = go.select(F.lit(1).alias("part"), "doc_ord", F.concat(F.lit(copy), quote(F.col("source")), F.lit(to), quote(F.concat_ws("/", dest, F.col("filename")))).alias("line"))
    notes = plan.filter("needs_review OR source IS NULL").select(F.lit(2).alias("part"), "doc_ord", F.concat(F.lit("# left out, "), F.when(F.col("needs_review"), F.concat(F.lit("needs review: "), safe(F.col("name")), F.lit(": "), safe(F.coalesce("rationale", F.lit(""))))).otherwise(F.concat(F.lit("no source file: "), safe(F.col("name"))))).alias("line"))
    return first.unionByName(dirs).unionByName(moves).unionByName(notes).orderBy("part", "doc_ord", "line")


def write_script(lines: DataFrame, path: str) -> None:
    at = _parent(path)
    with open(at, "w") as f:
        f.writelines(r.line + "\n" for r in lines.toLocalIterator())
    os.chmod(at, 0o700)


def digest(path: str | Path) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while piece := f.read(1 << 16):
            h.update(piece)
    return h.hexdigest()


def same_content(a: str | Path, b: str | Path) -> bool:
    """By size, then by digest."""
    return os.path.getsize(a) == os.path.getsize(b) and digest(a) == digest(b)


class Destination(ABC):
    """What a place to file in has to offer.  The same batch applied twice must not make two copies."""

    name = "abstract"

    @abstractmethod
    def apply(self, decisions: list[dict], sources: dict[str, str], dry_run: bool = True) -> list[dict]:
        """``decisions``: rows of operators.plan.decisions (its ``only`` is the operation's scope); ``sources``: source path by name.

        Returns doc_id, name, destination, action and note of each."""


class ProposalOnly(Destination):
    """A plan is a proposal: this refuses to file it."""

    name = "proposal only"

    def apply(self, decisions: list[dict], sources: dict[str, str], dry_run: bool = True) -> list[dict]:
        raise NotImplementedError("a plan is filed only through a destination, with a person's approvals")


class LocalFolder(Destination):
    """Files approved documents below a root.  Never overwrites; remembers what was filed by content id; logs every step."""

    name = "local folder"

    def __init__(self, root: str, mode: str = "copy"):
        if mode not in ("copy", "move"):
            raise ValueError(f"mode is copy or move, not {mode!r}")
        self.root, self.mode = Path(root).resolve(), mode
        self.state = self.root / "_foliant"

    def _filed(self) -> dict[str, str]:
        try:
            return json.loads((self.state / "filed.json").read_text())
        except (OSError, ValueError):
            return {}

    def apply(self, decisions: list[dict], sources: dict[str, str], dry_run: bool = True) -> list[dict]:
        filed, done = self._filed(), []
        for d in decisions:
            action, note = d["action"], d.get("note") or ""
            target = (self.root / d["destination"]).resolve()
            source = sources.get(d["name"])
            if action == "filed":
                if not target.is_relative_to(self.root):
                    action, note = "failed", "leaves the root"
                elif source is None or not os.path.exists(source):
                    # a move that was done leaves no source
                    action, note = ("already-filed", filed[d["doc_id"]]) if filed.get(d["doc_id"]) == str(target) and target.exists() else ("failed", "no source file")
                elif filed.get(d["doc_id"]) == str(target) and target.exists():
                    action, note = "already-filed", "the same content is at this path"
                elif target.exists():
                    action, note = ("already-filed", "an identical file is there") if same_content(target, source) else ("failed", "another file is there")
                    if action == "already-filed":
                        filed[d["doc_id"]] = str(target)
                elif not dry_run:
                    action, note = self._file(d, source, target)
                    if action == "filed":
                        filed[d["doc_id"]] = str(target)
            done.append({"doc_id": d["doc_id"], "name": d["name"], "destination": str(target), "action": action, "note": note})
        if not dry_run:
            self.state.mkdir(parents=True, exist_ok=True)
            (self.state / "filed.json").write_text(json.dumps(filed, indent=1, sort_keys=True))
            _owned(_owned(self.state) / "filed.json")
        return done

    def _file(self, d: dict, source: str, target: Path) -> tuple[str, str]:
        try:
            target.parent.mkdir(parents=True, exist_ok=True)
            (shutil.copy2 if self.mode == "copy" else shutil.move)(source, target)
        except OSError as error:
            return "failed", str(error)
        _owned(target.parent)
        self._log({"doc_id": d["doc_id"], "action": self.mode, "source": str(source), "destination": str(target), "sha256": digest(_owned(target))})
        return "filed", self.mode

    def _log(self, row: dict) -> None:
        self.state.mkdir(parents=True, exist_ok=True)
        with open(self.state / "audit.jsonl", "a") as f:
            f.write(json.dumps({"at": time.strftime("%Y-%m-%dT%H:%M:%S"), **row}, sort_keys=True) + "\n")
        _owned(self.state / "audit.jsonl")

    def mirror(self, done: list[dict], backup: str, region: str, allow: tuple[str, ...] = REGIONS, dry_run: bool = False) -> list[dict]:
        """Copies of filed documents under another root, checked by digest.  The region has to be named."""
        region = (region or "").strip().lower()
        if region not in allow:
            raise ValueError(f"region {region!r} is not allowed: {', '.join(allow)}")
        out = []
        for d in done:
            path = Path(d["destination"])
            if d["action"] not in ("filed", "already-filed"):
                continue
            if not path.is_relative_to(self.root):
                out.append({**d, "action": "failed", "note": "outside the root"})
                continue
            if not path.exists():
                out.append({**d, "action": "skipped", "note": "the filed document is missing"})
                continue
            to = Path(backup) / path.relative_to(self.root)
            if to.exists() and same_content(to, path):
                out.append({**d, "destination": str(to), "action": "already-filed", "note": "verified"})
                continue
            if dry_run:
                out.append({**d, "destination": str(to), "action": "mirrored", "note": "dry run"})
                continue
            to.parent.mkdir(parents=True, exist_ok=True)
            shutil.copy2(path, to)
            ok = same_content(_owned(to), path)
            out.append({**d, "destination": str(to), "action": "mirrored" if ok else "failed", "note": "verified" if ok else "the copy differs"})
        return out

    def carry_out(self, steps: Iterable[dict], dry_run: bool = True) -> list[dict]:
        """Moves within the root, in the order given (operators.moves.ordered: from, to, doc_id, blocked).  Nothing is overwritten; a step whose file is there already is done."""
        filed, out = self._filed(), []
        for s in steps:
            source, target = ((self.root / s[k]).resolve() for k in ("from", "to"))
            action, note = "filed", "dry run"
            if s.get("blocked"):
                action, note = "failed", "its place is taken by a file that stays"
            elif not (source.is_relative_to(self.root) and target.is_relative_to(self.root)):
                action, note = "failed", "leaves the root"
            elif dry_run:
                pass
            elif not source.exists():
                action, note = ("already-filed", "") if target.exists() else ("failed", "no source file")
            elif target.exists():
                action, note = "failed", "another file is there"
            else:
                action, note = self._file(s, str(source), target)
                if action == "filed":
                    filed[s["doc_id"]] = str(target)
            out.append({"doc_id": s["doc_id"], "name": s["from"], "destination": str(target), "action": action, "note": note})
        if not dry_run:
            self.state.mkdir(parents=True, exist_ok=True)
            (self.state / "filed.json").write_text(json.dumps(filed, indent=1, sort_keys=True))
            _owned(_owned(self.state) / "filed.json")
        return out

    def rollback(self, moves: list[dict], path: str) -> None:
        """Written before anything moves."""
        _parent(path).write_text(json.dumps({"schema": ROLLBACK, "root": str(self.root), "moves": moves}, indent=1))
        _owned(Path(path))

    @staticmethod
    def undo(path: str, dry_run: bool = False) -> list[dict]:
        """Moves back in reverse order; what is missing, or whose old place is taken, is left."""
        data = json.loads(Path(path).read_text())
        if data.get("schema") != ROLLBACK:
            raise ValueError(f"{path} is no rollback file")
        out = []
        for m in reversed(data["moves"]):
            there, back = Path(m["to"]), Path(m["from"])
            if not there.exists() or back.exists():
                out.append({**m, "action": "skipped", "note": "no longer there" if not there.exists() else "its old place is taken"})
                continue
            if dry_run:
                out.append({**m, "action": "undone", "note": "dry run"})
                continue
            back.parent.mkdir(parents=True, exist_ok=True)
            shutil.move(there, back)
            out.append({**m, "action": "undone"})
        return out


def grow(register: DataFrame, new_clients: DataFrame) -> DataFrame:
    """A register with confirmed new clients (``confirm`` counts as true where it is missing); folders it has already stay as they are."""
    ok = new_clients.filter(F.coalesce("confirm", F.lit(True))) if "confirm" in new_clients.columns else new_clients
    add = ok.select(F.col("family_key").alias("folder_name"), "surnames", "given").dropDuplicates(["folder_name"])
    return register.unionByName(add.join(register.select("folder_name"), "folder_name", "left_anti"))
