"""python -m foliant.cli: run the engine over a folder or a sample file; nothing is moved without an approvals file."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import report, sinks
from .kb import KnowledgeBase, Profile
from .operators import evaluate, moves as M, plan as P
from .plans import batch, evaluation
from .sources import documents as S

OK, REFUSED, BAD = 0, 1, 2


def parser() -> argparse.ArgumentParser:
    a = argparse.ArgumentParser(prog="foliant", description=__doc__)
    g = a.add_argument_group("input")
    g.add_argument("--input", help="folder of documents: one intake batch")
    g.add_argument("--samples", help="JSON file of documents")
    g.add_argument("--reorganise", help="a filed tree to propose a new filing for; it is its own register unless one is given")
    g.add_argument("--recursive", action="store_true")
    g.add_argument("--kb")
    g.add_argument("--profile", default="nested")
    g.add_argument("--threshold", type=float)
    g.add_argument("--register", help="CSV or JSON client register, or a folder of client folders")
    g = a.add_argument_group("evaluation")
    g.add_argument("--truth", help="known answers; without them nothing is scored")
    g.add_argument("--calibrate", action="store_true", help="with --truth: every threshold, in one job")
    g.add_argument("--failure-log", help="JSON-lines file to which failures are appended")
    g = a.add_argument_group("output")
    g.add_argument("--display", choices=("new", "experienced"), default="experienced")
    g.add_argument("--manifest")
    g.add_argument("--csv")
    g.add_argument("--script")
    g.add_argument("--shell", choices=("bash", "powershell"), default="bash")
    g.add_argument("--approvals-out")
    g.add_argument("--new-clients", help="where the clients that the register does not know are written, to be confirmed")
    g.add_argument("--redact", action="store_true", help="exports without names")
    g.add_argument("--salt", default="")
    g = a.add_argument_group("filing")
    g.add_argument("--approvals")
    g.add_argument("--into", help="root to file below, with --approvals")
    g.add_argument("--mode", choices=("copy", "move"), default="copy")
    g.add_argument("--commit", action="store_true", help="really file; a dry run without it")
    g.add_argument("--backup")
    g.add_argument("--backup-region")
    g.add_argument("--allow-region", action="append", default=[])
    g.add_argument("--undo", help="a rollback file")
    g.add_argument("--accept-new-clients", help="an edited --new-clients file; grows --register")
    g.add_argument("--register-out")
    a.add_argument("--list-profiles", action="store_true")
    return a


def _accept(spark: SparkSession, o) -> int:
    if not o.register:
        print("--accept-new-clients needs --register", file=sys.stderr)
        return BAD
    out = o.register_out or (o.register if o.register.endswith(".json") else None)
    if out is None:
        print("say with --register-out where the grown register goes", file=sys.stderr)
        return BAD
    schema = "clients array<struct<family_key:string,surnames:array<string>,given:array<string>,confirm:boolean>>"
    new = spark.read.schema(schema).json(o.accept_new_clients, multiLine=True).select(F.inline("clients"))
    before = S.read_register(spark, o.register)
    grown = sinks.grow(before, new).cache()
    print(f"{grown.count() - before.count()} clients added, {grown.count()} in all, written to {out}")
    sinks.write_register(grown, out)
    return OK


def _evaluate(o, result, kb: KnowledgeBase, profile: Profile, truth: DataFrame) -> None:
    compared = evaluation.compare(result, truth, kb)
    evaluation.score(compared).show(truncate=False)
    rows = evaluation.failures(compared, evaluation.run_id(), kb)
    rows.select("input", "why").show(report.SHOWN, truncate=False)
    if o.failure_log:
        print(sinks.append_log(sinks.redacted(rows, o.salt, report.vocabulary(kb)) if o.redact else rows, o.failure_log), "rows appended to", o.failure_log)
    if o.calibrate:
        for line in report.calibration(evaluation.calibrate(result.records, truth, kb, profile)):
            print(line)


def _export(o, result, failed: DataFrame | None) -> None:
    words = report.vocabulary(result.kb)
    hide = lambda frame: sinks.redacted(frame, o.salt, words) if o.redact else frame
    if o.manifest:
        sinks.write_json(hide(sinks.manifest(result, datetime.now().isoformat(), unreadable=failed)), o.manifest)
    if o.csv:
        sinks.write_csv(hide(sinks.flat(result)), o.csv)
    if o.script:
        sources = result.records.select("batch_id", "doc_ord", "source") if "source" in result.records.columns else None
        plan = result.plan.join(sources, ["batch_id", "doc_ord"]) if sources is not None else result.plan.withColumn("source", F.lit(None).cast("string"))
        sinks.write_script(sinks.script(plan, o.into or "/PATH/TO/CLIENTS", o.shell), o.script)
    if o.new_clients and result.new_clients is not None:
        sinks.write_json(result.new_clients, o.new_clients, "foliant.new-clients@1", "clients")
    if o.approvals_out:
        sinks.write_json(sinks.approvals(result), o.approvals_out, sinks.APPROVALS, filing_profile=result.profile.id, instructions=sinks.INSTRUCTIONS)


def _show(done: list[dict]) -> None:
    counts: dict[str, int] = {}
    for row in done:
        counts[row["action"]] = counts.get(row["action"], 0) + 1
        if row["action"] in ("filed", "failed", "mirrored", "undone"):
            print(row["action"], row.get("name") or row.get("doc_id") or "", "->", row.get("destination") or row.get("from"), row.get("note", ""))
    print(", ".join(f"{n} {action}" for action, n in sorted(counts.items())) or "nothing to do")


def _file(o, result, root: str, mode: str, only: DataFrame | None = None) -> int:
    spark = result.plan.sparkSession
    sources = result.records.select("batch_id", "doc_ord", "name", "source") if "source" in result.records.columns else result.records.select("batch_id", "doc_ord", "name", F.lit(None).cast("string").alias("source"))
    issues = P.preflight(result.plan, result.profile, sources=sources, root=str(Path(root).resolve()))
    issues.show(report.SHOWN, truncate=False)
    if issues.filter("level = 'error'").limit(1).count():
        print("refusing to file with errors outstanding", file=sys.stderr)
        return REFUSED
    decided = P.decisions(result.plan, S.read_approvals(spark, o.approvals), only=only).orderBy("batch_id", "doc_ord")
    paths = {r.name: r.source.removeprefix("file:").replace("///", "/") for r in sources.filter("source IS NOT NULL").toLocalIterator()}
    place = sinks.LocalFolder(root, mode)
    done = place.apply([r.asDict() for r in decided.toLocalIterator()], paths, dry_run=not o.commit)
    _show(done)
    if o.backup:
        try:
            _show(place.mirror(done, o.backup, o.backup_region or "", (*sinks.REGIONS, *o.allow_region), dry_run=not o.commit))
        except ValueError as error:
            print(f"backup refused: {error}", file=sys.stderr)
            return REFUSED
    if not o.commit:
        print("a dry run: nothing was written; --commit files")
    return OK


def _reorganise(o, result) -> int:
    moves = P.reorganise(result.plan, result.records.select("batch_id", "doc_ord", F.col("name").alias("path"))).cache()
    P.counted(moves).show()
    print("moves that change the client; read these first:")
    moves.filter("crosses_client").show(report.SHOWN, truncate=False)
    moves.filter("action <> 'keep' AND NOT crosses_client").show(report.SHOWN, truncate=False)
    if not o.approvals:
        return OK
    approved = P.approved_moves(moves, S.read_approvals(moves.sparkSession, o.approvals))
    stays = moves.join(approved.select("batch_id", "doc_ord"), ["batch_id", "doc_ord"], "left_anti").select("batch_id", "path")
    # each file goes when its place is free; a cycle's first file steps aside
    steps = [r.asDict() for r in M.ordered(approved, stays).orderBy("turn", "batch_id", "doc_ord").toLocalIterator()]
    root = Path(o.reorganise).resolve()
    place = sinks.LocalFolder(str(root), "move")
    if o.commit:
        at = root / "_foliant" / f"rollback-{evaluation.run_id()}.json"
        place.rollback([{"doc_id": s["doc_id"], "from": str(root / s["from"]), "to": str(root / s["to"])} for s in steps if not s["blocked"]], str(at))
        print(f"undo with --undo {at} --commit")
    _show(place.carry_out(steps, dry_run=not o.commit))
    if not o.commit:
        print("a dry run: nothing was written; --commit moves")
    return OK


def main(argv: list[str] | None = None) -> int:
    o = parser().parse_args(argv)
    if o.list_profiles:
        print("\n".join(Profile.available()))
        return OK
    if o.undo:
        try:
            _show(sinks.LocalFolder.undo(o.undo, dry_run=not o.commit))
        except (OSError, ValueError) as error:
            print(f"undo failed: {error}", file=sys.stderr)
            return BAD
        return OK
    if not o.accept_new_clients and sum(map(bool, (o.input, o.samples, o.reorganise))) != 1:
        print("give one of --input, --samples and --reorganise", file=sys.stderr)
        return BAD
    if o.into and not o.approvals:
        print("nothing is filed without --approvals; write a sheet with --approvals-out first", file=sys.stderr)
        return REFUSED
    try:
        kb, profile = KnowledgeBase.load(o.kb), Profile.load(o.profile)
    except (OSError, ValueError) as error:
        print(error, file=sys.stderr)
        return BAD
    if o.threshold is not None:
        kb = kb.with_threshold(o.threshold)
    spark = SparkSession.builder.getOrCreate()
    try:
        if o.accept_new_clients:
            return _accept(spark, o)
        folder = o.input or o.reorganise
        docs, failed = S.read_directory(spark, folder, o.recursive or bool(o.reorganise)) if folder else (S.read_samples(spark, o.samples), None)
        at = o.register or o.reorganise
        entries = S.read_register(spark, at) if at else None
        truth = S.read_truth(spark, o.truth) if o.truth else None
        result = batch.run(docs, kb, profile, entries)
    except (AnalysisException, OSError, ValueError) as error:
        print(f"cannot read the input: {error}", file=sys.stderr)
        return BAD
    for line in report.text(result, o.display == "new"):
        print(line)
    if failed is not None:
        failed.show(report.SHOWN, truncate=100)
    if truth is not None:
        _evaluate(o, result, kb, profile, truth)
    _export(o, result, failed)
    if o.reorganise:
        return _reorganise(o, result)
    return _file(o, result, o.into, o.mode) if o.into else OK


if __name__ == "__main__":
    sys.exit(main())
