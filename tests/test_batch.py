import json
import subprocess

import pytest
from pyspark.sql import functions as F

from foliant import cli, sinks
from foliant.kb import KnowledgeBase, Profile
from foliant.operators import classify, flags, plan
from foliant.plans import batch, evaluation
from foliant.shared import written
from foliant.sources import documents as S


@pytest.fixture(scope="module")
def samples(spark, fixtures):
    return S.read_samples(spark, str(fixtures / "samples.json"))


@pytest.fixture(scope="module")
def result(samples):
    return batch.run(samples)


def test_every_sample_matches_its_label(spark, result, fixtures):
    compared = evaluation.compare(result, S.read_truth(spark, str(fixtures / "truth.json")))
    assert [(r.name, r.why) for r in compared.filter("NOT ok").collect()] == []
    got = evaluation.score(compared).first()
    assert (got.n, got.n_wrong, got.n_filed, got.n_ok, got.n_confident_and_wrong) == (10, 0, 8, 10, 0)
    assert evaluation.failures(compared, evaluation.run_id(), KnowledgeBase.load()).count() == 0


def test_a_step_of_the_calibration_is_a_run_at_that_threshold(spark, samples, result, fixtures):
    truth, kb = S.read_truth(spark, str(fixtures / "truth.json")), KnowledgeBase.load()
    swept = {r.step: r for r in evaluation.calibrate(result.records, truth, kb, materialise=written).collect()}
    assert sorted(swept) == list(range(20)) and swept[0].n == 10
    for step in (18,):
        k = kb.with_threshold(step / 20)
        alone = evaluation.score(evaluation.compare(batch.run(samples, k), truth, k)).first()
        got = swept[step]
        assert (got.n, got.n_filed, got.n_wrong, got.n_ok) == (alone.n, alone.n_filed, alone.n_confident_and_wrong, alone.n_ok)
    assert swept[19].n_filed < swept[12].n_filed  # anchors below the threshold take their events with them


def test_event_folders(result):
    folders = {"/".join(r.folder) for r in result.plan.filter("kind = 'event_document'").collect()}
    assert folders == {"Nguyen/2024-03 — Retirement & Super Consolidation [SOA]", "Nguyen/2025-09 — Insurance [ROA · further advice]"}


def test_plan_is_total_and_free_of_collisions(samples, result):
    assert result.plan.count() == samples.count()
    assert plan.preflight(result.plan, Profile.load()).count() == 0


def test_lookalike_by_a_wide_margin(result):
    s = {x.type: x.score for x in result.records.filter("name = 'a05.pdf'").first().scores}
    assert s["authority_to_proceed"] > 3 * s["soa"] and s["car"] == 0


def test_order_and_partitions_do_not_matter(samples, result):
    pick = lambda r: sorted((x.name, x.kind, tuple(x.folder), x.filename) for x in r.plan.collect())
    assert pick(batch.run(samples.orderBy(F.col("doc_ord").desc()).repartition(5))) == pick(result)


@pytest.mark.parametrize("profile", ["flat", "web-safe", "keep-names"])
def test_profiles_change_paths_alone(samples, result, profile):
    got = batch.run(samples, profile=Profile.load(profile))
    pick = lambda r: sorted((x.name, x.kind) for x in r.plan.collect())
    assert pick(got) == pick(result)
    if profile == "web-safe":
        assert all(("/".join(x.folder) + x.filename).isascii() for x in got.plan.collect())


def test_batches_do_not_mix(samples, result):
    two = samples.withColumn("batch_id", F.lit("one")).unionByName(samples.withColumn("batch_id", F.lit("two")))
    got = batch.run(two).plan
    assert got.filter("batch_id = 'two'").count() == 10
    assert sorted(tuple(x.folder) for x in got.filter("batch_id = 'one'").collect()) == sorted(tuple(x.folder) for x in result.plan.collect())


def test_register_decides_the_folder(spark, samples):
    entries = S.register_from_names(spark.createDataFrame([("Nguyen, Linh & David",), ("Nguyen, Bao",)], "folder_name string"))
    got = batch.run(samples, entries=entries)
    assert {x.family_key for x in got.plan.filter("kind = 'event_document' AND family_key IS NOT NULL").collect()} == {"Nguyen, Linh & David"}
    assert [x.family_key for x in got.new_clients.collect()] == ["Patel"]


def test_rules(samples):
    kb = KnowledgeBase.load()
    assert set(flags.coverage(kb, list(flags.RULES)).values()) == {"implemented"}
    with pytest.raises(KeyError):
        kb.rule("no such rule")
    with pytest.raises(ValueError):
        Profile.load("no such profile")


def test_a_new_advice_type_needs_no_code(spark):
    data = json.loads(json.dumps(KnowledgeBase.load().data))
    data["documents"].append({"id": "letter", "name": "Advice Letter", "category": "advice", "advice_record_role": True, "requires_date": True, "classifier_hints": {"title_patterns": ["letter of advice"], "structural_signals": ["we advise you"], "key_fields": ["date"]}})
    text = "LETTER OF ADVICE. Client: Mei Tran. We advise you to keep what you have, for the reasons that we set out in this letter to you. Date: 3 May 2024."
    docs = spark.createDataFrame([("b", "x.pdf", "x.pdf", text, 1, 1)], "batch_id string, path string, name string, text string, page_count int, doc_ord long")
    assert batch.run(docs, KnowledgeBase(data)).events.first().anchor_type == "letter"


def test_exports(spark, result, tmp_path):
    m = sinks.manifest(result).first()
    assert m.schema == sinks.MANIFEST and len(m.documents) == 10 and len(m.events) == 2
    assert m.batch.documents == 10 and m.batch.auto_filed == 8 and m.batch.needs_review == 2 and m.filing_profile == "nested"
    assert {len(e.member_doc_ids) for e in m.events} == {5, 2} and all(d.classification_evidence for d in m.documents)
    assert sinks.flat(result).columns == list(sinks.COLUMNS) and len(sinks.COLUMNS) == 14
    sinks.write_csv(sinks.flat(result), str(tmp_path / "x" / "flat.csv"))
    assert len((tmp_path / "x" / "flat.csv").read_text().splitlines()) == 11
    assert {r.decision for r in sinks.approvals(result).collect()} == {"pending", "reject"}
    for shell, copy in (("bash", "cp -n"), ("powershell", "Copy-Item")):
        lines = [r.line for r in sinks.script(result.plan, "/it's", shell).collect()]
        assert sum(x.startswith(copy) for x in lines) == 8 and sum(x.startswith("# left out, needs review") for x in lines) == 2
    sinks.write_script(sinks.script(result.plan, str(tmp_path / "it's")), str(tmp_path / "go.sh"))
    assert subprocess.run(["bash", "-n", str(tmp_path / "go.sh")]).returncode == 0
    words = ["Retirement", "Super", "Consolidation", "SOA", "ROA", "Insurance"]
    for safe in (sinks.redacted(sinks.documents(result).drop("event"), "salt", words), sinks.redacted(sinks.manifest(result), "salt", words)):
        assert not any("Nguyen" in str(r.asDict(recursive=True)) or "Patel" in str(r.asDict(recursive=True)) for r in safe.collect())
    assert sinks.append_log(result.plan.select("name"), str(tmp_path / "log.jsonl")) == 10 == sinks.append_log(result.plan.select("name"), str(tmp_path / "log.jsonl"))
    assert len((tmp_path / "log.jsonl").read_text().splitlines()) == 20
    assert [r.type for r in result.missing_references.collect()] == [] and result.unanchored.count() == 1
    assert result.needing_review.count() == 2 and result.flagged.count() == 3


def test_filing_is_dry_and_idempotent_and_never_overwrites(tmp_path):
    src = tmp_path / "in.txt"
    src.write_text("x")
    root = sinks.LocalFolder(str(tmp_path / "root"))
    row = {"doc_id": "d", "name": "in.txt", "destination": "A/x.txt", "action": "filed"}
    go = lambda dry: root.apply([row], {"in.txt": str(src)}, dry_run=dry)[0]["action"]
    assert go(True) == "filed" and not (tmp_path / "root/A/x.txt").exists()
    assert go(False) == "filed" and go(False) == "already-filed"
    other = dict(row, doc_id="e")
    src.write_text("y")
    assert root.apply([other], {"in.txt": str(src)}, dry_run=False)[0]["action"] == "failed"
    assert root.apply([dict(row, doc_id="f", destination="../../z")], {"in.txt": str(src)}, dry_run=False)[0]["action"] == "failed"
    with pytest.raises(ValueError):
        root.mirror([], str(tmp_path / "b"), "us-east-1")
    done = [{"doc_id": "d", "name": "in.txt", "destination": str(tmp_path / "root/A/x.txt"), "action": "filed", "note": ""}]
    assert root.mirror(done, str(tmp_path / "b"), "ap-southeast-2")[0]["action"] == "mirrored"
    moved = tmp_path / "root/A/x.txt"
    root.rollback([{"from": str(tmp_path / "back.txt"), "to": str(moved)}], str(tmp_path / "r.json"))
    assert root.undo(str(tmp_path / "r.json"))[0]["action"] == "undone" and (tmp_path / "back.txt").exists()


def test_directory_source(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello  there")
    (tmp_path / "b.xls").write_text("x")
    (tmp_path / ".c.txt").write_text("x")
    (tmp_path / "bad.docx").write_text("no zip")
    docs, failed = S.read_directory(spark, str(tmp_path))
    assert [(r.name, r.text, r.doc_ord) for r in docs.collect()] == [("a.txt", "hello there", 1)]
    assert sorted(r.name for r in failed.collect()) == ["b.xls", "bad.docx"]


def test_registers(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Client Name,Surname\n\"Nguyen, Linh & David\",\n,Patel\n".replace("Client Name", "client_name"))
    got = S.register_from_csv(spark, str(tmp_path / "r.csv")).collect()
    assert [(r.folder_name, r.surnames, r.given) for r in got] == [("Nguyen, Linh & David", ["Nguyen"], ["Linh", "David"])]
    (tmp_path / "r.json").write_text(json.dumps({"clients": [{"folder_name": "Mei Tran"}]}))
    assert S.register_from_json(spark, str(tmp_path / "r.json")).first().surnames == ["Tran"]


def test_stream(spark, tmp_path, fixtures):
    from foliant.streaming.intake import intake

    (tmp_path / "in").mkdir()
    for d in json.loads((fixtures / "samples.json").read_text())["documents"][:4]:
        (tmp_path / "in" / d["file"].replace("pdf", "txt")).write_text(d["text"])
    seen = []
    q = intake(spark, str(tmp_path / "in"), lambda r, n: seen.extend(x.kind for x in r.plan.collect()), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert len(seen) == 4


def test_cli(fixtures, capsys):
    assert cli.main(["--list-profiles"]) == 0
    assert cli.main([]) == 2
    assert cli.main(["--samples", "x", "--profile", "none"]) == 2


def test_nothing_leaves_this_machine():
    """No module can send; one listens, on the loopback address."""
    import pathlib
    import re

    root = pathlib.Path(__file__).parent.parent / "foliant"
    sends = re.compile(r"^\s*(?:import|from)\s+(?:socket|urllib|http\.client|http\s|requests|httpx|aiohttp|ftplib|smtplib|telnetlib|xmlrpc|websockets?|boto3)\b", re.M)
    listens = re.compile(r"^\s*(?:import|from)\s+(?:http\.server|socketserver|wsgiref)\b", re.M)
    assert [p.name for p in root.rglob("*.py") if sends.search(p.read_text())] == []
    assert [p.name for p in root.rglob("*.py") if listens.search(p.read_text())] == ["review.py"]
    assert "127.0.0.1" in (root / "review.py").read_text() and "0.0.0.0" not in (root / "review.py").read_text()


def test_review_page(spark, fixtures, tmp_path):
    import threading
    import urllib.error
    import urllib.request

    from foliant import review

    server = review.serve(review.State(spark, samples=str(fixtures / "samples.json")), 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_address[1]}"
    ask = lambda path, body: json.loads(urllib.request.urlopen(urllib.request.Request(at + path, json.dumps(body).encode())).read())
    assert b"<h1>Review" in urllib.request.urlopen(at + "/").read()
    assert "nested" in json.loads(urllib.request.urlopen(at + "/api/config").read())["profiles"]
    m = ask("/api/run", {})
    assert len(m["documents"]) == 10
    got = ask("/api/apply", {"dest": str(tmp_path), "decisions": {m["documents"][0]["doc_id"]: "approve"}})
    assert len(got["detail"]) == 1 and "no source file" in got["detail"][0]
    for path, code in (("/api/apply", 400), ("/none", 404)):
        with pytest.raises(urllib.error.HTTPError) as failed:
            ask(path, {})
        assert failed.value.code == code
    server.shutdown()


def test_cli_reads_exports_and_files(spark, fixtures, tmp_path, capsys):
    docs = json.loads((fixtures / "samples.json").read_text())["documents"]
    (tmp_path / "in").mkdir()
    for d in docs:
        (tmp_path / "in" / d["file"].replace("pdf", "txt")).write_text(d["text"])
    out = lambda name: str(tmp_path / "out" / name)
    base = ["--input", str(tmp_path / "in")]
    assert cli.main([*base, "--manifest", out("m.json"), "--csv", out("x.csv"), "--script", out("x.sh"), "--approvals-out", out("a.json"), "--redact"]) == 0
    assert "Nguyen" not in (tmp_path / "out/m.json").read_text() and (tmp_path / "out/m.json").stat().st_mode & 0o777 == 0o600
    sheet = json.loads((tmp_path / "out/a.json").read_text())
    assert cli.main([*base, "--into", out("filed")]) == 1  # no approvals
    for item in sheet["items"]:
        item["decision"] = "approve" if item["decision"] == "pending" else "reject"
    sheet["items"].append({**sheet["items"][0], "decision": "reject"})  # the last of several counts
    (tmp_path / "out/a.json").write_text(json.dumps(sheet))
    files = lambda: sorted(p.name for p in (tmp_path / "out/filed").rglob("*.txt"))
    filing = [*base, "--into", out("filed"), "--approvals", out("a.json")]
    assert cli.main([*filing, "--commit", "--backup", out("backup"), "--backup-region", "au"]) == 0
    first = files()
    assert len(first) == 7 and sorted(p.name for p in (tmp_path / "out/backup").rglob("*.txt")) == first


def test_register_from_folders_and_growth(spark, tmp_path):
    for name in ("Nguyen, Linh & David", "Smith-Jones", "_Review", ".x"):
        (tmp_path / "reg" / name).mkdir(parents=True)
    got = {r.folder_name: (r.surnames, r.given) for r in S.read_register(spark, str(tmp_path / "reg")).collect()}
    assert got == {"Nguyen, Linh & David": (["Nguyen"], ["Linh", "David"]), "Smith-Jones": (["Smith", "Jones"], [])}
    new = {"clients": [{"family_key": "Patel", "surnames": ["Patel"], "given": ["Anish"], "confirm": True}, {"family_key": "Wu", "surnames": ["Wu"], "given": [], "confirm": False}]}
    (tmp_path / "new.json").write_text(json.dumps(new))
    assert cli.main(["--accept-new-clients", str(tmp_path / "new.json"), "--register", str(tmp_path / "reg"), "--register-out", str(tmp_path / "out.json")]) == 0
    assert sorted(r.folder_name for r in S.read_register(spark, str(tmp_path / "out.json")).collect()) == ["Nguyen, Linh & David", "Patel", "Smith-Jones"]


def test_destinations_and_classifiers_are_interfaces(samples):
    with pytest.raises(NotImplementedError):
        sinks.ProposalOnly().apply([], {})
    with pytest.raises(TypeError):
        sinks.Destination()

    class Blind(classify.Classifier):
        def apply(self, documents):
            return classify.Keywords(KnowledgeBase.load()).apply(documents.withColumn("text", F.lit("")))

    assert {r.doc_type for r in batch.run(samples, classifier=Blind()).records.collect()} == {None}
    assert set(S.backends()) == {"pypdf", "pdfplumber"}


def test_reports(spark, result):
    from foliant import report

    assert [r.rule_id for r in report.findings(result).collect()] == ["atp_without_advice_record", "unknown_type", "risk_mismatch"]
    assert {tuple(r.missing) for r in report.completeness(result).collect()} == {(), ("fact_find", "risk_profile")}
    assert report.tree(result).collect()[-1].folder.startswith("_")
    assert "Super" in report.vocabulary(KnowledgeBase.load())
    lines = list(report.text(result, new_to_industry=True))
    assert "all implemented" in lines and sum(x.startswith("[review]") for x in lines) == 2
    assert {r.state for r in report.states(sinks.documents(result)).collect()} == {"ok", "warn", "bad"}
    assert report.summary(result.plan).first().n_documents == 10


def test_reorganise(spark, result):
    current = result.plan.select("batch_id", "doc_ord", F.when(F.col("name") == "a04.pdf", F.concat_ws("/", F.concat_ws("/", "folder"), "filename")).when(F.col("name") == "a02.pdf", F.lit("Patel/x.pdf")).otherwise(F.concat(F.lit("Nguyen/"), F.col("name"))).alias("path"))
    got = {r.doc_ord: (r.action, r.crosses_client) for r in plan.reorganise(result.plan, current).collect()}
    assert got[4] == ("keep", False) and got[2] == ("move", True) and got[3] == ("move", False) and got[9][0] == "leave"


def test_register_grows(spark):
    reg = S.register_from_names(spark.createDataFrame([("Mei Tran",)], "folder_name string"))
    new = spark.createDataFrame([("Mei Tran", ["Tran"], ["Mei"], True), ("Patel", ["Patel"], ["Anish"], None), ("Wu", ["Wu"], [], False)], "family_key string, surnames array<string>, given array<string>, confirm boolean")
    assert sorted(r.folder_name for r in sinks.grow(reg, new).collect()) == ["Mei Tran", "Patel"]
