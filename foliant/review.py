"""python -m foliant.review: a page on this machine, and on it alone, to look a batch through and file what is approved.

GET / and /api/config; POST /api/run (a batch's manifest) and /api/apply (decisions; a dry run unless commit is true)."""

from __future__ import annotations

import argparse
import json
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import SparkSession

from . import sinks
from .kb import KnowledgeBase, Profile
from .operators import plan as P
from .plans import batch
from .sources import documents as S

PAGE = """<!doctype html><meta charset="utf-8"><title>Review</title>
<style>body{font:15px system-ui;max-width:60em;margin:2em auto;padding:0 1em}.bad{color:#a00}.warn{color:#a60}li{margin:.4em 0}</style>
<h1>Review</h1><p><input id="input" placeholder="folder"> <select id="profile"></select> <button onclick="go()">Read</button></p>
<p><input id="dest" placeholder="file below"> <button onclick="file(false)">Try</button> <button onclick="file(true)">File</button></p><ul id="list"></ul><pre id="out"></pre>
<script>
const $ = id => document.getElementById(id), post = async (at, body) => (await fetch(at, {method: 'POST', body: JSON.stringify(body)})).json();
const asked = () => ({input: $('input').value, profile: $('profile').value}), decided = {};
fetch('/api/config').then(r => r.json()).then(c => { c.profiles.forEach(p => $('profile').add(new Option(p))); $('input').value = c.input; });
async function go() {
  const m = await post('/api/run', asked());
  if (m.error) { $('out').textContent = m.error; return; }
  $('list').replaceChildren(...m.documents.map(d => {
    const li = document.createElement('li'), box = document.createElement('input'), text = document.createElement('span');
    box.type = 'checkbox'; box.disabled = d.needs_review; box.onchange = () => decided[d.doc_id] = box.checked ? 'approve' : 'reject';
    text.className = d.needs_review ? 'bad' : d.flags.length ? 'warn' : '';
    text.textContent = ` ${d.source_name} -> ${d.destination.path} ` + d.flags.map(f => f.message).join('; ');
    li.append(box, text); return li; }));
}
async function file(commit) { const r = await post('/api/apply', {...asked(), dest: $('dest').value, decisions: decided, commit}); $('out').textContent = r.error || r.detail.join('\\n'); }
</script>"""


class State:
    """What the page works on: an input folder or a sample file."""

    def __init__(self, spark: SparkSession, folder: str = "", samples: str | None = None, register: str | None = None, kb: KnowledgeBase | None = None):
        self.spark, self.folder, self.samples, self.register, self.kb = spark, folder, samples, register, kb or KnowledgeBase.load()

    def run(self, asked: dict) -> tuple[batch.Result, dict[str, str]]:
        folder = asked.get("input") or self.folder
        if not folder and not self.samples:
            raise ValueError("choose a folder of documents")
        docs = S.read_directory(self.spark, folder)[0] if folder else S.read_samples(self.spark, self.samples)
        entries = S.read_register(self.spark, self.register) if self.register else None
        result = batch.run(docs, self.kb, Profile.load(asked.get("profile") or "nested"), entries)
        paths = {r.name: r.source.removeprefix("file:").replace("///", "/") for r in docs.select("name", "source").toLocalIterator() if r.source}
        return result, paths

    def config(self) -> dict:
        return {"profiles": Profile.available(), "descriptions": {p: Profile.load(p).description for p in Profile.available()}, "input": self.folder}

    def manifest(self, asked: dict) -> dict:
        rows = [json.loads(r) for r in sinks.manifest(self.run(asked)[0]).toJSON().toLocalIterator()]
        return rows[0] if rows else {"error": "no readable documents"}

    def apply(self, asked: dict) -> dict:
        """Filing reads the documents anew: what is filed is what is there now."""
        if not (asked.get("dest") or "").strip():
            raise ValueError("choose a folder to file below")
        result, paths = self.run(asked)
        errors = P.preflight(result.plan, result.profile, root=asked["dest"]).filter("level = 'error'").limit(20).collect()
        if errors:
            raise ValueError("; ".join(f"{r.issue}: {r.detail}" for r in errors))
        rows = [(k, v, None, None) for k, v in (asked.get("decisions") or {}).items()]
        said = self.spark.createDataFrame(rows, "doc_id string, decision string, folder string, filename string")
        decided = P.decisions(result.plan, said).orderBy("batch_id", "doc_ord")
        done = sinks.LocalFolder(asked["dest"]).apply([r.asDict() for r in decided.toLocalIterator()], paths, dry_run=not asked.get("commit"))
        return {"detail": [f"{d['action']} {d['name']} {d['destination']} {d['note']}" for d in done if d["action"] in ("filed", "already-filed", "failed")]}


def handler(state: State) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args) -> None:
            pass

        def _send(self, code: int, body: str, kind: str = "application/json") -> None:
            raw = body.encode()
            self.send_response(code)
            for k, v in (("Content-Type", f"{kind}; charset=utf-8"), ("Content-Length", str(len(raw))), ("X-Frame-Options", "DENY"), ("Content-Security-Policy", "default-src 'self' 'unsafe-inline'")):
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:
            if self.path in ("/", "/index.html"):
                self._send(200, PAGE, "text/html")
            elif self.path == "/api/config":
                self._send(200, json.dumps(state.config()))
            else:
                self._send(404, json.dumps({"error": "not found"}))

        def do_POST(self) -> None:
            act = {"/api/run": state.manifest, "/api/apply": state.apply}.get(self.path)
            if act is None:
                return self._send(404, json.dumps({"error": "not found"}))
            try:
                self._send(200, json.dumps(act(json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}"))))
            except Exception as error:  # shown on the page
                self._send(400, json.dumps({"error": str(error)}))

    return Handler


def serve(state: State, port: int = 8765) -> HTTPServer:
    """On the loopback address only."""
    return HTTPServer(("127.0.0.1", port), handler(state))


def main(argv: list[str] | None = None) -> int:
    a = argparse.ArgumentParser(prog="foliant.review", description=__doc__)
    a.add_argument("--input", default="")
    a.add_argument("--samples")
    a.add_argument("--register")
    a.add_argument("--port", type=int, default=8765)
    o = a.parse_args(argv)
    server = serve(State(SparkSession.builder.getOrCreate(), o.input, o.samples, o.register), o.port)
    print(f"http://127.0.0.1:{server.server_address[1]}/ (this machine only)")
    server.serve_forever()
    return 0


if __name__ == "__main__":
    main()
