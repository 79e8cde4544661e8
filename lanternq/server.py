"""A thin HTTP service over an engine: GET / (a page to ask from) /health /eval, POST /ask /ingest /eval; bodies up to 1 MiB, redacted log."""

from __future__ import annotations

import json
import os
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from lanternq.functions.constants import PII
from lanternq.functions.udfs import capabilities
from lanternq.operators import evaluation
from lanternq.plans.engine import Engine
from lanternq.sources import files

MAX_BODY = 1 << 20


#: The page at /: a question, the answer and its sources; texts are put in as texts, never as markup.
PAGE = """<!doctype html><html lang="en"><meta charset="utf-8"><title>Ask</title>
<style>body{font:16px sans-serif;max-width:44em;margin:2em auto}input{width:80%}li{color:#555}</style>
<form id="f"><input id="q" placeholder="Your question" autofocus> <button>Ask</button></form><p id="a"></p><ul id="s"></ul>
<script>
const at = id => document.getElementById(id), session = String(Math.random());
at("f").onsubmit = async event => {
  event.preventDefault(); at("a").textContent = "..."; at("s").textContent = "";
  const reply = await fetch("/ask", {method: "POST", body: JSON.stringify({question: at("q").value, session_id: session})});
  const said = await reply.json(); at("a").textContent = said.answer || said.error;
  for (const c of said.citations || []) { const li = document.createElement("li"); li.textContent = `[${c.marker}] ${c.label} (${c.source})`; at("s").append(li); }
};
</script></html>"""


def log_line(text: str) -> str:
    import re

    for kind, pattern in PII:
        text = re.sub(pattern, f"[{kind}_REDACTED]", text)
    return text


def handler(engine: Engine, goldset: str | None = None, allow_ingest: bool = True, log=print):
    """A request handler class; calls on the engine take turns, as its tables are replaced by writes."""
    lock = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def reply(self, status: int, body: dict | str) -> None:
            data = (body if isinstance(body, str) else json.dumps(body, default=str)).encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/html; charset=utf-8" if isinstance(body, str) else "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, form: str, *args) -> None:
            log(log_line(form % args))

        def evaluated(self) -> None:
            if not goldset:
                return self.reply(404, {"error": "no goldset"})
            with lock:
                self.reply(200, evaluation.report(engine.evaluate(files.read_goldset(engine.spark, goldset))).first().asDict())

        def do_GET(self) -> None:
            if self.path == "/health":
                c = engine.config
                about = {"status": "ok", "embedder": c.embedder, "dim": c.dim, "chunker": c.chunker, "mode": c.mode, "reranker": c.reranker, "ingest": allow_ingest, "eval": bool(goldset), "capabilities": capabilities()}
                self.reply(200, about | (engine.stats() if engine.chunks is not None else {"chunks": 0}))
            elif self.path == "/eval":
                self.evaluated()
            elif self.path == "/":
                self.reply(200, PAGE)
            else:
                self.reply(404, {"error": "not found"})

        def do_POST(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if size > MAX_BODY:
                return self.reply(400, {"error": "body too large"})
            try:
                body = json.loads(self.rfile.read(size) or b"{}")
                assert isinstance(body, dict)
            except (ValueError, AssertionError):
                return self.reply(400, {"error": "body is no JSON object"})
            if self.path == "/ask":
                question = body.get("question")
                if not isinstance(question, str) or not question.strip():
                    return self.reply(400, {"error": "question is missing"})
                with lock:
                    self.reply(200, engine.ask(question, body.get("session_id"), body.get("k")))
            elif self.path == "/ingest":
                if not allow_ingest:
                    return self.reply(403, {"error": "ingest is off"})
                paths = body.get("paths")
                if not isinstance(paths, list) or not paths or not all(isinstance(p, str) for p in paths):
                    return self.reply(400, {"error": "paths must be a list of files or folders"})
                if missing := [p for p in paths if "://" not in p and not os.path.exists(p)]:
                    return self.reply(400, {"error": f"not found: {', '.join(missing)}", "missing": missing})
                try:
                    with lock:
                        self.reply(200, engine.ingest(paths))
                except (FileNotFoundError, ValueError) as e:
                    self.reply(400, {"error": str(e)})
            elif self.path == "/eval":
                self.evaluated()
            else:
                self.reply(404, {"error": "not found"})

    return Handler


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 8080, **options) -> ThreadingHTTPServer:
    return ThreadingHTTPServer((host, port), handler(engine, **options))
