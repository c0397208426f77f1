"""HTTP front of a runner: /health, /metrics (text figures) and /state (point reads with an API key)."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

from .ops import state_response
from .runner import Runner


def figures(runner: Runner) -> str:
    """Totals and the last batch as lines `name{labels} value`."""
    rows, lines = runner.metrics, []
    for name in ("events", "admitted", "filtered", "malformed", "key_mismatch", "sessions", "sessions_on_several_partitions"):
        lines.append(f"keyfold_{name}_total {sum(m.get(name) or 0 for m in rows)}")
    for s in runner.transformer.streams:
        lines.append(f'keyfold_deltas_total{{topic="{s.topic}"}} {sum(m.get(f"deltas to {s.topic}") or 0 for m in rows)}')
    if rows:
        lines.append(f"keyfold_batch_seconds {rows[-1]['seconds']}")
        for place, lag in sorted(rows[-1]["lag"].items()):
            topic, _, partition = place.rpartition(":")
            lines.append(f'keyfold_lag_seconds{{topic="{topic}",partition="{partition}"}} {lag}')
    return "\n".join([*lines, f"keyfold_batches_total {len(rows)}"]) + "\n"


def serve(runner: Runner, api_key: str, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server that is not started yet (`serve_forever`); port 0 takes a free one."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802  the name that http.server asks for
            url = urlsplit(self.path)
            if url.path == "/health":
                self._say(200, "ok")
            elif url.path == "/metrics":
                self._say(200, figures(runner))
            elif url.path == "/state":
                status, body = state_response(runner.state, runner.schema.id_type, dict(parse_qsl(url.query)), self.headers.get("X-Api-Key"), api_key)
                self._say(status, json.dumps(body), "application/json")
            else:
                self._say(404, "not found")

        def _say(self, status: int, text: str, kind: str = "text/plain; charset=utf-8") -> None:
            raw = text.encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
