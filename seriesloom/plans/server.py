"""The forecast facade over HTTP: GET /health and POST /forecast, with an optional key."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from seriesloom.plans.pipeline import forecast, health


def make_server(spark: SparkSession, host: str = "127.0.0.1", port: int = 8000, api_key: str | None = None) -> ThreadingHTTPServer:
    """A server that is ready to ``serve_forever()``; requests without the key get 403, failed forecasts 500."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, body: dict) -> None:
            data = json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:  # noqa: N802
            if self.path == "/health":
                self.answer(200, health() | {"timestamp": datetime.now(timezone.utc).isoformat()})
            else:
                self.answer(404, {"detail": "not found"})

        def do_POST(self) -> None:  # noqa: N802
            if self.path != "/forecast":
                return self.answer(404, {"detail": "not found"})
            if api_key and self.headers.get("X-API-Key") != api_key:
                return self.answer(403, {"detail": "wrong key"})
            try:
                request = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))
            except ValueError:
                return self.answer(422, {"detail": "no JSON"})
            began = datetime.now(timezone.utc)
            out = forecast(spark, request)
            out["execution_time"] = (datetime.now(timezone.utc) - began).total_seconds()
            self.answer(200 if out["status"] == "success" else 500, out)

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
