from __future__ import annotations

import json
import threading
import urllib.error
import urllib.request
from datetime import date, timedelta

import pytest

import __spark_entry__
from seriesloom.__main__ import main
from seriesloom.plans import plots
from seriesloom.plans.server import make_server
from seriesloom.sources import tables


@pytest.fixture
def server(spark):
    s = make_server(spark, port=0, api_key="secret")
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_address[1]}"
    s.shutdown()


def post(url, body, key="secret"):
    request = urllib.request.Request(url, data=body if isinstance(body, bytes) else json.dumps(body).encode(), headers={"X-API-Key": key}, method="POST")
    try:
        with urllib.request.urlopen(request) as r:
            return r.status, json.loads(r.read())
    except urllib.error.HTTPError as e:
        return e.code, json.loads(e.read())


def test_http_contract(server):
    with urllib.request.urlopen(f"{server}/health") as r:
        assert r.status == 200 and json.loads(r.read())["status"] == "healthy"
    data = [{"date": (date(2024, 1, 7) + timedelta(7 * i)).isoformat(), "product": p, "sales": 10 + i % 4 + n} for n, p in enumerate("ab") for i in range(30)]
    request = {"data": data, "date_col": "date", "group_cols": ["product"], "signal_cols": ["sales"], "freq": "W", "horizon": 2, "model": "LR", "lags": [1, 2], "fe_window_size": [2, 4]}
    status, out = post(f"{server}/forecast", request)
    assert status == 200 and out["status"] == "success" and "RMSE" in out["metrics"] and out["execution_time"] > 0
    assert all(r["prediction"] is not None for r in out["predictions"])
    assert post(f"{server}/forecast", request, "wrong")[0] == 403
    assert post(f"{server}/forecast", {"data": []})[0] == 500
    assert post(f"{server}/forecast", b"{")[0] == 422
    assert post(f"{server}/elsewhere", {})[0] == 404


def test_rest_sink(spark):
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_DELETE(self):
            seen.append("clear")
            self.send_response(204)
            self.end_headers()

        def do_POST(self):
            seen.append(len(json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            self.send_response(201)
            self.end_headers()

        def log_message(self, *args):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    tables.write_rest(spark.range(25).coalesce(1), f"http://127.0.0.1:{s.server_address[1]}/", size=10)
    s.shutdown()
    assert seen == ["clear", 10, 10, 5]


def test_plot_frames(spark):
    df = tables.generate_sample(spark, "MS", 6)
    assert plots.series_lines(df, "date", "store", "sales").count() == 12
    if plots.plt is None:
        with pytest.raises(RuntimeError):
            plots.draw_lines(df, "date", ["sales"])


def test_command_line(spark, tmp_path, capsys):
    main(["--freq", "MS", "--horizon", "2", "--model", "LR", "--output", str(tmp_path)])
    assert "RMSE" in capsys.readouterr().out
    wide = tables.read_csv(spark, str(tmp_path / "metrics"))
    assert wide.count() == 3 and wide.columns == ["model", *tables.METRICS]


def test_entry_points():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 50
