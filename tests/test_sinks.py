"""Sinks that take every row once, whatever fails on the way."""

from __future__ import annotations

import json
import os
import subprocess
import sys
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from seriesloom.sources import tables


class Service:
    """Takes lists of rows under idempotency keys, by load; fails where it is told to."""

    def __init__(self, fail=lambda post: False):
        self.rows, self.posts, self.told = {}, 0, []
        service = self

        class Handler(BaseHTTPRequestHandler):
            def answer(self, code):
                self.send_response(code)
                self.end_headers()

            def body(self):
                return json.loads(self.rfile.read(int(self.headers["Content-Length"])))

            def do_POST(self):
                rows = self.body()
                service.posts += 1
                service.rows[self.headers["Idempotency-Key"]] = rows  # even where the answer is lost
                self.answer(500 if fail(service.posts) else 201)

            def do_PUT(self):
                service.told.append(("keep", self.body()["rows"]))
                self.answer(200)

            def do_DELETE(self):
                service.told.append(("forget", self.headers["X-Load"]))
                service.rows.clear()
                self.answer(204)

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_address[1]}/"

    def ids(self):
        return sorted(r["id"] for rows in self.rows.values() for r in rows)


def test_a_failing_attempt_leaves_exactly_the_rows_wanted(tmp_path):
    """Tasks fail after they have sent some lists; their next attempts send the same lists under the same keys."""
    service = Service(lambda n: n in (2, 5, 9))
    script = f"""
from pyspark.sql import SparkSession
from seriesloom.sources import tables
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
spark.sparkContext.setLogLevel("OFF")
tables.write_rest(spark.range(0, 100, 1, 3), {service.url!r}, size=10, two_phase=True)
"""
    root = Path(__file__).resolve().parent.parent
    subprocess.run([sys.executable, "-c", script], check=True, timeout=180, env=os.environ | {"PYTHONPATH": f"{root}:{os.environ.get('PYTHONPATH', '')}"}, capture_output=True)
    service.server.shutdown()
    assert service.ids() == list(range(100)) and service.posts > 12
    assert service.told[0][0] == "forget" and service.told[-1] == ("keep", 100)


def test_a_load_that_fails_for_good_is_forgotten(spark):
    service = Service(lambda n: n == 3)  # the session's tasks have one attempt
    with pytest.raises(Exception):
        tables.write_rest(spark.range(0, 40, 1, 1), service.url, size=10, clear=False, two_phase=True)
    service.server.shutdown()
    assert service.ids() == [] and [t[0] for t in service.told] == ["forget"] and service.told[0][1]


def test_rows_reach_a_service_with_their_values(spark):
    service = Service()
    df = spark.sql("SELECT 1L AS id, DATE'2024-01-02' AS date, CAST(NULL AS DOUBLE) AS x, ARRAY(1, 2) AS a, NAMED_STRUCT('k', 'v') AS s")
    tables.write_rest(df, service.url, {"X-Token": "t"})
    service.server.shutdown()
    assert list(service.rows.values()) == [[{"id": 1, "date": "2024-01-02", "x": None, "a": [1, 2], "s": {"k": "v"}}]]


def test_a_table_of_a_database_is_replaced_as_a_whole(spark):
    url = "jdbc:derby:memory:panel;create=true"
    first = spark.range(20).select("id", F.concat(F.lit("n"), "id").alias("name"), F.lit(1.5).alias("x"))
    tables.write_jdbc(first, url, "PANEL")
    read = lambda: sorted(map(tuple, spark.read.jdbc(url, "PANEL").collect()))
    assert read() == sorted(map(tuple, first.collect()))
    tables.write_jdbc(first.where("id < 3").withColumn("x", F.lit(2.5)), url, "PANEL")
    assert [(r[0], r[2]) for r in read()] == [(0, 2.5), (1, 2.5), (2, 2.5)]
    bad = first.withColumn("x", F.when(F.col("id") < 19, F.lit(1.0)).otherwise(F.raise_error(F.lit("no"))))
    with pytest.raises(Exception):
        tables.write_jdbc(bad, url, "PANEL")
    assert len(read()) == 3  # as it was
    left = spark.read.jdbc(url, "(SELECT TABLENAME AS t FROM SYS.SYSTABLES WHERE TABLETYPE = 'T') q").collect()
    assert [r[0] for r in left] == ["PANEL"]  # no staging table stays
