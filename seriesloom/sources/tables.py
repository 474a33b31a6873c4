"""Where panels come from and where results go."""

from __future__ import annotations

import json
import urllib.request
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import suppress
from dataclasses import dataclass
from datetime import date
from pathlib import PurePosixPath
from typing import Any

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from seriesloom.checkpoints import materialize
from seriesloom.functions.frequency import Frequency, frequency_params
from seriesloom.operators.metrics import METRICS


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header; types are inferred without a schema (one more pass over the file)."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, ORC, JSON or CSV by the file's ending; Parquet without one."""
    kind = PurePosixPath(path).suffix.lstrip(".")
    if kind == "csv":
        return read_csv(spark, path)
    return spark.read.format(kind if kind in ("orc", "json") else "parquet").load(path)


def from_records(spark: SparkSession, records: Sequence[dict], date_col: str, schema: StructType | str | None = None) -> DataFrame:
    """A list of dicts as a DataFrame with its date column parsed; absent fields are NULL."""
    if schema is None:
        fields = list(dict.fromkeys(k for r in records for k in r))
        rows = [Row(**{f: float(r[f]) if isinstance(r.get(f), int) and not isinstance(r[f], bool) else r.get(f) for f in fields}) for r in records]
        df = spark.createDataFrame(rows)
    else:
        df = spark.createDataFrame(records, schema)
    return df.withColumn(date_col, F.to_date(F.col(date_col)))


def generate_sample(spark: SparkSession, freq: str = "D", periods: int | None = None, end: date = date(2024, 12, 29), products: int = 5, stores: int = 2, seed: int = 42, start: date | None = None) -> DataFrame:
    """Seasonal series of products and stores with trend, noise and calendar effects, ending on the grid at or before ``end``, or from ``start`` on.

    The noise hangs on the key and the period, so that a seed gives the same panel in any partitioning.
    """
    f, n = Frequency.parse(freq), periods or frequency_params(freq)["periods"]
    span = {"D": n * f.step + 7, "B": 2 * n + 14, "W": 7 * n + 14}.get(f.kind, 31 * n * {"Q": 3, "Y": 12}.get(f.kind, 1) + 62)
    grid = f.grid(F.lit(start), F.date_add(F.lit(start), span)) if start else f.grid(F.date_sub(F.lit(end), span), F.lit(end))
    dates = spark.range(1).select(F.slice(grid, 1 if start else -n, n).alias("d"))
    t = dates.select(F.posexplode("d").alias("t", "date"))
    keys = spark.range(products * stores).select(
        F.format_string("P%03d", F.floor(F.col("id") / stores) + 1).alias("product"), F.format_string("S%02d", F.col("id") % stores + 1).alias("store"), "id"
    )
    rows = keys.crossJoin(F.broadcast(t))  # the dates of one series
    u = lambda name: (F.pmod(F.xxhash64("id", "t", F.lit(seed), F.lit(name)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    normal = lambda name: F.sqrt(-2 * F.ln(u(name + "a"))) * F.cos(6.283185307179586 * u(name + "b"))
    cycle = {"D": 365.25, "W": 52.18}.get(f.family, 12.0)
    level = 100 + 10 * F.pmod("id", F.lit(7)) + 20 * F.sin(6.283185307179586 * F.col("t") / cycle) + 20.0 * F.col("t") / n
    level = level * F.when((F.weekday("date") >= 5) & F.lit(f.kind == "D"), 1.3).otherwise(1.0) * F.when(F.month("date") == 12, 1.2).otherwise(1.0)
    sales = F.greatest(F.lit(0.0), level + 10 * normal("sales"))
    return rows.select("date", "product", "store", sales.alias("sales"), F.greatest(F.lit(0.0), 2 * sales + 15 * normal("stock")).alias("inventory"))


def write_results(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """The whole result as CSV (with a header) or Parquet; overwrites."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def write_metrics(metrics: DataFrame, path: str, fmt: str = "csv") -> None:
    """Metrics as a wide table: a row per model, a column per metric; ``metrics`` is tidy (model, metric, value)."""
    write_results(metrics.groupBy("model").pivot("metric", list(METRICS)).agg(F.first("value")), path, fmt)


def write_cutoff_statistics(stats: DataFrame, path: str, fmt: str = "csv") -> bool:
    """Rows per cutoff, written only where there are several cutoffs; tells whether they were."""
    several = stats.limit(2).count() > 1
    if several:
        write_results(stats, path, fmt)
    return several


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str] | None = None) -> None:
    """Replaces a table of a database that Spark has a driver for, all at once or not at all.

    Rows go to a staging table, each task's in a transaction of its own, so that a task
    that fails leaves nothing behind. The staging table takes the place of ``table`` only
    if it holds as many rows as there are; else it goes and ``table`` stays as it was.
    """
    spark, staging = df.sparkSession, f"{table}_{uuid.uuid4().hex[:8]}"
    rows = materialize(df)  # counted and written from the same rows
    jvm, given = spark._jvm, spark._jvm.java.util.Properties()
    for k, v in (properties or {}).items():
        given.setProperty(k, v)
    dialect = jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url)

    def run(*statements: str) -> None:
        """The first of the statements that the database knows."""
        for i, sql in enumerate(statements):
            made = connection.createStatement()
            try:
                made.execute(sql)
                return
            except Py4JJavaError:
                if i == len(statements) - 1:
                    raise
            finally:
                made.close()

    connection = jvm.java.sql.DriverManager.getConnection(url, given)
    try:
        rows.write.jdbc(url, staging, mode="error", properties=properties or {})
        held = spark.read.jdbc(url, staging, properties=properties or {}).count()
        if held != (wanted := rows.count()):
            raise RuntimeError(f"{staging} holds {held} rows instead of {wanted}")
        try:
            run(dialect.getTableExistsQuery(table))
        except Py4JJavaError:
            pass  # there is none yet
        else:
            run(f"DROP TABLE {table}")
        run(f"ALTER TABLE {staging} RENAME TO {table}", f"RENAME TABLE {staging} TO {table}")
    except Exception:
        with suppress(Py4JJavaError):  # it may not have come to be
            run(f"DROP TABLE {staging}")
        raise
    finally:
        connection.close()


def batches(parts: Iterable[pa.RecordBatch], size: int) -> Iterator[list[dict]]:
    """Rows of Arrow batches as lists of ``size`` records."""
    held: list[dict] = []
    for part in parts:
        held += part.to_pylist()
        while len(held) >= size:
            yield held[:size]
            held = held[size:]
    if held:
        yield held


@dataclass
class Sent(WriterCommitMessage):
    """What one task has sent."""

    batches: int
    rows: int


class RestWriter(DataSourceArrowWriter):
    """POSTs each task's rows as JSON lists; every list has a key that is the same whenever its task runs again."""

    def __init__(self, options: dict[str, str]) -> None:
        self.url, self.load, self.size = options["url"], options["load"], int(options["size"])
        self.headers = json.loads(options["headers"])

    def _ask(self, method: str, body: Any, **headers: str) -> None:
        data = None if body is None else json.dumps(body, default=str).encode()
        urllib.request.urlopen(urllib.request.Request(self.url, data=data, headers=self.headers | headers, method=method)).close()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Sent:
        part, sent = TaskContext.get().partitionId(), Sent(0, 0)
        for rows in batches(iterator, self.size):
            self._ask("POST", rows, **{"Idempotency-Key": f"{self.load}-{part}-{sent.batches}"})
            sent = Sent(sent.batches + 1, sent.rows + len(rows))
        return sent

    def commit(self, messages: list[Sent]) -> None:
        """All tasks have sent their rows."""
        if self.headers.get("X-Load"):
            done = [m for m in messages if m]
            self._ask("PUT", {"load": self.load, "batches": sum(m.batches for m in done), "rows": sum(m.rows for m in done)})

    def abort(self, messages: list[Sent]) -> None:
        """Some task failed for good: what the load has sent is to be forgotten."""
        if self.headers.get("X-Load"):
            self._ask("DELETE", None)


class RestSink(DataSource):
    """``df.write.format("rest_sink")`` with the options url, load, size and headers (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "rest_sink"

    def writer(self, schema: Any, overwrite: bool) -> RestWriter:
        return RestWriter({k: self.options[k] for k in ("url", "load", "size", "headers")})


def write_rest(df: DataFrame, url: str, headers: dict[str, str] | None = None, size: int = 1000, clear: bool = True, two_phase: bool = False) -> None:
    """DELETE once, then POST the rows as JSON lists of ``size`` from the executors.

    Each list carries an ``Idempotency-Key``; a task that runs again sends the same lists
    under the same keys, because its rows come from a checkpoint, so that a service that
    minds the keys takes every row once. With ``two_phase`` every request names its load
    (``X-Load``), and a last one, PUT when all is sent or DELETE when a task failed for
    good, tells the service to keep or to forget it.
    """
    spark, load = df.sparkSession, uuid.uuid4().hex
    sent = {"Content-Type": "application/json"} | (headers or {})
    if clear:
        urllib.request.urlopen(urllib.request.Request(url, headers=sent, method="DELETE")).close()
    if two_phase:
        sent["X-Load"] = load
    spark.dataSource.register(RestSink)
    options = {"url": url, "load": load, "size": str(size), "headers": json.dumps(sent)}
    materialize(df).write.format("rest_sink").options(**options).mode("append").save()
