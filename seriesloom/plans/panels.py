"""Panels over the star-schema tables: cells of a key and a period, all in whole numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.operators.preparation import run_data_preparation


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    week = F.to_date(F.date_trunc("week", "o_orderdate")).alias("date")
    cells = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus", week)
    return cells.agg(F.count("*").cast("double").alias("n_orders"), F.sum(F.round("o_totalprice")).alias("revenue"))


def ship_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("l_shipdate").alias("date")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus", day).agg(F.sum("l_quantity").alias("qty"))


def _monthly(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    month = F.trunc(F.to_date("l_shipdate"), "month").alias("date")
    return table(spark, sf_dir, "lineitem").groupBy(key, month).agg(F.sum("l_quantity").alias("qty"))


def supp_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _monthly(spark, sf_dir, "l_suppkey")


def part_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _monthly(spark, sf_dir, "l_partkey")


def ev_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("date")).agg(F.count("*").cast("double").alias("n"))


PANELS = {
    "orders_w": (orders_w, ["o_orderpriority", "o_orderstatus"], "n_orders"),
    "ship_d": (ship_d, ["l_returnflag", "l_linestatus"], "qty"),
    "supp_m": (supp_m, ["l_suppkey"], "qty"),
    "part_m": (part_m, ["l_partkey"], "qty"),
    "ev_d": (ev_d, ["event_type"], "n"),
}

#: The same panels as SQL.
SQL = {
    "orders_w": "SELECT o_orderpriority, o_orderstatus, CAST(date_trunc('week', o_orderdate) AS DATE) AS date, "
    "CAST(count(*) AS DOUBLE) AS n_orders, sum(round(o_totalprice)) AS revenue FROM orders GROUP BY ALL",
    "ship_d": "SELECT l_returnflag, l_linestatus, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS qty FROM lineitem GROUP BY ALL",
    "supp_m": "SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, sum(l_quantity) AS qty FROM lineitem GROUP BY ALL",
    "part_m": "SELECT l_partkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, sum(l_quantity) AS qty FROM lineitem GROUP BY ALL",
    "ev_d": "SELECT event_type, CAST(ts AS DATE) AS date, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY ALL",
}

HORIZON, CUTOFFS, WINDOW = 4, 2, 4


def prepared(spark: SparkSession, sf_dir: str, name: str = "supp_m") -> DataFrame:
    """A monthly panel as a backtest: completed, smoothed, two cutoffs, four horizons."""
    make, keys, target = PANELS[name]
    return run_data_preparation(make(spark, sf_dir), "date", keys, [target], target, HORIZON, "MS", CUTOFFS, dp_window_size=WINDOW)


def prepared_sql(name: str = "supp_m") -> str:
    """Common table expressions that end in ``prep``; ``comp``, ``smooth``, ``cut``, ``bt``, ``hz`` and ``hn`` come before it."""
    _, (key,), target = PANELS[name]
    return f"""
panel AS ({SQL[name]}),
ends AS (SELECT {key}, min(date) AS lo, max(date) AS hi FROM panel GROUP BY 1),
grid AS (SELECT {key}, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS date FROM ends),
comp AS (SELECT g.{key}, g.date, p.{target} FROM grid g LEFT JOIN panel p USING ({key}, date)),
avgs AS (SELECT *, avg({target}) OVER (PARTITION BY {key} ORDER BY date ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS a FROM comp),
smooth AS (SELECT {key}, date, {target}, CASE WHEN coalesce({target}, a) IS NOT NULL THEN greatest(coalesce({target}, a), 0) END AS filled_{target} FROM avgs),
months AS (SELECT date_trunc('month', date) AS m, min(date) AS f, max(date) AS l FROM panel WHERE {target} > 0 GROUP BY 1),
firsts AS (SELECT f AS cutoff FROM months WHERE f <> (SELECT max(l) FROM months) ORDER BY f DESC LIMIT {CUTOFFS - 1}),
cut AS (SELECT max(l) AS cutoff FROM months UNION ALL SELECT cutoff FROM firsts),
bt AS (SELECT s.*, cutoff, CASE WHEN date >= cutoff THEN 'test' ELSE 'train' END AS sample FROM smooth s CROSS JOIN cut),
need AS (SELECT {key}, cutoff, CAST(cutoff + to_months(CAST(i AS INT)) AS DATE) AS date FROM (SELECT DISTINCT {key}, cutoff FROM bt) k CROSS JOIN range(1, {HORIZON + 1}) t(i)),
hz AS (SELECT {key}, date, {target}, filled_{target}, cutoff, sample FROM bt
  UNION ALL SELECT n.{key}, n.date, NULL, NULL, n.cutoff, 'test' FROM need n
  WHERE NOT EXISTS (SELECT 1 FROM bt b WHERE b.{key} = n.{key} AND b.cutoff = n.cutoff AND b.date = n.date)),
ff AS (SELECT {key}, date, {target}, cutoff, sample,
  last_value(filled_{target} IGNORE NULLS) OVER (PARTITION BY {key}, cutoff ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled_{target} FROM hz),
hn AS (SELECT *, CAST(CASE WHEN sample = 'test' THEN row_number() OVER (PARTITION BY {key}, cutoff, sample ORDER BY date) ELSE 0 END AS INT) AS horizon FROM ff),
prep AS (SELECT * FROM hn WHERE sample = 'train' OR horizon <= {HORIZON})"""
