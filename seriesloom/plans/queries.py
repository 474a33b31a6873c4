"""Registered queries of the panel engine, each beside the SQL that must give the same rows."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.checkpoints import materialize, shared_folder
from seriesloom.functions.frequency import detect_frequency
from seriesloom.operators import baselines, columns, features, guard, metrics, models, preparation, statistics, tuning
from seriesloom.plans import panels as P
from seriesloom.plans.pipeline import Options, forecast, run_pipeline
from seriesloom.sources import tables
from seriesloom.streaming.features import stateful_features
from seriesloom.streaming.panels import event_cells

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

PREP = P.prepared_sql()
SERIES = ["l_suppkey", "cutoff"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rd(c: str | Column, digits: int = 6) -> Column:
    """Rounded for comparison; adding 0 turns -0 into 0."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def rs(c: str, digits: int = 6) -> str:
    return f"round({c}, {digits}) + 0.0"


# columns and profiles


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count_if({c} IS NULL) AS n_missing, count(DISTINCT {c}) AS n_distinct, "
        f"coalesce(100.0 * count_if({c} IS NULL) / nullif(count(*), 0), 0.0)::DOUBLE AS missing_pct FROM orders"
        for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    )
)
def ingest_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = columns.profile(P.table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])
    return out.withColumn("missing_pct", F.col("missing_pct").cast("double"))


@query("SELECT lower(coalesce(CAST(o_orderstatus AS VARCHAR), 'nan')) AS status, count(*) AS n, sum(round(o_totalprice)) AS total FROM orders GROUP BY 1")
def tidy_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = P.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("Status"), F.col("o_totalprice").cast("string").alias("Price"))
    return columns.tidy(raw, ["status"], ["price"]).groupBy(F.lower("status").alias("status")).agg(F.count("*").alias("n"), F.sum(F.round("price")).alias("total"))


@query(f"WITH panel AS ({P.SQL['part_m']}) SELECT * FROM panel WHERE l_partkey IN (SELECT l_partkey FROM panel GROUP BY 1 ORDER BY sum(qty) DESC, l_partkey LIMIT 20)")
def topk_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.top_series(P.part_m(spark, sf_dir), ["l_partkey"], "qty", 20)


@query(
    "WITH w AS (SELECT o_orderpriority, count_if(o_orderstatus = 'F') AS f, count_if(o_orderstatus = 'O') AS o, count_if(o_orderstatus = 'P') AS p FROM orders GROUP BY 1) "
    "SELECT o_orderpriority, 'F' AS status, f AS n FROM w UNION ALL SELECT o_orderpriority, 'O', o FROM w UNION ALL SELECT o_orderpriority, 'P', p FROM w"
)
def unpivot_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [F.count_if(F.col("o_orderstatus") == s).alias(s) for s in "FOP"]
    wide = P.table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(*counts)
    return columns.unpivot(wide, ["o_orderpriority"], "status", "n")


@query(
    f"WITH panel AS ({P.SQL['orders_w']}) SELECT 'priority' AS by, o_orderpriority AS key, date, {rs('avg(n_orders)')} AS value FROM panel GROUP BY ALL "
    f"UNION ALL SELECT 'status', o_orderstatus, date, sum(n_orders) FROM panel GROUP BY ALL"
)
def plot_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = P.orders_w(spark, sf_dir)
    mean = columns.rollup(cells, ["date", "o_orderpriority"], "n_orders", "mean").select(F.lit("priority").alias("by"), F.col("o_orderpriority").alias("key"), "date", rd("n_orders").alias("value"))
    total = columns.rollup(cells, ["date", "o_orderstatus"], "n_orders").select(F.lit("status").alias("by"), F.col("o_orderstatus").alias("key"), "date", F.col("n_orders").alias("value"))
    return mean.unionByName(total)


# calendar and backtest structure


def _frequency_sql(name: str) -> str:
    return f"""SELECT '{name}' AS panel, (
WITH d AS (SELECT DISTINCT date FROM ({P.SQL[name]})), g AS (SELECT date, date_diff('day', lag(date) OVER (ORDER BY date), date) AS gap FROM d),
top AS (SELECT gap FROM g WHERE gap IS NOT NULL GROUP BY gap ORDER BY count(*) DESC, min(date) LIMIT 1),
dow AS (SELECT isodow(date) AS p, count(*) * 1.0 / (SELECT count(*) FROM d) AS s FROM d GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1),
dom AS (SELECT day(date) AS p, count(*) * 1.0 / (SELECT count(*) FROM d) AS s FROM d GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
SELECT CASE WHEN gap <= 1 THEN 'D' WHEN gap <= 3 THEN 'B'
 WHEN gap BETWEEN 6 AND 8 THEN CASE WHEN (SELECT s FROM dow) > 0.7 THEN 'W-' || (['MON','TUE','WED','THU','FRI','SAT','SUN'])[(SELECT p FROM dow)] ELSE 'W' END
 WHEN gap BETWEEN 28 AND 31 THEN CASE WHEN (SELECT s FROM dom) > 0.7 AND (SELECT p FROM dom) <= 5 THEN 'MS' ELSE 'M' END
 WHEN gap BETWEEN 89 AND 93 THEN 'Q' WHEN gap BETWEEN 180 AND 186 THEN 'SM' WHEN gap BETWEEN 364 AND 366 THEN 'Y' ELSE gap || 'D' END FROM top) AS freq"""


@query(" UNION ALL ".join(_frequency_sql(n) for n in P.PANELS))
def detect_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [(n, detect_frequency(make(spark, sf_dir), "date")) for n, (make, _, _) in P.PANELS.items()]
    return spark.createDataFrame(found, "panel string, freq string")


_SHIP_GRID = f"""panel AS ({P.SQL['ship_d']}), ends AS (SELECT l_returnflag, l_linestatus, min(date) AS lo, max(date) AS hi FROM panel GROUP BY ALL),
grid AS (SELECT l_returnflag, l_linestatus, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM ends),
comp AS (SELECT g.*, p.qty FROM grid g LEFT JOIN panel p USING (l_returnflag, l_linestatus, date))"""
_SHIP = ["l_returnflag", "l_linestatus"]


@query(f"WITH {_SHIP_GRID} SELECT * FROM comp")
def calendar_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preparation.complete(P.ship_d(spark, sf_dir), _SHIP, "date", "D")


@query(f"WITH {P.prepared_sql('part_m')} SELECT l_partkey, date, qty FROM comp")
def calendar_complete_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preparation.complete(P.part_m(spark, sf_dir), ["l_partkey"], "date", "MS")


@query(
    f"""WITH {_SHIP_GRID}, a AS (SELECT *, avg(qty) OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY date ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS m FROM comp)
SELECT l_returnflag, l_linestatus, date, qty, CASE WHEN coalesce(qty, m) IS NOT NULL THEN {rs('greatest(coalesce(qty, m), 0)')} END AS filled_qty FROM a"""
)
def smooth_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = preparation.smoothing(calendar_complete(spark, sf_dir), _SHIP, "date", ["qty"], 13)
    return out.withColumn("filled_qty", rd("filled_qty"))


@query(f"SELECT DISTINCT date FROM ({P.SQL['orders_w']}) WHERE n_orders > 0 ORDER BY date DESC LIMIT 10")
def latest_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preparation.latest_dates(P.orders_w(spark, sf_dir), "date", "n_orders", 10)


@query(f"WITH {PREP} SELECT cutoff FROM cut")
def cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = preparation.cutoff_dates(P.supp_m(spark, sf_dir), "date", "qty", P.CUTOFFS)
    return spark.createDataFrame([(c,) for c in found], "cutoff date")


@query(f"WITH {PREP} SELECT p.l_suppkey, p.date, p.qty, cutoff, CASE WHEN p.date >= cutoff THEN 'test' ELSE 'train' END AS sample FROM panel p CROSS JOIN cut")
def backtest_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = P.supp_m(spark, sf_dir)
    return preparation.backtest(panel, "date", preparation.cutoff_dates(panel, "date", "qty", P.CUTOFFS))


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = P.supp_m(spark, sf_dir)
    full = preparation.smoothing(preparation.complete(panel, ["l_suppkey"], "date", "MS"), ["l_suppkey"], "date", ["qty"], P.WINDOW)
    split = preparation.backtest(full, "date", preparation.cutoff_dates(panel, "date", "qty", P.CUTOFFS))
    return preparation.add_horizon(split, ["l_suppkey"], "date", P.HORIZON, "MS")


@query(f"WITH {PREP} SELECT l_suppkey, date, qty, cutoff, sample, {rs('filled_qty')} AS filled_qty FROM ff")
def horizon_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir).withColumn("filled_qty", rd("filled_qty"))


@query(f"WITH {PREP} SELECT l_suppkey, date, cutoff, sample, horizon FROM hn")
def horizon_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preparation.horizon_number(_filled(spark, sf_dir), ["l_suppkey"], "date").select("l_suppkey", "date", "cutoff", "sample", "horizon")


@query(f"WITH {PREP} SELECT l_suppkey, date, qty, cutoff, sample, horizon, {rs('filled_qty')} AS filled_qty FROM prep")
def horizon_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.prepared(spark, sf_dir).withColumn("filled_qty", rd("filled_qty"))


@query(f"WITH {PREP}, c AS (SELECT cutoff, sample, l_suppkey, count(*) AS n FROM prep GROUP BY ALL) SELECT cutoff, sample, quantile_cont(n, 0.5)::DOUBLE AS median_rows FROM c GROUP BY ALL")
def horizon_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preparation.horizon_profile(P.prepared(spark, sf_dir), ["l_suppkey"])


@query(f"WITH {PREP} SELECT cutoff, count(*) AS n_rows, count_if(sample = 'train') AS train_rows, count_if(sample = 'test') AS test_rows FROM prep GROUP BY 1")
def cutoff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preparation.cutoff_statistics(P.prepared(spark, sf_dir))


@query(f"WITH {PREP} SELECT l_suppkey, date, cutoff, CAST(CASE WHEN sample = 'test' THEN horizon END AS INT) AS fcst_lag FROM prep")
def fcst_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preparation.forecast_lag(P.prepared(spark, sf_dir), SERIES, "date").select("l_suppkey", "date", "cutoff", "fcst_lag")


# features


@query(
    f"WITH panel AS ({P.SQL['orders_w']}) SELECT *, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INT) AS feature_o_orderpriority, "
    "CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INT) AS feature_o_orderstatus FROM panel"
)
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.encode(P.orders_w(spark, sf_dir), ["o_orderpriority", "o_orderstatus"])


_PERIODS = f"""{PREP}, per AS (SELECT *, CAST(CASE WHEN max(CASE WHEN qty > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey, cutoff ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1
 THEN row_number() OVER (PARTITION BY l_suppkey, cutoff ORDER BY date) ELSE 0 END AS DOUBLE) AS feature_periods FROM prep)"""


@query(f"WITH {_PERIODS} SELECT l_suppkey, cutoff, date, feature_periods, {rs('power(feature_periods, 1.10)')} AS feature_periods_expanding, {rs('sqrt(feature_periods)')} AS feature_periods_sqrt FROM per")
def periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.periods(P.prepared(spark, sf_dir), SERIES, "date", "qty")
    return out.select("l_suppkey", "cutoff", "date", "feature_periods", rd("feature_periods_expanding").alias("feature_periods_expanding"), rd("feature_periods_sqrt").alias("feature_periods_sqrt"))


def _dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.ship_d(spark, sf_dir).select("date").distinct()


_DATES = f"d AS (SELECT DISTINCT date FROM ({P.SQL['ship_d']}))"


@query(
    f"WITH {_DATES} SELECT date, CAST(year(date) AS INT) AS feature_year, CAST(quarter(date) AS INT) AS feature_quarter, CAST(month(date) AS INT) AS feature_month, "
    "CAST(weekofyear(date) AS INT) AS feature_week, CAST(day(date) AS INT) AS feature_day, CAST(isodow(date) - 1 AS INT) AS feature_dayofweek FROM d"
)
def date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dates(spark, sf_dir).withColumns(features.calendar_columns("date"))


_PHASES = {
    "yearly": (3, "dayofyear(date) / 365.25"),
    "quarterly": (2, "(dayofyear(date) - (quarter(date) - 1) * 91.3125) / 91.3125"),
    "monthly": (2, "day(date) / day(last_day(date))"),
    "weekly": (3, "(isodow(date) - 1) / 7.0"),
}


@query(
    f"WITH {_DATES} SELECT date, "
    + ", ".join(f"{rs(f'{f}(2 * pi() * {k} * CAST({e} AS DOUBLE))')} AS feature_{f}_{n}_{k}" for n, (m, e) in _PHASES.items() for k in range(1, m + 1) for f in ("sin", "cos"))
    + " FROM d"
)
def fourier_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dates(spark, sf_dir).select("date", *[rd(c).alias(n) for n, c in features.fourier_columns("date").items()])


@query(
    f"""WITH {_DATES}, e AS (SELECT date,
 CASE WHEN date = last_day(date) THEN last_day(date + 1) ELSE last_day(date) END AS m, date + CAST(CASE WHEN isodow(date) = 7 THEN 7 ELSE 7 - isodow(date) END AS INT) AS w,
 CASE WHEN date = CAST(date_trunc('quarter', date) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) THEN CAST(date_trunc('quarter', date) + INTERVAL 6 MONTH - INTERVAL 1 DAY AS DATE)
  ELSE CAST(date_trunc('quarter', date) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) END AS q,
 CASE WHEN month(date) = 12 AND day(date) = 31 THEN make_date(year(date) + 1, 12, 31) ELSE make_date(year(date), 12, 31) END AS y FROM d)
SELECT date, CAST(date_diff('day', date, m) AS INT) AS feature_days_until_month_end, CAST(date_diff('day', date, w) AS INT) AS feature_days_until_week_end,
 CAST(date_diff('day', date, q) AS INT) AS feature_days_until_quarter_end, CAST(date_diff('day', date, y) AS INT) AS feature_days_until_year_end,
 {rs("date_diff('day', date, m) / CAST(7.0 AS DOUBLE)")} AS feature_weeks_until_month_end, {rs("date_diff('day', date, q) / CAST(7.0 AS DOUBLE)")} AS feature_weeks_until_quarter_end,
 {rs("date_diff('day', date, y) / CAST(7.0 AS DOUBLE)")} AS feature_weeks_until_year_end,
 CAST((year(q) - year(date)) * 12 + month(q) - month(date) AS INT) AS feature_months_until_quarter_end, CAST((year(y) - year(date)) * 12 + month(y) - month(date) AS INT) AS feature_months_until_year_end FROM e"""
)
def extended_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {n: rd(c) if "weeks" in n else c.cast("int") for n, c in features.extended_date_columns("date").items()}
    return _dates(spark, sf_dir).withColumns(made)


def _over(rows: int, key: str = "l_suppkey, cutoff") -> str:
    return f"OVER (PARTITION BY {key} ORDER BY date ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"


@query(f"WITH {PREP} SELECT l_suppkey, cutoff, date, " + ", ".join(f"{rs(f'avg(qty) {_over(w)}')} AS qty_ma_{w}" for w in (2, 6)) + " FROM prep")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.moving_average(P.prepared(spark, sf_dir), SERIES, "date", ["qty"], (2, 6))
    return out.select("l_suppkey", "cutoff", "date", *[rd(f"qty_ma_{w}").alias(f"qty_ma_{w}") for w in (2, 6)])


@query(
    f"WITH {PREP} SELECT l_suppkey, cutoff, date, "
    + ", ".join(f"{rs(f'{f}(qty) {_over(w)}')} AS qty_{n}_{w}" for w in (2, 6) for n, f in (("min", "min"), ("max", "max"), ("mean", "avg")))
    + " FROM prep"
)
def moving_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = features.moving_stat_columns(SERIES, "date", ["qty"], (2, 6))
    return P.prepared(spark, sf_dir).select("l_suppkey", "cutoff", "date", *[rd(c).alias(n) for n, c in made.items()])


def _lag_sql(hide: str, fill: bool = False) -> str:
    lagged = ", ".join(
        f"CASE WHEN sample = 'test' AND row_number() OVER (PARTITION BY l_suppkey, cutoff, sample ORDER BY date) - 1 {hide} {n} THEN NULL "
        f"ELSE lag(qty, {n}) OVER (PARTITION BY l_suppkey, cutoff ORDER BY date) END AS feature_qty_lag_{n}"
        for n in (1, 3)
    )
    out = f"SELECT l_suppkey, cutoff, date, sample, {lagged} FROM prep"
    if fill:
        last = ", ".join(
            f"last_value(feature_qty_lag_{n} IGNORE NULLS) OVER (PARTITION BY l_suppkey, cutoff ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS feature_qty_lag_{n}" for n in (1, 3)
        )
        out = f"SELECT l_suppkey, cutoff, date, sample, {last} FROM ({out})"
    return f"WITH {PREP} {out}"


def _lags(spark: SparkSession, sf_dir: str, mask: str, fill: bool = False) -> DataFrame:
    out = features.lags(P.prepared(spark, sf_dir), SERIES, "date", ["qty"], (1, 3), fill, mask)
    return out.select("l_suppkey", "cutoff", "date", "sample", "feature_qty_lag_1", "feature_qty_lag_3")


@query(_lag_sql(">="))
def lags_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lags(spark, sf_dir, "safe")


@query(_lag_sql("<"))
def lags_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lags(spark, sf_dir, "reference")


@query(_lag_sql(">=", True))
def lags_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lags(spark, sf_dir, "safe", True)


@query(
    f"WITH {PREP} SELECT l_suppkey, cutoff, date, sample, horizon, {rs('filled_qty')} AS filled_qty, "
    + ", ".join(f"{rs(f'{f}({v}) {_over(w)}')} AS {v}_{n}_{w}" for v in ("filled_qty", "qty") for w in (2, 6) for n, f in (("min", "min"), ("max", "max"), ("mean", "avg")))
    + ", " + ", ".join(
        f"CASE WHEN sample = 'test' AND horizon > {n} THEN NULL ELSE lag(qty, {n}) OVER (PARTITION BY l_suppkey, cutoff ORDER BY date) END AS feature_qty_lag_{n}" for n in (1, 3)
    )
    + " FROM prep"
)
def late_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows and lags of all cutoffs' replicas, computed once on the series; lags are masked by the horizon."""
    raw = P.supp_m(spark, sf_dir)
    panel = preparation.smoothing(preparation.complete(raw, ["l_suppkey"], "date", "MS"), ["l_suppkey"], "date", ["qty"], P.WINDOW)

    def windowed(df: DataFrame, keys: list[str]) -> DataFrame:
        made = features.moving_stat_columns(keys, "date", ["filled_qty", "qty"], (2, 6))
        return df.withColumns(made | features.lag_columns(keys, "date", ["qty"], (1, 3), sampled=False))

    out = preparation.late_backtest(panel, ["l_suppkey"], "date", preparation.cutoff_dates(raw, "date", "qty", P.CUTOFFS), P.HORIZON, "MS", windowed, 6)
    lags = [F.when((F.col("sample") == "train") | (F.col("horizon") <= n), F.col(f"feature_qty_lag_{n}")).alias(f"feature_qty_lag_{n}") for n in (1, 3)]
    stats = [c for c in out.columns if re.fullmatch(r"(filled_)?qty_(min|max|mean)_\d", c)]
    return out.select(*SERIES, "date", "sample", "horizon", rd("filled_qty").alias("filled_qty"), *[rd(c).alias(c) for c in stats], *lags)


@query()
def feature_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.run_feature_engineering(materialize(P.prepared(spark, sf_dir)), SERIES, "date", "qty", "MS", ["filled_qty", "qty"], [], extended_stats=True)


_BUNDLE_SIGNALS, _BUNDLE_WINDOWS, _BUNDLE_LAGS = ("filled_qty", "qty"), (2, 6), (4, 8, 12)
_BUNDLE_STATS = [f"{s}_{n}_{w}" for s in _BUNDLE_SIGNALS for w in _BUNDLE_WINDOWS for n in ("ma", "min", "max", "mean")]
_BUNDLE = [*_BUNDLE_STATS, *[f"feature_{s}_lag_{n}" for s in _BUNDLE_SIGNALS for n in _BUNDLE_LAGS], "feature_qty_intermittence", "train_weight"]


def _bundle_sql() -> str:
    made = [f"{f}({s}) {_over(w)} AS {s}_{n}_{w}" for s in _BUNDLE_SIGNALS for w in _BUNDLE_WINDOWS for n, f in (("ma", "avg"), ("min", "min"), ("max", "max"), ("mean", "avg"))]
    made += [
        f"CASE WHEN sample = 'test' AND row_number() OVER (PARTITION BY l_suppkey, cutoff, sample ORDER BY date) - 1 >= {n} THEN NULL "
        f"ELSE lag({s}, {n}) OVER (PARTITION BY l_suppkey, cutoff ORDER BY date) END AS feature_{s}_lag_{n}"
        for s in _BUNDLE_SIGNALS
        for n in _BUNDLE_LAGS
    ]
    made.append("coalesce(avg(CASE WHEN sample = 'train' THEN CASE WHEN coalesce(qty, 0) = 0 THEN 100.0 ELSE 0.0 END END) OVER (PARTITION BY l_suppkey, cutoff), 0) AS feature_qty_intermittence")
    made.append("CASE WHEN sample = 'train' THEN feature_periods / nullif(max(CASE WHEN sample = 'train' THEN feature_periods END) OVER (PARTITION BY l_suppkey, cutoff), 0) END AS train_weight")
    rounded = ", ".join(f"{rs(c)} AS {c}" for c in _BUNDLE)
    return f"WITH {_PERIODS}, b AS (SELECT *, {', '.join(made)} FROM per) SELECT l_suppkey, cutoff, date, sample, horizon, feature_periods, CAST(month(date) AS INT) AS feature_month, {rounded} FROM b"


@query(_bundle_sql())
def feature_bundle_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bundle's periods, windows, lags, intermittence and weights; its other columns have queries of their own."""
    keys = [*SERIES, "date", "sample", "horizon", "feature_periods", "feature_month"]
    return feature_bundle(spark, sf_dir).select(*keys, *[rd(c).alias(c) for c in _BUNDLE])


# statistics per series


def _zeroed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed months of each part, missing ones as 0."""
    return calendar_complete_parts(spark, sf_dir).withColumn("qty", F.coalesce("qty", F.lit(0.0)))


_ZEROED = f"{P.prepared_sql('part_m')}, z AS (SELECT l_partkey, date, coalesce(qty, 0) AS qty FROM comp)"


@query(
    f"""WITH {_ZEROED}, i AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY date) - row_number() OVER (PARTITION BY l_partkey, qty = 0 ORDER BY date) AS g FROM z),
r AS (SELECT l_partkey, g, count(*) AS n FROM i WHERE qty = 0 GROUP BY ALL) SELECT p.l_partkey, coalesce(max(n), 0) AS feature_qty_max_consec_zeros FROM (SELECT DISTINCT l_partkey FROM z) p LEFT JOIN r USING (l_partkey) GROUP BY 1"""
)
def max_zero_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.zero_runs(_zeroed(spark, sf_dir), ["l_partkey"], "date", "qty")


def _decompose_sql(rows: str, key: str, value: str, period: str, periods: tuple[int, ...], out: str) -> str:
    """CTEs from ``rows`` (key, date, value) to ``out`` with pos, n, p, trend, seasonal and resid."""
    cases = []
    for k in periods:
        h = k // 2
        frame = f"OVER (PARTITION BY {key} ORDER BY date ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)"
        w = f"OVER (PARTITION BY {key} ORDER BY date)"
        mean = f"sum({value}) {frame} / {k}" if k % 2 else f"(sum({value}) {frame} - 0.5 * (lag({value}, {h}) {w} + lead({value}, {h}) {w})) / {k}"
        cases.append(f"WHEN p = {k} AND pos >= {h} AND pos < n - {h} THEN {mean}")
    return f"""
{out}_1 AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY {key}) AS n FROM {rows}),
{out}_2 AS (SELECT *, {period} AS p FROM {out}_1),
{out}_3 AS (SELECT *, CASE {' '.join(cases)} END AS trend FROM {out}_2),
{out}_4 AS (SELECT *, pos % p AS phase, {value} - trend AS detr FROM {out}_3),
{out}_5 AS (SELECT {key}, phase, avg(detr) AS m FROM {out}_4 GROUP BY ALL),
{out}_6 AS (SELECT {key}, sum(m) / count(*) AS centre FROM {out}_5 GROUP BY ALL),
{out} AS (SELECT a.*, b.m - c.centre AS seasonal, {value} - trend - (b.m - c.centre) AS resid FROM {out}_4 a JOIN {out}_5 b USING ({key}, phase) JOIN {out}_6 c USING ({key}))"""


@query(
    f"""WITH {PREP}, f AS (SELECT l_suppkey, date, filled_qty FROM smooth), {_decompose_sql('f', 'l_suppkey', 'filled_qty', '12', (12,), 'dc')}
SELECT l_suppkey, date, CASE WHEN n >= 24 THEN {rs('coalesce(last_value(trend IGNORE NULLS) OVER (PARTITION BY l_suppkey ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(trend IGNORE NULLS) OVER (PARTITION BY l_suppkey ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))', 7)} END AS feature_trend_filled_qty,
 CASE WHEN n >= 24 THEN {rs('seasonal', 7)} END AS feature_seasonal_filled_qty FROM dc"""
)
def decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = preparation.complete(P.supp_m(spark, sf_dir), ["l_suppkey"], "date", "MS")
    out = statistics.decomposition(preparation.smoothing(full, ["l_suppkey"], "date", ["qty"], P.WINDOW), ["l_suppkey"], "date", "filled_qty", 12)
    return out.select("l_suppkey", "date", *[rd(c, 7).alias(c) for c in ("feature_trend_filled_qty", "feature_seasonal_filled_qty")])


_MIXED = f"""ev AS ({P.SQL['ev_d']}), ow AS ({P.SQL['orders_w']}), sm AS ({P.SQL['supp_m']}),
raw AS (SELECT 'd ' || event_type AS series, date, n AS v FROM ev UNION ALL SELECT 'w ' || o_orderpriority || o_orderstatus, date, n_orders FROM ow UNION ALL SELECT 'm ' || l_suppkey, date, CAST(qty AS DOUBLE) FROM sm),
gaps AS (SELECT *, date_diff('day', lag(date) OVER (PARTITION BY series ORDER BY date), date) AS gap FROM raw),
mixed AS (SELECT series, date, v, floor(median(gap) OVER (PARTITION BY series)) AS g FROM gaps)"""


def _carried(c: str) -> str:
    w = "OVER (PARTITION BY series ORDER BY date ROWS BETWEEN"
    return f"CASE WHEN n >= 2 * p THEN {rs(f'coalesce(last_value({c} IGNORE NULLS) {w} UNBOUNDED PRECEDING AND CURRENT ROW), first_value({c} IGNORE NULLS) {w} CURRENT ROW AND UNBOUNDED FOLLOWING))', 7)} END"


@query(
    f"""WITH {_MIXED}, {_decompose_sql('mixed', 'series', 'v', 'CASE WHEN g = 7 THEN 52 WHEN g BETWEEN 28 AND 31 THEN 12 ELSE 7 END', (7, 12, 52), 'dc')}
SELECT series, date, {_carried('trend')} AS feature_trend_v, {_carried('seasonal')} AS feature_seasonal_v FROM dc"""
)
def decompose_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily, weekly and monthly series in one panel, each with the period that goes with its gaps."""
    part = lambda df, kind, key, v: df.select(F.concat(F.lit(f"{kind} "), *key).alias("series"), "date", F.col(v).cast("double").alias("v"))
    rows = part(P.ev_d(spark, sf_dir), "d", ["event_type"], "n").unionByName(part(P.orders_w(spark, sf_dir), "w", ["o_orderpriority", "o_orderstatus"], "n_orders"))
    rows = rows.unionByName(part(P.supp_m(spark, sf_dir), "m", [F.col("l_suppkey").cast("string")], "qty"))
    out = statistics.decomposition(rows, ["series"], "date", "v")
    return out.select("series", "date", *[rd(c, 7).alias(c) for c in ("feature_trend_v", "feature_seasonal_v")])


@query(
    f"""WITH panel AS ({P.SQL['part_m']}), v AS (SELECT l_partkey, date, qty FROM panel WHERE qty <> 0),
{_decompose_sql('v', 'l_partkey', 'qty', 'CASE WHEN n > 7 THEN least(7, n // 2) ELSE 2 END', (2, 3, 4, 5, 6, 7), 'dc')},
s AS (SELECT l_partkey, max(n) AS n, avg(qty) AS vm, stddev_samp(qty) AS vs, stddev_pop(resid) AS rsd FROM dc GROUP BY 1)
SELECT p.l_partkey, {rs('coalesce(CASE WHEN n >= 4 THEN coalesce(rsd, 0) ELSE coalesce(vs, 0) END / nullif(vm, 0), 0)', 4)} AS feature_qty_cov FROM (SELECT DISTINCT l_partkey FROM panel) p LEFT JOIN s USING (l_partkey)"""
)
def cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = statistics.cov(P.part_m(spark, sf_dir), ["l_partkey"], "date", "qty", "level")
    return out.select("l_partkey", rd("feature_qty_cov", 4).alias("feature_qty_cov")).distinct()


@query(
    f"WITH {PREP}, t AS (SELECT l_suppkey, cutoff, avg(CASE WHEN qty IS NULL OR qty = 0 THEN 100.0 ELSE 0.0 END) AS i FROM prep WHERE sample = 'train' GROUP BY ALL) "
    f"SELECT DISTINCT p.l_suppkey, p.cutoff, {rs('coalesce(CAST(i AS DOUBLE), 0)')} AS feature_qty_intermittence FROM prep p LEFT JOIN t USING (l_suppkey, cutoff)"
)
def intermittence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = statistics.intermittence(P.prepared(spark, sf_dir), SERIES, "qty")
    return out.select(*SERIES, rd("feature_qty_intermittence").alias("feature_qty_intermittence")).distinct()


@query(
    f"""WITH panel AS ({P.SQL['part_m']}), l AS (SELECT l_partkey, qty, lag(qty, 1) OVER (PARTITION BY l_partkey ORDER BY date) AS y FROM panel WHERE qty IS NOT NULL),
m AS (SELECT l_partkey, count(*) AS n, var_pop(qty) AS v, covar_pop(qty, y) AS c, var_pop(qty) FILTER (WHERE y IS NOT NULL) AS vx, var_pop(y) AS vy FROM l GROUP BY 1)
SELECT l_partkey, {rs('CASE WHEN n <= 2 OR v <= 1e-10 OR vx * vy <= 0 THEN 0.0 ELSE c / sqrt(vx * vy) END', 4)} AS feature_qty_autocorr_lag1 FROM m"""
)
def autocorr(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = statistics.autocorrelation(P.part_m(spark, sf_dir), ["l_partkey"], "date", "qty", 1)
    return out.select("l_partkey", rd("feature_qty_autocorr_lag1", 4).alias("feature_qty_autocorr_lag1")).distinct()


@query("SELECT l_suppkey, count(DISTINCT l_returnflag) AS feature_distinct_l_suppkey_l_returnflag, count(DISTINCT l_partkey) AS feature_distinct_l_suppkey_l_partkey FROM lineitem GROUP BY 1")
def distinct_combos(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_partkey")
    out = statistics.distinct_combinations(rows, "l_suppkey", ["l_returnflag", "l_partkey"])
    return out.select("l_suppkey", "feature_distinct_l_suppkey_l_returnflag", "feature_distinct_l_suppkey_l_partkey").distinct()


def _bucket_sql(stats: str, name: str, q: int = 10) -> str:
    points = "[" + ", ".join(f"{i / q!r}" for i in range(q + 1)) + "]"
    return (
        f"WITH panel AS ({P.SQL['part_m']}), s AS ({stats}), e AS (SELECT list_distinct(quantile_cont(stat, {points})) AS edges FROM s), k AS (SELECT DISTINCT l_partkey FROM panel) "
        f"SELECT k.l_partkey, CAST(CASE WHEN stat IS NULL OR len(edges) < 2 THEN 0 ELSE greatest(1, len(list_filter(edges, lambda x: x < stat))) END AS INT) AS {name} FROM k LEFT JOIN s USING (l_partkey) CROSS JOIN e"
    )


@query(_bucket_sql("SELECT l_partkey, avg(qty) AS stat FROM panel GROUP BY 1", "feature_qty_cluster"))
def quantile_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.quantile_clusters(P.part_m(spark, sf_dir), ["l_partkey"], "qty").select("l_partkey", "feature_qty_cluster").distinct()


@query(_bucket_sql("SELECT l_partkey, max(qty) AS stat FROM panel WHERE qty <> 0 GROUP BY 1", "feature_qty_history_cluster"))
def history_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.history_clusters(P.part_m(spark, sf_dir), ["l_partkey"], "qty").select("l_partkey", "feature_qty_history_cluster").distinct()


@query(
    _bucket_sql(
        "SELECT l_partkey, avg(CASE WHEN qty IS NULL OR qty = 0 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS stat FROM (SELECT l_partkey, date, qty, max(CASE WHEN qty > 0 THEN 1 ELSE 0 END) "
        "OVER (PARTITION BY l_partkey ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS o FROM comp) WHERE o = 1 GROUP BY 1",
        "feature_qty_intermittence_cluster",
    ).replace(f"WITH panel AS ({P.SQL['part_m']})", f"WITH {P.prepared_sql('part_m')}")
)
def intermittence_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.intermittence_buckets(calendar_complete_parts(spark, sf_dir), ["l_partkey"], "date", "qty")


def _weights_sql(weight: str) -> str:
    return f"""WITH {_PERIODS}, m AS (SELECT *, max(CASE WHEN sample = 'train' THEN feature_periods END) OVER (PARTITION BY l_suppkey, cutoff) AS mx FROM per)
SELECT l_suppkey, cutoff, date, CASE WHEN sample = 'train' THEN {rs(weight)} END AS train_weight FROM m"""


def _weights(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    rows = features.periods(P.prepared(spark, sf_dir), SERIES, "date", "qty")
    return statistics.train_weights(rows, SERIES, "feature_periods", kind).select(*SERIES, "date", rd("train_weight").alias("train_weight"))


@query(_weights_sql("feature_periods / nullif(mx, 0)"))
def train_weights_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, sf_dir, "linear")


@query(_weights_sql("exp((feature_periods - mx) / nullif(mx, 0))"))
def train_weights_exp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, sf_dir, "exponential")


# baselines

_MA = f"""{PREP}, ma AS (SELECT *, avg(qty) OVER (PARTITION BY l_suppkey, cutoff, sample ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS m FROM prep),
fin AS (SELECT l_suppkey, cutoff, arg_max(m, date) AS f FROM ma WHERE sample = 'train' AND m IS NOT NULL GROUP BY ALL),
base AS (SELECT a.l_suppkey, a.cutoff, a.date, a.sample, a.horizon, a.qty, CASE WHEN sample = 'train' THEN m ELSE f END AS ma FROM ma a LEFT JOIN fin USING (l_suppkey, cutoff))"""


def _ma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baselines.ma_baseline(P.prepared(spark, sf_dir), SERIES, "date", ["qty"], 4)


@query(f"WITH {_MA} SELECT l_suppkey, cutoff, date, sample, {rs('ma')} AS baseline_qty_ma_4 FROM base")
def ma_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ma(spark, sf_dir).select(*SERIES, "date", "sample", rd("baseline_qty_ma_4").alias("baseline_qty_ma_4"))


@query(
    f"""WITH RECURSIVE {PREP}, y AS (SELECT l_suppkey, cutoff, sample, date, row_number() OVER (PARTITION BY l_suppkey, cutoff, sample ORDER BY date) AS i, CAST(coalesce(qty, 0) AS DOUBLE) AS y FROM prep),
cr AS (SELECT l_suppkey, cutoff, i, CASE WHEN y > 0 THEN y ELSE 0.0::DOUBLE END AS a, 1.0::DOUBLE AS q, 1.0::DOUBLE AS p, 0.0::DOUBLE AS f FROM y WHERE sample = 'train' AND i = 1
 UNION ALL SELECT y.l_suppkey, y.cutoff, y.i, CASE WHEN y.y > 0 THEN a + 0.1 * (y.y - a) ELSE a END, CASE WHEN y.y > 0 THEN q + 0.1 * (p - q) ELSE q END, CASE WHEN y.y > 0 THEN 1.0 ELSE p + 1.0 END,
  CASE WHEN y.y > 0 THEN a + 0.1 * (y.y - a) ELSE a END / greatest(CASE WHEN y.y > 0 THEN q + 0.1 * (p - q) ELSE q END, 1e-6)
  FROM cr JOIN y ON y.l_suppkey = cr.l_suppkey AND y.cutoff = cr.cutoff AND y.sample = 'train' AND y.i = cr.i + 1),
fin AS (SELECT l_suppkey, cutoff, arg_max(f, i) AS f FROM cr GROUP BY ALL)
SELECT y.l_suppkey, y.cutoff, y.date, {rs("coalesce(CASE WHEN sample = 'train' THEN cr.f ELSE fin.f END, 0)", 4)} AS baseline_qty_croston
FROM y LEFT JOIN cr ON y.l_suppkey = cr.l_suppkey AND y.cutoff = cr.cutoff AND y.i = cr.i LEFT JOIN fin ON y.l_suppkey = fin.l_suppkey AND y.cutoff = fin.cutoff"""
)
def croston_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = baselines.croston_baseline(P.prepared(spark, sf_dir), SERIES, "date", ["qty"])
    return out.select(*SERIES, "date", rd("baseline_qty_croston", 4).alias("baseline_qty_croston"))


@query(
    f"""WITH {_PERIODS}, f AS (SELECT l_suppkey, cutoff, coalesce(regr_slope(coalesce(qty, 0), feature_periods), 0) AS b, coalesce(regr_intercept(coalesce(qty, 0), feature_periods), avg(coalesce(qty, 0))) AS a, count(*) AS n
 FROM per WHERE sample = 'train' GROUP BY ALL)
SELECT p.l_suppkey, p.cutoff, p.date, {rs("CASE WHEN sample = 'train' THEN qty WHEN n > 1 THEN a + b * feature_periods END", 4)} AS baseline_qty_lr FROM per p LEFT JOIN f USING (l_suppkey, cutoff)"""
)
def lr_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.periods(P.prepared(spark, sf_dir), SERIES, "date", "qty")
    out = baselines.lr_baseline(rows, SERIES, "date", ["qty"], ["feature_periods"])
    return out.select(*SERIES, "date", rd("baseline_qty_lr", 4).alias("baseline_qty_lr"))


@query(
    f"""WITH {_PERIODS}, x AS (SELECT l_suppkey, cutoff, date, sample, qty, CAST(coalesce(qty, 0) AS DOUBLE) AS y, feature_periods AS x1,
 sin(2 * pi() * CAST(dayofyear(date) / 365.25 AS DOUBLE)) AS x2, cos(2 * pi() * CAST(dayofyear(date) / 365.25 AS DOUBLE)) AS x3 FROM per),
a AS (SELECT l_suppkey, cutoff, regr_slope(x2, x1) AS b2, regr_intercept(x2, x1) AS a2, regr_slope(x3, x1) AS b3, regr_intercept(x3, x1) AS a3 FROM x WHERE sample = 'train' GROUP BY ALL),
z AS (SELECT x.*, x2 - a2 - b2 * x1 AS z2, x3 - a3 - b3 * x1 AS w3 FROM x JOIN a USING (l_suppkey, cutoff)),
c AS (SELECT l_suppkey, cutoff, regr_slope(w3, z2) AS b FROM z WHERE sample = 'train' GROUP BY ALL),
o AS (SELECT z.*, w3 - b * z2 AS z3 FROM z JOIN c USING (l_suppkey, cutoff)),
f AS (SELECT l_suppkey, cutoff, regr_slope(y, x1) AS c1, regr_intercept(y, x1) AS c0, regr_slope(y, z2) AS c2, regr_slope(y, z3) AS c3 FROM o WHERE sample = 'train' GROUP BY ALL)
SELECT o.l_suppkey, o.cutoff, o.date, {rs("CASE WHEN sample = 'train' THEN qty ELSE c0 + c1 * x1 + c2 * z2 + c3 * z3 END", 4)} AS baseline_qty_lr FROM o JOIN f USING (l_suppkey, cutoff)"""
)
def lr_baseline_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.date_features(features.periods(P.prepared(spark, sf_dir), SERIES, "date", "qty"), "date")
    known = ["feature_periods", "feature_sin_yearly_1", "feature_cos_yearly_1"]
    out = baselines.lr_baseline(rows.select(*SERIES, "date", "sample", "qty", *known), SERIES, "date", ["qty"], known)
    return out.select(*SERIES, "date", rd("baseline_qty_lr", 4).alias("baseline_qty_lr"))


@query()
def boosted_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.date_features(features.periods(P.prepared(spark, sf_dir), SERIES, "date", "qty"), "date")
    known = ["feature_periods", "feature_month"]
    out = baselines.boosted_baseline(rows.select(*SERIES, "date", "sample", "qty", *known), ["l_suppkey"], "date", ["qty"], known)
    return out.select(*SERIES, "date", "baseline_qty_lgbm")


# outliers, guardrail, ensemble, metrics; the last actual of a series stands in for a model's prediction


@query(
    f"""WITH {PREP}, q AS (SELECT l_suppkey, cutoff, quantile_cont(qty, [0.025, 0.975]) AS q FROM prep GROUP BY ALL)
SELECT l_suppkey, cutoff, date, {rs("CASE WHEN qty IS NOT NULL THEN least(greatest(qty, q[1]), q[2]) END")} AS qty FROM prep JOIN q USING (l_suppkey, cutoff)"""
)
def outlier_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.clip_outliers(P.prepared(spark, sf_dir), "qty", ["l_suppkey"]).select(*SERIES, "date", rd("qty").alias("qty"))


@query(
    f"""WITH panel AS ({P.SQL['part_m']}), {_decompose_sql('panel', 'l_partkey', 'qty', 'CASE WHEN n > 7 THEN least(7, n // 2) ELSE 2 END', (2, 3, 4, 5, 6, 7), 'dc')},
q AS (SELECT l_partkey, quantile_cont(resid, [0.025, 0.975]) AS q FROM dc GROUP BY 1)
SELECT l_partkey, date, {rs("coalesce(trend + seasonal + CASE WHEN resid IS NOT NULL THEN least(greatest(resid, q[1]), q[2]) END, qty)", 7)} AS qty FROM dc JOIN q USING (l_partkey)"""
)
def outlier_clip_resid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.clip_residual_outliers(P.part_m(spark, sf_dir), "qty", ["l_partkey"], "date").select("l_partkey", "date", rd("qty", 7).alias("qty"))


def _guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ma(spark, sf_dir).withColumn("prediction", F.col("filled_qty") * (1 + F.pmod(F.col("l_suppkey"), F.lit(5))))
    return guard.guardrail(rows.where("sample = 'test'"), ["l_suppkey"], "baseline_qty_ma_4", 2.5)


_GUARD = f"""{_MA}, pr AS (SELECT b.*, p.filled_qty * (1 + b.l_suppkey % 5) AS prediction FROM base b JOIN prep p USING (l_suppkey, cutoff, date) WHERE b.sample = 'test'),
t AS (SELECT *, sum(greatest(coalesce(prediction, 0), 0)) OVER s / nullif(sum(greatest(coalesce(ma, 0), 0)) OVER s, 0) AS r0 FROM pr WINDOW s AS (PARTITION BY l_suppkey, cutoff)),
g AS (SELECT *, CASE WHEN r0 > 0 THEN r0 ELSE 1.0 END AS r FROM t),
gd AS (SELECT *, greatest(coalesce(prediction, 0), 0) * CASE WHEN r > 2.5 THEN 2.5 / r WHEN r < 0.4 THEN 0.4 / r ELSE 1.0 END AS guarded, r > 2.5 OR r < 0.4 AS guardrail FROM g)"""


@query(f"WITH {_GUARD} SELECT l_suppkey, cutoff, date, {rs('prediction', 4)} AS model_prediction, {rs('guarded', 4)} AS prediction, guardrail FROM gd")
def guardrail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _guarded(spark, sf_dir).select(*SERIES, "date", rd("model_prediction", 4).alias("model_prediction"), rd("prediction", 4).alias("prediction"), "guardrail")


@query(f"WITH {_GUARD}, u AS (SELECT l_suppkey, cutoff, bool_or(guardrail) AS used FROM gd GROUP BY ALL) SELECT {rs('CAST(avg(CASE WHEN used THEN 100.0 ELSE 0.0 END) AS DOUBLE)')} AS usage_pct, count(*) AS n_series FROM u")
def guardrail_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.guardrail_usage(_guarded(spark, sf_dir), SERIES).select(rd("usage_pct").alias("usage_pct"), "n_series")


def _ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = statistics.intermittence(_ma(spark, sf_dir).withColumn("prediction", F.col("filled_qty")), SERIES, "qty")
    rows = rows.withColumn("feature_qty_cov", F.pmod(F.col("l_suppkey"), F.lit(7)) / 4.0)
    return guard.smart_ensemble(rows, "prediction", "baseline_qty_ma_4", "feature_qty_intermittence", "feature_qty_cov")


_ENSEMBLE = f"""{_MA}, it AS (SELECT l_suppkey, cutoff, CAST(avg(CASE WHEN qty IS NULL OR qty = 0 THEN 100.0 ELSE 0.0 END) AS DOUBLE) AS i FROM prep WHERE sample = 'train' GROUP BY ALL),
en AS (SELECT b.*, p.filled_qty, coalesce(i, 0) AS i, CAST((b.l_suppkey % 7) / 4.0 AS DOUBLE) AS c, CASE WHEN coalesce(i, 0) >= 50 OR (b.l_suppkey % 7) / 4.0 >= 1 THEN 'baseline' ELSE 'prediction' END AS decision
 FROM base b JOIN prep p USING (l_suppkey, cutoff, date) LEFT JOIN it USING (l_suppkey, cutoff))"""


@query(f"WITH {_ENSEMBLE} SELECT l_suppkey, cutoff, date, decision AS ensemble_choice, {rs('''CASE WHEN decision = 'baseline' THEN ma ELSE filled_qty END''', 4)} AS prediction_ensemble FROM en")
def smart_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ensemble(spark, sf_dir).select(*SERIES, "date", "ensemble_choice", rd("prediction_ensemble", 4).alias("prediction_ensemble"))


@query(
    f"""WITH {_ENSEMBLE}, s AS (SELECT l_suppkey, cutoff, max(i) AS i, max(c) AS c, max(decision) AS decision, count(*) AS n FROM en GROUP BY ALL)
SELECT decision, count(*) AS n_series, {rs('avg(i)')} AS mean_intermittence, {rs('avg(c)')} AS mean_cov, CAST(sum(n) AS BIGINT) AS n_rows FROM s GROUP BY 1"""
)
def ensemble_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = guard.ensemble_stats(_ensemble(spark, sf_dir), SERIES, "feature_qty_intermittence", "feature_qty_cov")
    return guard.ensemble_summary(stats).select("decision", "n_series", rd("mean_intermittence").alias("mean_intermittence"), rd("mean_cov").alias("mean_cov"), "n_rows")


def _metric_sql(model: str) -> dict[str, str]:
    e = f"({model} - qty)"
    ok = f"qty IS NOT NULL AND {model} IS NOT NULL"
    return {
        "RMSE": f"sqrt(avg({e} * {e}) FILTER (WHERE {ok}))",
        "MAE": f"avg(abs({e})) FILTER (WHERE {ok})",
        "MAPE": f"100 * avg(abs({e} / qty)) FILTER (WHERE {ok} AND qty <> 0)",
        "WMAPE": f"100 * sum(abs({e})) FILTER (WHERE {ok}) / nullif(sum(qty) FILTER (WHERE {ok}), 0)",
        "Custom Metric": f"100 * (sum(abs({e})) FILTER (WHERE {ok}) + abs(sum({e}) FILTER (WHERE {ok}))) / nullif(sum(qty) FILTER (WHERE {ok}), 0)",
    }


_EVALUATED = f"""{_MA}, ev AS (SELECT b.*, p.filled_qty * 1.1 AS model FROM base b JOIN prep p USING (l_suppkey, cutoff, date) WHERE b.sample = 'test' AND (b.qty IS NULL OR b.qty <> 0))"""
_MODELS = {"baseline_qty_ma_4": "ma", "prediction": "model"}


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ma(spark, sf_dir).withColumn("prediction", F.col("filled_qty") * F.lit(1.1))


@query(
    f"WITH {_EVALUATED} "
    + " UNION ALL ".join(f"SELECT '{n}' AS model, '{m}' AS metric, {rs(e, 4)} AS value FROM ev" for n, c in _MODELS.items() for m, e in _metric_sql(c).items())
)
def metric_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.evaluate(_evaluated(spark, sf_dir), "qty", list(_MODELS)).select("model", "metric", rd("value", 4).alias("value"))


@query(
    f"WITH {_EVALUATED} "
    + " UNION ALL ".join(f"SELECT '{n}' AS model, " + ", ".join(f'round_even({e}, 2) AS "{m}"' for m, e in _metric_sql(c).items()) + " FROM ev" for n, c in _MODELS.items())
)
def metric_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.metric_table(_evaluated(spark, sf_dir), "qty", list(_MODELS))


@query(
    f"WITH {_EVALUATED} "
    + " UNION ALL ".join(f"SELECT horizon, '{n}' AS model, {rs(_metric_sql(c)['RMSE'], 4)} AS value FROM ev WHERE horizon IN (1, 2, 3) GROUP BY horizon" for n, c in _MODELS.items())
)
def grouped_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.grouped_metric(_evaluated(spark, sf_dir), "qty", list(_MODELS), "horizon", "RMSE", [1, 2, 3])
    return out.select("horizon", "model", rd("value", 4).alias("value"))


# models


def _model_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    weekly = preparation.run_data_preparation(P.orders_w(spark, sf_dir), "date", ["o_orderpriority", "o_orderstatus"], ["n_orders"], "n_orders", 4, "W-MON", 1)
    keys = ["o_orderpriority", "o_orderstatus", "cutoff"]
    rows = features.periods(features.date_features(weekly, "date"), keys, "date", "n_orders")
    return features.lags(rows, keys, "date", ["filled_n_orders"], (1, 4), fill_lags=True)


_KEYS = ["o_orderpriority", "o_orderstatus"]
_FEATURES = ["feature_periods", "feature_month", "feature_week", "feature_filled_n_orders_lag_1", "feature_filled_n_orders_lag_4"]


def _forecast(model: str, params: dict | None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = models.run_backtesting(_model_frame(spark, sf_dir), _KEYS, _FEATURES, "n_orders", model=model, params=params)
        return out.frame.where("sample = 'test'").select(*_KEYS, "cutoff", "date", "horizon", "prediction")

    run.__name__ = f"forecast_{model.lower()}"
    return query()(run)


for _model in models.MODELS:  # the parameters that go with the number of rows, but fewer trees in the forest
    _forecast(_model, {"numTrees": 40, "maxDepth": 10} if _model == "RF" else None)


_GROUPED = f"""{_PERIODS}, g AS (SELECT l_suppkey, cutoff, date, sample, coalesce(qty, 0) AS y, feature_periods AS x, CAST(month(date) AS INT) AS m, l_suppkey % 3 AS grp FROM per),
mid AS (SELECT cutoff, grp, avg(y) AS mean FROM g WHERE sample = 'train' GROUP BY ALL)"""


def _grouped_backtest(spark: SparkSession, sf_dir: str, model: str, feature: str, params: dict) -> DataFrame:
    """A model per cutoff and third of the suppliers."""
    rows = features.periods(P.prepared(spark, sf_dir), SERIES, "date", "qty").withColumns({"feature_month": F.month("date"), "third": F.col("l_suppkey") % 3})
    out = models.run_backtesting(rows, "l_suppkey", [feature], "qty", "third", model, params).frame
    return out.select(*SERIES, "date", "sample", "training_group", rd("prediction", 4).alias("prediction"))


@query(
    f"""WITH {_GROUPED}, f AS (SELECT cutoff, grp, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM g WHERE sample = 'train' GROUP BY ALL)
SELECT l_suppkey, cutoff, date, sample, CAST(grp AS INT) AS training_group, {rs('greatest(a + b * x, 0)', 4)} AS prediction FROM g JOIN f USING (cutoff, grp)"""
)
def backtest_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped_backtest(spark, sf_dir, "LR", "feature_periods", {"regParam": 0.0})


@query(
    f"""WITH {_GROUPED}, r AS (SELECT g.*, y - mean AS e FROM g JOIN mid USING (cutoff, grp) WHERE sample = 'train'),
h AS (SELECT cutoff, grp, m, sum(e) AS e, count(*) AS n FROM r GROUP BY ALL),
c AS (SELECT cutoff, grp, m, sum(e) OVER w AS le, sum(n) OVER w AS ln, sum(e) OVER a AS te, sum(n) OVER a AS tn FROM h
  WINDOW w AS (PARTITION BY cutoff, grp ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY cutoff, grp)),
b AS (SELECT cutoff, grp, m AS edge, le / (ln + 3) AS low, (te - le) / (tn - ln + 3) AS high FROM c WHERE ln >= 20 AND tn - ln >= 20
  QUALIFY row_number() OVER (PARTITION BY cutoff, grp ORDER BY le * le / (ln + 3) + (te - le) * (te - le) / (tn - ln + 3) DESC, m) = 1)
SELECT l_suppkey, cutoff, date, sample, CAST(grp AS INT) AS training_group, {rs('greatest(mean + 0.5 * coalesce(CASE WHEN m <= edge THEN low ELSE high END, 0), 0)', 4)} AS prediction
FROM g JOIN mid USING (cutoff, grp) LEFT JOIN b USING (cutoff, grp)"""
)
def backtest_stump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One boosted tree of two leaves, with an L2 term."""
    return _grouped_backtest(spark, sf_dir, "LGBM", "feature_month", {"maxIter": 1, "num_leaves": 2, "stepSize": 0.5, "reg_lambda": 3.0})


@query()
def tune_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successive halving: rows grow to 3,000 while candidates shrink."""
    train = _model_frame(spark, sf_dir).where("sample = 'train'")
    rows = tuning.rows_for(train, F.lit("all"), _FEATURES, F.coalesce("n_orders", F.lit(0.0)), F.lit(1.0), "date", 42)
    space = models.grid("GBM") | {"maxIter": [10, 20]}
    best = tuning.search(rows, {"all": rows.count()}, "GBM", space).best["all"]
    return spark.createDataFrame([(k, float(v)) for k, v in sorted(best.items())], "parameter string, value double")


@query()
def mi_feature_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.feature_scores(_model_frame(spark, sf_dir).where("sample = 'train'"), _KEYS, _FEATURES, "n_orders")


@query()
def pipeline_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = Options(horizon=8, freq="W-MON", n_cutoffs=3, baseline_types=("MA", "CROSTON"), model="LGBM", params={"maxIter": 10, "maxDepth": 5}, use_guardrail=True, use_weights=True)
    out = run_pipeline(P.orders_w(spark, sf_dir), "date", _KEYS, ["n_orders"], "n_orders", options)
    return out.metrics.select("model", "metric", F.round("value", 4).alias("value"))


@query()
def pipeline_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline as it is without any option: four baselines, among them 1,000 trees a series, and a boosted model."""
    out = run_pipeline(P.ev_d(spark, sf_dir), "date", ["event_type"], ["n"])
    return out.metrics.select("model", "metric", F.round("value", 4).alias("value"))


def _pipeline_without_model(spark: SparkSession, sf_dir: str):
    options = Options(P.HORIZON, "MS", P.CUTOFFS, dp_window_size=P.WINDOW, fe_window_size=(2, 6), lags=(4, 8), baseline_types=("MA",), bs_window_size=4, model=None)
    return run_pipeline(P.supp_m(spark, sf_dir), "date", ["l_suppkey"], ["qty"], "qty", options)


@query(f"WITH {_EVALUATED} " + " UNION ALL ".join(f"SELECT 'baseline_qty_ma_4' AS model, '{m}' AS metric, {rs(e, 4)} AS value FROM ev" for m, e in _metric_sql("ma").items()))
def pipeline_baseline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline from raw cells to metrics, without a learned model."""
    return _pipeline_without_model(spark, sf_dir).metrics.select("model", "metric", rd("value", 4).alias("value"))


@query(f"WITH {PREP} SELECT cutoff, count(*) AS n_rows, count_if(sample = 'train') AS train_rows, count_if(sample = 'test') AS test_rows FROM prep GROUP BY 1")
def pipeline_cutoff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pipeline_without_model(spark, sf_dir).cutoff_stats


# sources, sinks, streams


@query("SELECT event_type, CAST(ts AS DATE) AS date, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_cells(P.table(spark, sf_dir, "events"), "ts", ["event_type"], "value").withColumn("total", F.round("total", 2))


_EVENT = "event_type"


@query(
    f"WITH panel AS ({P.SQL['ev_d']}) SELECT event_type, date, n, "
    + ", ".join(f"lag(n, {k}) OVER (PARTITION BY event_type ORDER BY date) AS feature_n_lag_{k}" for k in (1, 7))
    + ", " + ", ".join(f"{rs(f'avg(n) {_over(w, _EVENT)}')} AS n_ma_{w}" for w in (3, 7))
    + " FROM panel"
)
def stream_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily cells as a stream, dealt over several batches in no order, to the features they end in."""
    where = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    cells = P.ev_d(spark, sf_dir)
    cells.repartition(3, "date").write.parquet(f"{where}/in/0")
    after = cells.agg(F.max("date").alias("date")).select(F.lit("end").alias("event_type"), "date", F.lit(0.0).alias("n"))
    for k in (1, 2):  # cells behind all others, so that the watermark passes these
        after.withColumn("date", F.date_add("date", 10_000 + k)).write.parquet(f"{where}/in/{k}")
    stream = spark.readStream.schema(cells.schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/in/*")
    out = stateful_features(stream, "event_type", "date", "n", (1, 7), (3, 7), late="9000 days")
    run = out.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    found = spark.read.schema(out.schema).parquet(f"{where}/out").where("event_type <> 'end'")
    return found.select("event_type", "date", "n", "feature_n_lag_1", "feature_n_lag_7", rd("n_ma_3").alias("n_ma_3"), rd("n_ma_7").alias("n_ma_7"))


@query()
def generate_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.generate_sample(spark, "W", 52)


@query(f"SELECT * FROM ({P.SQL['ev_d']})")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = f"{shared_folder(spark)}/csv_round_trip-{uuid.uuid4().hex}"
    tables.write_results(P.ev_d(spark, sf_dir), where)
    return tables.read_csv(spark, where, "event_type string, date date, n double")


@query(
    f"WITH {_EVALUATED} "
    + " UNION ALL ".join(f"SELECT '{n}' AS model, " + ", ".join(f'{rs(e, 4)} AS "{m}"' for m, e in _metric_sql(c).items()) + " FROM ev" for n, c in _MODELS.items())
)
def metrics_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = f"{shared_folder(spark)}/metrics_csv-{uuid.uuid4().hex}"
    tables.write_metrics(metrics.evaluate(_evaluated(spark, sf_dir), "qty", list(_MODELS)), where)
    out = tables.read_csv(spark, where, "model string, " + ", ".join(f"`{m}` double" for m in metrics.METRICS))
    return out.select("model", *[rd(F.col(f"`{m}`"), 4).alias(m) for m in metrics.METRICS])


@query(f"WITH {PREP} SELECT cutoff, count(*) AS n_rows, count_if(sample = 'train') AS train_rows, count_if(sample = 'test') AS test_rows FROM prep GROUP BY 1")
def cutoff_stats_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = f"{shared_folder(spark)}/cutoff_stats_csv-{uuid.uuid4().hex}"
    tables.write_cutoff_statistics(preparation.cutoff_statistics(P.prepared(spark, sf_dir)), where)
    return tables.read_csv(spark, where, "cutoff date, n_rows long, train_rows long, test_rows long")


@query()
def request_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = forecast(spark, {"data": P.ev_d(spark, sf_dir), "date_col": "date", "group_cols": ["event_type"], "signal_cols": ["n"], "freq": "D", "horizon": 3, "model": "LR", "lags": (1, 2), "fe_window_size": (2, 3)})
    if out["status"] != "success":
        raise RuntimeError(out["message"])
    return out["predictions"].select("event_type", "date", "prediction")
