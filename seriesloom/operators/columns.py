"""Projection, profiling and reshaping helpers."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesloom.panel import names


def tidy(df: DataFrame, keys: Sequence[str], signals: Sequence[str]) -> DataFrame:
    """Column names in lower case, keys as text (a missing key becomes ``nan``), signals as numbers or NULL."""
    out = df.toDF(*[c.lower() for c in df.columns])
    text = {k: F.coalesce(F.col(k).cast("string"), F.lit("nan")) for k in names(keys)}
    number = {s: F.expr(f"try_cast(`{s}` AS DOUBLE)") for s in names(signals)}
    return out.withColumns(text | number)


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: rows, missing values, their share and the distinct values; one pass."""
    columns = list(columns or df.columns)
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(columns):
        aggs += [F.count_if(F.col(c).isNull()).alias(f"na{i}"), F.count_distinct(F.col(c)).alias(f"d{i}")]
    row = df.agg(*aggs)
    each = [F.struct(F.lit(c).alias("column"), F.col("n").alias("n_rows"), F.col(f"na{i}").alias("n_missing"), F.col(f"d{i}").alias("n_distinct")) for i, c in enumerate(columns)]
    out = row.select(F.explode(F.array(*each)).alias("x")).select("x.*")
    return out.withColumn("missing_pct", F.coalesce(F.try_divide(100.0 * F.col("n_missing"), F.col("n_rows")), F.lit(0.0)))


def duplicated_names(df: DataFrame) -> list[str]:
    return sorted({c for c in df.columns if df.columns.count(c) > 1})


def empty_columns(df: DataFrame) -> list[str]:
    """Columns without any value."""
    row = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if row[c] == 0]


def unpivot(df: DataFrame, id_vars: Sequence[str], var_name: str = "date", value_name: str = "value") -> DataFrame:
    """Wide to long; the former column names stay text."""
    ids = names(id_vars)
    return df.unpivot(ids, [c for c in df.columns if c not in ids], var_name, value_name)


def round_half_even(df: DataFrame, columns: Sequence[str], digits: int = 2) -> DataFrame:
    return df.withColumns({c: F.bround(c, digits) for c in columns})


def drop_features(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("feature_")])


def feature_columns(df: DataFrame, use_lags: bool = True) -> list[str]:
    """Every column whose name contains ``feature``; without lags on request."""
    return [c for c in df.columns if "feature" in c and (use_lags or "lag" not in c)]


def first_matching(df: DataFrame, pattern: str) -> str | None:
    return next((c for c in df.columns if re.match(pattern, c)), None)


def top_series(df: DataFrame, group_cols: Sequence[str], target: str, k: int) -> DataFrame:
    """The rows of the ``k`` series with the largest total target; ties by key."""
    keys = names(group_cols)
    top = df.groupBy(*keys).agg(F.sum(target).alias("_total")).orderBy(F.desc("_total"), *keys).limit(k)
    return df.join(top.select(*keys), keys, "left_semi")


#: Ranges of the random order that ``sample_keys`` counts.
RANGES = 1 << 16


def sample_keys(df: DataFrame, group_cols: Sequence[str], share: float = 0.25, seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """``int(share * n)`` of the ``n`` keys, of each ``by`` if given, the same on every run.

    Keys stand in a random order that is cut into RANGES ranges; counts per range say in
    which one the sample ends, and only the keys of that range are sorted.
    """
    keys, by = names(group_cols), list(by)
    h = F.xxhash64(*keys, F.lit(seed))
    distinct = df.select(*keys).distinct().withColumns({"_h": h, "_range": F.shiftright(h, 48).cast("int")})
    counts = distinct.groupBy(*by, "_range").agg(F.count("*").alias("_in"))
    one = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    counts = counts.withColumns({"_before": F.sum("_in").over(one.orderBy("_range")) - F.col("_in"), "_want": F.floor(F.sum("_in").over(one) * share)})
    counts = counts.where(F.col("_before") < F.col("_want")).select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_r"), "_before", "_want", "_in")
    same = F.col("_range") == F.col("_r")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    placed = distinct.join(counts, same)
    whole = placed.where(F.col("_before") + F.col("_in") <= F.col("_want"))
    last = placed.where(F.col("_before") + F.col("_in") > F.col("_want"))
    place = F.col("_before") + F.row_number().over(W.partitionBy(*by, "_range").orderBy("_h", *keys))
    return whole.select(*keys).unionByName(last.withColumn("_place", place).where(F.col("_place") <= F.col("_want")).select(*keys))


def rollup(df: DataFrame, by: Sequence[str], value: str, how: str = "sum") -> DataFrame:
    """Sum or mean of a value by the given columns, as plots need it."""
    return df.groupBy(*names(by)).agg({"sum": F.sum, "mean": F.avg}[how](value).alias(value))
