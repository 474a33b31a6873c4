"""Outliers, guardrails and the choice between prediction and baseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesloom.operators.statistics import PERIODS, decompose_columns, series_period
from seriesloom.panel import clip, clip0, finite_or_zero, names


def clip_outliers(df: DataFrame, column: str, group_cols: str | Sequence[str], lower: float = 0.025, upper: float = 0.975) -> DataFrame:
    """The column between its series' exact quantiles (per cutoff where there is one); NULL stays NULL.

    Quantiles are one aggregate per series, joined back.
    """
    keys = names(group_cols)
    by = [*keys, "cutoff"] if "cutoff" in df.columns and "cutoff" not in keys else keys
    bounds = df.groupBy(*by).agg(F.percentile(column, F.array(F.lit(lower), F.lit(upper))).alias("_q"))
    out = df.join(bounds, by, "left").withColumn(column, clip(F.col(column), F.col("_q")[0], F.col("_q")[1]))
    return out.select(*df.columns)


def clip_residual_outliers(df: DataFrame, column: str, group_cols: str | Sequence[str], date_col: str, lower: float = 0.025, upper: float = 0.975) -> DataFrame:
    """As ``clip_outliers`` for what trend and season leave over; rows without a residual stay as they are."""
    keys = names(group_cols)
    by = [*keys, "cutoff"] if "cutoff" in df.columns and "cutoff" not in keys else keys
    parts = decompose_columns(df, by, date_col, column, series_period(F.count("*").over(W.partitionBy(*by))), PERIODS)
    bounds = parts.groupBy(*by).agg(F.percentile("_resid", F.array(F.lit(lower), F.lit(upper))).alias("_q"))
    rebuilt = F.col("_trend") + F.col("_seasonal") + clip(F.col("_resid"), F.col("_q")[0], F.col("_q")[1])
    return parts.join(bounds, by, "left").withColumn(column, F.coalesce(rebuilt, F.col(column))).select(*df.columns)


def guardrail(df: DataFrame, group_cols: str | Sequence[str], baseline_col: str, limit: float = 2.5) -> DataFrame:
    """Predictions scaled so that their total stays within ``limit`` times the baseline's, either way, per series and cutoff.

    ``model_prediction`` keeps the prediction as it was; ``guardrail`` says where the
    scaling took effect. A total of 0 on either side leaves predictions alone.
    """
    keys = names(group_cols)
    by = W.partitionBy(*keys, "cutoff") if "cutoff" in df.columns and "cutoff" not in keys else W.partitionBy(*keys)
    clean = lambda c: clip0(finite_or_zero(F.col(c)))
    out = df.withColumns({"model_prediction": F.col("prediction"), "prediction": clean("prediction"), baseline_col: clean(baseline_col)})
    ratio = F.try_divide(F.sum("prediction").over(by), F.sum(baseline_col).over(by))
    out = out.withColumn("_r", F.coalesce(F.when(ratio > 0, ratio), F.lit(1.0)))
    factor = F.when(F.col("_r") > limit, limit / F.col("_r")).when(F.col("_r") < 1 / limit, (1 / limit) / F.col("_r")).otherwise(1.0)
    outside = (F.col("_r") > limit) | (F.col("_r") < 1 / limit)
    return out.withColumns({"prediction": F.col("prediction") * factor, "guardrail": outside}).drop("_r")


def guardrail_usage(df: DataFrame, group_cols: str | Sequence[str]) -> DataFrame:
    """Percentage of the series in which the guardrail took effect anywhere."""
    used = df.groupBy(*names(group_cols)).agg(F.bool_or("guardrail").alias("used"))
    return used.agg(F.avg(F.when(F.col("used"), 100.0).otherwise(0.0)).alias("usage_pct"), F.count("*").alias("n_series"))


def smart_ensemble(
    df: DataFrame, prediction_col: str, baseline_col: str, intermittence_col: str, cov_col: str, intermittence_threshold: float = 50.0, cov_threshold: float = 1.0
) -> DataFrame:
    """``prediction_ensemble``: the baseline where a series is intermittent or erratic, else the prediction. NULL statistics do not trigger."""
    if missing := [c for c in (prediction_col, baseline_col, intermittence_col, cov_col) if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    trigger = F.coalesce(F.col(intermittence_col) >= intermittence_threshold, F.lit(False)) | F.coalesce(F.col(cov_col) >= cov_threshold, F.lit(False))
    out = df.withColumn("ensemble_choice", F.when(trigger, "baseline").otherwise("prediction"))
    return out.withColumn("prediction_ensemble", F.when(trigger, F.col(baseline_col)).otherwise(F.col(prediction_col)))


def ensemble_stats(df: DataFrame, group_cols: str | Sequence[str], intermittence_col: str, cov_col: str) -> DataFrame:
    """One row per series: its statistics, the choice made and the rows it affects."""
    return df.groupBy(*names(group_cols)).agg(
        F.max(intermittence_col).alias("intermittence"), F.max(cov_col).alias("cov"), F.max("ensemble_choice").alias("decision"), F.count("*").alias("rows")
    )


def ensemble_summary(stats: DataFrame) -> DataFrame:
    return stats.groupBy("decision").agg(
        F.count("*").alias("n_series"), F.avg("intermittence").alias("mean_intermittence"), F.avg("cov").alias("mean_cov"), F.sum("rows").alias("n_rows")
    )
