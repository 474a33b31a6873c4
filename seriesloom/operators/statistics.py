"""Statistics per series, joined back to its rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesloom.checkpoints import materialize
from seriesloom.functions.ranks import running_before
from seriesloom.panel import finite_or_zero, names, nonzero_or_null, ordered, upto

#: Periods that ``cov`` can meet.
PERIODS = (2, 3, 4, 5, 6, 7)


def _train(df: DataFrame) -> Column:
    return F.col("sample") == "train" if "sample" in df.columns else F.lit(True)


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str], column: str, default: object = None) -> DataFrame:
    """One value per series back to its rows; series without one get ``default``."""
    out = df.join(stats.select(*keys, column), list(keys), "left")
    return out if default is None else out.withColumn(column, F.coalesce(column, F.lit(default)))


def _centred(v: Column, p: int, w) -> Column:
    """Centred moving mean of period ``p``: half weight at both ends where p is even."""
    h = p // 2
    total = F.sum(v).over(w.rowsBetween(-h, h))
    if p % 2:
        return total / p
    return (total - 0.5 * (F.lag(v, h).over(w) + F.lead(v, h).over(w))) / p


def _centred_from_sums(v: Column, p: int, w) -> Column:
    """``_centred`` from the differences of running sums ``_sum`` and counts ``_seen``, whatever the period: a row looks at four others."""
    h = p // 2
    inside = lambda c: F.lead(c, h).over(w) - F.coalesce(F.lag(c, h + 1).over(w), F.lit(0))
    total = F.when(inside("_seen") > 0, inside("_sum"))
    if p % 2:
        return total / p
    return (total - 0.5 * (F.lag(v, h).over(w) + F.lead(v, h).over(w))) / p


def decompose_columns(df: DataFrame, keys: Sequence[str], date_col: str, value: str, period: Column | int, periods: Sequence[int], sums: bool = False) -> DataFrame:
    """Adds _trend, _seasonal and _resid of the classical additive decomposition with a period that may differ by series.

    Frames need fixed bounds, so each candidate period has its own centred sum in the
    same window and a CASE picks one. All windows of the series share one sort. With
    ``sums`` no frame is added up per row: centred sums are differences of running ones,
    for periods of many rows.
    """
    w = ordered(keys, date_col)
    p = F.lit(period) if isinstance(period, int) else period
    out = df.withColumns({"_pos": F.row_number().over(w) - 1, "_n": F.count("*").over(W.partitionBy(*keys)), "_p": p})
    if sums:
        out = out.withColumns({"_sum": F.coalesce(F.sum(value).over(upto(keys, date_col)), F.lit(0.0)), "_seen": F.count(value).over(upto(keys, date_col))})
    centred = _centred_from_sums if sums else _centred
    trend = F.lit(None).cast("double")
    for k in periods:
        inside = (F.col("_pos") >= k // 2) & (F.col("_pos") < F.col("_n") - k // 2)
        trend = F.when((F.col("_p") == k) & inside, centred(F.col(value), k, w)).otherwise(trend)
    out = out.withColumn("_trend", trend)
    out = out.withColumn("_phase", F.col("_pos") % F.col("_p")).withColumn("_detr", F.col(value) - F.col("_trend"))
    phase = W.partitionBy(*keys, "_phase")
    out = out.withColumns({"_mean": F.avg("_detr").over(phase), "_inphase": F.count("*").over(phase)})
    centre = F.sum(F.col("_mean") / F.col("_inphase")).over(W.partitionBy(*keys)) / F.least(F.col("_p"), F.col("_n"))
    out = out.withColumn("_seasonal", F.col("_mean") - centre)
    return out.withColumn("_resid", F.col(value) - F.col("_trend") - F.col("_seasonal"))


def series_period(n: Column) -> Column:
    """Period for a series of ``n`` rows: half its length, at most 7; 2 for short ones."""
    return F.when(n > 7, F.least(F.lit(7), F.floor(n / 2))).otherwise(2).cast("int")


def dispersion(df: DataFrame, group_cols: str | Sequence[str], date_col: str, value: str, mode: str = "reference") -> DataFrame:
    """(keys, feature_<value>_cov) over train rows with a non-zero or missing value.

    From four rows without a missing value on, deviation and mean are those of the
    decomposition's residuals (``mode="level"`` divides by the mean of the values, which
    does not vanish); else sample deviation and mean of the values.
    """
    keys = names(group_cols)
    rows = df.where(_train(df) & nonzero_or_null(F.col(value))).select(*keys, date_col, F.col(value).cast("double").alias("_v"))
    n = F.count("*").over(W.partitionBy(*keys))
    parts = decompose_columns(rows, keys, date_col, "_v", series_period(n), PERIODS)
    stats = parts.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.count("_v").alias("_filled"),
        F.avg("_v").alias("_vm"),
        F.stddev_samp("_v").alias("_vs"),
        F.avg("_resid").alias("_rm"),
        F.stddev_pop("_resid").alias("_rs"),
    )
    regular = (F.col("_n") >= 4) & (F.col("_filled") == F.col("_n"))
    deviation = F.coalesce(F.when(regular, F.col("_rs")).otherwise(F.col("_vs")), F.lit(0.0))
    mean = F.when(regular & F.lit(mode == "reference"), F.col("_rm")).otherwise(F.col("_vm"))
    return stats.select(*keys, finite_or_zero(F.try_divide(deviation, mean)).alias(f"feature_{value}_cov"))


def cov(df: DataFrame, group_cols: str | Sequence[str], date_col: str, value: str, mode: str = "reference") -> DataFrame:
    keys = names(group_cols)
    return attach(df, dispersion(df, keys, date_col, value, mode), keys, f"feature_{value}_cov", 0.0)


def inferred_period(gap: Column) -> Column:
    """The period that goes with a median gap in days: a week of days, a year of weeks or of months, else 7."""
    days = F.floor(gap)
    return F.when(days == 7, 52).when(days.between(28, 31), 12).otherwise(7).cast("int")


def decomposition(df: DataFrame, group_cols: str | Sequence[str], date_col: str, value: str, period: int | None = None) -> DataFrame:
    """``feature_trend_<value>`` and ``feature_seasonal_<value>`` per series, carried to its ends.

    Without a ``period`` each series gets its own, from the median gap between its dates
    (``inferred_period``), so that a panel may mix daily, weekly and monthly series.
    Series shorter than two periods get NULL. Missing ends are filled forward, then
    backward, inside the series.
    """
    keys = names(group_cols)
    if period is None:
        rows = df.withColumn("_gap", F.date_diff(date_col, F.lag(date_col).over(ordered(keys, date_col))))
        rows = rows.withColumn("_period", inferred_period(F.percentile("_gap", F.lit(0.5)).over(W.partitionBy(*keys))))
        parts = decompose_columns(rows, keys, date_col, value, F.col("_period"), (7, 12, 52), sums=True)
    else:
        parts = decompose_columns(df, keys, date_col, value, period, (period,))
    long = F.col("_n") >= 2 * F.col("_p")
    back = ordered(keys, date_col).rowsBetween(0, W.unboundedFollowing)
    filled = {
        f"feature_{n}_{value}": F.when(long, F.coalesce(F.last(c, True).over(upto(keys, date_col)), F.first(c, True).over(back)))
        for n, c in (("trend", "_trend"), ("seasonal", "_seasonal"))
    }
    return parts.withColumns(filled).select(*df.columns, *filled)


def intermittence(df: DataFrame, group_cols: str | Sequence[str], value: str) -> DataFrame:
    """``feature_<value>_intermittence``: percentage of missing or zero values on train rows; 0 without train rows."""
    keys, name = names(group_cols), f"feature_{value}_intermittence"
    empty = F.when(F.col(value).isNull() | (F.col(value) == 0), 100.0).otherwise(0.0)
    return attach(df, df.where(_train(df)).groupBy(*keys).agg(F.avg(empty).alias(name)), keys, name, 0.0)


def zero_runs(df: DataFrame, group_cols: str | Sequence[str], date_col: str, value: str, sample: str | None = None) -> DataFrame:
    """(keys, feature_<value>_max_consec_zeros): the longest run of zeros of each series; a missing value ends a run.

    A zero's place behind the last other row is the length of its run so far: one sort
    and one aggregate in the series' own task.
    """
    keys, w = names(group_cols), ordered(names(group_cols), date_col)
    rows = (df if sample is None else df.where(F.col("sample") == sample)).select(*keys, date_col, F.coalesce(F.col(value) == 0, F.lit(False)).alias("_z"))
    rows = rows.withColumn("_pos", F.row_number().over(w))
    run = F.col("_pos") - F.coalesce(F.max(F.when(~F.col("_z"), F.col("_pos"))).over(upto(keys, date_col)), F.lit(0))
    return rows.withColumn("_run", run).groupBy(*keys).agg(F.max("_run").cast("long").alias(f"feature_{value}_max_consec_zeros"))


def max_consecutive_zeros(df: DataFrame, group_cols: str | Sequence[str], date_col: str, value: str, sample: str | None = None) -> DataFrame:
    """``feature_<value>_max_consec_zeros`` on every row (``zero_runs``). All rows count, or one sample's."""
    keys = names(group_cols)
    return attach(df, zero_runs(df, keys, date_col, value, sample), keys, f"feature_{value}_max_consec_zeros", 0)


def autocorrelation(df: DataFrame, group_cols: str | Sequence[str], date_col: str, value: str, lag: int = 1, sample: str | None = None) -> DataFrame:
    """``feature_<value>_autocorr_lag<k>``: correlation of the present values with themselves k earlier; 0 if short, constant or not finite."""
    keys, name = names(group_cols), f"feature_{value}_autocorr_lag{lag}"
    rows = df.where(F.col(value).isNotNull()) if sample is None else df.where(F.col(value).isNotNull() & (F.col("sample") == sample))
    pairs = rows.withColumn("_y", F.lag(value, lag).over(ordered(keys, date_col)))
    both = F.col("_y").isNotNull()
    x, y = F.when(both, F.col(value)), F.col("_y")
    moments = pairs.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.var_pop(value).alias("_var"), F.covar_pop(x, y).alias("_c"), F.var_pop(x).alias("_vx"), F.var_pop(y).alias("_vy")
    )
    r = finite_or_zero(F.try_divide(F.col("_c"), F.sqrt(F.col("_vx") * F.col("_vy"))))
    flat = (F.col("_n") <= lag + 1) | (F.col("_var") <= 1e-10)
    return attach(df, moments.select(*keys, F.when(flat, 0.0).otherwise(r).alias(name)), keys, name, 0.0)


def distinct_combinations(df: DataFrame, low: str, group_cols: str | Sequence[str]) -> DataFrame:
    """``feature_distinct_<low>_<g>``: how many values of each g go with a value of ``low``."""
    out = df
    for g in (g for g in names(group_cols) if g != low):
        name = f"feature_distinct_{low}_{g}"
        counts = df.groupBy(F.col(low).alias("_low")).agg(F.count_distinct(g).alias(name))
        out = out.join(counts, F.col(low).eqNullSafe(F.col("_low")), "left").drop("_low")
    return out


def bucket(stats: DataFrame, value: str, q: int, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Quantile bucket 1..q of a statistic; repeated edges count once; 0 for NULL or fewer than two edges.

    ``by`` computes the edges per group (a cutoff, so that replicas do not weigh in). The
    statistic is written once, because ranges, edges and buckets all read it.
    """
    stats = materialize(stats)
    edges = quantile_edges(stats, value, q, by)
    rows = stats.join(F.broadcast(edges), F.lit(True) if not by else reduce(and_, [stats[c].eqNullSafe(edges[f"_by_{c}"]) for c in by]), "left")  # a row per cutoff
    rows = rows.drop(*[f"_by_{c}" for c in by])
    place = F.greatest(F.lit(1), F.size(F.filter("_edges", lambda e: e < F.col(value))))
    return rows.withColumn(name, F.when(F.col(value).isNull() | (F.coalesce(F.size("_edges"), F.lit(0)) < 2), 0).otherwise(place).cast("int")).drop("_edges")


def quantile_edges(stats: DataFrame, value: str, q: int, by: Sequence[str] = ()) -> DataFrame:
    """(_by_<c>, _edges): the distinct q-quantiles of a statistic, interpolated between neighbours, per group.

    Values are counted, put in order by ranges, and only those at a wanted rank are
    gathered, so that no task holds a group's values.
    """
    own = [F.col(c).alias(f"_by_{c}") for c in by]
    keys = [f"_by_{c}" for c in by]
    counts = stats.where(F.col(value).isNotNull()).groupBy(*own, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    order = [*[F.col(k).asc_nulls_first() for k in keys], F.col("_v").asc()]
    counts = materialize(running_before(counts, order, {"_before": F.col("_c")}))
    # totals per group: as many rows as cutoffs; ranks count from the group's first value
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.min("_before").alias("_first"))
    totals = totals.select(*[F.col(k).alias(f"{k}_") for k in keys], "_n", "_first")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys], F.lit(True))
    placed = counts.join(F.broadcast(totals), same).withColumn("_at", F.col("_before") - F.col("_first"))
    spots = F.array(*[F.lit(i / q) for i in range(q + 1)])
    rank = lambda i: (F.col("_n") - 1) * i
    inside = lambda r: (r >= F.col("_at")) & (r < F.col("_at") + F.col("_c"))
    low = F.transform(F.filter(spots, lambda i: inside(F.floor(rank(i)))), lambda i: F.struct(i.alias("i"), (1 - (rank(i) - F.floor(rank(i)))).alias("w")))
    high = F.transform(F.filter(spots, lambda i: inside(F.ceil(rank(i))) & (F.ceil(rank(i)) > F.floor(rank(i)))), lambda i: F.struct(i.alias("i"), (rank(i) - F.floor(rank(i))).alias("w")))
    met = placed.select(*keys, "_v", F.explode(F.concat(low, high)).alias("_s"))
    points = met.groupBy(*keys, "_s.i").agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.max_by(F.col("_s.w"), F.col("_v")).alias("w"))
    point = F.struct("i", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("w")).alias("v"))
    return points.groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("_p")).select(*keys, F.array_distinct(F.col("_p.v")).alias("_edges"))


def quantile_clusters(df: DataFrame, group_cols: str | Sequence[str], value: str, n_clusters: int = 10) -> DataFrame:
    """``feature_<value>_cluster`` from each series' mean on train rows, zeros included."""
    keys, name = names(group_cols), f"feature_{value}_cluster"
    means = df.where(_train(df)).groupBy(*keys).agg(F.avg(value).alias("_stat"))
    by = ["cutoff"] if "cutoff" in keys else []
    return attach(df, bucket(means, "_stat", n_clusters, name, by), keys, name, 0)


def history_clusters(df: DataFrame, group_cols: str | Sequence[str], value: str, n_clusters: int = 10) -> DataFrame:
    """``feature_<value>_history_cluster`` from each series' maximum on train rows, zeros left out."""
    keys, name = names(group_cols), f"feature_{value}_history_cluster"
    tops = df.where(_train(df) & (F.col(value) != 0)).groupBy(*keys).agg(F.max(value).alias("_stat"))
    by = ["cutoff"] if "cutoff" in keys else []
    return attach(df, bucket(tops, "_stat", n_clusters, name, by), keys, name, 0)


def intermittence_buckets(df: DataFrame, group_cols: str | Sequence[str], date_col: str, value: str, n_clusters: int = 10) -> DataFrame:
    """(keys, feature_<value>_intermittence_cluster) from the share of zeros after a series' first sale on train rows; 0 without a sale."""
    keys = names(group_cols)
    train = df.where(_train(df)).select(*keys, date_col, value)
    train = train.withColumn("_on", F.max(F.when(F.col(value) > 0, 1).otherwise(0)).over(upto(keys, date_col)))
    empty = F.when(F.col(value).isNull() | (F.col(value) == 0), 1.0).otherwise(0.0)
    shares = train.groupBy(*keys).agg(F.avg(F.when(F.col("_on") == 1, empty)).alias("_stat"))
    return bucket(shares, "_stat", n_clusters, f"feature_{value}_intermittence_cluster", ["cutoff"] if "cutoff" in keys else []).drop("_stat")


def intermittence_clusters(df: DataFrame, group_cols: str | Sequence[str], date_col: str, value: str, n_clusters: int = 10) -> DataFrame:
    """``feature_<value>_intermittence_cluster`` on every row (``intermittence_buckets``)."""
    keys = names(group_cols)
    return attach(df, intermittence_buckets(df, keys, date_col, value, n_clusters), keys, f"feature_{value}_intermittence_cluster", 0)


def series_statistics(
    df: DataFrame, base: DataFrame, group_cols: str | Sequence[str], date_col: str, value: str, n_clusters: int = 10, cov_mode: str = "reference", extended: bool = False
) -> DataFrame:
    """Dispersion, intermittence and cluster (zero runs and autocorrelation on request) of ``base``'s series, joined to ``df`` at once."""
    keys = names(group_cols)
    slim = base.select(*keys, date_col, value, *(["sample"] if "sample" in base.columns else []))
    empty = F.when(F.col(value).isNull() | (F.col(value) == 0), 100.0).otherwise(0.0)
    stats = slim.where(_train(slim)).groupBy(*keys).agg(F.avg(empty).alias(f"feature_{value}_intermittence"), F.avg(value).alias("_stat"))
    stats = bucket(stats, "_stat", n_clusters, f"feature_{value}_cluster", ["cutoff"] if "cutoff" in keys else []).drop("_stat")
    stats = stats.join(dispersion(slim, keys, date_col, value, cov_mode), keys, "full_outer")
    defaults: dict[str, object] = {f"feature_{value}_cov": 0.0, f"feature_{value}_intermittence": 0.0, f"feature_{value}_cluster": 0}
    if extended:
        runs, auto = f"feature_{value}_max_consec_zeros", f"feature_{value}_autocorr_lag1"
        more = autocorrelation(max_consecutive_zeros(slim, keys, date_col, value), keys, date_col, value)
        stats = stats.join(more.groupBy(*keys).agg(F.max(runs).alias(runs), F.max(auto).alias(auto)), keys, "full_outer")
        defaults |= {runs: 0, auto: 0.0}
    out = df.join(stats, keys, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def train_weights(df: DataFrame, group_cols: str | Sequence[str], periods_col: str = "feature_periods", weight_type: str = "linear") -> DataFrame:
    """``train_weight`` on train rows, rising to 1 with the periods: linearly or exponentially; NULL on test rows."""
    if weight_type not in ("linear", "exponential"):
        raise ValueError(f"weight_type: linear or exponential, not {weight_type}")
    train = _train(df)
    p = F.col(periods_col)
    most = F.max(F.when(train, p)).over(W.partitionBy(*names(group_cols)))
    weight = F.try_divide(p, most) if weight_type == "linear" else F.exp(F.try_divide(p - most, most))
    return df.withColumn("train_weight", F.when(train, weight))
