"""Calendar completion, smoothing, cutoffs, backtest replicas and horizons."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesloom.functions.frequency import Frequency, aligned, detect_frequency, frequency_params
from seriesloom.panel import clip0, double_columns, names, ordered, string_columns, trailing, upto


def complete(df: DataFrame, group_cols: str | Sequence[str], date_col: str, freq: str | Frequency) -> DataFrame:
    """Every grid date of each series between its first and last date; rows off the grid go, null keys go.

    Each row brings the grid dates between it and the next row, so that the observed rows
    alone travel, once, by their keys; a series without a grid date keeps its first date.
    """
    keys, f, day = names(group_cols), Frequency.parse(freq), F.col(date_col)
    rest = [c for c in df.columns if c not in (*keys, date_col)]
    w = ordered(keys, date_col)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = df.dropna(subset=keys).withColumns(
        {"_lo": F.min(date_col).over(whole), "_hi": F.max(date_col).over(whole), "_next": F.lead(date_col).over(w), "_first": F.row_number().over(w) == 1}
    )
    if f.kind == "D":  # counted from the first date
        steps = F.floor(F.date_diff(day, "_lo") / f.step).cast("int")
        on, after = F.date_add("_lo", steps * f.step) == day, F.date_add("_lo", (steps + 1) * f.step)
    else:
        on, after = f.on_grid(day) == day, f.on_grid(F.date_add(day, 1))
    none = f.on_grid(F.col("_lo")) > F.col("_hi")
    own = F.coalesce(on | (none & (day == F.col("_lo"))), F.lit(False)) | (F.col("_lo").isNull() & F.col("_first"))
    at = lambda d, own: F.struct(d.alias("d"), F.lit(own).alias("own"))
    gap = F.transform(f.between(after, F.date_sub("_next", 1)), lambda d: at(d, False))
    rows = rows.withColumn("_x", F.explode(F.when(own, F.concat(F.array(at(day, True)), gap)).otherwise(gap)))
    there = F.col("_x.own") & F.col("_x.d").isNotNull()
    return rows.select(*keys, F.col("_x.d").alias(date_col), *[F.when(there, F.col(c)).alias(c) for c in rest])


def smoothing(df: DataFrame, group_cols: str | Sequence[str], date_col: str, signal_cols: Sequence[str], window_size: int = 13) -> DataFrame:
    """``filled_x``: x, or the mean of the trailing window where x is missing; at least 0; NULL where the window is empty."""
    w = trailing(group_cols, date_col, window_size)
    filled = {f"filled_{c}": clip0(F.coalesce(F.col(c), F.avg(c).over(w))) for c in names(signal_cols)}
    return df.withColumns(filled)


def latest_dates(df: DataFrame, date_col: str, target: str, n: int) -> DataFrame:
    """The ``n`` latest dates on which the target is positive."""
    return df.where(F.col(target) > 0).select(date_col).distinct().orderBy(F.desc(date_col)).limit(n)


def cutoff_dates(df: DataFrame, date_col: str, target: str, n: int) -> list[date]:
    """The latest valid date, then the first valid date of each month going back, ``n`` in all."""
    firsts = df.where(F.col(target) > 0).groupBy(F.trunc(date_col, "month").alias("m")).agg(F.min(date_col).alias("first"), F.max(date_col).alias("last"))
    rows = firsts.orderBy(F.desc("m")).limit(n + 1).collect()  # n + 1 months at most
    if not rows:
        raise ValueError(f"no date with {target} > 0")
    latest = rows[0]["last"]
    return [latest, *(r["first"] for r in rows if r["first"] != latest)][:n]


def backtest(df: DataFrame, date_col: str, cutoffs: Sequence[date]) -> DataFrame:
    """A replica of all rows per cutoff; rows from the cutoff date on are ``test``. One explode, no join."""
    replicas = df.withColumn("cutoff", F.explode(F.array(*[F.lit(c) for c in cutoffs])))
    return replicas.withColumn("sample", F.when(F.col(date_col) >= F.col("cutoff"), "test").otherwise("train"))


def add_horizon(df: DataFrame, group_cols: str | Sequence[str], date_col: str, horizon: int, freq: str | Frequency, carry_across_cutoffs: bool = False) -> DataFrame:
    """Test rows for the ``horizon`` dates after each cutoff where a series lacks them.

    Text attributes and ``filled_*`` columns are carried forward within the series and
    cutoff; ``carry_across_cutoffs`` carries them from one cutoff's replica to the next.
    """
    keys = names(group_cols)
    series, day = [*keys, "cutoff"], F.col(date_col)
    w = ordered(series, date_col)
    future = Frequency.parse(freq).future(F.col("cutoff"), horizon)
    # a series' last row brings the dates that are missing; at most ``horizon`` are held per series
    have = F.collect_set(F.when(F.array_contains(future, day), day)).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    rows = df.withColumns({"_have": have, "_last": F.lead(F.lit(True)).over(w).isNull()})
    at = lambda d, own: F.struct(d.alias("d"), F.lit(own).alias("own"))
    own, new = F.array(at(day, True)), F.transform(F.array_except(future, F.col("_have")), lambda d: at(d, False))
    rows = rows.withColumn("_x", F.explode(F.when(F.col("_last"), F.concat(own, new)).otherwise(own)))
    there = F.col("_x.own")
    values = {date_col: F.col("_x.d"), "sample": F.when(there, F.col("sample")).otherwise("test")} if "sample" in df.columns else {date_col: F.col("_x.d")}
    both = rows.select(*[(values[c] if c in values else F.col(c) if c in series else F.when(there, F.col(c))).alias(c) for c in df.columns])
    if "sample" not in df.columns:
        both = both.withColumn("sample", F.lit(None).cast("string"))
    carried = [c for c in string_columns(df) if c not in keys] + [c for c in df.columns if c.startswith("filled_")]
    w = W.partitionBy(*keys).orderBy("cutoff", date_col).rowsBetween(W.unboundedPreceding, 0) if carry_across_cutoffs else upto(series, date_col)
    return both.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in carried})


def horizon_number(df: DataFrame, group_cols: str | Sequence[str], date_col: str, name: str = "horizon", before: int | None = 0) -> DataFrame:
    """1, 2, ... over the test rows of each series and cutoff; ``before`` on train rows."""
    w = W.partitionBy(*names(group_cols), "cutoff", "sample").orderBy(date_col)
    train = F.lit(before).cast("int")
    return df.withColumn(name, F.when(F.col("sample") == "test", F.row_number().over(w)).otherwise(train))


def forecast_lag(df: DataFrame, group_cols: str | Sequence[str], date_col: str) -> DataFrame:
    """``fcst_lag``: as ``horizon_number``, NULL before the first test row."""
    return horizon_number(df, [c for c in names(group_cols) if c != "cutoff"], date_col, "fcst_lag", None)


def filter_by_horizon(df: DataFrame, horizon: int) -> DataFrame:
    return df.where((F.col("sample") == "train") | ((F.col("sample") == "test") & (F.col("horizon") <= horizon)))


def horizon_profile(df: DataFrame, group_cols: str | Sequence[str]) -> DataFrame:
    """Median over the series of their rows, per cutoff and sample."""
    rows = df.groupBy("cutoff", "sample", *names(group_cols)).agg(F.count("*").alias("rows"))
    return rows.groupBy("cutoff", "sample").agg(F.median("rows").alias("median_rows"))


def cutoff_statistics(df: DataFrame) -> DataFrame:
    return df.groupBy("cutoff").agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("sample") == "train").alias("train_rows"),
        F.count_if(F.col("sample") == "test").alias("test_rows"),
    )


def late_backtest(
    df: DataFrame, group_cols: str | Sequence[str], date_col: str, cutoffs: Sequence[date], horizon: int, freq: str | Frequency, windowed: Callable[[DataFrame, list[str]], DataFrame], reach: int
) -> DataFrame:
    """What ``windowed(filter_by_horizon(horizon_number(add_horizon(backtest(df)))))`` is, with windows computed once for all cutoffs.

    ``df`` is a completed panel; ``windowed(df, keys)`` adds columns of windows that look
    back over ``reach`` rows at most, the own one included. Such columns do not depend on
    the cutoff where a series has rows; so they are computed on the series alone, and
    cutoffs are attached to the finished rows. Only the horizon rows that a series lacks
    are computed per cutoff, from the series' last ``reach`` rows. All of it is dealt by
    the keys once and sorted once, and no row travels per cutoff.
    """
    keys, f = names(group_cols), Frequency.parse(freq)
    whole, cut = W.partitionBy(*keys), [F.lit(c) for c in cutoffs]
    carried = [c for c in string_columns(df) if c not in keys] + [c for c in df.columns if c.startswith("filled_")]
    # a cutoff's replica holds all rows, so that what is carried is the same for every cutoff; windows see it carried
    df = df.withColumns({c: F.last(c, ignorenulls=True).over(upto(keys, date_col)) for c in carried})
    raw = windowed(df, keys).withColumn("_pos", F.row_number().over(ordered(keys, date_col)))
    raw = raw.withColumns({"_n": F.count("*").over(whole), "_lo": F.min(date_col).over(whole), "_before": F.array(*[F.count_if(F.col(date_col) < c).over(whole) for c in cut])})

    def attached(rows: DataFrame) -> DataFrame:
        """Rows per cutoff, with the dates that its horizon has outside the series."""
        rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(len(cut)))))
        future = F.element_at(F.array(*[f.future(c, horizon) for c in cut]), F.col("_i"))
        rows = rows.withColumns({"cutoff": F.element_at(F.array(*cut), F.col("_i")), "_b": F.element_at("_before", F.col("_i")), "_future": future})
        return rows.withColumn("_pre", F.size(F.filter("_future", lambda d: d < F.col("_lo"))))

    test = F.col(date_col) >= F.col("cutoff")
    number = F.when(test, F.col("_pos") - F.col("_b") + F.col("_pre")).otherwise(0).cast("int")
    out = [*raw.columns[:-4], "cutoff", "sample", "horizon"]
    there = attached(raw).withColumns({"sample": F.when(test, "test").otherwise("train"), "horizon": number}).where(~test | (F.col("horizon") <= horizon))

    # the horizon rows that are not there come from the last row, behind the rows that their windows look at
    tail = attached(raw.withColumn("_hi", F.max(date_col).over(whole)).where(F.col("_pos") > F.col("_n") - reach))
    tail = tail.withColumn("_new", F.filter("_future", lambda d: (d < F.col("_lo")) | (d > F.col("_hi")))).where(F.size("_new") > 0)
    at = lambda d, new: F.struct(d.alias("d"), F.lit(new).alias("new"))
    own, news = F.array(at(F.col(date_col), False)), F.transform("_new", lambda d: at(d, True))
    tail = tail.withColumn("_x", F.explode(F.when(F.col("_pos") == F.col("_n"), F.concat(own, news)).otherwise(own)))
    is_new, after = F.col("_x.new"), F.col("_x.new") & (F.col("_x.d") > F.col("_hi"))
    values = {c: F.when(after | ~is_new if c in carried else ~is_new, F.col(c)) for c in df.columns if c not in (*keys, date_col)}
    tail = tail.select(*keys, F.col("_x.d").alias(date_col), *[v.alias(c) for c, v in values.items()], "cutoff", is_new.alias("_is_new"), F.lit("test").alias("sample"), "_hi", "_future", "_n", "_b", "_pre")
    tail = windowed(tail, [*keys, "cutoff"]).where("_is_new")
    later = F.size(F.filter("_future", lambda d: (d > F.col("_hi")) & (d <= F.col(date_col)))) + F.col("_n") - F.col("_b") + F.col("_pre")
    earlier = F.size(F.filter("_future", lambda d: d <= F.col(date_col)))
    tail = tail.withColumn("horizon", F.when(F.col(date_col) > F.col("_hi"), later).otherwise(earlier).cast("int")).where(F.col("horizon") <= horizon)
    return there.select(*out).unionByName(tail.select(*out))


def run_data_preparation(
    df: DataFrame, date_col: str, group_cols: str | Sequence[str], signal_cols: Sequence[str], target: str | None = None, horizon: int | None = None, freq: str | None = None,
    n_cutoffs: int = 1, complete_dataframe: bool = True, smooth: bool = True, dp_window_size: int | None = None, cutoffs: Sequence[date] | None = None,
) -> DataFrame:
    """Completion, smoothing, cutoffs, replicas, horizon rows and the horizon filter; frequency and cutoffs alone run jobs."""
    keys, signals = names(group_cols), names(signal_cols)
    freq = aligned(freq, df, date_col) if freq else detect_frequency(df, date_col)
    known = frequency_params(freq)
    horizon, window = horizon or known["horizon"], dp_window_size or known["dp_window_size"]
    out = df.withColumns({c: F.col(c).cast("double") for c in signals})
    if complete_dataframe:
        out = complete(out, keys, date_col, freq)
    if smooth:
        out = smoothing(out, keys, date_col, [c for c in double_columns(out) if c in signals], window)
    cutoffs = list(cutoffs) if cutoffs else cutoff_dates(df, date_col, target or signals[0], n_cutoffs)
    out = add_horizon(backtest(out, date_col, cutoffs), keys, date_col, horizon, freq)
    return filter_by_horizon(horizon_number(out, keys, date_col), horizon)
