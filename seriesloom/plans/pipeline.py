"""From a raw panel to predictions and their errors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.checkpoints import materialize
from seriesloom.functions.frequency import aligned, detect_frequency, frequency_params
from seriesloom.operators import baselines, features, guard, metrics, models, preparation
from seriesloom.operators.columns import feature_columns
from seriesloom.panel import PanelSpec, ingest, names
from seriesloom.sources.tables import from_records


@dataclass
class Options:
    """What can be set, with its defaults; None takes the frequency's default."""

    horizon: int | None = 4
    freq: str | None = None
    n_cutoffs: int = 1
    complete_dataframe: bool = True
    smoothing: bool = True
    dp_window_size: int | None = 13
    fe_window_size: Sequence[int] | None = (4, 13)
    lags: Sequence[int] | None = (4, 13)
    fill_lags: bool = False
    n_clusters: int = 10
    lag_mask: str = "safe"
    baseline_types: Sequence[str] = ("MA", "LR", "ML", "CROSTON")
    bs_window_size: int | None = 13
    create_features: bool = False
    training_group: str | None = None
    model: str | None = "LGBM"
    params: dict | None = None
    use_lags: bool = True
    use_weights: bool = False
    tune_hyperparameters: bool = False
    search_method: str = "halving"
    scoring: str = "neg_mean_squared_log_error"
    n_iter: int | None = None
    param_distributions: dict | None = None
    best_features: bool | Sequence[str] = False
    use_feature_selection: bool = False
    n_best_features: int = 15
    remove_outliers: bool = False
    outlier_column: str | None = None
    lower_quantile: float = 0.025
    upper_quantile: float = 0.975
    ts_decomposition: bool = False
    baseline_col: str | None = None
    use_guardrail: bool = False
    guardrail_limit: float = 2.5
    eval_group_col: str | None = None
    eval_group_filter: Sequence | None = None
    use_parallel: bool = True
    num_cpus: int | None = None
    log_level: str | None = None
    seed: int = 42


@dataclass
class Result:
    """The lazy result frame and what was learned on the way."""

    frame: DataFrame
    metrics: DataFrame
    cutoff_stats: DataFrame
    grouped_metrics: DataFrame | None = None
    backtest: models.Backtest | None = None
    baseline_columns: list[str] = field(default_factory=list)

    @property
    def feature_importance(self) -> list[dict]:
        return self.backtest.feature_importance() if self.backtest else []


def run_pipeline(df: DataFrame, date_col: str, group_cols: str | Sequence[str], signal_cols: Sequence[str], target: str | None = None, options: Options | None = None) -> Result:
    """Preparation, features, baselines, models and metrics; every window runs per series and cutoff."""
    o = options or Options()
    if o.log_level:
        df.sparkSession.sparkContext.setLogLevel(o.log_level)
    keys, signals = names(group_cols), names(signal_cols)
    spec = PanelSpec(tuple(keys), date_col, tuple(signals), target or signals[0])
    series = [*keys, "cutoff"]
    df = ingest(df, spec)
    freq = aligned(o.freq, df, date_col) if o.freq else detect_frequency(df, date_col)
    known = frequency_params(freq)
    frame = preparation.run_data_preparation(
        df, date_col, keys, spec.signals, spec.target, o.horizon or known["horizon"], freq, o.n_cutoffs, o.complete_dataframe, o.smoothing, o.dp_window_size or known["dp_window_size"]
    )
    if o.remove_outliers:
        column = o.outlier_column or spec.target
        if o.ts_decomposition:
            frame = guard.clip_residual_outliers(frame, column, keys, date_col, o.lower_quantile, o.upper_quantile)
        else:
            frame = guard.clip_outliers(frame, column, keys, o.lower_quantile, o.upper_quantile)
    frame = materialize(frame)  # features and statistics both read it
    counts = preparation.cutoff_statistics(frame)  # what follows adds columns, no rows
    kept = materialize if o.model else (lambda f: f)  # a model reads its frame several times, metrics read it once
    windowed = [c for s in spec.signals for c in (f"filled_{s}", s) if c in frame.columns]
    frame = features.run_feature_engineering(
        frame, series, date_col, spec.target, freq, windowed, keys, o.fe_window_size or known["fe_window_size"], o.lags or known["lags"], o.fill_lags, o.n_clusters, lag_mask=o.lag_mask
    )
    frame = kept(frame)
    chosen = feature_columns(frame, o.use_lags)
    before = set(frame.columns)
    window = o.bs_window_size or known["bs_window_size"]
    known_ahead = feature_columns(frame, False)  # without lags, which train rows may lack
    frame = kept(baselines.run_baselines(frame, series, date_col, [spec.target], o.baseline_types, window, known_ahead, o.create_features))
    made = [c for c in frame.columns if c not in before and c.startswith("baseline_")]
    evaluated, backtest = list(made), None
    if o.model:
        chosen += [c for c in frame.columns if c not in before and c.startswith("feature_")]
        backtest = models.run_backtesting(
            frame, keys, chosen, spec.target, o.training_group, o.model, o.params, o.use_weights, o.use_guardrail, o.baseline_col or f"baseline_{spec.target}_ma_{window}",
            o.guardrail_limit, o.best_features or o.use_feature_selection, o.n_best_features, o.tune_hyperparameters, o.search_method, (o.num_cpus or 2) if o.use_parallel else 1, o.seed, date_col,
            o.n_iter, o.scoring, o.param_distributions,
        )
        frame = backtest.frame
        evaluated.append("prediction")
    grouped = metrics.grouped_metric(frame, spec.target, evaluated, o.eval_group_col, "RMSE", o.eval_group_filter) if o.eval_group_col else None
    return Result(frame, metrics.evaluate(frame, spec.target, evaluated), counts, grouped, backtest, made)


def forecast(spark: SparkSession, request: dict) -> dict:
    """One request as plain data: records in, records out, with metrics; an error comes back as its message.

    ``data`` may be a DataFrame instead, and then ``predictions`` is one, so that no row passes the driver.
    """
    try:
        known = {k: v for k, v in request.items() if k in Options.__dataclass_fields__}
        options = Options(**({"baseline_types": ("MA",)} | known))
        whole = isinstance(request.get("data"), DataFrame)
        missing = [k for k in ("data", "date_col", "group_cols", "signal_cols") if not (k == "data" and whole or request.get(k))]
        if missing:
            raise ValueError(f"missing: {missing}")
        df = request["data"] if whole else from_records(spark, request["data"], request["date_col"])
        out = run_pipeline(df, request["date_col"], request["group_cols"], request["signal_cols"], request.get("target"), options)
        table: dict[str, dict[str, float]] = {}
        for r in out.metrics.collect():
            table.setdefault(r.metric, {})[r.model] = r.value
        test = out.frame.where(F.col("sample") == "test")
        records = test if whole else [r.asDict() for r in test.collect()]  # as many as the request asked for
        return {"status": "success", "metrics": table, "predictions": records, "feature_importance": out.feature_importance}
    except Exception as e:  # the facade answers every request
        return {"status": "error", "message": f"{type(e).__name__}: {e}"}


def health() -> dict:
    return {"status": "healthy"}
