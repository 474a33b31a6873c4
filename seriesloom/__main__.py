"""Command line: forecast a panel from a file, or a generated one, and write the results."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from seriesloom.plans.pipeline import Options, run_pipeline
from seriesloom.sources.tables import generate_sample, read_table, write_cutoff_statistics, write_metrics, write_results


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="seriesloom", description=__doc__)
    p.add_argument("--input", help="CSV, Parquet, ORC or JSON; a generated panel without it")
    p.add_argument("--date", default="date")
    p.add_argument("--keys", nargs="+", default=["product", "store"])
    p.add_argument("--signals", nargs="+", default=["sales"])
    p.add_argument("--freq", default="W")
    p.add_argument("--horizon", type=int)
    p.add_argument("--n-cutoffs", type=int, default=1)
    p.add_argument("--model", default="LGBM", choices=["LGBM", "RF", "GBM", "ADA", "LR"])
    p.add_argument("--tune", action="store_true")
    p.add_argument("--output", help="folder for the results, the metrics and, of several cutoffs, their rows")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    df = read_table(spark, a.input) if a.input else generate_sample(spark, a.freq)
    options = Options(horizon=a.horizon, freq=a.freq, n_cutoffs=a.n_cutoffs, model=a.model, tune_hyperparameters=a.tune, baseline_types=("MA", "CROSTON"), use_guardrail=True)
    out = run_pipeline(df, a.date, a.keys, a.signals, options=options)
    if a.output:
        write_results(out.frame, f"{a.output}/results")
        write_metrics(out.metrics, f"{a.output}/metrics")
        write_cutoff_statistics(out.cutoff_stats, f"{a.output}/cutoffs")
    for r in out.metrics.orderBy("metric", "model").collect():
        print(f"{r.metric:15} {r.model:30} {r.value if r.value is None else round(r.value, 4)}")


if __name__ == "__main__":
    main()
