"""Running sums over a whole table in a given order, without a window that one task must sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesloom.checkpoints import materialize


def running_before(df: DataFrame, order: Sequence[Column], amounts: dict[str, Column]) -> DataFrame:
    """Under each name of ``amounts``: its sum (of whole numbers) over all rows that come earlier in the order; 0 for the first.

    Rows are dealt to tasks by ranges of the order; each range is summed by itself, and
    the ranges' totals, one row each, give where it starts.
    """
    held = {n: f"_amount_{i}" for i, n in enumerate(amounts)}
    dealt = df.withColumns({held[n]: c.cast("long") for n, c in amounts.items()}).repartitionByRange(*order)
    dealt = materialize(dealt.withColumn("_part", F.spark_partition_id()))
    start, starts = [0] * len(held), []
    for r in dealt.groupBy("_part").agg(*[F.sum(c).alias(c) for c in held.values()]).orderBy("_part").collect():  # a row per range
        starts.append((r["_part"], *start))
        start = [x + (r[c] or 0) for x, c in zip(start, held.values())]
    offsets = df.sparkSession.createDataFrame(starts, ", ".join(["_part int", *(f"_start{c} long" for c in held.values())]))
    earlier = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    sums = {n: F.col(f"_start{c}") + F.coalesce(F.sum(c).over(earlier), F.lit(0)) for n, c in held.items()}
    return dealt.join(F.broadcast(offsets), "_part").withColumns(sums).drop("_part", *held.values(), *[f"_start{c}" for c in held.values()])
