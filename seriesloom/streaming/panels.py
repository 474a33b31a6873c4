"""Panels from event streams: the same cells as in batch, kept up to date by Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.panel import names


def event_cells(events: DataFrame, ts_col: str, group_cols: str | Sequence[str], value_col: str, every: str = "1 day", late: str = "1 day") -> DataFrame:
    """(keys, date, n, total) per key and tumbling window; a cell is final once the watermark has passed it.

    Works on a stream and, without the watermark's effect, on a table.
    """
    keys = names(group_cols)
    rows = events.withWatermark(ts_col, late) if events.isStreaming else events
    cells = rows.groupBy(F.window(ts_col, every).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value_col).alias("total"))
    return cells.select(*keys, F.to_date("w.start").alias("date"), "n", "total")
