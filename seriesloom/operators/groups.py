"""Arrays over whole groups of rows, in Arrow batches whose own columns pass through as they are."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of many groups that are worked on together; a larger group goes alone.
TOGETHER = 1 << 14

#: Gets the needed columns by name and the number of each row's group; gives the new columns.
Compute = Callable[[dict[str, np.ndarray], np.ndarray], dict[str, "np.ndarray | pa.Array"]]


def begins(batch: pa.RecordBatch, keys: Sequence[int], before: pa.RecordBatch | None) -> np.ndarray:
    """Which rows have other keys than the row before them; nulls are equal."""
    out = np.zeros(batch.num_rows, bool)
    for k in keys:
        own = batch.column(k)
        last = pa.concat_arrays([(batch.slice(0, 1) if before is None else before).column(k), own.slice(0, batch.num_rows - 1)])
        other = pc.fill_null(pc.not_equal(own, last), False).to_numpy(zero_copy_only=False)
        out |= other | (own.is_null().to_numpy(zero_copy_only=False) != last.is_null().to_numpy(zero_copy_only=False))
    if before is None:
        out[0] = True
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[int], together: int = TOGETHER) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray]]:
    """Rows sorted by their keys in lots of whole groups, and the number of each row's group in its lot.

    Every row is looked at once, however long its group is.
    """
    held: list[pa.RecordBatch] = []
    marks: list[np.ndarray] = []
    rows, open_at, before = 0, 0, None  # rows held, where the last group among them begins
    for batch in batches:
        if not batch.num_rows:
            continue
        mark = begins(batch, keys, before)
        before = batch.slice(batch.num_rows - 1, 1)
        at = np.flatnonzero(mark)
        if len(at):
            done = rows + int(at[-1])
            if done >= together:
                cut = int(at[-1])
                yield [b for b in (*held, batch.slice(0, cut)) if b.num_rows], np.cumsum(np.concatenate([*marks, mark[:cut]])) - 1
                held, marks, rows, batch, mark = [], [], 0, batch.slice(cut), mark[cut:]
        held.append(batch)
        marks.append(mark)
        rows += batch.num_rows
    if held:
        yield held, np.cumsum(np.concatenate(marks)) - 1


def appended(df: DataFrame, keys: Sequence[str], order: Sequence[str], needed: dict[str, Column], fields: Sequence[T.StructField], compute: Compute, together: int | None = None, tasks: int | None = None) -> DataFrame:
    """``df`` with new ``fields`` that ``compute`` makes of the ``needed`` columns of whole groups of equal ``keys``.

    Groups are dealt to tasks by their keys and come in ``order``. Only the needed columns
    become arrays (a null number is NaN); the columns of ``df`` are handed on in the
    buffers they came in, whatever their type. ``tasks`` is for work that costs far more
    than its bytes tell, by which small partitions would be joined.
    """
    width = len(df.columns)
    # one column: as columns of their own, aliases of many features make the optimizer derive constraints without end
    rows = df.select("*", F.struct(*[c.alias(n) for n, c in needed.items()]).alias("_needed"))
    rows = (rows.repartition(tasks, *keys) if tasks else rows.repartition(*keys)).sortWithinPartitions(*keys, *order)
    at, called, lot_rows = [df.columns.index(k) for k in keys], list(needed), together or TOGETHER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot, number in whole_groups(batches, at, lot_rows):
            arrays = {n: pa.chunked_array([b.column(width).field(i) for b in lot]).to_numpy() for i, n in enumerate(called)}
            made, done = compute(arrays, number), 0
            for b in lot:
                part = slice(done, done + b.num_rows)
                done += b.num_rows
                new = [pa.array(made[f.name][part], from_pandas=True) if isinstance(made[f.name], np.ndarray) else made[f.name][part] for f in fields]
                yield pa.RecordBatch.from_arrays([*b.columns[:width], *new], [*b.schema.names[:width], *[f.name for f in fields]])

    return rows.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))
