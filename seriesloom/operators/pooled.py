"""A boosted ensemble of more rows than one task holds: histograms summed over executors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.checkpoints import materialize
from seriesloom.operators.boosting import BINS
from seriesloom.operators.trees import BEST, Ensemble, Growth, Tree, best_splits, boost, encode, histograms, place_of, width_of

#: Rows of a block, and trees between two checkpoints of what they leave over.
BLOCK, CUT = 1 << 15, 8


def feature_edges(rows: DataFrame, features: int) -> list[np.ndarray]:
    """Bin edges of the array ``x``'s features: BINS ranks of each (exact to a ten-thousandth of the rows), in one pass."""
    at = F.array(*[F.lit(i / BINS) for i in range(1, BINS + 1)])
    value = lambda f: F.nanvl(F.get("x", F.lit(f)), F.lit(None).cast("double"))
    found = rows.agg(*[F.percentile_approx(value(f), at, 10_000).alias(f"e{f}") for f in range(features)]).first()
    return [np.unique(np.array(e or [], float)) for e in found]


class Blocks:
    """Rows in blocks over executors; each level of a tree is one job, whose answer is one split per (column, node).

    A task adds up the histograms of its blocks; those of one column meet in one task,
    which adds them as they come and finds the column's best splits. What the trees leave
    over is written every CUT trees; in between, tasks apply the trees since. A lost
    executor's blocks come from the checkpoint again.
    """

    def __init__(self, rows: DataFrame, edges: Sequence[np.ndarray], start: float, growth: Growth) -> None:
        self.growth, self.features, self.width, self.recent = growth, len(edges), width_of(edges), []
        parts = 2 * rows.sparkSession.sparkContext.defaultParallelism
        table = "block long, n int, codes binary, rest binary, weight binary"
        self.blocks = materialize(rows.select("x", "y", "w").mapInArrow(_blocked(list(edges), start), table).repartition(parts, "block")).persist()

    def best(self, number: int, tree: Tree, level: list[int], columns: np.ndarray) -> np.ndarray:
        parts = self.blocks.mapInArrow(_level(self.recent, number, tree, level, columns, self.growth, self.width), "col int, sums binary")
        found = parts.repartitionById(len(columns), "col").mapInArrow(_summed(len(level), self.growth, self.width), "col int, best binary").collect()
        out = np.full((len(columns), len(level), BEST), -1.0)
        for r in found:
            out[r.col] = np.frombuffer(r.best).reshape(len(level), BEST)
        return out

    def take(self, tree: Tree) -> None:
        self.recent = [*self.recent, tree]
        if len(self.recent) == CUT:
            before, self.blocks = self.blocks, materialize(self.blocks.mapInArrow(_left_over(self.recent), self.blocks.schema)).persist()
            before.unpersist()
            self.recent = []


def _blocked(edges: list[np.ndarray], start: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = part.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, len(edges))
                rest, weight = (part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in (1, 2))
                data = encode(x, edges).tobytes(), (rest - start).tobytes(), weight.tobytes()
                yield pa.RecordBatch.from_pydict({"block": pa.array([number]), "n": pa.array([part.num_rows], pa.int32())} | {c: pa.array([d], pa.binary()) for c, d in zip(("codes", "rest", "weight"), data)})
                number += 1

    return run


def _each(batches: Iterator[pa.RecordBatch], trees: Sequence[Tree]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(block, codes, what is left over after ``trees``, weights) of each block."""
    for batch in batches:
        for r in batch.to_pylist():
            codes = np.frombuffer(r["codes"], np.uint8).reshape(-1, r["n"])
            rest = np.frombuffer(r["rest"]).copy()
            for tree in trees:
                rest -= tree.value[tree.leaf(codes)]
            yield r["block"], codes, rest, np.frombuffer(r["weight"])


def _left_over(trees: Sequence[Tree]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [rest.tobytes() for _, _, rest, _ in _each([batch], trees)]
            yield batch.set_column(3, "rest", pa.array(rest, pa.binary()))

    return run


def _level(trees: Sequence[Tree], number: int, tree: Tree, level: list[int], columns: np.ndarray, growth: Growth, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for block, codes, rest, weight in _each(batches, trees):
            sees = growth.draws(number, block, len(rest))
            h = np.concatenate(list(histograms(codes, place_of(tree, level, tree.leaf(codes)), rest, weight if sees is None else np.where(sees, weight, 0.0), len(level), columns, width)))
            total = h if total is None else total + h
        if total is not None:
            for i, h in enumerate(total):
                yield pa.RecordBatch.from_pydict({"col": pa.array([i], pa.int32()), "sums": pa.array([h.tobytes()], pa.binary())})

    return run


def _summed(nodes: int, growth: Growth, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                h = np.frombuffer(r["sums"]).reshape(nodes, width, 3)
                totals[r["col"]] = totals[r["col"]] + h if r["col"] in totals else h
        for c, h in totals.items():
            yield pa.RecordBatch.from_pydict({"col": pa.array([c], pa.int32()), "best": pa.array([best_splits(h[None], growth).tobytes()], pa.binary())})

    return run


def fit_blocks(rows: DataFrame, features: int, growth: Growth, edges: list[np.ndarray] | None = None) -> Ensemble:
    """A boosted ensemble of ``rows`` (x: array of ``features`` doubles, NaN or NULL where missing; y; w)."""
    x = F.transform("x", lambda v: F.coalesce(v, F.lit(float("nan"))))
    rows = rows.select(x.alias("x"), F.coalesce("y", F.lit(0.0)).cast("double").alias("y"), F.coalesce("w", F.lit(0.0)).cast("double").alias("w"))
    edges = edges or feature_edges(rows, features)
    start = rows.agg(F.try_divide(F.sum(F.col("y") * F.col("w")), F.sum("w")).alias("m")).first().m or 0.0
    source = Blocks(rows, edges, start, growth)
    try:
        return boost(source, growth, edges, float(start))
    finally:
        source.blocks.unpersist()
