"""Search for parameters: all pairs of a candidate and a fold in one job, for all groups at once."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesloom.checkpoints import materialize
from seriesloom.operators import fits
from seriesloom.operators.groups import whole_groups

#: Of the candidates a bracket leaves one in FACTOR, and the next one's rows grow by it, up to RESOURCES.
FACTOR, RESOURCES = 3, 3000
#: Candidates that a random search draws.
DRAWN = 30


@dataclass
class Found:
    """The best parameters of each group, and what each bracket did: rows, candidates and fits a group at most."""

    best: dict[str, dict]
    brackets: list[tuple[int, int, int]] = field(default_factory=list)


def combinations(space: dict[str, Sequence]) -> list[dict]:
    return [dict(zip(space, v)) for v in itertools.product(*space.values())]


def fold(n: int, k: int, folds: int) -> tuple[int, int]:
    """Of n rows by date, fold k (from 0) trains on the first ones up to a, and is checked on those up to b."""
    size = max(1, n // (folds + 1))
    a = n - (folds - k) * size
    return a, min(n, a + size)


def _scored(model: str, pool: list[dict], alive: dict[str, list[int]], folds: int, scoring: str, seed: int):
    """Rows of (name, part) by date; a part fits its share of the name's pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot, number in whole_groups(batches, [0, 1], 1):
            rows = pa.Table.from_batches(lot)
            edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            out: list[tuple[str, int, float]] = []
            for low, high in zip(edges, edges[1:]):
                own = rows.slice(low, high - low)
                name, part, parts = (own[c][0].as_py() for c in ("name", "part", "parts"))
                x = np.array(own["x"].to_pylist(), float).reshape(high - low, -1)
                y, w = own["y"].to_numpy(), own["w"].to_numpy()
                for c, k in list(itertools.product(alive[name], range(folds)))[part::parts]:
                    a, b = fold(len(y), k, folds)
                    value = -math.inf
                    if 0 < a < b:
                        fitted = fits.fit(model, x[:a], y[:a], w[:a], pool[c], seed)
                        value = fits.score(scoring, y[a:b], fitted.predict(x[a:b]))
                    out.append((name, c, -math.inf if math.isnan(value) else value))
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(("name", "candidate", "score"), (pa.array(v, t) for v, t in zip(zip(*out), (pa.string(), pa.int32(), pa.float64()))))))

    return run


def _bracket(rows: DataFrame, model: str, pool: list[dict], alive: dict[str, list[int]], folds: int, scoring: str, seed: int, keep: int) -> dict[str, list[int]]:
    """The ``keep`` best candidates of each name, best first, by their mean score over folds; one job."""
    spark = rows.sparkSession
    pairs = max(map(len, alive.values())) * folds
    parts = max(1, min(pairs, -(-spark.sparkContext.defaultParallelism // len(alive))))
    dealt = rows.withColumn("parts", F.lit(parts)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("name", "part", "parts", "day", "h", "x", "y", "w")
    dealt = dealt.repartition(len(alive) * parts, "name", "part").sortWithinPartitions("name", "part", "day", "h")
    each = dealt.mapInArrow(_scored(model, pool, alive, folds, scoring, seed), "name string, candidate int, score double")
    mean = each.groupBy("name", "candidate").agg(F.avg("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("name").orderBy(F.desc("score"), "candidate"))
    found = mean.withColumn("rank", rank).where(F.col("rank") <= keep).orderBy("name", "rank").collect()
    out: dict[str, list[int]] = {}
    for r in found:
        out.setdefault(r.name, []).append(r.candidate)
    return out


def rows_for(frame: DataFrame, name: Column, features: Sequence[str], y: Column, w: Column, date_col: str | None, seed: int) -> DataFrame:
    """(name, day, h, x, y, w) of training rows; ``h`` orders rows at random, the same way on every run."""
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features])
    day = F.unix_micros(F.col(date_col).cast("timestamp")) if date_col else F.lit(0).cast("long")
    rows = frame.select(name.alias("name"), day.alias("day"), x.alias("x"), y.alias("y"), w.alias("w"))
    return rows.withColumn("h", F.pmod(F.xxhash64("name", "day", "x", "y", F.lit(seed)), F.lit(1 << 30)))


def search(
    rows: DataFrame, sizes: dict[str, int], model: str, space: dict[str, Sequence], how: str = "halving", most: int | None = None, folds: int = 4, seed: int = 42,
    scoring: str = "neg_root_mean_squared_error", resources: int = RESOURCES,
) -> Found:
    """The best of the combinations of ``space`` for each name among ``rows`` (``rows_for``), of ``sizes`` rows each.

    ``grid`` tries all and ``random`` draws ``most`` of them (DRAWN), on all rows.
    ``halving`` draws as many as ``resources`` allow at 2 rows a fold (``most`` at most);
    each bracket keeps the best third and triples the rows, while they are at most
    ``resources`` and no more than a name has. Fewer candidates start with more rows. A bracket's rows are those of the
    smallest random order, so that each holds the one before it; folds are expanding
    ranges of dates within them. Every pair of candidate and fold is one fit inside a
    task, and all pairs of all names are one job. Equal scores leave the earlier
    candidate.
    """
    pool = combinations(space)
    if not sizes:
        return Found({})
    drawn = np.random.default_rng(seed).permutation(len(pool)).tolist()
    if how != "halving":
        alive = range(len(pool)) if how == "grid" else drawn[: most or DRAWN]
        best = _bracket(rows, model, pool, {n: sorted(alive) for n in sizes}, folds, scoring, seed, 1)
        return Found({n: pool[c[0]] for n, c in best.items()}, [(max(sizes.values()), len(alive), len(alive) * folds)])
    least = 2 * folds
    top = min(resources, max(sizes.values()))
    rows = _smallest(rows, sizes, top)
    alive = {n: sorted(drawn[: min(most or len(pool), max(1, min(resources, size) // least))]) for n, size in sizes.items()}
    rounds = math.ceil(math.log(max(map(len, alive.values())), FACTOR) - 1e-9)
    brackets, now = [], max(least, top // FACTOR**rounds)
    while True:
        tried = max(map(len, alive.values()))
        alive = {n: sorted(c) for n, c in alive.items()}
        keep = 1 if now * FACTOR > top or tried == 1 else math.ceil(tried / FACTOR)
        brackets.append((now, tried, tried * folds))
        alive = _bracket(rows.where(F.col("place") <= now), model, pool, alive, folds, scoring, seed, keep)
        if keep == 1:
            return Found({n: pool[c[0]] for n, c in alive.items()}, brackets)
        now *= FACTOR


def _smallest(rows: DataFrame, sizes: dict[str, int], most: int) -> DataFrame:
    """The ``most`` rows of each name whose ``h`` is smallest, numbered by ``place``.

    Rows beyond a threshold that about 1.5 times as many pass go before anything is
    sorted, so that a name of any size meets in one task with a bounded number of rows.
    """
    share = rows.sparkSession.createDataFrame([(n, int((1 << 30) * min(1.0, (1.5 * most + 64) / max(1, size)))) for n, size in sizes.items()], "name string, up_to long")
    near = rows.join(share, "name").where(F.col("h") <= F.col("up_to")).drop("up_to")
    place = F.row_number().over(W.partitionBy("name").orderBy("h", "day", "y"))
    return materialize(near.withColumn("place", place).where(F.col("place") <= most))


def pick(found: Found, name: str, otherwise: dict[str, Any]) -> dict[str, Any]:
    """A name without any row keeps the parameters it would have had."""
    return found.best.get(name, otherwise)
