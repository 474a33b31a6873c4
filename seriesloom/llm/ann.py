"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seriesloom.llm.common import materialize, slices

TABLES, PROBES, SEED = 10, 64, 7
#: Rows and queries of one block of a bucket.
BLOCK = 4096
#: Blocks with so few rows are compared at once for many queries.
SMALL = 512
#: Split buckets whose numbers of parts are sent to all tasks at most; more are joined by a shuffle.
LISTED = 100_000


def hash_widths(dim: int, rows: int) -> list[int]:
    """Coordinates of each of the concatenated hashes of a table, so that its buckets grow with the number of rows.

    A hash over w coordinates has 2 * w signed axes. All hashes together have about
    90 * rows ** 0.3 buckets (at least those of one full hash), while probes stay as many:
    of more rows, a smaller share is compared, and nearest neighbours are nearer.
    """
    size = 1 << max(1, (dim - 1).bit_length())
    left = (1 << int(0.3 * math.log2(max(rows, 1)) + 6.5)) // (2 * size)
    widths = [size]
    while left > 1:
        widths.append(min(size, left // 2))
        left //= 2 * widths[-1]
    return widths


def rotations(dim: int, hashes: int = 1, tables: int = TABLES, seed: int = SEED) -> np.ndarray:
    """Signs of three diagonal matrices per table and hash, for vectors padded to a power of two."""
    size = 1 << max(1, (dim - 1).bit_length())
    return np.random.default_rng([seed, size]).choice([-1.0, 1.0], (tables, hashes, 3, size))


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of each row (power-of-two length), scaled to keep norms."""
    n, size = rows.shape
    step = 1
    while step < size:
        pairs = rows.reshape(n, -1, 2, step)
        rows = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], 2).reshape(n, size)
        step *= 2
    return rows / np.sqrt(size)


def buckets(vectors: np.ndarray, signs: np.ndarray, widths: list[int], probes: int) -> np.ndarray:
    """Per unit vector the ``probes`` buckets of one table whose axes are nearest together, nearest first.

    ``signs`` has the pseudo-rotation of each of the concatenated hashes. A bucket is one
    signed axis of each hash; its nearness is the sum of the projections on them.
    """
    n, size = len(vectors), signs.shape[-1]
    code, score = np.zeros((n, 1), np.int64), np.zeros((n, 1))
    for diagonals, width in zip(signs, widths):
        rows = np.zeros((n, size))
        rows[:, : vectors.shape[1]] = vectors
        for diagonal in diagonals:
            rows = hadamard(rows * diagonal)
        both = np.concatenate([rows[:, :width], -rows[:, :width]], 1)
        near = _largest(both, probes)
        sums = (score[:, :, None] + np.take_along_axis(both, near, 1)[:, None, :]).reshape(n, -1)
        codes = (code[:, :, None] * (2 * width) + near[:, None, :]).reshape(n, -1)
        best = _largest(sums, probes)
        code, score = np.take_along_axis(codes, best, 1), np.take_along_axis(sums, best, 1)
    return code


def _largest(values: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` largest values of each row, the largest first."""
    most = min(most, values.shape[1])
    if most == 1:
        return values.argmax(1)[:, None]
    near = np.argpartition(-values, most - 1, axis=1)[:, :most]
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(values, near, 1), axis=1, kind="stable"), 1)


def usable(df: DataFrame, id_col: str, vector_col: str, kind: str = "double") -> DataFrame:
    """(id, v) of vectors that are not null, empty or zero and hold no null, NaN or infinity."""
    v = F.col(vector_col).cast(f"array<{kind}>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~bad & F.exists("v", lambda x: x != 0))


def _bytes(matrix: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in matrix], pa.binary())


def _hashed(tables: int, probes: int, rows: int, every: int):
    """Per vector its bytes, its bucket in each table, and for a query the buckets it looks into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, sizes = batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy()
            flat, starts = batch.column(1).flatten().to_numpy(), np.cumsum(sizes) - sizes
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                x = flat[starts[at][:, None] + np.arange(dim)]
                unit = x.astype(np.float64)
                unit /= np.abs(unit).max(axis=1, keepdims=True)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                widths = hash_widths(int(dim), rows)
                asks = np.flatnonzero(ids[at] % every == 0)
                own, asked = [], []
                for signs in rotations(int(dim), len(widths), tables):
                    own.append(buckets(unit, signs, widths, 1)[:, 0])
                    if len(asks):
                        asked.append(buckets(unit[asks], signs, widths, probes))
                looks: list[list | None] = [None] * len(at)
                for j, i in enumerate(asks):
                    looks[i] = [c[j].tolist() for c in asked]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(at), dim), pa.int32()),
                        pa.array(ids[at], pa.int64()),
                        _bytes(x),
                        pa.array(list(np.stack(own, 1)) if own else [[]] * len(at), pa.list_(pa.int64())),
                        pa.array(looks, pa.list_(pa.list_(pa.int64()))),
                    ],
                    ["dim", "id", "v", "own", "looks"],
                )

    return run


def _nearest(k: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list] = {True: [], False: []}
        key = None
        for batch in batches:
            for *own, is_query, i, v in zip(*(c.to_pylist() for c in batch.columns)):
                if own != key:
                    yield from _block(held, k, kind)
                    held, key = {True: [], False: []}, own
                held[is_query].append((i, v))
        yield from _block(held, k, kind)

    return run


def _block(held: dict[bool, list], k: int, kind: str) -> Iterator[pa.RecordBatch]:
    """The ``k`` nearest ids of one block for each of its queries, each with its smallest distance; ties to the smaller id."""
    if not held[True] or not held[False]:
        return
    q_ids, r_ids = (np.array([i for i, _ in held[x]], np.int64) for x in (True, False))
    q, r = (np.frombuffer(b"".join(v for _, v in held[x]), kind).reshape(len(held[x]), -1).astype(np.float64) for x in (True, False))
    by_id = np.argsort(r_ids, kind="stable")
    r_ids, r = r_ids[by_id], r[by_id]
    firsts = np.flatnonzero(np.r_[True, r_ids[1:] != r_ids[:-1]])
    if len(r) <= SMALL and len(firsts) == len(r):
        yield from _small_block(q_ids, q, r_ids, r, k)
        return
    most_at = min(k, len(firsts)) - 1
    scale = max(np.abs(r).max(), np.abs(q).max())
    rs, out = r / scale, [[], [], []]
    square = (rs**2).sum(1)
    for at in range(0, len(q), 256):
        part = q[at : at + 256] / scale
        rough = square - 2 * part @ rs.T + (part**2).sum(1)[:, None]
        rough[q_ids[at : at + 256][:, None] == r_ids] = np.inf
        most = np.partition(np.minimum.reduceat(rough, firsts, axis=1), most_at, axis=1)[:, most_at]
        for j, row in enumerate(rough):
            near = np.flatnonzero((row <= most[j] + 1e-9 * (1 + abs(most[j]))) & np.isfinite(row) if np.isfinite(most[j]) else np.isfinite(row))
            exact = np.sqrt(((r[near] - q[at + j]) ** 2).sum(1))
            order = np.lexsort((r_ids[near], exact))
            order = order[np.sort(np.unique(r_ids[near][order], return_index=True)[1])[:k]]
            best = near[order]
            out[0].append(np.full(len(best), q_ids[at + j]))
            out[1].append(r_ids[best])
            out[2].append(exact[order])
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["query_id", "id", "score"])


def _small_block(q_ids: np.ndarray, q: np.ndarray, r_ids: np.ndarray, r: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """As ``_block``, for few rows of rising, different ids: all queries of a step at once."""
    step = max(1, (1 << 21) // r.size)
    for at in range(0, len(q), step):
        ids = q_ids[at : at + step]
        exact = np.sqrt(((r[None, :, :] - q[at : at + step, None, :]) ** 2).sum(2))
        order = np.argsort(np.where(ids[:, None] == r_ids, np.inf, exact), axis=1, kind="stable")[:, : k + 1]
        found = np.repeat(ids, order.shape[1]), r_ids[order].ravel(), np.take_along_axis(exact, order, 1).ravel()
        other = found[0] != found[1]
        within = np.cumsum(other.reshape(order.shape), axis=1).ravel() <= k
        yield pa.RecordBatch.from_arrays([pa.array(x[other & within]) for x in found], ["query_id", "id", "score"])


def _compared(both: DataFrame, k: int, block: int, kind: str) -> DataFrame:
    """(query_id, rank, id, score) of the ``k`` nearest among rows and queries of equal (dim, t, b), compared block by block."""
    bucket = ["dim", "t", "b"]
    sizes = both.groupBy(*bucket).agg(F.count_if(~F.col("q")).alias("nr"), F.count_if("q").alias("nq"))
    parts = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / block)).cast("int")
    split = materialize(sizes.where((F.col("nr") > block) | (F.col("nq") > block)).select(*bucket, parts("nr").alias("pr"), parts("nq").alias("pq")))
    few = split.limit(LISTED + 1).count()
    # without split buckets there is nothing to join; a list of proven size goes to all tasks
    placed = both.withColumns({"pr": F.lit(1), "pq": F.lit(1)}) if not few else both.join(F.broadcast(split) if few <= LISTED else split, bucket, "left")
    pr, pq = F.coalesce("pr", F.lit(1)), F.coalesce("pq", F.lit(1))
    own = F.when(F.col("q"), F.pmod(F.xxhash64("id"), pq)).otherwise(F.pmod(F.xxhash64("id"), pr)).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.when(F.col("q"), pr).otherwise(pq) - 1))
    placed = placed.select(*bucket, own.alias("own"), others.alias("other"), "q", "id", "v")
    block_key = [F.when(F.col("q"), F.col("other")).otherwise(F.col("own")).alias("br"), F.when(F.col("q"), F.col("own")).otherwise(F.col("other")).alias("bq")]
    blocks = placed.select(*bucket, *block_key, "q", "id", "v")
    key = [*bucket, "br", "bq"]
    found = blocks.repartition(*key).sortWithinPartitions(*key).mapInArrow(_nearest(k, kind), "query_id long, id long, score double")
    best = found.groupBy("query_id", "id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def nearest(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, every: int = 100, tables: int = TABLES, probes: int = PROBES, block: int = BLOCK
) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest found for each row whose id is divisible by ``every``.

    Every usable row stands in one bucket of each of ``tables`` tables: the nearest signed
    axis of each of the table's concatenated hashes, whose number of buckets grows with
    the rows (``hash_widths``); a query looks into the ``probes`` nearest ones. Rows and
    queries that meet in a bucket are compared exactly (Euclidean, double precision,
    original vectors), block by block: a bucket is split into blocks of about ``block``
    rows and of as many queries, so that a hot bucket is spread over tasks and none is
    capped. Only each block's ``k`` best ids per query leave it. A query that meets fewer
    than ``k`` ids in all its buckets is compared with all rows, in blocks as well.

    Each vector is hashed once and travels as its original bytes (4 a component for
    floats). Null, zero or non-finite vectors and null ids take no part. A query's own id
    is no candidate, repeated rows of an id count once with their smallest distance, ties
    go to the smaller id, and fewer than ``k`` candidates are returned if there are no
    more. Vectors are compared with those of the same length. An empty table gives an
    empty result. Other columns are not read.
    """
    kind = "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"
    rows = usable(vectors, id_col, vector_col, "float" if kind == "<f4" else "double").dropDuplicates(["id", "v"])
    schema = "dim int, id long, v binary, own array<long>, looks array<array<long>>"
    rows = materialize(rows.mapInArrow(_hashed(tables, probes, vectors.count(), every), schema))
    asked = rows.where("looks IS NOT NULL")
    stand = rows.select("dim", F.posexplode("own").alias("t", "b"), F.lit(False).alias("q"), "id", "v")
    ask = asked.select("dim", F.posexplode("looks").alias("t", "each"), "id", "v").select("dim", "t", F.explode("each").alias("b"), F.lit(True).alias("q"), "id", "v")
    best = materialize(_compared(stand.unionByName(ask), k, block, kind))
    full = best.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("query_id")
    short = materialize(asked.select("id").distinct().join(full, F.col("id") == F.col("query_id"), "left_anti"))
    if short.isEmpty():
        return best
    place = ["dim", F.lit(0).alias("t"), F.lit(0).cast("long").alias("b")]
    whole = rows.select(*place, F.lit(False).alias("q"), "id", "v").unionByName(asked.join(short, "id", "left_semi").select(*place, F.lit(True).alias("q"), "id", "v"))
    return best.join(full, "query_id", "left_semi").unionByName(_compared(whole, k, block, kind))


def op4_ann(vectors: DataFrame) -> DataFrame:
    return nearest(vectors).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
