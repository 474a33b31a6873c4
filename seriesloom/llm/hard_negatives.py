"""Hard negatives by branch-and-bound over ball trees: exact integer inner products inside score windows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seriesloom.llm.common import materialize, slices

#: Rows of one tree and of one leaf; anchors that a task holds; anchors compared with a node at once.
TREE, LEAF, HELD, STEP = 1 << 14, 64, 1 << 16, 1 << 12
#: Steps in which a ball's center moves to make it smaller.
MOVES = 8
#: Rows a task's share has at least.
SHARE = 1024
NONE, LAST = -np.inf, np.iinfo(np.int64).max
#: Sums of products up to here are exact in doubles.
EXACT = 2.0**53
INTEGERS = np.vectorize(int, otypes=[object])


@dataclass
class Node:
    """Rows ``low`` to ``high`` of a tree, all within ``radius`` of ``center``; ``first`` is their smallest id."""

    low: int
    high: int
    center: np.ndarray
    radius: float
    first: int
    left: Node | None = None
    right: Node | None = None


def ball(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A center of a small ball around all rows, and their distances from it.

    From the mean, steps of falling size lead to the row that is farthest off; the
    smallest ball on the way is taken, so that it is never wider than the one around the mean.
    """
    best = center = x.mean(0)
    far = distances = np.sqrt(((x - center) ** 2).sum(1))
    for i in range(MOVES):
        center = center + (x[distances.argmax()] - center) / (i + 2)
        distances = np.sqrt(((x - center) ** 2).sum(1))
        if distances.max() < far.max():
            best, far = center, distances
    return best, far


def ball_tree(vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> tuple[Node, np.ndarray]:
    """The root over all rows, and the order in which the tree holds them; ids rise inside a leaf.

    A ball is halved between two far points: by the median of the projection on the line
    through them. Rows that are all equal are halved by their ids.
    """
    order = np.arange(len(vectors))

    def node(low: int, high: int) -> Node:
        own = order[low:high]
        x = vectors[own]
        center, far = ball(x)
        here = Node(low, high, center, float(far.max()), int(ids[own].min()))
        if high - low > leaf:
            one = x[far.argmax()]
            line = x[((x - one) ** 2).sum(1).argmax()] - one
            middle = (high - low) // 2
            order[low:high] = own[np.argpartition(x @ line if here.radius else ids[own], middle)]
            here.left, here.right = node(low, low + middle), node(low + middle, high)
        else:
            order[low:high] = own[np.argsort(ids[own], kind="stable")]
        return here

    return node(0, len(vectors)), order


class Search:
    """Anchors with their score windows, and the ``k`` best rows found so far for each window."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> None:
        self.vectors, self.labels, self.ids, self.low, self.high, self.k, self.same = vectors, labels, ids, low, high, k, same
        self.norms = np.sqrt((vectors**2).sum(1))
        shape = (*low.shape, k)
        self.scores, self.found = np.full(shape, NONE), np.full(shape, LAST)
        self.compared = 0  # pairs of an anchor and a row

    def tree(self, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        """Searches rows of any labels: one tree a label, for the anchors whose label is the same, or is another one."""
        for label in np.unique(labels):
            rows = np.flatnonzero(labels == label)
            who = np.flatnonzero((self.labels == label) == self.same)
            if not len(who):
                continue
            root, order = ball_tree(vectors[rows], ids[rows])
            rows = rows[order]
            x, own = vectors[rows], ids[rows]
            exact = self.scores.dtype != object and self.norms.max() * np.sqrt((x**2).sum(1).max()) < EXACT
            if not exact:
                self.scores = self.scores.astype(object)
            for at in range(0, len(who), STEP):
                self._visit(root, x, own, who[at : at + STEP], exact)

    def _visit(self, root: Node, x: np.ndarray, ids: np.ndarray, who: np.ndarray, exact: bool) -> None:
        stack = [(root, who)]
        while stack:
            node, who = stack.pop()
            middle, reach = self.vectors[who] @ node.center, self.norms[who] * node.radius
            # more than rounding can take away
            slack = 1e-9 * (np.abs(middle) + reach + self.norms[who] * np.linalg.norm(node.center)) + 1e-6
            most, least = middle + reach + slack, middle - reach - slack
            worst, last = self.scores[who, :, -1].astype(float), self.found[who, :, -1]
            # inside the window, and better than the k-th or level with it at a smaller id; scores are whole
            beats = (most[:, None] >= worst + 1) | (most[:, None] >= worst) & (node.first < last)
            open_ = (most[:, None] >= self.low[who]) & (least[:, None] <= self.high[who]) & beats
            go = open_.any(1)
            if not go.any():
                continue
            who = who[go]
            if node.left is None:
                self._leaf(x[node.low : node.high], ids[node.low : node.high], who, exact)
            else:  # the child that is nearer to most anchors comes first
                nearer = self.vectors[who].sum(0) @ (node.left.center - node.right.center) >= 0
                stack += [(node.right, who), (node.left, who)] if nearer else [(node.left, who), (node.right, who)]

    def _leaf(self, x: np.ndarray, ids: np.ndarray, who: np.ndarray, exact: bool) -> None:
        self.compared += len(who) * len(ids)
        if exact:
            scores = self.vectors[who] @ x.T
        else:  # whole numbers of any size
            scores = INTEGERS(self.vectors[who]) @ INTEGERS(x.T)
        for w in range(self.low.shape[1]):
            inside = (scores >= self.low[who, w][:, None]) & (scores <= self.high[who, w][:, None]) & (ids != self.ids[who][:, None])
            here = np.where(inside, scores, NONE)
            some = np.flatnonzero(((here.max(1) >= self.scores[who, w, -1]) & inside.any(1)).astype(bool))
            if not len(some):
                continue
            # rows stand in the order of their ids, so that a stable sort leaves ties to the smaller one
            best = np.argsort(-here[some], axis=1, kind="stable")[:, : self.k]
            mine = who[some]
            both = np.concatenate([self.scores[mine, w], np.take_along_axis(here[some], best, 1)], 1)
            names = np.concatenate([self.found[mine, w], np.where(np.take_along_axis(inside[some], best, 1), ids[best], LAST)], 1)
            for by in (names, None):
                order = np.argsort(-both if by is None else by, axis=1, kind="stable")
                both, names = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
            self.scores[mine, w], self.found[mine, w] = both[:, : self.k], names[:, : self.k]


def _usable(vectors: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    columns = F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v")
    rows = vectors.select(*columns).where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~bad).distinct()


def _whole_numbers(scale: int):
    """Vectors as bytes of whole doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, flat = batch.column(2).value_lengths().to_numpy(), np.floor(scale * batch.column(2).flatten().to_numpy())
            ends = np.cumsum(sizes)
            data = [flat[e - n : e].tobytes() for e, n in zip(ends, sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int32()), batch.column(0), batch.column(1), pa.array(data, pa.binary())], ["dim", "id", "label", "v"])

    return run


def _table(parts: list[pa.RecordBatch], *also: str) -> tuple:
    """Vectors as a matrix, then ids, labels and whatever else is asked for, of batches of one length of vectors."""
    columns = {c: pa.chunked_array([p.column(c) for p in parts]) for c in ("v", "id", "label", *also)}
    ids, labels = columns["id"].to_numpy(), columns["label"].to_numpy()
    vectors = np.frombuffer(b"".join(columns["v"].to_pylist()), "<f8").reshape(len(ids), -1)
    return vectors, ids, labels, *[columns[c].to_pylist() for c in also]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Consecutive rows of equal (cell, dim, kind), TREE at most at once."""
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("cell", "dim", "kind")])
        edges = [0, *(np.flatnonzero((np.diff(keys) != 0).any(0)) + 1).tolist(), batch.num_rows]
        for low, high in zip(edges, edges[1:]):
            for at in range(low, high, TREE):
                yield tuple(keys[:, low].tolist()), batch.slice(at, min(TREE, high - at))


def _searched(k: int, same: bool):
    """Of each (cell, dim) the anchors come first and are held; the rows stream past them, one forest of TREE rows at a time."""

    def start(parts: list[pa.RecordBatch]) -> tuple[Search, np.ndarray]:
        vectors, ids, labels, rows, low, high = _table(parts, "row", "low", "high")
        wide = lambda table, fill: np.array([r + [fill] * (max(map(len, low)) - len(r)) for r in table], np.int64)
        return Search(vectors, labels, ids, wide(low, LAST), wide(high, -LAST), k, same), np.array(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, rows, held, now = None, None, [], None

        def end() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(search.ids) if search else 0, STEP):
                a, w, r = np.nonzero(search.found[at : at + STEP] != LAST)
                scores = [int(s) for s in search.scores[at : at + STEP][a, w, r]]
                columns = [pa.array(rows[at + a]), pa.array(search.ids[at + a]), pa.array(w, pa.int32()), pa.array(search.found[at : at + STEP][a, w, r]), pa.array(scores, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["row", "anchor_id", "w", "id", "score"])

        def pass_on() -> None:
            nonlocal search, rows, held
            if held and now[2] == 0:
                search, rows = start(held)
            elif held and search:
                search.tree(*_table(held))
            held = []

        for key, part in _runs(batches):
            if now and key != now:
                pass_on()
                if key[:2] != now[:2]:
                    yield from end()
                    search = None
            now = key
            held.append(part)
            if key[2] and sum(p.num_rows for p in held) >= TREE:
                pass_on()
        if now:
            pass_on()
            yield from end()

    return run


def _best(rows: DataFrame, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """(row, anchor_id, w, id, score, rank): the ``k`` best rows of each anchor's windows, over all rows.

    Anchors are dealt to blocks of about HELD, rows to shares; every block meets every
    share in one cell. A row travels once per block, an anchor once per share, and a cell
    gives ``k`` rows a window at most.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-anchors.count() // HELD))
    shares = max(1, min(-(-parts // blocks), rows.count() // SHARE))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block, share = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64("row"), F.lit(shares)).cast("int")
    asks = anchors.withColumn("other", each(shares)).withColumns({"cell": block * shares + F.col("other"), "kind": F.lit(0)})
    stands = rows.withColumn("other", each(blocks)).withColumns({"cell": F.col("other") * shares + share, "kind": F.lit(1)})
    both = asks.drop("other").unionByName(stands.drop("other"), allowMissingColumns=True)
    dealt = both.repartitionById(blocks * shares, "cell").sortWithinPartitions("cell", "dim", "kind")
    found = dealt.mapInArrow(_searched(k, same), "row long, anchor_id long, w int, id long, score long")
    rank = F.row_number().over(W.partitionBy("row", "w").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of each anchor's positives.

    Anchors are the rows whose id is divisible by ``every``; a score is the inner product
    with the anchor after each component x became floor(``scale`` * x). An anchor's
    positives are its ``positives`` best rows of the same label; a positive's negatives
    are the ``negatives`` best rows of other labels whose score is ``low`` to ``high``
    percent of the positive's. Higher scores come first, ties by the smaller id; fewer
    are returned where there are no more.

    The search is exact: each task builds ball trees, one per label, over TREE rows at a
    time; a node of center c and radius r bounds the score of anchor q by q.c + |q| r
    from above and q.c - |q| r from below, and is left out where that lies outside all
    windows of the anchor or beneath its present k-th. Scores are counted in whole
    numbers, and with Python's own integers where doubles would round; one that exceeds a
    long is an error.

    Rows with a null id, label, vector or component, or one that is not finite, take no
    part; empty vectors score 0 with one another; vectors of different length do not meet.
    Rows alike in id, label and vector count once; others that share an id are rows and
    anchors of their own, but an anchor never meets its own id. An empty table gives an
    empty result. Other columns are not read, whatever their names.
    """
    named = "dim int, id long, label long, v binary"
    rows = _usable(vectors, id_col, label_col, vector_col).mapInArrow(_whole_numbers(scale), named)
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
    anchors = rows.where(F.col("id") % every == 0)
    limits = [F.array(F.lit(x)).alias(c) for x, c in ((-LAST, "low"), (LAST, "high"))]
    near = _best(rows, anchors.select("*", *limits), positives, same=True)
    near = near.withColumn("w", F.dense_rank().over(W.partitionBy("row").orderBy("score")) - 1)  # equal scores share a window
    near = materialize(near.select("row", "w", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("positive_rank")))
    part = F.expr(f"positive_score * {low}L"), F.expr(f"positive_score * {high}L")
    least = F.expr(f"positive_score * {low}L div 100") + (part[0] % 100 > 0).cast("int")
    most = F.expr(f"positive_score * {high}L div 100") - (part[1] % 100 < 0).cast("int")
    windows = near.select("row", F.struct("w", least.alias("low"), most.alias("high")).alias("x")).groupBy("row").agg(F.array_sort(F.collect_set("x")).alias("x"))
    asks = anchors.join(windows, "row").select("dim", "id", "label", "v", "row", F.col("x.low").alias("low"), F.col("x.high").alias("high"))
    found = _best(rows, materialize(asks), negatives, same=False).join(near, ["row", "w"])
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(vectors: DataFrame) -> DataFrame:
    """Every seventh row gets the next label first, so that labels are not only what the vectors say."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.select("vec_id", label.alias("label"), "embedding"))
