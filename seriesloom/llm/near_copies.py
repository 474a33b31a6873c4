"""Near copies by shingle similarity: min-wise bands propose pairs, the shingle sets themselves decide."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import materialize, row_key, rows_of, slices
from seriesloom.llm.graph import components

SHINGLE = 5
#: Similar are two texts of which 4 / 5 of all shingles are in both.
PART, OF = 4, 5
#: A pair at similarity 0.8 shares none of the bands in (1 - 0.8**ROWS)**BANDS = 5e-6 of all cases, a more similar one more seldom.
BANDS, ROWS = 40, 6
#: A bucket with more rows outside its largest known group is compared in blocks.
BUCKET = 16
BLOCK = 256
SEED = 42
_P = np.uint64(0x9E3779B97F4A7C15)
_A = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    """The final step of MurmurHash3: spreads every bit over all."""
    for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(c)
    return h ^ (h >> np.uint64(33))


class _Words(dict):
    """Word -> 64-bit hash, computed once while remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h


def shingle_set(text: bytes, seen: dict, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; all words are one shingle where there are fewer."""
    words = text.lower().split()  # as the fingerprint of op1_simhash reads words
    w = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    if not len(w):
        return w
    size = min(shingle, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for j in range(size):
        h = h * _P + w[j : len(w) - size + 1 + j]
    return np.unique(_mixed(h))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One bucket key per band from the smallest value of each permutation."""
    if not len(hashes):
        return hashes
    least = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 256):
        least = np.minimum(least, (_A[:, None] * hashes[at : at + 256]).min(axis=1))
    key = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = _mixed(key * _P + row)
    return key


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64), pa.int64())


def _signatures(mark: Callable[[bytes], int] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Words()
        for batch in slices(batches):
            ids, texts = rows_of(batch)
            sets = [shingle_set(x, seen) for x in texts]
            fp = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64)
            keys = [bands(x) for x in sets]
            ends = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
            marks = pa.array([mark(x) if mark else None for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column(2), marks, _signed(fp), pa.array([len(x) for x in sets], pa.int64()), pa.ListArray.from_arrays(ends, _signed(np.concatenate(keys)))],
                ["id", "row", "mark", "fp", "n", "bands"],
            )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = _Words()
    for batch in slices(batches):
        fps, texts = rows_of(batch)
        sets = [shingle_set(x, seen) for x in texts]
        ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
        yield pa.RecordBatch.from_arrays([fps, pa.ListArray.from_arrays(ends, _signed(np.concatenate(sets)))], ["fp", "s"])


def _similar(both, one, other):
    """both / (one + other - both) >= PART / OF, in whole numbers."""
    return both * (OF + PART) >= (one + other) * PART


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of set ids whose sets are similar."""
    left, right = (sets.select(F.col("fp").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    return pairs.join(left, "a").join(right, "b").where(_similar(both, F.size("sa"), F.size("sb"))).select("a", "b")


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each block (key, ob, mb) between its outsiders and its members; a spanning forest of them."""
    held, own = ([], []), None
    for batch in batches:
        for key, ob, mb, outside, fp, root, s in zip(*(batch.column(i).to_pylist() for i in range(6)), batch.column(6)):
            if (key, ob, mb) != own:
                yield from _forest(*held)
                held, own = ([], []), (key, ob, mb)
            held[0 if outside else 1].append((fp, root, np.sort(s.values.to_numpy().view(np.uint64))))
    yield from _forest(*held)


def _forest(outsiders: list, members: list) -> Iterator[pa.RecordBatch]:
    if not outsiders or not members:
        return
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            x = up
        return x

    sizes = np.array([len(s) for _, _, s in members])
    flat, starts = np.concatenate([s for _, _, s in members]), np.cumsum(sizes) - sizes
    out = ([], [])
    for fp, root, s in outsiders:
        at = np.minimum(np.searchsorted(s, flat), len(s) - 1)
        both = np.add.reduceat((s[at] == flat).astype(np.int64), starts)
        for j in np.flatnonzero(_similar(both, len(s), sizes)):
            a, b = find(root), find(members[j][1])
            if a != b:
                parent[max(a, b)] = min(a, b)
                out[0].append(fp)
                out[1].append(members[j][0])
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])


def _blocks(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of the buckets in ``rest`` (key, fp, root, u rows outside the largest group, m rows), compared block by block."""
    parts = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK)).cast("int")
    place = lambda n: F.pmod(F.xxhash64("fp"), parts(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), parts(n) - 1))
    outsiders = rest.where("root <> top").select("key", place("u").alias("ob"), every("m").alias("mb"), F.lit(True).alias("outside"), "fp", "root")
    members = rest.select("key", every("u").alias("ob"), place("m").alias("mb"), F.lit(False).alias("outside"), "fp", "root")
    rows = outsiders.unionByName(members).join(sets, "fp").select("key", "ob", "mb", "outside", "fp", "root", "s")
    return rows.repartition("key", "ob", "mb").sortWithinPartitions("key", "ob", "mb").mapInArrow(_cross, "a long, b long")


def _roots(busy: DataFrame, links: DataFrame) -> DataFrame:
    """``busy`` with the root of each set over ``links``; buckets whose sets all have one root are done and go."""
    roots = components(links, "a", "b").select(F.col("node").alias("fp"), F.col("root").alias("known"))
    rows = busy.join(roots, "fp", "left").select("key", "fp", "n", F.coalesce("known", "fp").alias("root"))
    return materialize(rows)


def _pairs(rows: DataFrame) -> DataFrame:
    """Distinct (a, b) with a < b whose sizes allow the similarity."""
    low, high = F.least("na", "nb"), F.greatest("na", "nb")
    return rows.where(low * OF >= high * PART).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct()


def similar_links(nodes: DataFrame, sets_of) -> DataFrame:
    """(a, b): similar sets of ``nodes`` (fp, n, bands), so many that all similar pairs sharing a band are connected.

    ``sets_of`` gives the shingle sets (fp, s) of the sets named in its argument. Where a
    bucket holds many sets, each is first compared with the smallest and the largest one
    it meets. What is then still apart is compared exactly, whatever its number: rows
    outside the bucket's largest group with all rows, as pairs while they are BUCKET at
    most (so that pairs grow with the bucket, not with its square), else block by block.
    """
    tables = nodes.select("fp", "n", F.explode("bands").alias("key"))
    counts = materialize(tables.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))
    met = materialize(tables.join(counts, "key"))
    sets = materialize(sets_of(met.select("fp").distinct()))
    busy, links = met.select("key", "fp", "n", F.col("fp").alias("root")), None
    if not met.where(F.col("m") > BUCKET).isEmpty():
        hot = met.where(F.col("m") > BUCKET)
        ends = hot.groupBy("key").agg(F.min(F.struct("fp", "n")).alias("lo"), F.max(F.struct("fp", "n")).alias("hi"))
        own = materialize(hot.join(materialize(ends), "key").groupBy("fp").agg(F.first("n").alias("na"), F.min("lo").alias("lo"), F.max("hi").alias("hi")))
        pairs = own.select(F.col("fp").alias("x"), "na", F.explode(F.array("lo", "hi")).alias("p")).select("x", "na", F.col("p.fp").alias("y"), F.col("p.n").alias("nb"))
        links = materialize(_verified(materialize(_pairs(pairs)), sets))
        busy = _roots(busy, links)
    groups = busy.groupBy("key", "root").agg(F.count("*").alias("c"))
    tops = groups.groupBy("key").agg(F.max(F.struct("c", "root")).alias("t"), F.sum("c").alias("m"))
    tops = materialize(tops.select("key", F.col("t.root").alias("top"), "m", (F.col("m") - F.col("t.c")).alias("u")).where("u > 0"))
    rest = materialize(busy.join(tops, "key"))
    few = rest.where(F.col("u") <= BUCKET)
    outside = materialize(few.where("root <> top").groupBy("key").agg(F.collect_list(F.struct("fp", "n", "root")).alias("o")))
    pairs = few.join(outside, "key").select("fp", "n", "root", F.explode("o").alias("o")).where("root <> o.root")
    pairs = pairs.select(F.col("fp").alias("x"), F.col("n").alias("na"), F.col("o.fp").alias("y"), F.col("o.n").alias("nb"))
    found = _verified(materialize(_pairs(pairs)), sets)
    if not tops.where(F.col("u") > BUCKET).isEmpty():
        found = found.unionByName(_blocks(rest.where(F.col("u") > BUCKET), sets))
    return found if links is None else found.unionByName(links)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: Callable[[bytes], int] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, row (``row_key``), mark (of its UTF-8 text, if asked for), fp (of its shingle set) and component.

    Texts are linked if the Jaccard similarity of their sets of five-word shingles is 0.8
    or more (A-Z lower-cased, words as in ``op1_simhash``; a shorter text is one shingle).
    Equal sets are one node; texts without words have equal, empty sets.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), row_key(docs).alias("row"))
    marks = materialize(rows.mapInArrow(_signatures(mark), "id long, row string, mark long, fp long, n long, bands array<long>"))
    nodes = materialize(marks.groupBy("fp").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("bands").alias("bands")))

    def sets_of(wanted: DataFrame) -> DataFrame:
        chosen = nodes.join(wanted, "fp", "left_semi").select("fp", F.col("row").alias("chosen"))
        texts = rows.join(chosen, F.col("row") == F.col("chosen")).select("fp", "text")
        return texts.mapInArrow(_sets, "fp long, s array<long>").dropDuplicates(["fp"])

    roots = components(similar_links(nodes, sets_of), "a", "b").select(F.col("node").alias("fp"), "root")
    named = materialize(nodes.select("fp").join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("component")))
    return marks.select("id", "row", "mark", "fp").join(named, "fp").select("id", "row", "mark", "fp", "component")
