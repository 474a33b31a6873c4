"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import id_and_text, materialize, row_key, rows_of, slices, unused
from seriesloom.llm.graph import components
from seriesloom.llm.near_copies import near_copies

SEED = 42
#: Buckets of more fingerprints than this are linked through shared ball centres.
BUCKET = 16


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of one UTF-8 text; bit 63 is the first in ``unpackbits`` order."""
    words = text.lower().split()  # bytes: lower-cases A-Z alone, splits at space and 09-0D alone
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        line = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(sizes) - 1
        starts = ends - sizes + 1
        parts = [line[a:b] for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    digest = xxhash.xxh64_digest
    raw = np.frombuffer(b"".join([digest(x, SEED) for x in parts]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(raw), 1 << 15):
        ones += np.unpackbits(raw[at : at + (1 << 15)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(raw)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp) of every row of ``docs``; a null text or one without words has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, texts = rows_of(batch)
            yield pa.RecordBatch.from_arrays([ids, pa.array([fingerprint(x, shingle) for x in texts], pa.int64())], ["id", "fp"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "id long, fp long")


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """2^(radius+1)-1 masks; fingerprints at most ``radius`` bits apart agree under one of them at least.

    Bit i carries a non-zero vector of radius+1 bits, and mask v keeps the bits whose
    vector has odd parity with v. The vectors of ``radius`` differing bits span too small
    a space to leave no v that is even with all of them.
    """
    n = (1 << (radius + 1)) - 1
    masks = [sum(1 << i for i in range(bits) if (v & (i % n + 1)).bit_count() % 2) for v in range(1, n + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): fingerprints of ``nodes.fp`` (distinct) joined so that all within ``radius`` <= 2 bits are connected.

    A bucket of two compares its smallest with its largest; one of up to BUCKET compares
    its list; larger ones hand their members to ``ball_links``. No bucket is capped and
    no bucket emits more than its verified links.
    """
    if not 0 <= radius <= 2:
        raise ValueError("radius: 0, 1 or 2")
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in covering_masks(radius)])
    tables = nodes.select("fp", F.posexplode(keys).alias("t", "key"))
    buckets = materialize(
        tables.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    )
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= radius
    twos = buckets.where("n = 2").where(near(F.col("a"), F.col("b"))).select("a", "b")
    busy = tables.join(buckets.where("n > 2").select("t", "key", "n"), ["t", "key"])
    lists = busy.where(F.col("n") <= BUCKET).groupBy("t", "key").agg(F.collect_list("fp").alias("fps"))
    few = lists.select(F.explode(_verified("fps", near)).alias("x")).select("x.a", "x.b")
    return twos.unionByName(few).unionByName(ball_links(busy.where(F.col("n") > BUCKET).select("fp").distinct(), near)).distinct()


def _verified(column: str, near):
    fps = F.col(column)
    pairs = F.transform(
        fps,
        lambda x: F.transform(F.filter(fps, lambda y: (y > x) & near(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b"))),
    )
    return F.flatten(pairs)


def ball_links(nodes: DataFrame, near) -> DataFrame:
    """Links among the members of large buckets, exact and without comparing them in pairs.

    Each fingerprint stands in the ball of radius 1 around itself and its 64 one-bit
    neighbours. Two fingerprints at most 2 bits apart share a ball, and a ball holds 65
    distinct fingerprints at most, so that its list is small however hot the bucket was.
    """
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0))) for i in range(64)])
    balls = nodes.select("fp", F.explode(flips).alias("centre")).groupBy("centre").agg(F.collect_list("fp").alias("fps"))
    return balls.where(F.size("fps") > 1).select(F.explode(_verified("fps", near)).alias("x")).select("x.a", "x.b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row per row of ``docs``: id, fp and component, the smallest id reachable over links of at most ``radius`` bits.

    Null or empty texts have fingerprint 0 and link like any other. A null id takes part
    but is never a component's id unless all ids of that component are null. Repeated
    rows each get a row. An empty table gives an empty result. Other columns of ``docs``
    are not read.

    Equal fingerprints are merged before any comparison, so that thousands of copies
    cost one node.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle))
    nodes = materialize(fps.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(nodes, radius), "a", "b")
    linked = roots.join(nodes, roots.node == nodes.fp).select("fp", "root", "least")
    moved = linked.join(linked.groupBy("root").agg(F.min("least").alias("to")), "root").select("fp", "to")
    named = materialize(nodes.join(moved, "fp", "left").select("fp", F.coalesce("to", "least").alias("component")))
    return fps.join(named, "fp").select("id", "fp", "component")


def op1_simhash(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def simhash_groups(docs: DataFrame, radius: int = 2) -> DataFrame:
    """One row per row of ``docs``: id, row (``row_key``) and component, over links of both kinds.

    Rows are linked by fingerprints at most ``radius`` bits apart, through the covering
    masks of ``op1_simhash``, and by what fingerprints cannot tell: 0.8 of the five-word
    shingles or more in common (``near_copies``), where texts lie 3 to 11 bits apart.
    Groups by shingles become one node each before fingerprints link them.
    """
    rows = materialize(near_copies(docs, mark=fingerprint))
    met = rows.select("mark", "component").distinct()
    prints = materialize(met.groupBy("mark").agg(F.min("component").alias("least")))
    same = met.join(prints, "mark").where("component <> least").select(F.col("component").alias("a"), F.col("least").alias("b"))
    near = links(prints.select(F.col("mark").alias("fp")), radius)
    ends = [prints.select(F.col("mark").alias(x), F.col("least").alias(f"_{x}")) for x in "ab"]
    near = near.join(ends[0], "a").join(ends[1], "b").where("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    roots = components(same.unionByName(near), "a", "b").select(F.col("node").alias("component"), "root")
    return rows.join(roots, "component", "left").select("id", "row", F.coalesce("root", "component").alias("component"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Pipeline stage: of each group of near copies, one row stays: the smallest doc_id, null last, then the smallest row digest.

    Near copies are those of ``simhash_groups``. All columns stay as they are. Rows alike
    in every column are one row here.
    """
    rows = simhash_groups(docs).groupBy("component", "id", "row").agg(F.count("*").alias("rows"))
    order = F.struct(F.col("id").isNull().alias("unnamed"), "id", "row", "rows")
    best = rows.groupBy("component").agg(F.min(order).alias("best"))
    row = unused(docs, "_row")
    best = materialize(best.select(F.col("best.row").alias(row), F.col("best.rows").alias("rows")))
    kept = docs.withColumn(row, row_key(docs)).join(best.select(row), row, "left_semi")
    if not best.where("rows > 1").isEmpty():
        kept = kept.dropDuplicates([row])
    return kept.select(docs.columns)
