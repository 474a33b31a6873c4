"""Exact duplicates by an extendible-hash index on shared files; DataFrame functions only."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesloom.llm.common import shared_folder

#: Keys a bucket holds; a fuller one is split.
CAPACITY = 1 << 12
#: Keys or directory slots that are sent to all tasks at most (8 to 30 bytes each); more are joined by a shuffle.
LISTED = 100_000
#: Bits of a key.
BITS = 64


def key_of(text: Column, bits: int = BITS) -> Column:
    """The key of a text: the first ``bits`` bits of its XXH64."""
    h = F.xxhash64(text)
    return h if bits == BITS else F.shiftrightunsigned(h, BITS - bits)


def slot(key: Column, depth: int, bits: int = BITS) -> Column:
    """The first ``depth`` bits of a key: its place in a directory of that depth."""
    return F.lit(0).cast("long") if depth == 0 else F.shiftrightunsigned(key, bits - depth)


def directory(keys: DataFrame, capacity: int = CAPACITY, bits: int = BITS) -> tuple[DataFrame, int]:
    """(slot, bucket, depth, n) of an extendible-hash directory over distinct ``key``s, and its depth.

    The directory doubles, which makes one more bit of the key count, until no slot holds
    more than ``capacity`` keys (or bits run out, and then keys chain). Slots that agree
    in fewer bits share a bucket as long as it is not overfull: a bucket's own ``depth``
    is the smallest at which it fits, ``bucket`` is its first slot and ``n`` its keys.
    """
    total = keys.count()
    depth = min(bits, max(0, -(-total // capacity) - 1).bit_length())
    while True:
        counts = keys.groupBy(slot(F.col("key"), depth, bits).alias("slot")).agg(F.count("*").alias("n"))
        if depth >= bits or counts.where(F.col("n") > capacity).isEmpty():
            break
        depth += 1
    halves = counts.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth"))
    halves = halves.withColumn("bucket", F.expr(f"shiftleft(shiftrightunsigned(slot, {depth} - depth), {depth} - depth)"))
    fits = halves.groupBy("depth", "bucket").agg(F.sum("n").alias("held")).where((F.col("held") <= capacity) | (F.col("depth") == depth))
    own = halves.drop("n").join(fits, ["depth", "bucket"]).groupBy("slot").agg(F.min_by(F.struct("bucket", "depth", F.col("held").alias("n")), "depth").alias("b"))
    return own.select("slot", "b.*"), depth


def _few(df: DataFrame, most: int = LISTED) -> bool:
    return df.limit(most + 1).count() <= most


@dataclass
class Index:
    """What ``build`` wrote: the rows, their directory, and one entry per text that stands in several rows."""

    path: str
    rows: DataFrame
    directory: DataFrame
    entries: DataFrame


def build(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, bits: int = BITS, listed: int = LISTED) -> Index:
    """Writes the index of ``docs`` under ``path``, a folder that all executors share, as Parquet.

    * ``rows``: (key, sha, id, copies), one per different id and text.
    * ``directory``: which bucket a slot of keys belongs to (``directory``).
    * ``entries``: (owner, bucket, key, chain, keep_id, size, text), one per different text
      under a key that several rows share. Texts are compared byte by byte: rows of a key
      are grouped by the text itself, and different texts of one key form a chain in
      their own order. ``text`` is kept where a chain has more than one link, else null.

    Neighbouring buckets go to one owner task, which chains and writes their entries.
    Copies are counted before anything is shuffled, so that a group of any size is one
    row a task, and texts of keys that only one row has are neither compared nor moved
    where the shared keys are few enough (``listed``) to be sent to all tasks.
    """
    spark = docs.sparkSession
    id_, text = F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    seen = docs.select(id_, key_of(text, bits).alias("key"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"))
    seen.groupBy("key", "sha", "id").agg(F.count("*").alias("copies")).write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    rows.groupBy("key").agg(F.sum("copies").alias("n")).write.parquet(f"{path}/keys")
    keys = spark.read.parquet(f"{path}/keys")
    slots, depth = directory(keys, capacity, bits)
    slots.write.parquet(f"{path}/directory")
    slots = spark.read.parquet(f"{path}/directory")

    shared = keys.where(F.col("n") > 1).select("key")
    texts = docs.select(id_, key_of(text, bits).alias("key"), text.alias("text"))
    few = _few(shared, listed)
    if few:
        texts = texts.join(F.broadcast(shared), "key", "left_semi")
    groups = texts.groupBy("key", "text").agg(F.max("id").alias("keep_id"), F.count("*").alias("size"))
    if not few:  # all texts have been grouped, those that stand alone under their key too
        groups = groups.join(shared, "key", "left_semi")
    place = slots if not _few(slots, listed) else F.broadcast(slots)
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = groups.withColumn("slot", slot(F.col("key"), depth, bits)).join(place.select("slot", "bucket"), "slot")
    placed = placed.withColumn("owner", F.floor(F.col("bucket") * (owners / 2.0**depth)).cast("int")).repartition("owner")
    chain = W.partitionBy("owner", "key")
    entries = placed.withColumn("chain", F.row_number().over(chain.orderBy("text"))).withColumn("links", F.count("*").over(chain))
    entries = entries.select("owner", "bucket", "key", "chain", "links", "keep_id", "size", F.when(F.col("links") > 1, F.col("text")).alias("text"))
    entries.sortWithinPartitions("bucket", "key", "chain").write.parquet(f"{path}/entries")
    return Index(path, rows, slots, spark.read.parquet(f"{path}/entries"))


def duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, bits: int = BITS, listed: int = LISTED
) -> DataFrame:
    """(id, keep_id, size, kept, sha) per row of ``docs``: of equal texts, the row with the largest id is kept.

    The index (``build``) is written under ``path``, a new folder beside the checkpoints
    by default. A row finds its group by its key; only where different texts share a key
    does it go by its text.

    A null text is empty and equal to every empty text. Rows without an id are kept only
    if no row of their group has one. Rows alike in id and text are repeated rows: each
    gets its row, and of those that could be kept one is. Texts of any length are
    compared whole. An empty table gives an empty result. Other columns are not read,
    whatever their names.
    """
    spark = docs.sparkSession
    index = build(docs, path or f"{shared_folder(spark)}/exact-{uuid.uuid4().hex}", id_col, text_col, capacity, bits, listed)
    alone = index.entries.where(F.col("links") == 1).select("key", "keep_id", "size")
    out = index.rows.join(alone, "key", "left")
    chained = index.entries.where(F.col("links") > 1).select("key", "text", F.col("keep_id").alias("chain_keep"), F.col("size").alias("chain_size"))
    if not chained.isEmpty():  # different texts under one key
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        texts = docs.select(F.col(id_col).cast("long").alias("id"), key_of(text, bits).alias("key"), text.alias("text"))
        linked = texts.join(chained, ["key", "text"]).select("key", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"), "id", "chain_keep", "chain_size").distinct()
        linked = linked.select(*[F.col(c).alias(f"_{c}") for c in ("key", "sha", "id")], "chain_keep", "chain_size")
        same = (F.col("key") == F.col("_key")) & (F.col("sha") == F.col("_sha")) & F.col("id").eqNullSafe(F.col("_id"))
        out = out.join(linked, same, "left").withColumns(
            {"keep_id": F.when(F.col("chain_size").isNotNull(), F.col("chain_keep")).otherwise(F.col("keep_id")), "size": F.coalesce("chain_size", "size")}
        )
    out = out.withColumns({"keep_id": F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep_id")), "size": F.coalesce("size", "copies")})
    each = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return each.select("id", "keep_id", "size", kept.alias("kept"), F.lower(F.hex("sha")).alias("sha"))


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text another row of a larger id has; of rows alike in id and text all stay.

    Nulls, empty texts and tables as in ``duplicates``; all columns come back as they were.
    """
    gone = duplicates(docs, id_col, text_col).where(~F.col("id").eqNullSafe(F.col("keep_id"))).select(F.col("id").alias("_gone"), F.col("sha").alias("_sha")).distinct()
    sha = F.sha2(F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary"), 256)
    return docs.join(gone, docs[id_col].cast("long").eqNullSafe(gone["_gone"]) & (sha == gone["_sha"]), "left_anti")


def op13_exact_dedup(docs: DataFrame) -> DataFrame:
    return duplicates(docs).select(F.col("id").alias("doc_id"), "keep_id", F.col("size").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))
