"""What the training-data operators share: reading, checkpoints, text helpers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.checkpoints import materialize, shared_folder

__all__ = ["WORD", "bounded_labels", "held_out", "id_and_text", "materialize", "read", "remove_folder", "row_key", "rows_of", "shared_folder", "slices", "unused"]

#: A word is a run of anything but the space and the control characters 09 to 0D.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under names that nothing else can clash with."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of an intermediate result, wherever Spark keeps it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: JSON that tells any two values of a column apart: times to the nanosecond, nulls written out.
EXACT_JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSSSS"}


def row_key(docs: DataFrame):
    """What tells rows apart: digests of all columns, so that only rows alike in every column share it.

    One digest is of the columns written out in full, the other of the columns
    themselves, where writing could lose something (text that is no valid UTF-8).
    """
    written = [F.col(f"`{c}`") for c in docs.columns]
    hashed = [F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    return F.concat(F.md5(F.to_json(F.struct(*written), EXACT_JSON)), F.hex(F.xxhash64(F.lit(0), *hashed)))


def unused(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one where a column of ``docs`` is called so."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def rows_of(batch: pa.RecordBatch) -> tuple[pa.Array, list[bytes]]:
    """Ids and UTF-8 texts of a batch; a null text is empty."""
    texts = batch.column(1).cast(pa.binary()).to_pylist()
    return batch.column(0), [x or b"" for x in texts]


def slices(batches: Iterable[pa.RecordBatch], most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most_bytes`` (one row at least), so that Python holds little at once."""
    for batch in batches:
        if batch.num_rows:
            step = max(1, int(batch.num_rows * most_bytes / max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                yield batch.slice(at, step)


def held_out(id_col: str, modulus: int, remainder: int):
    """crc32 of the id as text, modulo ``modulus``, equals ``remainder`` (false for a null id)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(False))


def bounded_labels(labels: DataFrame, label_col: str, train, most: int) -> DataFrame:
    """At most ``most`` labelled ids with one label each, the same ones on every run.

    ``train`` says which rows may be learned from. Rows with a null id or label are left
    out; an id with several labels counts as 1 if any of them is 1.
    """
    one = (
        labels.where(train & F.col("doc_id").isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("label"))
    )
    n = one.count()
    if n <= most:
        return one
    # by a hash first, so that no more than about ``most`` rows reach the final choice
    near = one.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * most / n))
    return near.orderBy(F.xxhash64("id"), "id").limit(most)
