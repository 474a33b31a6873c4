"""Quality by compression: zstandard dictionaries of good and bad text, calibrated size difference."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import bounded_labels, held_out, id_and_text, materialize, rows_of, slices

#: At most so many labelled documents are learned from.
MOST_LABELS = 20_000
#: A dictionary is trained on at most so many bytes of blocks of each class.
MOST_BYTES = 8 << 20
DICTIONARY = 96 << 10
BLOCK, LEVEL = 1024, 3


def blocks(text: bytes, size: int = BLOCK) -> list[bytes]:
    """The whole text in blocks, so that a dictionary tells as much at the end as at the start."""
    return [text[i : i + size] for i in range(0, len(text), size)]


class Compressors:
    """Compressed sizes under the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.both = []
        for raw in (good, bad):
            known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO) if raw else None
            if known:
                known.precompute_compress(level=LEVEL)
            self.both.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False))

    def difference(self, text: bytes) -> float:
        """(size under bad - size under good) / (their sum): positive for text that looks good; 0 for an empty one."""
        good, bad = (sum(len(c.compress(b)) for b in blocks(text)) for c in self.both)
        return (bad - good) / (bad + good) if text else 0.0


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves where there are too few to train on, or nothing."""
    samples = [x for x in samples if x]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY:]


def _dictionaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A dictionary per class from its first blocks, MOST_BYTES of them at most."""
    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for label, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = held.setdefault(label, [])
            if len(own) < MOST_BYTES // BLOCK:
                own.append(block)
    if held:
        made = [dictionary(x) for x in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(made, pa.binary())], ["label", "dictionary"])


def calibrate(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of a logistic curve by Newton steps with a weak prior."""
    if not len(y) or y.min() == y.max():
        share = (float(y.sum()) + 1) / (len(y) + 2)
        return 0.0, float(np.log(share / (1 - share)))
    scale = float(x.std()) or 1.0
    a = np.stack([x / scale, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (y - p) - 1e-3 * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def train(docs: DataFrame, labels: DataFrame, label_col: str, trainable, id_col: str = "doc_id", text_col: str = "text", most_labels: int = MOST_LABELS) -> tuple[bytes, bytes, float, float]:
    """Good and bad dictionary and the calibration, from at most ``most_labels`` labelled documents, the smallest text of each id.

    Half of those documents give the blocks of the dictionaries, at most MOST_BYTES of each
    class; the other half, unseen by the dictionaries, gives one number each for the curve.
    """
    ids = F.broadcast(bounded_labels(labels, label_col, trainable, most_labels))
    half = F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)).alias("half")
    # rows of one id give one text, so that the bound on ids bounds the rows
    rows = id_and_text(docs, id_col, text_col).join(ids, "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    rows = materialize(rows.select("id", "text", "label", half))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, texts = rows_of(batch)
            found = [(i, k, y, b) for i, y, t in zip(ids.to_pylist(), batch.column(2).to_pylist(), texts) for k, b in enumerate(blocks(t))]
            if found:
                i, k, y, b = map(list, zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(k, pa.int32()), pa.array(y, pa.int32()), pa.array(b, pa.binary())], ["id", "k", "label", "block"])

    # a hash of each block's place decides first, so that only about MOST_BYTES of a class are shuffled to its dictionary
    learned = rows.where("half = 0")
    share = {r.label: min(1.0, MOST_BYTES / BLOCK / (r.n or 1)) for r in learned.groupBy("label").agg(F.sum(F.ceil(F.octet_length("text") / BLOCK)).alias("n")).collect()}
    most = F.lit(0)
    for label, part in share.items():
        most = F.when(F.col("label") == label, int(part * (1 << 30))).otherwise(most)
    ordered = learned.mapInArrow(cut, "id long, k int, label int, block binary").where(F.pmod(F.xxhash64("id", "k"), F.lit(1 << 30)) < most)
    ordered = ordered.repartition("label").sortWithinPartitions("label", F.xxhash64("id", "k"), "id", "k").select("label", "block")
    found = {r.label: bytes(r.dictionary) for r in ordered.mapInArrow(_dictionaries, "label int, dictionary binary").collect()}
    made = [found.get(1, b""), found.get(0, b"")]
    shared = docs.sparkSession.sparkContext.broadcast(tuple(made))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Compressors(*shared.value)
        for batch in slices(batches):
            _, texts = rows_of(batch)
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array([tool.difference(t) for t in texts], pa.float64())], ["label", "x"])

    points = rows.where("half = 1").mapInArrow(measure, "label int, x double").collect()
    slope, intercept = calibrate(np.array([p.x for p in points]), np.array([p.label for p in points], float))
    return made[0], made[1], slope, intercept


def score(docs: DataFrame, good: bytes, bad: bytes, slope: float, intercept: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, difference, score) per row of ``docs``; an empty or null text has difference 0.

    Repeated rows each get a row; other columns are not read; an empty table gives an
    empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast((good, bad))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Compressors(*shared.value)
        for batch in slices(batches):
            ids, texts = rows_of(batch)
            x = np.array([tool.difference(t) for t in texts])
            p = 1 / (1 + np.exp(-np.clip(slope * x + intercept, -500, 500)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(x), pa.array(p)], ["id", "difference", "score"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "id long, difference double, score double")


def op6_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels, "quality", ~held_out("doc_id", 3, 1))
    return score(docs, *model).select(
        F.col("id").alias("doc_id"),
        held_out("id", 3, 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "difference",
    )
