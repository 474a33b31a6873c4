"""Token counts per document from distinct pre-tokens, without materialising ids."""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import id_and_text, materialize, rows_of, slices
from seriesloom.llm.tokens import PreTokenizer, PreTokenModel, load, vocabulary_path

LIMIT = 512
#: Distinct pre-tokens that a task holds before it passes on their frequencies.
HELD = 400_000
#: Most frequent pre-tokens, at most so many, whose counts every worker gets; the others are joined by a shuffle.
FREQUENT = 200_000
#: Steps per factor e by which frequencies are told apart when the frequent ones are chosen.
STEPS = 64


def _frequencies(path: str | None):
    """(p, n): distinct pre-tokens with their frequency, combined as far as a task holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held = PreTokenizer(path or vocabulary_path()), Counter()
        for batch in slices(batches):
            for text in _decoded(batch):
                found = split(text)
                if found is not None:
                    held.update(found)
            if len(held) >= HELD:
                yield _rows(held)
                held = Counter()
        if held:
            yield _rows(held)

    return run


def _decoded(batch: pa.RecordBatch) -> list[str]:
    return [t.decode("utf-8", "replace") for t in rows_of(batch)[1]]


def _rows(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["p", "n"])


def _pieces(path: str | None):
    """(p, n, k): the tokens of each pre-token, asked of the vocabulary once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PreTokenModel(load(path or vocabulary_path()))
        for batch in slices(batches):
            counts = pa.array([len(model.ids(p)) for p in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, counts], ["p", "n", "k"])

    return run


class _Known(dict):
    """Tokens per frequent pre-token; any other counts 0 and is noted in ``rest``."""

    def __missing__(self, p: str) -> int:
        self.rest.append(p)
        return 0


def _documents(path: str | None, frequent: Broadcast):
    """Per row: id, n_bytes, the tokens of its frequent pre-tokens, and its other pre-tokens with their frequencies."""
    kinds = pa.list_(pa.struct([("p", pa.string()), ("f", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = PreTokenizer(path or vocabulary_path()), _Known(pickle.loads(frequent.value))
        for batch in slices(batches):
            ids, texts = rows_of(batch)
            sums, rest = [], []
            for text in _decoded(batch):
                found, known.rest = split(text), []
                sums.append(split.whole(text) if found is None else sum(map(known.__getitem__, found)))
                rest.append([{"p": p, "f": f} for p, f in Counter(known.rest).items()])
            columns = [ids, pa.array(map(len, texts), pa.int64()), pa.array(sums, pa.int64()), pa.array(rest, kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "known", "rest"])

    return run


def frequent_from(pieces: DataFrame, most: int) -> int | None:
    """The smallest frequency (up to STEPS steps per factor e) that ``most`` pre-tokens reach at most; None if any does too many."""
    step = F.floor(F.ln("n") * STEPS).cast("long").alias("step")
    table = pieces.groupBy(step).agg(F.count("*").alias("c"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()  # some thousand rows at most
    total, least = 0, None
    for r in table:
        total += r.c
        if total > most:
            break
        least = r.least
    return least


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """(id, n_bytes, n_tokens) per row of ``docs`` under the vocabulary file at ``path``.

    (1) A scan gives the distinct pre-tokens of all texts with their frequencies, combined
    in tasks before they are shuffled. (2) The pieces of each distinct pre-token are
    counted once. (3) A second scan joins each document's pre-token frequencies with that
    table and sums: the ``frequent`` most frequent ones at most, which would be hot join
    keys, come to the workers as a broadcast of that bounded size; the rest, combined per
    document, meets the table in a shuffle. No ids are made.

    ``path`` None looks the public file up on each worker. Texts with added tokens, or with
    characters that Unicode versions may sort differently, are left to the library as a
    whole. Null texts are empty, with 0 tokens. Repeated rows each get a row; other
    columns are not read; an empty table gives an empty result.
    """
    source = id_and_text(docs, id_col, text_col)
    spark = docs.sparkSession
    found = source.mapInArrow(_frequencies(path), "p string, n long").groupBy("p").agg(F.sum("n").alias("n"))
    pieces = materialize(found.mapInArrow(_pieces(path), "p string, n long, k long"))
    least = frequent_from(pieces, frequent)
    near = F.lit(False) if least is None else F.col("n") >= least
    table = dict(map(tuple, pieces.where(near).select("p", "k").collect()))  # ``frequent`` rows at most
    shared = spark.sparkContext.broadcast(pickle.dumps(table))
    schema = "id long, n_bytes long, known long, rest array<struct<p: string, f: long>>"
    rows = materialize(source.mapInArrow(_documents(path, shared), schema)).withColumn("row", F.monotonically_increasing_id())
    seldom = rows.select("row", F.explode("rest").alias("x")).select("row", "x.p", "x.f")
    sums = seldom.join(pieces.where(~near).select("p", "k"), "p").groupBy("row").agg(F.sum(F.col("f") * F.col("k")).alias("others"))
    out = rows.select("row", "id", "n_bytes", "known").join(sums, "row", "left")
    return out.select("id", "n_bytes", (F.col("known") + F.coalesce("others", F.lit(0))).alias("n_tokens"))


def op8_token_counts(docs: DataFrame) -> DataFrame:
    return token_counts(docs).select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
