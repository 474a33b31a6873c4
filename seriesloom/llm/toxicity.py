"""Toxicity by multiple-instance learning: sentences joined by noisy-or, trained from document labels."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import bounded_labels, held_out, id_and_text, materialize, rows_of, slices

SENTENCE = re.compile(r"[.!?\n]+")
TOKEN = re.compile(r"[^\W_]+")
#: At most so many labelled documents are learned from, in so many parts and rounds; and so many features are kept.
MOST_LABELS, PARTS, ROUNDS, EPOCHS, MOST_FEATURES = 20_000, 8, 4, 3, 4096
BIAS, RATE, SHRINK = -6.0, 0.5, 1e-4
#: Words whose scores a worker remembers at most.
MEMORY = 400_000


def word_features(word: str) -> list[str]:
    """Features of a word: itself in lower case, and its first 4, 5 and 6 characters for what its forms share."""
    word = word.lower()
    return [word, *(word[:n] + "~" for n in (4, 5, 6) if len(word) >= n)]


class WordScores(dict):
    """Score of a word under feature weights, computed once and forgotten when too many are held."""

    def __init__(self, weights: dict[str, float]) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = score = sum(self.weights.get(f, 0.0) for f in word_features(word))
        return score


def sentence_scores(text: str, scores: WordScores) -> list[tuple[int, int, float]]:
    """(start, end, summed word scores) of each sentence with a word, as character offsets."""
    found, at = [], 0  # lowering a whole text could move its places
    ends = [*((m.start(), m.end()) for m in SENTENCE.finditer(text)), (len(text), len(text))]
    for stop, after in ends:
        if words := TOKEN.findall(text, at, stop):
            found.append((at, stop, sum(map(scores.__getitem__, words))))
        at = after
    return found


def noisy_or(sums: list[float], bias: float) -> float:
    """1 - prod(1 - sigmoid(bias + s)) over sentences with telling words and one leak term, sigmoid(bias).

    Sentences without telling words say nothing, so that a clean text's score does not
    rise with its length.
    """
    z = np.array([bias, *(bias + s for s in sums if s)])
    return float(-np.expm1(-np.logaddexp(0.0, z).sum()))


def _present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per labelled document the features that it has."""
    for batch in slices(batches):
        _, texts = rows_of(batch)
        found = [list({f for w in set(TOKEN.findall(t.decode("utf-8", "replace"))) for f in word_features(w)}) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(found, pa.list_(pa.string()))], ["label", "features"])


def telling_features(rows: DataFrame, most: int = MOST_FEATURES) -> list[str]:
    """The features that speak for label 1 most strongly (likelihood ratio), ``most`` at most.

    Counted in documents of the bounded sample. A feature counts if four documents of
    label 1 have it and label 1 is at least 1.5 times as likely with it.
    """
    pos, n = rows.agg(F.count_if(F.col("label") == 1), F.count("*")).first()
    if not pos or pos == n:
        return []
    counts = rows.mapInArrow(_present, "label int, features array<string>").select("label", F.explode("features").alias("f"))
    counts = counts.groupBy("f").agg(F.count_if(F.col("label") == 1).alias("a"), F.count("*").alias("m")).where("a >= 4")
    share = F.col("a") / F.col("m")
    rest = F.col("m") - F.col("a")
    part = lambda k, q: F.when(k > 0, k * F.ln(k / (F.col("m") * q))).otherwise(0.0)
    ratio = part(F.col("a"), pos / n) + part(rest, 1 - pos / n)
    best = counts.where(share > 1.5 * pos / n).where(ratio > 8).orderBy(ratio.desc(), "f").limit(most)
    return [r.f for r in best.select("f").collect()]


def train(
    docs: DataFrame, labels: DataFrame, label_col: str, trainable, id_col: str = "doc_id", text_col: str = "text", most_labels: int = MOST_LABELS, most_features: int = MOST_FEATURES
) -> tuple[dict[str, float], float]:
    """Weights of at most ``most_features`` features and bias learned from at most ``most_labels`` labelled documents, the smallest text of each id.

    Every round, each part descends from the shared weights over its own documents and
    the driver averages the parts: a fixed number of vectors of bounded size, whatever
    the number of documents. A document's log-likelihood is that of the noisy-or over
    its sentences with telling words and a leak, so that a positive label pulls up the
    sentences already under suspicion. No labelled rows, or one class alone: no weights.
    """
    ids = F.broadcast(bounded_labels(labels, label_col, trainable, most_labels))
    # rows of one id give one text, so that the bound on ids bounds the rows; sorted, so that reruns learn alike
    rows = id_and_text(docs, id_col, text_col).join(ids, "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    rows = materialize(rows.select("id", "text", "label").repartition(PARTS, "id").sortWithinPartitions("id"))
    names = telling_features(rows, most_features)
    sc = docs.sparkSession.sparkContext
    place = sc.broadcast({f: i for i, f in enumerate(names)})

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = place.value
        for batch in slices(batches):
            _, texts = rows_of(batch)
            flat, counts = [], []
            for text in texts:
                ids, sizes = [len(number)], [1]  # the leak: the constant feature alone
                for sentence in SENTENCE.split(text.decode("utf-8", "replace")):
                    own = [number[f] for w in TOKEN.findall(sentence) for f in word_features(w) if f in number]
                    if own:
                        ids.extend([*own, len(number)])
                        sizes.append(len(own) + 1)
                flat.append(np.asarray(ids, "<i4").tobytes())
                counts.append(np.asarray(sizes, "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(flat, pa.binary()), pa.array(counts, pa.binary())], ["label", "ids", "sizes"])

    found = materialize(rows.mapInArrow(examples, "label int, ids binary, sizes binary"))
    weights = np.zeros(len(names) + 1)
    weights[-1] = BIAS
    for turn in range(ROUNDS if names else 0):
        shared = sc.broadcast(weights)

        def descend(batches: Iterator[pa.RecordBatch], turn: int = turn, shared=shared) -> Iterator[pa.RecordBatch]:
            rows = [x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())]
            own = shared.value.copy()
            slope = np.full(len(own), 1e-2)
            slope[-1] = 1.0
            for epoch in range(EPOCHS):
                for i in np.random.default_rng(turn * EPOCHS + epoch).permutation(len(rows)):
                    label, ids, sizes = rows[i]
                    sizes, ids = np.frombuffer(sizes, "<i4"), np.frombuffer(ids, "<i4")
                    z = np.add.reduceat(own[ids], np.cumsum(sizes) - sizes)
                    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                    nothing = np.exp(-np.logaddexp(0, z).sum())
                    g = np.clip(p * (nothing / max(1 - nothing, 1e-9)), 0, 1) if label else -p
                    used, back = np.unique(ids, return_inverse=True)
                    total = np.bincount(back, np.repeat(g, sizes)) - SHRINK * own[used]
                    slope[used] += total**2
                    own[used] += RATE / (1 + turn) * total / np.sqrt(slope[used])
            if rows:
                yield pa.RecordBatch.from_pydict({"n": [len(rows)], "w": [own.astype("<f8").tobytes()]})

        parts = found.mapInArrow(descend, "n long, w binary").collect()
        weights = sum(np.frombuffer(x.w, "<f8") * x.n for x in parts) / sum(x.n for x in parts)
    return {f: float(w) for f, w in zip(names, weights)}, float(weights[-1])


def score(docs: DataFrame, weights: dict[str, float], bias: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, worst_start, worst_end, worst_score) per row; the worst sentence as character offsets.

    Null and empty texts score the leak alone and have a null worst sentence. Repeated rows each get
    a row; other columns are not read; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        scores = WordScores(weights)
        for batch in slices(batches):
            ids, texts = rows_of(batch)
            out: list[list] = [[], [], [], []]
            for text in texts:
                found = sentence_scores(text.decode("utf-8", "replace"), scores)
                out[0].append(noisy_or([x[2] for x in found], bias))
                start, end, most = max(found, key=lambda x: (x[2], -x[0]), default=(None, None, None))
                out[1].append(start)
                out[2].append(end)
                out[3].append(None if most is None else float(1 / (1 + np.exp(-np.clip(bias + most, -500, 500)))))
            kinds = (pa.float64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, k) for x, k in zip(out, kinds))], ["id", "score", "worst_start", "worst_end", "worst_score"])

    schema = "id long, score double, worst_start long, worst_end long, worst_score double"
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)


def op2_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    weights, bias = train(docs, labels, "toxic", ~held_out("doc_id", 5, 0))
    return score(docs, weights, bias).select(
        F.col("id").alias("doc_id"),
        held_out("id", 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "worst_start",
        "worst_end",
    )


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pipeline stage: documents scored below 0.5 stay, with all their columns, whatever their names.

    Null and empty texts stay. Whole texts count, however long; repeated rows are judged
    alike, and an empty table gives an empty one.
    """
    weights, bias = train(docs, labels, "toxic", ~held_out("doc_id", 5, 0))
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        scores = WordScores(weights)
        for batch in slices(batches):
            keep = [noisy_or([x[2] for x in sentence_scores(t or "", scores)], bias) < 0.5 for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
