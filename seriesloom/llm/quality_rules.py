"""Quality rules as weak supervision: votes, accuracies by expectation-maximisation, posterior."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import WORD, id_and_text, materialize, rows_of, slices

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_caps", "n_ends", "n_letters", "n_letter_words"]
WORDS, LETTERS = re.compile(WORD), re.compile(r"[^\W\d_]+")
BLANK = " \t\n\v\f\r"


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside ``window``-word windows that occur twice or more in the text, the first included."""
    n = len(words)
    if n <= window:
        return 0
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    # pairs of equal windows get equal numbers: names of 1, 2, 4, ... words, each from two shorter names
    names, size = ids, 1
    while size < window:
        step = min(size, window - size)
        joined = names[: n - size - step + 1] * (int(names.max()) + 1) + names[step : n - size + 1]
        names = np.unique(joined, return_inverse=True)[1].astype(np.int64)
        size += step
    twice = np.bincount(names)[names] > 1
    if not twice.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def statistics(data: bytes) -> tuple[int, ...]:
    """STATS of one UTF-8 text; capitals, letters and marks that end a line are those of any script."""
    text = data.decode("utf-8", "replace")
    words = WORDS.findall(text)
    lines = [x for x in (line.rstrip(BLANK) for line in text.split("\n")) if x]
    whole = [x for x in text.split("\n") if x.strip(BLANK)]
    symbols = sum(data.count(bytes([c])) for c in SYMBOLS)
    caps = sum(w.isupper() and len(w) > 1 for w in words)
    ends = sum(unicodedata.category(x[-1])[0] == "P" for x in lines)
    letters = sum(map(len, LETTERS.findall(text)))
    lettered = sum(w.isalpha() or LETTERS.search(w) is not None for w in words)
    return len(words), sum(map(len, words)), symbols, len(whole) - len(set(whole)), repeated_words(words), len(whole), caps, ends, letters, lettered


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and STATS per row of ``docs``: one pass, nothing shuffled. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, texts = rows_of(batch)
            table = np.array([statistics(x) for x in texts], np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(table[:, i]) for i in range(len(STATS)))], ["id", *STATS])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "id long, " + ", ".join(f"{x} long" for x in STATS))


def rules() -> list[tuple[str, Column]]:
    """Each rule votes 1 (good), 0 (bad) or abstains (null)."""
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, 0).when(good, 1)

    mean = share("word_chars", "n_words")
    return [
        ("length", vote(F.col("n_words") >= 100, F.col("n_words") < 50)),
        ("word_size", vote(mean.between(2.5, 9), ~mean.between(1.5, 14))),
        ("symbols", vote(share("n_symbols", "n_words") < 0.1, share("n_symbols", "n_words") > 0.3)),
        ("dup_lines", vote(share("n_dup_lines", "n_lines") < 0.1, share("n_dup_lines", "n_lines") > 0.5)),
        ("repeats", vote(share("n_repeat_words", "n_words") < 0.1, share("n_repeat_words", "n_words") > 0.3)),
        ("capitals", vote(share("n_caps", "n_words") < 0.15, share("n_caps", "n_words") > 0.5)),
        ("ends", vote(share("n_ends", "n_lines") >= 0.5, (F.col("n_lines") >= 3) & (share("n_ends", "n_lines") < 0.1))),
        ("letter_words", vote(share("n_letter_words", "n_words") >= 0.95, share("n_letter_words", "n_words") < 0.8)),
        ("letters", vote(share("n_letters", "word_chars") >= 0.9, share("n_letters", "word_chars") < 0.75)),
    ]


#: Where BELIEF votes of no document draw the estimates: P(good), P(votes good | good), P(votes good | bad).
PRIOR, GOOD, BAD, BELIEF = 0.8, 0.9, 0.5, 20.0
#: How sure the start is that a document with fewer than two bad votes is good, and one with more is not.
START = 0.9


def fit(patterns: list[tuple[tuple[int | None, ...], int]], rounds: int = 500) -> tuple[float, np.ndarray, np.ndarray]:
    """Prior of good and, per rule, P(votes good | good) and P(votes good | bad), from vote patterns with their counts.

    Expectation-maximisation on two classes; abstaining says nothing. It starts from the
    documents, those with two bad votes or more being bad. All rules are held alike, and
    how often each errs in either class is what the votes say: a rule whose bad votes
    come alone turns out weak, one whose bad votes come with others' strong.
    """
    m = len(patterns[0][0]) if patterns else 0
    if not m:
        return 0.5, np.zeros(0), np.zeros(0)
    votes = np.array([[-1 if v is None else v for v in p] for p, _ in patterns])
    counts = np.array([c for _, c in patterns], float)
    cast, yes = (votes >= 0).astype(float), (votes == 1).astype(float)
    q, before = np.where((votes == 0).sum(1) < 2, START, 1 - START), np.zeros(2 * m + 1)
    for _ in range(rounds):
        prior = float((counts @ q + BELIEF * PRIOR) / (counts.sum() + BELIEF))
        a, b = counts * q, counts * (1 - q)
        good, bad = (a @ yes + BELIEF * GOOD) / (a @ cast + BELIEF), (b @ yes + BELIEF * BAD) / (b @ cast + BELIEF)
        now = np.r_[prior, good, bad]
        if np.abs(now - before).sum() < 1e-10:
            break
        before, q = now, posterior(votes, prior, good, bad)
    return prior, good, bad


def posterior(votes: np.ndarray, prior: float, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    z = np.log(prior / (1 - prior)) + (votes == 1) @ np.log(good / bad) + (votes == 0) @ np.log((1 - good) / (1 - bad))
    return 1 / (1 + np.exp(-z))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """id, STATS, the votes, ``quality`` (posterior of good) and ``good`` (at least ``least``) per row of ``docs``.

    Accuracies come from all rows: they are grouped by their votes, of which there are
    3^rules combinations at most, and the driver sees those counts alone. An empty text
    has no words and its length rule votes bad. Repeated rows each get a row; an empty
    table gives an empty result; other columns are not read.
    """
    named = rules()
    names = [f"vote_{n}" for n, _ in named]
    stats = materialize(text_statistics(docs, id_col, text_col))
    voted = stats.select("*", *[c.cast("int").alias(n) for (_, c), n in zip(named, names)])
    seen = [(tuple(r[n] for n in names), r["count"]) for r in voted.groupBy(*names).count().collect()]
    prior, good, bad = fit(seen)
    z = F.lit(float(np.log(prior / (1 - prior))))
    for j, n in enumerate(names if len(good) else []):
        yes, no = float(np.log(good[j] / bad[j])), float(np.log((1 - good[j]) / (1 - bad[j])))
        z = z + F.when(F.col(n) == 1, F.lit(yes)).when(F.col(n) == 0, F.lit(no)).otherwise(F.lit(0.0))
    quality = 1.0 / (1.0 + F.exp(-z))
    return voted.withColumn("quality", quality).withColumn("good", F.col("quality") >= least)


def op5_quality_rules(docs: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judge(docs).select(F.col("id").alias("doc_id"), *base, failed.alias("base_failed"), (~failed & F.col("good")).alias("kept"), "quality")
