from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def vocabulary():
    rng = random.Random(1)
    return ["".join(rng.choice("abdefgilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]


@pytest.fixture(scope="session")
def prose(vocabulary):
    def make(seed, n):
        rng = random.Random(seed)
        return " ".join(rng.choice(vocabulary) + (". " if rng.random() < 0.1 else "") for _ in range(n))

    return make


@pytest.fixture(scope="session")
def hard_texts(prose):
    """Copies, near copies, shared passages, runs, nulls, empty, very long and odd texts."""
    base = [prose(i, 40 + 17 * i) for i in range(12)]
    passage = prose(99, 150)
    near = [base[9].replace(" ", "  ", k % 3) + ("x" if k % 2 else "") for k in range(8)]
    shared = [prose(200 + i, 30) + " " + passage + " " + prose(300 + i, 30) for i in range(6)]
    odd = [None, "", " \n\t ", "a", "one two", "a" * 1500, "ab" * 900, "same line here\n" * 60, "Ünïcode ² Ⅷ 日本語 \U0001f600 " * 20, "# * $ % & | < > " * 40, "<|endoftext|> is text"]
    long = prose(7, 30_000)
    return [*base, *near, *shared, *odd, base[3], base[3], base[3], passage, long, long[: len(long) // 2]]


@pytest.fixture(scope="session")
def documents(spark, hard_texts):
    rows = [(i, t, "en", ["src0", "src1", "src2", None, ""][i % 5], None if t is None else len(t)) for i, t in enumerate(hard_texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(documents):
    """The same documents with columns named like those the operators make."""
    extra = ["id", "fp", "h", "sha", "label", "score", "size", "key", "window", "start", "rank", "component", "taken", "target"]
    return documents.selectExpr("*", *[f"'{c}' AS {c}" for c in extra])
