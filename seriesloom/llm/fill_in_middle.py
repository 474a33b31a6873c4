"""Fill-in-the-middle documents by a two-pass streaming matcher, and the way back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import id_and_text, slices

#: A unit is a run of ASCII letters or any other single character.
UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
PREFIX, SUFFIX, MIDDLE = MARKS = "<P>", "<S>", "<M>"
#: Of a hundred documents, so many are rearranged, and of a hundred of those so many have the suffix first.
REARRANGED, SUFFIX_FIRST, SEED = 90, 20, 1


def draws(doc: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 that hang on the seed and the id alone; a null id is an empty number."""
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def cut_points(text: str, a: int, b: int) -> tuple[int, int, int]:
    """Units of ``text``, and the characters before unit min and max of (a mod n+1, b mod n+1).

    The first pass counts units; the second advances one lazy match iterator to the
    smaller rank and on to the larger. Neither holds more than one match.
    """
    n = sum(1 for _ in UNIT.finditer(text))
    low, high = sorted((a % (n + 1), b % (n + 1)))
    matches = UNIT.finditer(text)
    # units leave no gaps, so a rank's place is where the match before it ended
    end = lambda k, before: next(islice(matches, k - 1, None)).end() if k else before
    first = end(low, 0)
    return n, first, end(high - low, first)


def arranged(text: str, doc: int | None, seed: int = SEED, rearranged: int = REARRANGED, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of prefix and of middle, output) of one text; plain texts have no parts."""
    h1, h2, h3, h4 = draws(doc, seed)
    n, first, second = cut_points(text, h1, h2)
    if not text or h3 % 100 >= rearranged or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if h4 % 100 < suffix_first:
        return n, "spm", first, second - first, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", first, second - first, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rearranged: int = REARRANGED, suffix_first: int = SUFFIX_FIRST
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) per row of ``docs``, in one pass without a shuffle.

    A text is cut into prefix, middle and suffix between units (``UNIT``) at two places
    drawn from ``seed`` and the id, so that reruns agree. ``form`` is psm (prefix,
    suffix, middle), spm (suffix, prefix, middle) or plain: the text as it is, for empty
    texts, texts that hold one of the marks, and the share that is not ``rearranged``.

    A null text is empty; a null id draws as an empty number; repeated rows each get the
    same row; texts of any length are cut whole, and the matcher needs no memory beside
    the text and its output; an empty table gives an empty result; other columns are not
    read, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = [arranged(t or "", i, seed, rearranged, suffix_first) for i, t in zip(*(c.to_pylist() for c in batch.columns))]
            kinds = pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from: what stands between the marks, put back in order.

    No part holds a mark, and none can arise where a part meets one, because a mark
    begins with the only ``<`` in it; so each mark is found at its first place.
    """
    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        at_second, at_middle = F.locate(second, output), F.locate(MIDDLE, output)
        return F.substr(output, F.lit(4), at_second - 4), F.substr(output, at_second + 3, at_middle - at_second - 3), F.substr(output, at_middle + 3)

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(SUFFIX, PREFIX)
    spm = F.concat(prefix, middle, suffix)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_in_middle(docs: DataFrame) -> DataFrame:
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    out = fill_in_middle(docs)
    back = restored(F.col("output"), F.col("form"))
    return out.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(back).alias("restored_sha256"))
