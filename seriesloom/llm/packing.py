"""Bounded-space online packing of tokenized documents into fixed windows."""

from __future__ import annotations

import bisect
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import id_and_text, materialize, rows_of, slices
from seriesloom.llm.tokens import added_strings, load, rank_encoder, vocabulary_path

WINDOW, END = 2048, 1
#: A space that no visible character follows.
WIDE = re.compile(r" (?:\s|\Z)")
#: Open windows a partition keeps at most.
OPEN = 256
#: Bytes that a worker spends on remembered chunks at most, and the characters of a chunk worth remembering.
MEMORY, LONG = 128 << 20, 48
#: Partitions whose leftover windows one task merges.
MERGED = 32


class Known(dict):
    """Ids of chunks, encoded once and forgotten when they take more than MEMORY bytes; LONG ones are not kept."""

    def __init__(self, ranks) -> None:
        super().__init__()
        self.ranks, self.held = ranks, 0

    def __missing__(self, chunk: str) -> bytes:
        data = array("I", self.ranks.encode_ordinary(chunk)).tobytes()
        if len(chunk) <= LONG:
            size = sys.getsizeof(chunk) + sys.getsizeof(data) + 100  # and its place in the table
            if self.held + size > MEMORY:
                self.clear()
                self.held = 0
            self[chunk] = data
            self.held += size
        return data


class Encoder:
    """Little-endian 32-bit ids of a text, put together from remembered chunks.

    The byte-level pattern always starts a pre-token at a space that stands before a
    character which is no white space, so that texts may be cut there and equal chunks
    share their ids. Texts with added tokens are left to the library as they are.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = load(path)
        self.special = added_strings(self.tokenizer)
        self.ranks = rank_encoder(self.tokenizer)
        self.known = Known(self.ranks)

    def pieces(self, text: str) -> list[str]:
        parts = text.split(" ")
        out = [parts[0]] if parts[0] else []
        spaces = ""
        for part in parts[1:]:
            if not part or part[0].isspace():  # a longer run of white space stays with what precedes it
                spaces += " " + part
                continue
            if spaces:
                out = [*out[:-1], out[-1] + spaces] if out else [spaces]
                spaces = ""
            out.append(" " + part)
        if spaces:
            out = [*out[:-1], out[-1] + spaces] if out else [spaces]
        return out

    def chunks(self, text: str) -> list[str]:
        """``pieces``; where every space stands before a visible character, by one split."""
        if WIDE.search(text) or "\0" in text:
            return self.pieces(text)
        return text.replace(" ", "\0 ").split("\0")

    def encode(self, texts: list[str]) -> list[bytes]:
        given = lambda t: array("I", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes()
        whole = [self.ranks is None or (self.special is not None and self.special.search(t)) for t in texts]
        return [given(t) if w else b"".join(map(self.known.__getitem__, self.chunks(t))) for t, w in zip(texts, whole)]


class Shelf:
    """At most ``space`` open windows, found by the room they have left."""

    def __init__(self, size: int, space: int) -> None:
        self.size, self.space = size, space
        self.room: list[tuple[int, int]] = []  # (room left, window), sorted
        self.made = 0

    def place(self, need: int) -> tuple[int, int, int | None]:
        """(window, offset, window closed to make space) for a piece of ``need`` <= size tokens: best fit."""
        at = bisect.bisect_left(self.room, (need, -1))
        closed = None
        if at < len(self.room):
            room, window = self.room.pop(at)
        else:
            if len(self.room) >= self.space:
                closed = self.room.pop(0)[1]  # the fullest
            room, window = self.size, self.made
            self.made += 1
        if room > need:
            bisect.insort(self.room, (room - need, window))
        return window, self.size - room, closed


def _pieces(path: str | None, window: int, space: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shelf = Encoder(path or vocabulary_path()), Shelf(window, space)
        part = TaskContext.get().partitionId()
        end = END.to_bytes(4, "little")
        for batch in slices(batches, 2 << 20):
            ids, texts = rows_of(batch)
            rows: list[tuple] = []
            for doc, data in zip(ids.to_pylist(), encoder.encode([t.decode("utf-8", "replace") for t in texts])):
                data += end
                total = len(data) // 4
                for start in range(0, total, window):
                    length = min(window, total - start)
                    where, offset, _ = shelf.place(length)
                    rows.append((doc, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), total, (part << 32) + where, offset))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], PIECE)
        left = [(None, LEFTOVER, window - room, 0, 0, (part << 32) + where, 0) for room, where in shelf.room]
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*left)], PIECE)

    return run


#: ``start`` of the row that says how full a window was when its partition ended.
LEFTOVER = -1
PIECE = ["id", "start", "length", "crc", "total", "window", "offset"]


def _merge(window: int, space: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf, group, targets = Shelf(window, space), None, {}
        for batch in batches:
            rows: list[tuple] = []
            for g, w, used in zip(*(c.to_pylist() for c in batch.columns)):
                if g != group:
                    shelf, group, targets = Shelf(window, space), g, {}
                where, offset, _ = shelf.place(used)
                rows.append((w, targets.setdefault(where, w), offset))  # a merged window is named after its first part
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 3, ["window", "target", "shift"])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = WINDOW, space: int = OPEN) -> DataFrame:
    """Pieces (id, start, length, crc, total, sequence, offset) of every row of ``docs``.

    A document is its ids and the end id. What exceeds a window is cut into full
    windows; the rest is placed best-fit among ``space`` open windows of its partition,
    and where none has room the fullest is closed and a new one opened. The windows still
    open when their partition ends are its leftovers: those of MERGED partitions, largest
    first, are put together the same way, which shifts offsets but cuts nothing.

    A null or empty text is one piece of one id. Texts of any length are encoded whole,
    one at a time; what a worker remembers is bounded in bytes. Repeated rows each get
    their pieces; an empty table gives an empty result; other columns are not read.
    """
    named = ", ".join(f"{c} long" for c in PIECE)
    pieces = materialize(id_and_text(docs, id_col, text_col).mapInArrow(_pieces(path, window, space), named))
    group = F.floor(F.shiftright(F.col("window"), 32) / MERGED).alias("g")
    loose = pieces.where(F.col("start") == LEFTOVER).select(group, "window", F.col("length").alias("used")).repartition("g").sortWithinPartitions("g", F.desc("used"), "window")
    moves = materialize(loose.mapInArrow(_merge(window, 1 << 20), "window long, target long, shift long"))
    placed = pieces.where(F.col("start") >= 0).join(moves, "window", "left")
    return placed.select(
        "id",
        "start",
        "length",
        "crc",
        "total",
        F.coalesce("target", "window").alias("sequence"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )


def op7_packing(docs: DataFrame) -> DataFrame:
    return pack(docs).select(
        F.col("id").alias("doc_id"),
        "start",
        "length",
        F.col("crc").alias("ids_crc32"),
        F.col("total").alias("doc_tokens"),
        F.col("sequence").alias("sequence_id"),
        "offset",
    )
