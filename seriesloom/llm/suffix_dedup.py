"""Removal of long byte strings that occur more than once, by sharded suffix arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import id_and_text, materialize, rows_of, slices, unused
from seriesloom.llm.suffix_array import repeated_starts

LENGTH, GRAM = 400, 64
#: The pipeline takes out passages of more words than this that repeat; found by strings of so many bytes, about four to a word.
PASSAGE_WORDS, PASSAGE_BYTES, PASSAGE_GRAM = 50, 200, 32
#: Contexts of one anchor that a suffix array takes at most; larger anchors go window by window.
CONTEXTS = 1024
#: Bytes of one shard's suffix array, about.
SHARD = 3 << 18
#: Texts are hashed in parts of about so many bytes, and a position inside them takes so many bits.
PART = 1 << 19
PLACE = np.uint64((1 << (2 * PART).bit_length()) - 1)
BLANKS = frozenset(b" \t\n\v\f\r")
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_RANDOM = np.random.default_rng(400)
_LETTERS = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _RANDOM.integers(0, 1 << 62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """64-bit hashes of all strings of ``gram`` bytes (a power of two) in ``data``, each from two halves."""
    x, size, level = _LETTERS[data], 1, 0
    while size < gram:
        x = x[:-size] * _FACTORS[level] + x[size:]
        size, level = size * 2, level + 1
    x ^= x >> np.uint64(31)
    return x * _FACTORS[level]


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive keys, from running minima of blocks in both directions."""
    n = len(keys)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = keys
    blocks = blocks.reshape(-1, width)
    forth = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], forth[width - 1 : n])


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, anchor, first, last, hash): each ``length``-byte window's anchor is the smallest gram inside it.

    Windows first..last (starts, in bytes of the text) share the anchor at ``anchor``.
    Equal windows have equal anchor hashes at equal distances, so that a window can only
    occur twice if its anchor's hash does.
    """
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    for numbers, offsets, parts in _chunks(texts, length):
        data = np.frombuffer(b"".join(parts), np.uint8)
        if len(data) < length:
            continue
        sizes = np.array([len(p) for p in parts], np.int64)
        begin = np.cumsum(sizes) - sizes
        h = gram_hashes(data, gram)
        # the same bits in every part give way to the position, so that equal windows choose alike wherever they are
        least = window_minima((h & ~PLACE) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
        at = (least & PLACE).astype(np.int64)
        owner = np.repeat(np.arange(len(parts)), sizes)[: len(at)]
        valid = np.arange(len(at)) + length <= (begin + sizes)[owner]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        good = valid[first]
        first, last = first[good], last[good]
        own = owner[first]
        shift = np.array(offsets, np.int64)[own] - begin[own]
        for o, x in zip(out, (np.array(numbers)[own], at[first] + shift, first + shift, last + shift, h[at[first]].astype(np.int64))):
            o.append(x)
    return tuple(np.concatenate(o) if o else np.zeros(0, np.int64) for o in out)


def _chunks(texts: list[bytes], length: int, size: int = PART) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts in groups of about ``size`` bytes; longer ones in parts that overlap by one window less a byte."""
    numbers, offsets, parts, held = [], [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), size):
            part = text[at : at + size + length - 1]
            if held and held + len(part) > 2 * size:
                yield numbers, offsets, parts
                numbers, offsets, parts, held = [], [], [], 0
            numbers.append(i)
            offsets.append(at)
            parts.append(part)
            held += len(part)
    if parts:
        yield numbers, offsets, parts


def _scan(length: int, gram: int):
    """Per row: id, size, digest, words and anchor hashes, each at most twice (one place in a text or several)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, texts = rows_of(batch)
            text, _, _, _, h = anchors(texts, length, gram)
            order = np.lexsort((h, text))
            text, h = text[order], h[order]
            third = np.zeros(len(h), bool)
            third[2:] = (h[2:] == h[:-2]) & (text[2:] == text[:-2])
            text, h = text[~third], h[~third]
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(texts) + 1)), pa.int32()), pa.array(h, pa.int64()))
            shas = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            words = pa.array([len(t.split()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(map(len, texts), pa.int64()), shas, words, lists], ["id", "n_bytes", "sha", "words", "anchors"])

    return run


def _packed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches):
            ids, texts = rows_of(batch)
            long = [i for i, t in enumerate(texts) if len(t) >= length]
            shas = pa.array([hashlib.sha256(texts[i]).digest() for i in long], pa.binary())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(long, pa.int64())), shas, pa.array([tool.compress(texts[i]) for i in long], pa.binary())], ["id", "sha", "z"])

    return run


def _contexts(length: int, gram: int):
    """Of each text, the windows under each anchor that is shared with another place, as one context.

    A context that a text holds several times comes once; its windows repeat in that text
    already, and come as runs without context, merged where they touch, so that a text of
    one repeated letter gives few rows.
    """
    names, kinds = ["h", "context", "sha", "start", "stop"], (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdDecompressor()
        for batch in slices(batches, 1 << 20):
            shas, packed, shared = (c.to_pylist() for c in batch.columns)
            texts = [tool.decompress(z) for z in packed]
            text, _, first, last, h = anchors(texts, length, gram)
            cut = np.searchsorted(text, np.arange(len(texts) + 1))
            out: list[tuple] = []
            for i, t in enumerate(texts):
                a, b, own = (x[cut[i] : cut[i + 1]] for x in (first, last, h))
                seen: dict[tuple[int, bytes], tuple[int, int]] = {}
                again = []
                for j in np.flatnonzero(np.isin(own, np.array(shared[i], np.int64))).tolist():
                    start, stop = int(a[j]), int(b[j]) + length
                    key = (int(own[j]), hashlib.md5(t[start:stop]).digest())
                    if key in seen:
                        again += [(start, stop), seen[key]]
                    else:
                        seen[key] = (start, stop)
                        out.append((*key, shas[i], start, stop))
                out += [(None, None, shas[i], start, stop) for start, stop in merge([(x, y - length) for x, y in again], length)]
                while len(out) >= 8192:
                    yield _record(out[:8192], names, kinds)
                    del out[:8192]
            if out:
                yield _record(out, names, kinds)

    return run


def _record(rows: list[tuple], names: list[str], kinds: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tool = zstandard.ZstdDecompressor()
    for batch in slices(batches, 1 << 20):
        rows = []
        for z, wanted in zip(*(c.to_pylist() for c in batch.columns)):
            text = tool.decompress(z)
            rows += [(x["h"], x["context"], x["hot"], text[x["start"] : x["stop"]]) for x in wanted]
        for at in range(0, len(rows), 4096):
            h, context, hot, text = zip(*rows[at : at + 4096])
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(context, pa.binary()), pa.array(hot, pa.bool_()), pa.array(text, pa.binary())], ["h", "context", "hot", "text"])


def _runs(starts: np.ndarray) -> tuple[list[int], list[int]]:
    """Runs of consecutive starts as (first, last)."""
    if not len(starts):
        return [], []
    edge = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.append(0, edge + 1)].tolist(), starts[np.append(edge, len(starts) - 1)].tolist()


def _shard_arrays(length: int):
    """Rows sorted by anchor: whole anchors are joined to shards, and each shard gets its suffix array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[tuple[int, bytes]] = []
        texts: list[bytes] = []
        held = 0
        for batch in batches:
            for h, context, text in zip(*(c.to_pylist() for c in batch.columns)):
                if held >= SHARD and h != keys[-1][0]:
                    yield _found(keys, repeated_starts(texts, length))
                    keys, texts, held = [], [], 0
                keys.append((h, context))
                texts.append(text)
                held += len(text)
        if texts:
            yield _found(keys, repeated_starts(texts, length))

    return run


def _found(keys: list[tuple[int, bytes]], starts: list[np.ndarray]) -> pa.RecordBatch:
    rows = [(h, c, a, b) for (h, c), x in zip(keys, starts) for a, b in zip(*_runs(x))]
    h, c, a, b = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(c, pa.binary()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["h", "context", "first", "last"])


def _windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 16):
            for h, context, text in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(text) - length + 1
                digests = [hashlib.md5(text[i : i + length]).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([h] * n, pa.int64()), pa.array([context] * n, pa.binary()), pa.array(range(n), pa.int64()), pa.array(digests, pa.binary())], ["h", "context", "first", "window"])

    return run


def _hot(texts: DataFrame, length: int) -> DataFrame:
    """Repeated starts of anchors with more contexts than one shard may hold: windows counted by their digests.

    Counts are combined before they are shuffled, and a window that all contexts share is
    one group of counts, so that no task holds the anchor's texts.
    """
    windows = materialize(texts.mapInArrow(_windows(length), "h long, context binary, first long, window binary"))
    twice = windows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    # a context has no more windows than an anchor reaches, about ``length``; neighbours become one run
    starts = windows.join(twice, "window", "left_semi").groupBy("h", "context").agg(F.array_sort(F.collect_list("first")).alias("at"))
    firsts, lasts = F.array_except("at", F.transform("at", lambda x: x + 1)), F.array_except("at", F.transform("at", lambda x: x - 1))
    runs = starts.select("h", "context", F.explode(F.arrays_zip(firsts.alias("first"), lasts.alias("last"))).alias("run"))
    return runs.select("h", "context", "run.first", "run.last")


def _strip(length: int, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdDecompressor()
        for batch in slices(batches, 1 << 20):
            out: list[list] = [[], [], [], []]
            for sha, z, found in zip(*(c.to_pylist() for c in batch.columns)):
                text = tool.decompress(z)
                spans = merge([(x["first"], x["last"]) for x in found], length)
                if least_words:
                    spans = whole_words(text, spans, least_words)
                out[0].append(sha)
                out[1].append([{"start": a, "stop": b} for a, b in spans])
                out[2].append(sum(b - a for a, b in spans))
                out[3].append(hashlib.sha256(keep(text, spans)).hexdigest())
            kinds = (pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["sha", "spans", "n_removed", "kept_sha256"])

    return run


def merge(runs: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal byte spans covered by windows that start in any of the runs."""
    spans: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], b + length))
        else:
            spans.append((a, b + length))
    return spans


def whole_words(text: bytes, spans: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """The spans cut back to the words that lie in them as a whole, where these are ``least`` or more."""
    out = []
    for a, b in spans:
        if 0 < a < b and text[a - 1] not in BLANKS:
            while a < b and text[a] not in BLANKS:
                a += 1
        if a < b < len(text) and text[b] not in BLANKS:
            while a < b and text[b - 1] not in BLANKS:
                b -= 1
        if len(text[a:b].split()) >= least:
            out.append((a, b))
    return out


def keep(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, least_words: int = 0, gram: int = GRAM) -> DataFrame:
    """Per row of ``docs``: id, n_bytes, sha, spans (start, stop in bytes), n_removed, n_spans, kept_sha256.

    A byte is in a span if a string of ``length`` bytes around it also starts anywhere
    else, in any document or the same one. With ``least_words`` a span is cut back to
    whole words and counts only if it still has so many. Null texts are empty; texts
    shorter than ``length`` have no spans; texts that several rows share are repeated as a
    whole; repeated rows each get a row. An empty table gives an empty result. Other
    columns are not read.

    Steps: (1) one scan gives each text's digest and anchor hashes; (2) equal texts
    become one; (3) windows whose anchor is found at one place only are out; (4) the
    rest, as contexts of up to 2 * ``length`` bytes, is merged by content, and an anchor's
    different contexts meet in one shard, of which a suffix array by induced sorting and
    permuted common prefixes tell the repeated windows; (5) windows return to their texts
    as spans. Texts travel once, compressed; contexts that many documents share travel
    once.
    """
    scan = _scan(length, gram)
    scanned = materialize(id_and_text(docs, id_col, text_col).mapInArrow(scan, "id long, n_bytes long, sha binary, words long, anchors array<long>"))
    distinct = scanned.groupBy("sha").agg(
        F.count("*").alias("copies"), F.min("id").alias("least"), F.first("n_bytes").alias("n_bytes"), F.first("words").alias("words"), F.first("anchors").alias("anchors")
    )
    distinct = materialize(distinct)
    places = distinct.select("sha", "least", F.explode("anchors").alias("h"))
    shared = materialize(places.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    by_text = places.join(shared, "h", "left_semi").groupBy("sha").agg(F.first("least").alias("least"), F.collect_set("h").alias("shared"))
    by_text = materialize(by_text)  # so that the next join shuffles both sides and a text of many rows can be split
    packed = id_and_text(docs, id_col, text_col).mapInArrow(_packed(length), "id long, sha binary, z binary")
    texts = packed.join(by_text, "sha").where(F.col("id").eqNullSafe(F.col("least")))
    texts = materialize(texts.select("sha", "z", "shared"))
    found = materialize(texts.mapInArrow(_contexts(length, gram), "h long, context binary, sha binary, start long, stop long"))
    own = found.where("context IS NULL").select("sha", F.struct(F.col("start").alias("first"), (F.col("stop") - length).alias("last")).alias("run"))
    found = found.where("context IS NOT NULL")
    contexts = found.groupBy("h", "context").agg(F.count("*").alias("n"), F.min(F.struct("sha", "start", "stop")).alias("at"))
    contexts = materialize(contexts)
    groups = materialize(contexts.groupBy("h").agg(F.count("*").alias("d")).where("d > 1"))
    wanted = contexts.join(groups, "h").select("h", "context", (F.col("d") > CONTEXTS).alias("hot"), "at.*")
    lists = wanted.groupBy("sha").agg(F.collect_list(F.struct("h", "context", "hot", "start", "stop")).alias("wanted"))
    cut = texts.join(lists, "sha").select("z", "wanted").mapInArrow(_cut_out, "h long, context binary, hot boolean, text binary")
    hot = not groups.where(F.col("d") > CONTEXTS).isEmpty()
    if hot:
        cut = materialize(cut)
    calm = cut.where("NOT hot").select("h", "context", "text").repartition("h").sortWithinPartitions("h")
    runs = calm.mapInArrow(_shard_arrays(length), "h long, context binary, first long, last long")
    if hot:
        runs = runs.unionByName(_hot(cut.where("hot").select("h", "context", "text"), length))
    whole = contexts.where("n > 1").select("h", "context", F.lit(0).cast("long").alias("first"), (F.col("at.stop") - F.col("at.start") - length).alias("last"))
    runs = materialize(runs.unionByName(whole))
    met = found.join(runs, ["h", "context"]).select(
        "sha", F.struct((F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last")).alias("run")
    )
    spans = met.unionByName(own).groupBy("sha").agg(F.collect_set("run").alias("found"))
    schema = "sha binary, spans array<struct<start: long, stop: long>>, n_removed long, kept_sha256 string"
    stripped = texts.join(spans, "sha").select("sha", "z", "found").mapInArrow(_strip(length, least_words), schema)
    copied = distinct.where((F.col("copies") > 1) & (F.col("n_bytes") >= length) & (F.col("words") >= least_words))
    copied = copied.select(F.col("sha"), F.lit(True).alias("copied"))
    # a text of several rows goes as a whole, whatever its own spans
    known = stripped.join(copied.select("sha"), "sha", "left_anti").withColumn("copied", F.lit(False))
    gone = copied.select("sha", "copied", F.lit(EMPTY_SHA).alias("kept_sha256"))
    known = materialize(known.unionByName(gone, allowMissingColumns=True))
    rows = scanned.select("id", "n_bytes", "sha").join(known, "sha", "left")
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    copied = F.coalesce("copied", F.lit(False))
    spans = F.when(copied, all_of_it).otherwise(F.coalesce("spans", F.filter(all_of_it, lambda _: F.lit(False))))
    return rows.select(
        "id",
        "n_bytes",
        "sha",
        spans.alias("spans"),
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.size(spans).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", F.lower(F.hex("sha"))).alias("kept_sha256"),
    )


def op3_suffix_dedup(docs: DataFrame) -> DataFrame:
    return repeated_spans(docs).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame) -> DataFrame:
    """Pipeline stage: every document without its repeated passages of over PASSAGE_WORDS words; ``n_chars`` is counted anew.

    Such a passage also stands elsewhere byte by byte, and has PASSAGE_BYTES bytes or more
    (``op3_suffix_dedup``'s 400 bytes are for its own query alone: they are over 60 words
    of common prose). Documents of which nothing but white space is left go; null texts
    and empty ones stay. Cuts lie between words. Whole texts count, however long; a text
    that several rows share loses all of itself; an empty table gives an empty one, and
    columns may have any names.
    """
    spans = repeated_spans(docs, length=PASSAGE_BYTES, least_words=PASSAGE_WORDS + 1, gram=PASSAGE_GRAM).where("n_removed > 0").select("sha", "spans")
    own_sha, own_spans = unused(docs, "own_sha"), unused(docs, "own_spans")
    spans = spans.groupBy(F.col("sha").alias(own_sha)).agg(F.first("spans").alias(own_spans))
    joined = docs.withColumn(own_sha, F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))).join(spans, own_sha, "left")
    names = docs.columns
    text_at, spans_at = names.index("text"), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns, texts, stay = list(batch.columns[: len(names)]), [], []
            for text, own in zip(batch.column(text_at).to_pylist(), batch.column(spans_at).to_pylist()):
                if own:
                    text = keep(text.encode(), [(x["start"], x["stop"]) for x in own]).decode("utf-8", "ignore")
                texts.append(text)
                stay.append(not own or bool(text.strip()))
            columns[text_at] = pa.array(texts, pa.string())
            if "n_chars" in names:
                columns[names.index("n_chars")] = pa.array([None if t is None else len(t) for t in texts]).cast(batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(stay, pa.bool_()))

    return joined.select(*names, own_spans).mapInArrow(run, docs.schema)
