"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesloom.functions.ranks import running_before
from seriesloom.llm.common import WORD, materialize, row_key, unused

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: No document is taken more often.
MOST = 3
#: Slices of a source's key range; only the slice in which the budget ends is sorted.
SLICES = 4096


def text_quality() -> Column:
    """A weight above 0 and at most 1: the share of words left after taking symbols off; 1 for a text without words."""
    symbols = F.regexp_count("text", F.lit("[#*$%&|<>]"))
    return F.greatest(F.lit(0.05), F.lit(1.0) - F.coalesce(symbols / F.greatest(F.col("size"), F.lit(1)), F.lit(0.0)))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) -> target of each source, with as many rows as there are sources.

    The whole size is shared out by weight; a source that would get more than ``most``
    times its size stops there and the rest is shared again. Sorted by the ratio of
    limit to weight, the sources that stop are a prefix, so that running sums replace
    the rounds. The sums run over ranges of the sources, however many there are. Products
    of sizes and weights are exact: decimals where two long sums meet, long where a weight
    meets one, for Spark takes a literal under 2^31 as an int.
    """
    listed = F.array([F.lit(w) for w in weights])
    shares = running_before(sizes, [F.col("source").asc_nulls_last()], {"place": F.lit(1)})
    shares = shares.withColumn("w", F.element_at(listed, (F.col("place") % len(weights) + 1).cast("int"))).withColumn("limit", F.col("source_size") * most)
    shares = materialize(shares.withColumn("ratio", F.col("limit") / F.col("w")))
    whole = shares.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("w"), F.lit(0)).alias("w")).first()
    rest = running_before(shares, [F.col("ratio").asc(), F.col("place").asc()], {"stopped": F.col("limit"), "stopped_w": F.col("w")})
    rest = rest.withColumn("left", F.lit(whole.size) - F.col("stopped")).withColumn("left_w", F.lit(whole.w) - F.col("stopped_w"))
    exact = {c: F.col(c).cast("decimal(19,0)") for c in ("limit", "left_w", "left", "w")}
    stops = exact["limit"] * exact["left_w"] <= exact["left"] * exact["w"]
    at = rest.where(~stops).agg(F.min(F.struct("ratio", "place", "left", "left_w")).alias("at")).first().at  # the first that does not stop
    target = F.col("limit").cast("double")
    if at is not None:
        before = (F.col("ratio") < at.ratio) | ((F.col("ratio") == at.ratio) & (F.col("place") < at.place))
        target = F.when(before, target).otherwise(F.lit(at.left).cast("long") * F.col("w") / F.lit(at.left_w))
    return rest.select("source", "source_size", target.alias("target"))


def draw_key(id_col: str, text_col: str, weight: Column, seed: str = "mix") -> Column:
    """Exponential key -ln(u) / weight with u from the MD5 of id and text: small keys come first, and reruns agree.

    The text is in it so that rows without ids, or with one id, spread over all keys.
    """
    none = F.lit("null")
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), none), F.lit("|"), F.coalesce(F.col(text_col), none)).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return -F.ln(u) / weight


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None, row: Column | None = None) -> DataFrame:
    """Per row of ``docs``: id, source, size, source_size, target and taken (words the mix takes, repeats counted).

    ``row`` is carried along as a column of that name, to tell rows with equal ids apart;
    it also orders those of one size.

    A source takes ``floor(target / source_size)`` complete epochs of all its documents;
    the rest of its target is filled by documents in the order of their exponential keys
    (weighted sampling without replacement), and the last one contributes only the words
    still missing. Null texts and texts without words have size 0 and are taken 0 times.
    The null source is a source of its own, the last one. Repeated rows each count; rows
    with equal id and text share a key, and have one size.

    Nothing sorts a whole source: keys fall into SLICES ranges, sums per range decide
    which are taken whole, and only the range in which the budget ends is ordered.
    """
    sized = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.col(text_col).cast("string").alias("text"),
        *([] if row is None else [row.alias("row")]),
    )
    own = ["id", "source", "size"] if row is None else ["id", "source", "size", "row"]
    key = draw_key("id", "text", text_quality() if weight is None else weight)
    rows = sized.select(*own, key.alias("key"))
    rows = materialize(rows.withColumn("slice", F.floor(F.col("key") / (F.col("key") + 1.0) * SLICES).cast("int")))
    cells = rows.groupBy("source", "slice").agg(F.sum("size").alias("cell"))
    sums = cells.groupBy("source").agg(F.sum("cell").alias("source_size"))
    targets = source_targets(sums)
    cells = cells.withColumnRenamed("source", "cell_source").join(targets, F.col("cell_source").eqNullSafe(F.col("source")))
    running = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    epochs = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    cells = cells.select(
        F.col("cell_source"),
        F.col("slice").alias("cell_slice"),
        "cell",
        "source_size",
        "target",
        epochs.alias("epochs"),
        F.coalesce(F.sum("cell").over(running), F.lit(0)).alias("before"),
    ).withColumn("budget", F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 1e-6).cast("long"))
    placed = rows.join(cells, F.col("source").eqNullSafe(F.col("cell_source")) & (F.col("slice") == F.col("cell_slice")))
    ends_here = (F.col("before") < F.col("budget")) & (F.col("before") + F.col("cell") > F.col("budget"))
    whole = placed.where(~ends_here).withColumn("part", F.when(F.col("before") < F.col("budget"), F.col("size")).otherwise(0))
    order = W.partitionBy("source").orderBy("key", "id", "size", *own[3:]).rowsBetween(W.unboundedPreceding, -1)
    at = F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    last = placed.where(ends_here).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - at)))
    out = [*own, "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken")]
    return whole.select(*out).unionByName(last.select(*out))


def op9_mixing(docs: DataFrame) -> DataFrame:
    return mix(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """Pipeline stage: the rows of ``docs``, each as often as the mix takes it (half a text or more rounds up).

    Documents without words have nothing to take and go; a null doc_id or one of several
    rows is no reason to. Times belong to the row, told apart by ``row_key``: rows alike
    in every column are one row that comes as often as all of them are taken. Whole texts
    count, however long; an empty table gives an empty one; columns may have any names.
    """
    times = mix(docs, row=row_key(docs)).where("taken > 0")
    own, often, several, copy = (unused(docs, c) for c in ("_row", "_times", "_rows", "_copy"))
    times = times.select(F.col("row").alias(own), F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("times"))
    times = materialize(times.groupBy(own).agg(F.sum("times").cast("int").alias(often), F.count("*").alias(several)).where(F.col(often) > 0))
    keyed = docs.withColumn(own, row_key(docs))
    if not times.where(F.col(several) > 1).isEmpty():
        keyed = keyed.dropDuplicates([own])
    kept = keyed.join(times, own)
    return kept.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(often)))).select(docs.columns)
