"""Preference formatting: shared prompt once, then paired masked completions; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.ranks import running_before
from seriesloom.llm.common import materialize

PARTS = ("prompt", "chosen", "rejected")


def render(turn: Column) -> Column:
    """One turn (turn, role, text) as text, between role marks."""
    return F.concat(F.lit("<|"), turn.role, F.lit("|>\n"), turn.text, F.lit("\n"))


def conversations_of(turns: DataFrame, id_col: str) -> DataFrame:
    """(pair_id, turns): the different turns of each id in the order of (turn, role, text).

    Rows with a null id or turn take no part; a null role or text is an empty one.
    Repeated turns are dropped before they are shuffled.
    """
    none = F.lit("")
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), none).alias("role"), F.coalesce(F.col("text").cast("string"), none).alias("text"))
    rows = turns.where(F.col(id_col).isNotNull() & F.col("turn").isNotNull()).select(F.col(id_col).cast("long").alias("pair_id"), turn.alias("t"))
    return rows.groupBy("pair_id").agg(F.array_sort(F.collect_set("t")).alias("turns"))


def paired(sides: DataFrame) -> DataFrame:
    """One row per row of ``sides`` (pair_id, c, r: the turns of both sides, sorted and each once): its prompt and completions.

    The longest common prefix of the turns is rendered once, as ``prompt``; what follows
    it as ``chosen`` and ``rejected``. For these, ``_mask`` has 1 per assistant turn (it
    counts for the loss) and 0 per other turn, and ``_chars`` the characters of each
    rendered turn, so that masks can be laid over the text.
    """
    same = F.zip_with("c", "r", lambda a, b: F.coalesce(a == b, F.lit(False)))
    first = F.array_position(same, F.lit(False)).cast("int")  # 0 where the sides are equal
    rows = sides.withColumn("shared", F.when(first == 0, F.size("c")).otherwise(first - 1))
    rest = lambda c: F.slice(c, F.col("shared") + 1, F.greatest(F.size(c) - F.col("shared"), F.lit(0)))
    rows = rows.select("pair_id", F.slice("c", F.lit(1), F.col("shared")).alias("prompt"), rest("c").alias("chosen"), rest("r").alias("rejected"))
    out = [F.array_join(F.transform(p, render), "").alias(p) for p in PARTS]
    for p in PARTS[1:]:
        out += [F.transform(p, lambda t: (t.role == "assistant").cast("int")).alias(f"{p}_mask"), F.transform(p, lambda t: F.char_length(render(t))).alias(f"{p}_chars")]
    return rows.select("pair_id", *out)


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row per pair of two turn tables (pair_id, turn, role, text): pair_id and the columns of ``paired``.

    Turns of a side stand in the order of (turn, role, text); turns repeated in full count
    once, a null role or text is an empty one. A side that is missing altogether leaves
    all turns of the other as its completion; equal sides leave only a prompt. Rows with a
    null pair_id or turn take no part. A pair is one row however many turns it has, and
    texts are rendered whole, however long; the row takes what its own texts take. Empty
    tables give an empty result. Other columns are not read, whatever their names.
    """
    c, r = conversations_of(chosen, "pair_id").withColumnRenamed("turns", "c"), conversations_of(rejected, "pair_id").withColumnRenamed("turns", "r")
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    return paired(c.join(r, "pair_id", "full").select("pair_id", F.coalesce("c", none).alias("c"), F.coalesce("r", none).alias("r")))


def swapped_replies(conversations: DataFrame) -> DataFrame:
    """(pair_id, c, r) from plain conversations (conv_id, turn, role, text), for ``paired``.

    Chosen is the conversation as it is; rejected is the same with its last assistant
    reply replaced by that of the next id that has a reply, and after the last id by that
    of the first. Turns after the last reply stand in both. A conversation without a
    reply is equal on both sides. Nulls and repeated rows as in ``format_preferences``.
    """
    talks = materialize(conversations_of(conversations, "conv_id"))
    said = F.filter("turns", lambda t: t.role == "assistant")
    last = F.try_element_at(said, F.lit(-1))  # of several at one turn the largest text
    ids = running_before(talks.where(F.size(said) > 0).select("pair_id"), [F.col("pair_id")], {"place": F.lit(1)})
    n = ids.count()
    following = ids.select("pair_id", F.pmod(F.col("place") + 1, F.lit(max(n, 1))).alias("place")).join(ids.select(F.col("pair_id").alias("next_id"), "place"), "place")
    replies = talks.where(F.size(said) > 0).select(F.col("pair_id").alias("next_id"), last.text.alias("other"))
    other = replies.join(following.select("pair_id", "next_id"), "next_id").select("pair_id", "other")
    swap = lambda t: F.when((t.turn == last.turn) & (t.role == "assistant"), F.struct(t.turn.alias("turn"), t.role.alias("role"), F.col("other").alias("text"))).otherwise(t)
    swapped = F.when(F.col("other").isNull(), F.col("turns")).otherwise(F.array_sort(F.array_distinct(F.transform("turns", swap))))
    return talks.join(other, "pair_id", "left").select("pair_id", F.col("turns").alias("c"), swapped.alias("r"))


def op10_chat(conversations: DataFrame) -> DataFrame:
    """One row per conversation (see ``paired``); the lists of masks and lengths are joined to texts."""
    rows = paired(swapped_replies(conversations))
    joined = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in rows.columns if c.endswith(("_mask", "_chars"))]
    return rows.select("pair_id", *PARTS, *joined)
