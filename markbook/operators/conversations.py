"""Message lists out of a table of turns, whole or in parts, and prompts out of parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_messages(turns: DataFrame, key: str, order: str, role: str = "role", content: str = "text") -> DataFrame:
    """(key, messages): every conversation as one array in order, ready to be rendered.

    One exchange, and nothing is collected twice.  The array is no larger than the prompt made from
    it, which is one cell; turns without a place come first, equal places are ordered by role and
    content, and turns without a key are one conversation.
    """
    turn = F.struct(F.col(order), F.col(role).alias("role"), F.col(content).alias("content"))
    listed = turns.groupBy(key).agg(F.array_sort(F.collect_list(turn)).alias("_turns"))
    return listed.select(key, F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))


def message_parts(turns: DataFrame, key: str, order: str, role: str = "role", content: str = "text", part_turns: int = 1024) -> DataFrame:
    """(key, part, messages, role_before, is_last): the turns as arrays in order.

    For conversations whose prompt is to be written piece by piece.  One of up to ``part_turns``
    turns is one part; a longer one has its turns in several parts, all kept.  ``role_before``
    and ``is_last`` let a renderer join the parts without a seam.
    """
    # A struct key is never null, so the join below keeps turns without a key; turns without
    # a place come before all others, as in any ascending order.
    part = F.coalesce(F.floor(F.col(order) / part_turns), F.lit(-(2**62)))
    rows = turns.withColumn("_at", F.struct(F.col(key).alias("key"), part.alias("part")))
    arrays = rows.groupBy("_at").agg(
        F.array_sort(F.collect_list(F.struct(F.col(order), F.col(role).alias("role"), F.col(content).alias("content")))).alias("_t")
    )
    # Seams from the roles alone: no message text takes part in this window.
    ends = rows.groupBy("_at").agg(F.max_by(role, order).alias("_role"))
    along = Window.partitionBy(F.col("_at")["key"]).orderBy(F.col("_at")["part"])
    seams = ends.select(
        "_at",
        F.lag("_role").over(along).alias("role_before"),
        F.lead("_at").over(along).isNull().alias("is_last"),
    )
    return arrays.join(seams, "_at").select(
        F.col("_at")["key"].alias(key),
        F.col("_at")["part"].alias("part"),
        F.transform("_t", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"),
        "role_before",
        "is_last",
    )


def whole_prompts(parts: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, prompt): the rendered text of all parts of a conversation in one cell, in their order."""
    pieces = F.array_sort(F.collect_list(F.struct("part", text.alias("text"))))
    joined = F.array_join(F.transform(pieces, lambda p: p["text"]), "")
    return parts.select(key, "part", "messages", "role_before", "is_last").groupBy(key).agg(joined.alias("prompt"))
