"""Chat messages rendered to the prompt text a backend expects.

Every renderer takes an array<struct<role, content>> column.  ``closing`` is a
Column or bool: False for a part of a long conversation that is not its last.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from markbook import fixed_values as fixed


def _join(messages: Column, piece) -> Column:
    return F.array_join(F.transform(messages, piece), "")


def _end(token: Column, closing) -> Column:
    return F.when(closing if isinstance(closing, Column) else F.lit(closing), token).otherwise("")


def literal_tokens(tokens: dict[str, str] | None = None) -> dict[str, Column]:
    return {name: F.lit(value) for name, value in (tokens or fixed.CHATML_TOKENS).items()}


def column_tokens(tokens: Column) -> dict[str, Column]:
    """Role tokens of a template row (a struct column)."""
    return {name: tokens[f"{name}_token"] for name in ("system", "user", "assistant", "end")}


def render_chat(messages: Column, tokens: dict[str, Column] | None = None, closing=True) -> Column:
    """Role token, content, end token per message; then the assistant token."""
    t = tokens or literal_tokens()
    text = _join(
        messages,
        lambda m: F.when(
            m["role"].isin("system", "user", "assistant"),
            F.concat(
                F.when(m["role"] == "system", t["system"]).when(m["role"] == "user", t["user"]).otherwise(t["assistant"]),
                m["content"],
                t["end"],
            ),
        ).otherwise(""),
    )
    return F.concat(text, _end(t["assistant"], closing))


def render_turns(messages: Column, human: str = fixed.TURN_MARKERS["human"], ai: str = fixed.TURN_MARKERS["ai"], closing=True) -> Column:
    """Human/AI transcript; a system message counts as a human turn."""
    text = _join(
        messages,
        lambda m: F.when(m["role"].isin("system", "user"), F.concat(F.lit(human + " "), m["content"]))
        .when(m["role"] == "assistant", F.concat(F.lit(ai + " "), m["content"]))
        .otherwise(""),
    )
    return F.concat(text, _end(F.lit(ai), closing))


def render_lines(messages: Column) -> Column:
    """Contents, one per line."""
    return _join(messages, lambda m: F.concat(m["content"], F.lit("\n")))


def render_segments(messages: Column) -> Column:
    """Array of segments; a user turn directly after a system one joins its segment."""

    def piece(m):
        cue = F.when(m["role"] == "user", F.lit(fixed.SEGMENT_CUE)).otherwise("")
        return F.concat(cue, m["content"], F.lit("\n"))

    # A segment has at most two messages, so each one sees its whole segment from
    # its own neighbours and no running state is needed.
    def segment(m, i):
        follower = F.get(messages, i + 1)
        merges = (m["role"] == "system") & F.coalesce(follower["role"] == "user", F.lit(False))
        merged = (m["role"] == "user") & F.coalesce(F.get(messages, i - 1)["role"] == "system", F.lit(False))
        starts = m["role"].isin("system", "user", "assistant") & ~merged
        return F.when(starts, F.concat(piece(m), F.when(merges, piece(follower)).otherwise("")))

    return F.filter(F.transform(messages, segment), lambda s: s.isNotNull())


def render_pairs(pairs: Column) -> Column:
    """(query, answer) pairs as alternating text, for logging or comparing."""
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["query"], p["answer"])), "")
