"""Prompt blocks: one question row as text, as chat messages, or as a query/answer pair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from markbook import fixed_values as fixed
from markbook.functions.extract import CHOICES


def fill(template: str, **columns: Column) -> Column:
    """A wording with ``{name}`` places filled from columns; null fields as empty text."""
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before)] * bool(before) + [F.coalesce(columns[name], F.lit(""))]
    return F.concat(*parts, *[F.lit(rest)] * bool(rest))


def system_header(subject: Column, direct: bool = False) -> Column:
    return fill(fixed.SYSTEM_HEADER_DIRECT if direct else fixed.SYSTEM_HEADER, subject=subject)


def user_header(subject: Column, direct: bool = False) -> Column:
    return fill(fixed.USER_HEADER_DIRECT if direct else fixed.USER_HEADER, subject=subject)


def _options(choices: Sequence[str], before: str, after: str) -> list[Column]:
    """One line per answer letter."""
    return [F.concat(F.lit(f"{before}{c}. "), F.coalesce(F.col(c), F.lit("")), F.lit(after)) for c in choices]


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def worked_answer(ending: str) -> Column:
    """A worked solution: opener, the row's explanation, the closing sentence."""
    return F.concat(
        fill(fixed.STEPS_CUE + "{explanation}\n" + fixed.WORKED_END, explanation=F.col("explanation"), answer=F.col("answer")),
        F.lit(ending),
    )


def question_block(choices: Sequence[str] = CHOICES) -> Column:
    """Question, one line per option, answer cue."""
    return F.concat(F.col("question"), *_options(choices, "\n", ""), F.lit("\n" + fixed.ANSWER_CUE))


def exemplar_block(choices: Sequence[str] = CHOICES) -> Column:
    """The same with its answer and a blank line."""
    return F.concat(question_block(choices), F.col("answer"), F.lit("\n\n"))


def exemplar_messages(choices: Sequence[str] = CHOICES, cot: bool = False) -> Column:
    """A worked example as a user and an assistant message."""
    reply = worked_answer("") if cot else F.col("answer")
    return F.array(message("user", question_block(choices)), message("assistant", reply))


def question_messages(choices: Sequence[str] = CHOICES) -> Column:
    return F.array(message("user", question_block(choices)))


def base_block(choices: Sequence[str] = CHOICES, answered: bool = False, cot: bool = False) -> Column:
    """Block for base models; the answer cue comes twice except in worked examples."""
    stem = F.concat(F.lit(fixed.QUESTION_CUE), F.col("question"), *_options(choices, "\n", ""), F.lit("\n" + fixed.ANSWER_CUE))
    if answered and cot:
        return F.concat(stem, worked_answer("\n\n"))
    if answered:
        return F.concat(stem, F.lit("\n" + fixed.ANSWER_CUE), F.col("answer"), F.lit("\n\n"))
    return F.concat(stem, F.lit("\n" + fixed.ANSWER_CUE + (fixed.STEPS_CUE if cot else "")))


def history_query(choices: Sequence[str] = CHOICES) -> Column:
    """Block for chat-history models: a blank line, then each option on its own line."""
    return F.concat(
        F.lit(fixed.QUESTION_CUE), F.col("question"), F.lit("\n\n"), *_options(choices, "", "\n"), F.lit("\n" + fixed.ANSWER_CUE)
    )


def history_pair(choices: Sequence[str] = CHOICES, cot: bool = False) -> Column:
    """A worked example as a (query, answer) pair."""
    reply = worked_answer("\n\n") if cot else F.concat(F.lit("\n" + fixed.ANSWER_CUE), F.col("answer"), F.lit("\n\n"))
    return F.struct(history_query(choices).alias("query"), reply.alias("answer"))


def instruct_block(
    choices: Sequence[str] = CHOICES,
    answered: bool = False,
    cot: bool = False,
    with_prompt: bool = False,
    compat: bool = False,
) -> Column:
    """Block for instruction models.

    A worked example carries its explanation; ``compat`` gives the bare stem
    instead, as older runs did.
    """
    stem = F.concat(
        F.lit(fixed.QUESTION_CUE), F.col("question"), F.lit("\n\n"), *_options(choices, "\n", ""), F.lit("\n" + fixed.ANSWER_CUE)
    )
    if answered and cot:
        return stem if compat else F.concat(stem, worked_answer("\n\n"))
    if answered:
        return F.concat(stem, F.lit("\n" + fixed.ANSWER_CUE), F.col("answer"), F.lit("\n\n"))
    if not cot:
        return F.concat(stem, F.lit("\n" + fixed.ANSWER_CUE))
    return F.concat(stem, F.lit("\n" + (fixed.INSTRUCT_STEPS_PROMPTED if with_prompt else fixed.INSTRUCT_STEPS)))


def instruct_wrap(block: Column) -> Column:
    return F.concat(F.lit("[INST] "), block, F.lit(" [/INST]"))


def instruct_exemplar(choices: Sequence[str] = CHOICES) -> Column:
    """A worked example inside an instruction transcript."""
    return F.concat(
        F.lit("[INST] "), F.col("question"), *_options(choices, "\n", ""),
        F.lit("\n" + fixed.ANSWER_CUE + " [/INST]"), F.col("answer"), F.lit("\n"),
    )


def instruct_opening(subject: Column) -> Column:
    return fill(fixed.INSTRUCT_OPENING, subject=subject)


def judge_prompt(response: Column, choices: Sequence[str] = CHOICES, unknown: bool = False) -> Column:
    """Request to a judge model for exactly one label."""
    labels = ", ".join(choices) + (" or unknown" if unknown else "")
    ask = (
        f"Read the RESPONSE below and name its final answer with exactly one of these labels: {labels}. "
        "Give the label alone, without brackets or line breaks.\nRESPONSE: "
    )
    return F.concat(F.lit(ask), F.coalesce(response, F.lit("")))
