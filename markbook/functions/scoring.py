"""Scoring policies: extracted answer and gold answer to a 0/1 correctness column.

The policies share one shape: ``marks`` adds the columns ``extracted`` (what the
policy read out of the response) and ``correctness``.  Extraction is written once
per row and the policies differ only in cheap comparisons around it.  A row
without a gold answer gets a null correctness and is not counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markbook import fixed_values as fixed
from markbook.functions import extract, scores
from markbook.functions.text import Script, exact_match, strip, text_or_empty

POLICIES = ("zero_shot", "few_shot", "exact_only", "cot", "judge")


def as_mark(right: Column, gold: Column) -> Column:
    """1 if right, 0 if not (unknown counts as wrong), null without a gold answer."""
    return F.when(gold.isNotNull(), F.coalesce(right, F.lit(False)).cast("int"))


def policy_of(parsing: Column, few_shot: Column, cot: Column, few_shot_policy: Column | str = "few_shot") -> Column:
    """Policy name from the run's options; the judge ignores shots and steps."""
    shot = F.lit(few_shot_policy) if isinstance(few_shot_policy, str) else few_shot_policy
    return F.when(parsing == "llm", "judge").when(cot, "cot").when(few_shot, shot).otherwise("zero_shot")


def marks(
    rows: DataFrame,
    policy: Column | str,
    response: str = "response",
    gold: str = "answer",
    judged: str | None = None,
    simplified: bool = False,
    choices: Sequence[str] = extract.CHOICES,
    patterns: Sequence[str] = fixed.CASCADE,
    script: Script | None = None,
) -> DataFrame:
    """Rows with ``extracted`` and ``correctness`` under one policy, or one per row.

    ``judged`` names the judge's reply column for the judge policy.  The response
    is trimmed for every policy but ``cot``.
    """
    constant = policy if isinstance(policy, str) else None
    which = F.lit(policy) if constant else policy
    raw = text_or_empty(F.col(response))
    # Trimmed text as a column of its own: the cascade refers to it many times.
    rows = rows.withColumn("_text", raw if constant == "cot" else F.when(which == "cot", raw).otherwise(strip(raw)))
    text, answer = F.col("_text"), F.col(gold)

    branches = {
        "zero_shot": lambda: extract.last_choice(text, patterns, choices, script),
        "exact_only": lambda: text,
        "cot": lambda: extract.worked_choice(text, simplified),
        "judge": lambda: extract.judge_label(F.col(judged)) if judged else F.lit(None).cast("string"),
    }
    if constant:
        extracted = branches["zero_shot" if constant == "few_shot" else constant]()
    else:
        # One cascade serves both plain policies, so it is in the plan only once.
        extracted = F.when(which.isin("zero_shot", "few_shot"), branches["zero_shot"]())
        for name in ("exact_only", "cot", "judge"):
            extracted = extracted.when(which == name, branches[name]())
    rows = rows.withColumn("extracted", F.when(F.length(text) > 0, extracted))
    found = F.col("extracted")

    rules = {
        "zero_shot": found == answer,
        "few_shot": exact_match(text, answer) | F.coalesce(found == answer, F.lit(False)),
        "exact_only": exact_match(found, answer),
        "cot": exact_match(found, answer),
        "judge": found == answer,
    }
    if constant:
        right = rules[constant]
    else:
        right = F.when(which == "zero_shot", rules["zero_shot"])
        for name in POLICIES[1:]:
            right = right.when(which == name, rules[name])
    nonempty = F.length(text) > 0
    return rows.withColumn("correctness", as_mark(nonempty & right, answer)).drop("_text")


def mark_scores(rows: DataFrame, vector: str = "scores", gold: str = "answer", choices: Sequence[str] = extract.CHOICES) -> DataFrame:
    """Score-vector policy: the letter of the largest score against the gold answer."""
    rows = rows.withColumn("extracted", scores.argmax_choice(F.col(vector), choices))
    return rows.withColumn("correctness", as_mark(F.col("extracted") == F.col(gold), F.col(gold)))


def blind(rows: DataFrame, gold: str = "answer") -> DataFrame:
    """Test mode: no gold answer is known, so every row is marked wrong."""
    return rows.withColumn(gold, F.lit("NA"))
