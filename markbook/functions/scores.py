"""Answers from score vectors: softmax over choices, first maximum, summed logits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from markbook.functions.extract import CHOICES
from markbook.functions.text import bound


def _shifted(scores: Column, use) -> Column:
    """``use(scores - max)`` so that ``exp`` stays finite; the maximum is found once."""
    return bound(scores, lambda s: bound(F.array_max(s), lambda top: use(s, top)))


def softmax(scores: Column) -> Column:
    """Softmax of an array<double>."""

    def shares(powers: Column) -> Column:
        total = F.aggregate(powers, F.lit(0.0), lambda acc, x: acc + x)
        return bound(total, lambda z: F.transform(powers, lambda x: x / z))

    return _shifted(scores, lambda s, top: bound(F.transform(s, lambda x: F.exp(x - top)), shares))


def choice_probabilities(logits: Column, token_ids: Sequence[int]) -> Column:
    """Softmax over the vocabulary, the choice tokens gathered, softmax again.

    Only the vocabulary's maximum and normaliser are needed for the first step, so
    no second vocabulary-sized array is built.
    """

    def gathered(s: Column, top: Column) -> Column:
        total = F.aggregate(s, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
        return bound(total, lambda z: F.array(*[F.exp(F.element_at(s, i + 1) - top) / z for i in token_ids]))

    return softmax(_shifted(logits, gathered))


def argmax_choice(scores: Column, choices: Sequence[str] = CHOICES) -> Column:
    """Letter of the largest score; the first one wins a tie."""
    place = F.array_position(scores, F.array_max(scores)).cast("int")
    return F.when(F.size(scores) > 0, F.try_element_at(F.array(*map(F.lit, choices)), F.nullif(place, F.lit(0))))


def finite(scores: Column) -> Column:
    """True if the array holds no NaN and no infinity."""
    return ~F.exists(scores, lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def argmax_sum(left: Column, right: Column, choices: Sequence[str] = CHOICES, on_invalid: str = "error") -> Column:
    """Letter of the largest elementwise sum of two score vectors.

    A sum with NaN or infinity fails the job, or gives null with
    ``on_invalid="null"``.
    """
    bad = F.raise_error(F.lit("summed choice scores are not finite")) if on_invalid == "error" else F.lit(None)
    return bound(
        F.zip_with(left, right, lambda a, b: a + b),
        lambda summed: F.when(finite(summed), argmax_choice(summed, choices)).otherwise(bad.cast("string")),
    )
