"""From marks to accuracies, category means, completeness and the leaderboard.

The first aggregation (model, subject) is combined map-side, so however many
marks there are and however few models hold them, each task sends at most one row
per model and subject.  Everything after it works on that small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markbook.plans.joins import join_small


def accuracy_by_subject(marks: DataFrame, correctness: str = "correctness", order: str | None = None, failed: str | None = None) -> DataFrame:
    """(model, subject, n_rows, n_correct, accuracy 0-100); no marked rows gives null.

    ``order`` keeps the first value of that column as ``seq``, for stable ranking.
    ``failed`` (a boolean column) adds ``n_failed``, the rows that were never answered.
    """
    aggregates = [
        F.count(correctness).alias("n_rows"),
        F.sum(F.col(correctness).cast("long")).alias("n_correct"),
    ]
    if order:
        aggregates.append(F.min(order).alias("seq"))
    if failed:
        aggregates.append(F.count_if(F.col(failed)).alias("n_failed"))
    totals = marks.groupBy("model", "subject").agg(*aggregates)
    return totals.withColumn("accuracy", F.try_divide(100.0 * F.col("n_correct"), F.col("n_rows")))


def macro_by_category(ledger: DataFrame, dimension: DataFrame, category: str = "supercategory") -> DataFrame:
    """Unweighted mean of the ledger's accuracies per (model, category).

    ``dimension`` maps subject to category; repeated ledger rows count each time, rows of
    a subject that it does not know count nowhere, here and in every report below.
    """
    rows = join_small(ledger, dimension.select("subject", category), ["subject"], "inner")
    return rows.groupBy("model", category).agg(F.avg("accuracy").alias("mean_accuracy"), F.count("*").alias("n_subjects"))


def category_pivot(means: DataFrame, categories: Sequence[str], category: str = "supercategory") -> DataFrame:
    """One column per category; a category the model lacks is null.

    The list of categories is given, so no extra job looks for them.
    """
    return means.groupBy("model").pivot(category, list(categories)).agg(F.first("mean_accuracy"))


def overall(means: DataFrame, n_categories: int | None) -> DataFrame:
    """(model, average): category means added and divided by the number of categories.

    The divisor is fixed even if a model lacks a category; ``None`` divides by the
    categories present.
    """
    divisor: Column = F.lit(n_categories) if n_categories else F.count("mean_accuracy")
    return means.groupBy("model").agg((F.sum("mean_accuracy") / divisor).alias("average"))


def micro_average(subject_totals: DataFrame) -> DataFrame:
    """(model, average): all marked rows weigh the same."""
    return subject_totals.groupBy("model").agg(
        F.try_divide(100.0 * F.sum("n_correct"), F.sum("n_rows")).alias("average")
    )


def completeness(ledger: DataFrame, n_subjects: int, distinct: bool = False) -> DataFrame:
    """(model, n_rows, complete): a model is complete with exactly ``n_subjects`` rows.

    Repeated rows count, as in the ledger; ``distinct`` counts subjects instead.
    """
    counted = F.countDistinct("subject") if distinct else F.count("*")
    return ledger.groupBy("model").agg(counted.alias("n_rows")).withColumn("complete", F.col("n_rows") == n_subjects)


def _named(categories: Sequence[str]) -> list[Column]:
    """Category columns; their names may hold dots and spaces."""
    return [F.col(f"`{c}`") for c in categories]


def _report(ledger: DataFrame, dimension: DataFrame, categories: Sequence[str], category: str, n_categories: int | None) -> DataFrame:
    """One row per model: row count, a column per category, average, first place.

    One pass over (model, category): the pivot, the average and the row count all
    come from the same grouped table.
    """
    # Unknown subjects keep the model in the report, but count neither in the average nor for the gate.
    rows = join_small(ledger, dimension.select("subject", category), ["subject"], "left")
    means = rows.groupBy("model", category).agg(
        F.avg("accuracy").alias("mean_accuracy"), F.count("*").alias("n"), F.min("seq").alias("seq")
    )
    columns = [F.max(F.when(F.col(category) == c, F.col("mean_accuracy"))).alias(c) for c in categories]
    known = F.col(category).isNotNull()
    divisor = F.lit(n_categories) if n_categories else F.count(F.when(known, F.col("mean_accuracy")))
    return means.groupBy("model").agg(
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("n_rows"),
        F.min("seq").alias("seq"),
        *columns,
        (F.sum(F.when(known, F.col("mean_accuracy"))) / divisor).alias("average"),
    )


def leaderboard(
    ledger: DataFrame,
    dimension: DataFrame,
    categories: Sequence[str],
    n_subjects: int | None,
    category: str = "supercategory",
    n_categories: int | None = -1,
) -> DataFrame:
    """Complete models ranked by average; ties keep the order of first appearance.

    ``ledger`` has (model, subject, accuracy, seq).  ``n_subjects=None`` ranks all.
    The divisor defaults to the number of categories.
    """
    divisor = len(categories) if n_categories == -1 else n_categories
    rows = _report(ledger, dimension, categories, category, divisor)
    if n_subjects is not None:
        rows = rows.where(F.col("n_rows") == n_subjects)
    # The last digits of a mean depend on the order of adding, so they do not decide between
    # models.  The window takes one row per model, which is what the board itself shows.
    order = Window.orderBy(F.round("average", 9).desc(), F.col("seq").asc(), F.col("model").asc())
    ranked = rows.withColumn("rank", F.row_number().over(order))
    return ranked.select(F.col("rank").cast("int").alias("rank"), "model", *_named(categories), "average").orderBy("rank")


def incomplete_models(
    ledger: DataFrame, dimension: DataFrame, categories: Sequence[str], n_subjects: int, category: str = "supercategory"
) -> DataFrame:
    """The models that are not ranked: row count, category means, average."""
    rows = _report(ledger, dimension, categories, category, len(categories))
    return rows.where(F.col("n_rows") != n_subjects).select("model", "n_rows", *_named(categories), "average")


def bank_stats(bank: DataFrame, dimension: DataFrame) -> DataFrame:
    """Rows per split for every subject, category and the whole bank.

    Subjects are counted first; the rollup then runs over one row per subject
    instead of tripling every question.
    """
    splits = {"train": "n_train", "validation": "n_validation", "test": "n_test"}
    counts = bank.groupBy("subject").agg(
        *[F.count(F.when(F.col("split") == s, 1)).alias(name) for s, name in splits.items()], F.count("*").alias("n_total")
    )
    rows = join_small(counts, dimension.select("subject", "category"), ["subject"], "left")
    return rows.rollup("category", "subject").agg(
        F.grouping_id().alias("level"), *[F.sum(c).alias(c) for c in (*splits.values(), "n_total")]
    )
