"""Accuracy kept up to date from new marks alone.

Marked rows arrive as committed appends.  Of each append one row per (model, subject) is kept: sums that can be added in any
order.  A refresh reads the appends that the state has not seen, found by their records, and no others; the accuracy is the sum
over the state, which has a few rows per append however many marks there were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markbook.sources import commits

STATE = "source string, model string, subject string, n_rows long, n_correct long, n_failed long"


def _state(spark: SparkSession, state: str) -> DataFrame:
    # Two refreshes at once may take the same append; its sums are the same in both and count once.
    return commits.latest(commits.read(spark, state, STATE), ["source", "model", "subject"]).drop("number")


def unseen(spark: SparkSession, scored: str, state: str) -> list[str]:
    """The committed appends of ``scored`` that the state does not cover yet, oldest first."""
    seen = commits.read(spark, state, STATE).select(F.col("source").alias("attempt")).distinct()
    new = commits.records(spark, scored).join(seen, "attempt", "left_anti")
    return [r.attempt for r in new.orderBy("number", "attempt").collect()]


def new_marks(spark: SparkSession, scored: str, attempts: list[str], row_type: T.StructType | str) -> DataFrame:
    """The rows of these appends; no other folder is listed as input."""
    return commits.read(spark, scored, row_type).where(F.col("attempt").isin(attempts))


def refresh(spark: SparkSession, scored: str, state: str, row_type: T.StructType | str = "model string, subject string, correctness int, failed boolean") -> int:
    """Bring the state up to date and return how many appends were read.

    ``row_type`` names at least model, subject, correctness and failed; a row belongs to one append.  An append without
    rows leaves a row of nulls, so that it is not looked at again.
    """
    attempts = unseen(spark, scored, state)
    if attempts:
        rows = new_marks(spark, scored, attempts, row_type)
        sums = rows.groupBy(F.col("attempt").alias("source"), "model", "subject").agg(
            F.count("correctness").alias("n_rows"), F.coalesce(F.sum(F.col("correctness").cast("long")), F.lit(0)).alias("n_correct"),
            F.count_if(F.coalesce("failed", F.lit(False))).alias("n_failed"))
        empty = spark.createDataFrame([(a,) for a in attempts], "source string").join(sums.select("source").distinct(), "source", "left_anti")
        commits.append(sums.unionByName(empty, allowMissingColumns=True), state)
    return len(attempts)


def accuracy(spark: SparkSession, state: str) -> DataFrame:
    """(model, subject, n_rows, n_correct, n_failed, accuracy 0-100) over all appends that the state covers."""
    sums = _state(spark, state).where("n_rows IS NOT NULL").groupBy("model", "subject").agg(*[F.sum(c).alias(c) for c in ("n_rows", "n_correct", "n_failed")])
    return sums.withColumn("accuracy", F.try_divide(100.0 * F.col("n_correct"), F.col("n_rows")))
