"""Sinks and sources of scored rows and of the score ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markbook import schema
from markbook.plans.joins import join_small
from markbook.session import written
from markbook.sources import commits

LEDGER_ROW = "run string, model string, subject string, accuracy double, content string"


def write_scored(scored: DataFrame, path: str, fmt: str = "parquet", by=("model", "subject")) -> None:
    """Scored rows, one folder per (model, subject); a re-run replaces only its own.

    ``rebalance`` brings the rows of a folder together, so tasks do not each leave
    a small file in every folder, and lets AQE split a folder that is too large
    for one task.
    """
    (
        scored.hint("rebalance", *by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .format(fmt)
        .save(path)
    )


def read_scored(spark: SparkSession, path: str, row_type, fmt: str = "parquet") -> DataFrame:
    """Scored rows back; filters on model or subject prune folders."""
    return spark.read.schema(row_type).format(fmt).load(path)


def accuracy_text(accuracy: Column) -> Column:
    """Accuracy as the ledger stores it: five decimals."""
    return F.format_string("%.5f", accuracy)


def append_ledger(accuracy: DataFrame, path: str) -> None:
    """Append (model, subject, accuracy) lines, tab separated and without a header."""
    accuracy.select("model", "subject", accuracy_text(F.col("accuracy")).alias("accuracy")).write.mode(
        "append"
    ).csv(path, sep="\t")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger with ``seq``, a sortable value that follows the order of appending.

    Later appends have later file times; within one append the file name, the
    offset of the split and the row's place in it give the order.
    """
    rows = spark.read.schema(schema.LEDGER).csv(path, sep="\t")
    meta = F.col("_metadata")
    return rows.select(
        "*",
        F.struct(
            meta["file_modification_time"].alias("written"),
            meta["file_name"].alias("file"),
            meta["file_block_start"].alias("split"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("seq"),
    )


def commit_ledger(accuracy: DataFrame, path: str) -> None:
    """Append (run, model, subject, accuracy, content) rows as one commit; nothing is seen of an append that breaks off."""
    commits.append(accuracy.select("run", "model", "subject", "accuracy", "content").coalesce(1), path)


def committed_ledger(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """One row per (run, model, subject), that of the last committed append, with ``seq``, its order of appending."""
    rows = commits.read(spark, path, LEDGER_ROW)
    rows = rows if run is None else rows.where(F.col("run") == run)
    return commits.latest(rows, ["run", "model", "subject"]).withColumn("seq", F.struct("number", "model", "subject")).drop("number")


def upsert_scored(rows: DataFrame, path: str, key=("model", "subject", "row_idx", "attempt"), version: str = "version", by=("model", "subject")) -> None:
    """Merge ``rows`` into the scored rows at ``path``: of each key the row of the highest version stays.

    Only the folders (``by``) that ``rows`` touches are read and replaced.  The merged rows are written aside first, so a run that
    breaks off can be repeated.  A late row of a lower version changes nothing, and a repeated one nothing either.
    """
    spark = rows.sparkSession
    merged = rows
    if commits.path_exists(spark, path):
        touched = rows.select(*by).distinct()
        old = join_small(spark.read.schema(rows.schema).parquet(path), touched, list(by), "left_semi")
        merged = rows.unionByName(old)
    write_scored(written(newest(merged, key, version), "upsert"), path, by=by)


def newest(rows: DataFrame, key, version: str) -> DataFrame:
    """One row per key, that of the highest version; equal versions are settled by a hash of the row.  Null keys are values."""
    rest = [c for c in rows.columns if c not in key]
    order = F.struct(F.col(version), F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]))
    one = rows.groupBy(*key).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), order).alias("_one"))
    return one.select(*key, "_one.*").select(*[f"`{c}`" for c in rows.columns])
