"""From raw documents to packed training sequences, one stage after another.

Each stage works on all rows that the one before it kept; what it returns is written as Parquet in the shared folder and read
again, so a lost executor never costs more than its stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markbook.llm import decontamination, near_duplicates, packing, secrets, toxicity
from markbook.llm.common import stored, table


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; the model learns from the labels of the documents here."""
    distance, model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, distance, model, name="_toxicity")
    return scored.where(F.col("_toxicity") < toxicity.THRESHOLD).drop("_toxicity")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, and one row of each repeated doc_id; null ids stay."""
    found = near_duplicates.groups(docs)
    verdicts = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("kept").alias("_kept"), F.count("*").alias("_rows"))
    verdicts = stored(verdicts.where("NOT _kept OR _rows > 1"), "verdicts")
    known = docs.join(verdicts, "doc_id", "left").where(F.coalesce("_kept", F.lit(True)))
    once = known.where("_rows IS NULL").select(*docs.columns)
    repeated = docs.join(verdicts.where("_kept").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    return once.union(repeated.dropDuplicates(["doc_id"]))


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret."""
    return secrets.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs, packing.public_tokenizer()).drop("ids")


STAGES = [
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_each_group),
    ("decontamination", not_in_benchmark),
    ("secrets", without_secrets),
    ("packing", packed),
]

# Models and component search are beyond SQL; the tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; the pieces of all documents that are left.

    A null or empty text passes every stage and is packed as the end id alone.  A row without an id is judged by its text: it is
    never a near duplicate, and goes if it is toxic or holds a benchmark item.  Of rows that share an id one stays.  Columns
    beyond those of documents are carried along up to packing, whatever their names, and an empty table gives no pieces.
    """
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        rows = stored(stage(spark, rows, sf_dir), f"pipeline-{name}")
    return rows
