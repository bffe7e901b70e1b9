"""Dimension tables: subjects, category hierarchy, role tokens per model.

The built-in ones are constants of this package, so their size never grows with
the data; each also has a reader for a caller's own file.
"""

from __future__ import annotations

import csv
import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from markbook import fixed_values as fixed
from markbook import schema

EXAMS = {
    "traditional": fixed.TRADITIONAL_SUBJECTS,
    "cmmlu": fixed.MAINLAND_SUBJECTS,
    "ceval": fixed.LEVELS_SUBJECTS,
}


def local_table(spark: SparkSession, rows: list[tuple], row_type: T.StructType) -> DataFrame:
    """A constant table as a local relation, so the optimizer knows its true size."""
    columns = list(zip(*rows)) if rows else [[] for _ in row_type]
    arrow = to_arrow_schema(row_type)
    return spark.createDataFrame(
        pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow), row_type
    )


def subject_rows(exam: str) -> list[tuple[str, str, str]]:
    """(subject, display name, category) of every subject set as a task."""
    rows = [tuple(line.split(" | ")) for line in EXAMS[exam].strip().splitlines()]
    return [row for row in rows if exam != "traditional" or row[0] not in fixed.UNSET_SUBJECTS]


def subjects(spark: SparkSession, exam: str) -> DataFrame:
    return local_table(spark, subject_rows(exam), schema.SUBJECTS)


def read_subjects(spark: SparkSession, path: str) -> DataFrame:
    """A subject dimension from a TSV file with a header."""
    return spark.read.schema(schema.SUBJECTS).csv(path, sep="\t", header=True)


def hierarchy_frame(spark: SparkSession, hierarchy: dict[str, list[str]] | None = None) -> DataFrame:
    """A map of supercategory -> categories turned into one row per category."""
    pairs = [(c, top) for top, names in (hierarchy or fixed.HIERARCHY).items() for c in names]
    return local_table(spark, pairs, schema.HIERARCHY)


def invert_hierarchy(maps: DataFrame, column: str) -> DataFrame:
    """The same for a DataFrame that holds the map<string, array<string>> in a column."""
    entries = maps.select(F.explode(F.map_entries(column)).alias("entry"))
    return entries.select(F.explode("entry.value").alias("category"), F.col("entry.key").alias("supercategory"))


def templates(spark: SparkSession) -> DataFrame:
    """Built-in role tokens, missing tokens as empty text, in file order."""
    lines = list(csv.reader(io.StringIO(fixed.MODEL_TEMPLATES_CSV)))[1:]
    rows = [(i, name, sys, end, ast, usr) for i, (name, sys, end, ast, usr) in enumerate(lines)]
    return local_table(spark, rows, schema.TEMPLATES)


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """Role tokens from a CSV file with the columns of the built-in table.

    Rows keep the order of the file, also where it is read in several splits.  One row per
    model name, so their numbering is one small window.
    """
    text = ["model_name", "systemMessageToken", "messageEndToken", "assistantMessageToken", "userMessageToken"]
    raw = spark.read.schema(",".join(f"{name} string" for name in text)).csv(path, header=True)
    meta = F.col("_metadata")
    place = F.struct(meta["file_name"].alias("file"), meta["file_block_start"].alias("split"), F.monotonically_increasing_id().alias("row"))
    placed = raw.select("*", place.alias("place")).na.fill("", text)
    return placed.select(
        (F.row_number().over(Window.orderBy("place")) - 1).cast("int").alias("file_order"),
        "model_name",
        F.col("systemMessageToken").alias("system_token"),
        F.col("messageEndToken").alias("end_token"),
        F.col("assistantMessageToken").alias("assistant_token"),
        F.col("userMessageToken").alias("user_token"),
    )
