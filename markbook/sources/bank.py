"""Question bank scans (test rows to mark, train rows as worked examples)."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from markbook.schema import bank_schema

# Subject and split in the path of a file under the root: <subject>/<split>.csv, <subject>/<split>/<any>.csv, or the folders
# that Spark writes.
LAYOUT = r"^(?:subject=)?([^/]+)/(?:split=)?([^/]+?)(?:/.*|\.[^/.]+)$"
NAMED = ("subject", "split", "row_idx", "question", "answer", "explanation")


def read_bank(spark: SparkSession, path: str, fmt: str = "parquet", choices=("A", "B", "C", "D")) -> DataFrame:
    """All subjects of a bank in one scan with an explicit schema."""
    reader = spark.read.schema(bank_schema(choices))
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.format(fmt).load(path)


def scan_split(bank: DataFrame, split: str, subjects: list[str] | None = None) -> DataFrame:
    """Rows of one split; both predicates reach the scan (or prune partitions)."""
    rows = bank.where(F.col("split") == split)
    return rows.where(F.col("subject").isin(subjects)) if subjects else rows


def _path(root: str) -> Column:
    """The file's path under the root as it was named; folders that Spark writes escape their values once more."""
    once = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    front = re.escape("/" + re.sub(r"^file:/+|^\w+://[^/]*/", "/", root).strip("/") + "/")
    once = F.regexp_replace(once, "^.*?" + front, "")
    return F.coalesce(F.try_url_decode(F.replace(once, F.lit("+"), F.lit("%2B"))), once)


def _letters(columns: Sequence[str]) -> list[str]:
    """The choices among the columns of a file: single capital letters, from A on without a gap."""
    out = []
    while chr(65 + len(out)) in columns:
        out.append(chr(65 + len(out)))
    return out


def _csv_headers(spark: SparkSession, root: str) -> dict[str, list[str]]:
    """First line -> files that begin with it.  Only what is read of a file's first block is looked at, and what
    comes to the driver is a path per file."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(root)
    lines = lines.where("_metadata.file_block_start = 0").select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    first = lines.groupBy("file").agg(F.min_by("value", "at").alias("header"))
    out: dict[str, list[str]] = {}
    for row in sorted(first.collect(), key=lambda r: r.file):
        out.setdefault(row.header.lstrip("﻿").rstrip("\r"), []).append(row.file)
    return out


def read_tree(spark: SparkSession, root: str, fmt: str = "csv", layout: str = LAYOUT) -> DataFrame:
    """A bank kept as one file per subject and split, each with its own list of choices.

    Subject and split come from the path (two groups of ``layout``), the choices from the columns of each file.  Gives the columns
    of ``read_bank`` with as many choices as the longest list, null where a file has fewer, and ``letters``, the file's own list.
    ``row_idx`` is the file's, or else the place of the row in it.  CSV files are read once per different header, others by
    the names of their columns with all schemas merged.  Columns of other names are left out.
    """
    if fmt == "csv":
        tables = []
        for header, files in _csv_headers(spark, root).items():
            names = next(csv.reader([header]), [])
            names = [n or f"_{i}" for i, n in enumerate(names)]
            schema = ", ".join(f"`{n}` string" for n in names)
            reader = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"')
            tables.append((reader.csv([unquote(f) for f in files]), names))
    else:
        # A list of choices is that of the rows' own file: a column that the file lacks is null in all of its rows.
        rows = spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).format(fmt).load(root)
        tables = [(rows, rows.columns)]
    if not tables:
        return spark.createDataFrame([], bank_schema()).withColumn("letters", F.lit(None).cast("array<string>"))
    longest = max((_letters(names) for _, names in tables), key=len)
    return reduce(DataFrame.unionByName, [_one_list(rows, names, longest, root, layout, fmt) for rows, names in tables])


def _one_list(rows: DataFrame, names: Sequence[str], longest: Sequence[str], root: str, layout: str, fmt: str) -> DataFrame:
    letters = _letters(names)
    path = F.regexp_extract(_path(root), layout, 1), F.regexp_extract(_path(root), layout, 2)
    text = {c: F.col(f"`{c}`").cast("string") if c in names else F.lit(None).cast("string") for c in (*longest, "question", "answer", "explanation")}
    order = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    placed = rows.select(path[0].alias("subject"), path[1].alias("split"), order.alias("_order"),
                         (F.col("row_idx").cast("long") if "row_idx" in names else F.lit(None).cast("long")).alias("_row"), *[c.alias(n) for n, c in text.items()])
    if fmt == "csv":
        own = F.array(*[F.lit(c) for c in letters]).cast("array<string>")
    else:
        whole = Window.partitionBy("subject", "split")
        own = F.filter(F.array(*[F.when(F.count(c).over(whole) > 0, c) for c in letters]), lambda c: c.isNotNull()) if letters else F.array().cast("array<string>")
    # One file per subject and split, so this window sorts no more than a file.
    place = (F.row_number().over(Window.partitionBy("subject", "split").orderBy("_order")) - 1).cast("long")
    return placed.select("subject", "split", F.coalesce("_row", place).alias("row_idx"), "question", *longest, "answer", "explanation", own.alias("letters"))


def by_choices(bank: DataFrame, letters: Sequence[str]) -> DataFrame:
    """The rows of a tree whose files have exactly these choices, in the columns of ``read_bank``: one evaluation's bank."""
    own = F.array(*[F.lit(c) for c in letters]).cast("array<string>")
    return bank.where(F.col("letters") == own).select("subject", "split", "row_idx", "question", *letters, "answer", "explanation")
