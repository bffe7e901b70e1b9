"""Tables that grow by committed appends, on files that any Spark reader opens.

An append writes its rows under ``data/attempt=<id>`` and then one record under ``commits``.  Rows count only with their record, so
an append that broke off leaves nothing to be seen, and of a key written by several appends the last committed one is read,
so an append that was repeated, whole or in part, counts once.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markbook.plans.joins import join_small

RECORD = "attempt string, number long, written timestamp"


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def records(spark: SparkSession, path: str) -> DataFrame:
    """(attempt, number, written) of every committed append, one row each; none where nothing was written."""
    if not path_exists(spark, f"{path}/commits"):
        return spark.createDataFrame([], RECORD)
    return spark.read.schema(RECORD).parquet(f"{path}/commits")


def write(rows: DataFrame, path: str, partitions: Sequence[str] = ()) -> str:
    """The rows of an append without its record; returns the attempt to commit."""
    attempt = uuid.uuid4().hex
    writer = rows.write
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.parquet(f"{path}/data/attempt={attempt}")
    return attempt


def commit(spark: SparkSession, path: str, attempt: str) -> None:
    """Make the rows of an attempt count.  Its number follows all earlier ones; of two appends that commit
    at once and take one number, the attempt's name decides."""
    last = records(spark, path).agg(F.coalesce(F.max("number"), F.lit(0)).alias("n")).first().n
    record = spark.range(1).select(F.lit(attempt).alias("attempt"), F.lit(last + 1).cast("long").alias("number"), F.current_timestamp().alias("written"))
    record.coalesce(1).write.mode("append").parquet(f"{path}/commits")


def append(rows: DataFrame, path: str, partitions: Sequence[str] = ()) -> None:
    commit(rows.sparkSession, path, write(rows, path, partitions))


def read(spark: SparkSession, path: str, row_type: T.StructType | str) -> DataFrame:
    """All rows of committed appends, with ``attempt`` and ``number``; ``row_type`` names the columns of the rows.

    Conditions on partition columns prune folders, as does the join with the records."""
    if isinstance(row_type, str):
        row_type = T.StructType.fromDDL(row_type)
    done = records(spark, path).select("attempt", "number")
    if not path_exists(spark, f"{path}/data"):
        typed = T.StructType([*row_type.fields, T.StructField("attempt", T.StringType()), T.StructField("number", T.LongType())])
        return spark.createDataFrame([], typed)
    rows = spark.read.schema(T.StructType([*row_type.fields, T.StructField("attempt", T.StringType())])).parquet(f"{path}/data")
    return join_small(rows, done, ["attempt"], "inner").select(*[f"`{f.name}`" for f in row_type.fields], "attempt", "number")


def latest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key: that of the last commit, with its ``number``.

    Combined map-side, so a key written by many appends is one partial row per task."""
    rest = [c for c in rows.columns if c not in keys]
    # A repeated row within one append is settled by its hash.
    order = F.struct("number", "attempt", F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]))
    one = rows.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), order).alias("_one"))
    return one.select(*keys, "_one.*").drop("attempt")
