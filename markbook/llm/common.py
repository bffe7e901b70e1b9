"""Reading, storing and joining shared by the operators of this folder."""

from __future__ import annotations

import gc
import sys
import types
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markbook.session import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# A key with more than this share of all rows is joined by broadcast, so at most HOT_SHARE of them exist.
HOT_SHARE = 4096


def travels(module: str) -> None:
    """Workers get the functions and classes of this module with the job, so they need no installed copy."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


travels(__name__)


def kept(key: str, make: Callable[[], object]):
    """``make()``, kept in the worker from task to task, until a pass that works without it calls ``tidy``."""
    held = sys.modules.setdefault("_markbook_kept", types.ModuleType("_markbook_kept")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def tidy(keep: bool = False) -> None:
    """At the start of a task in a worker: what earlier passes kept there goes unless ``keep``, and memory that nothing uses any
    more goes back to the system.  Workers live on from pass to pass, so otherwise each holds the most of all its passes."""
    if not keep and sys.modules.pop("_markbook_kept", None):
        gc.collect()
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL where SQL can say the same."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, and an
    executor lost later costs only a read."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Within it, what a job exchanged is removed when the job ends, not when the driver next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def discard(*frames: DataFrame) -> None:
    """Remove stored tables that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lookup_join(rows: DataFrame, small: DataFrame, key: str, weight: str, total: int, row_id: Column) -> DataFrame:
    """``rows`` left-joined to ``small`` (one row per key, ``weight`` = its rows in ``rows``).

    Keys above total / HOT_SHARE rows are at most HOT_SHARE in number, whatever the data: those are broadcast.
    All other keys go through a shuffle in which the rows of hot keys, already answered, are spread by ``row_id``.
    """
    values = [c for c in small.columns if c not in (key, weight)]
    answer = F.struct(*[F.col(c) for c in values])
    small = small.where(F.col(key).isNotNull())
    hot = small.where(F.col(weight) > total / HOT_SHARE).select(F.col(key).alias("_hk"), answer.alias("_hot"))
    cold = small.where(F.col(weight) <= total / HOT_SHARE)
    rows = rows.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left").drop("_hk")
    asked = F.struct(F.when(F.col("_hot").isNull(), F.col(key)).alias("k"), F.when(F.col("_hot").isNotNull() | F.col(key).isNull(), row_id).alias("r"))
    cold = cold.select(F.struct(F.col(key).alias("k"), F.lit(None).cast("string").alias("r")).alias("_ck"), answer.alias("_cold"))
    rows = rows.withColumn("_ask", asked).join(cold, F.col("_ask") == F.col("_ck"), "left")
    got = F.coalesce(F.col("_hot"), F.col("_cold"))
    return rows.select(*[c for c in rows.columns if not c.startswith("_hot") and c not in ("_ask", "_ck", "_cold")], *[got[c].alias(c) for c in values])
