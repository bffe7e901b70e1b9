"""Replies stored under what was asked: the prompt, its parameters, the model and the backend.

The key of a reply is a hash of exactly what was sent.  Whatever changes the text or the parameters of a prompt, a question, an
example, a template, a name or a setting, changes its key, and only such prompts are sent again.  Rows lie in PLACES folders
by a hash of (model, subject), so that a wave of tasks reads and writes its own folders only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markbook.operators.inference import FAILED
from markbook.sources import commits

PLACES = 256
STORED = "key string, model string, subject string, response string, status string, attempts int, error string, place int"
JUDGED = "key string, judged string, judge_status string, place int"


def reply_key(prompt: Column, params: Column, model: Column, backend: str) -> Column:
    """sha256 over the JSON text of backend, model, parameters and prompt."""
    asked = F.struct(F.lit(backend).alias("backend"), model.alias("model"), params.alias("params"), prompt.alias("prompt"))
    return F.sha2(F.to_json(asked, {"ignoreNullFields": "false"}), 256)


def task_place() -> Column:
    return F.pmod(F.xxhash64("model", "subject"), F.lit(PLACES)).cast("int")


def key_place() -> Column:
    """For replies that belong to no task: the first byte of their key."""
    return F.conv(F.substring("key", 1, 2), 16, 10).cast("int")


def failed(status: str) -> Column:
    return F.coalesce(F.col(status).isin(*FAILED), F.lit(False))


def outcomes(spark: SparkSession, path: str, row_type: str, status: str, low: int = 0, high: int = PLACES) -> DataFrame:
    """One row per key in the places low .. high - 1: its first answer, else its last failure."""
    rows = commits.read(spark, path, row_type).where(F.col("place").between(low, high - 1))
    order = F.struct(failed(status), F.when(failed(status), -F.col("number")).otherwise(F.col("number")), "attempt")
    rest = [c for c in rows.columns if c not in ("key", "place", "attempt", "number")]
    return rows.groupBy("key").agg(F.min_by(F.struct(*rest), order).alias("_one")).select("key", "_one.*")


def unanswered(rows: DataFrame, stored: DataFrame, status: str) -> DataFrame:
    """``rows`` whose key has no answer in ``stored``, one row per key."""
    return rows.join(stored.where(~failed(status)).select("key"), "key", "left_anti").dropDuplicates(["key"])
