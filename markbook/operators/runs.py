"""Run bookkeeping: run keys, pending tasks, caps, models per question, merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markbook.plans.joins import join_small
from markbook.plans.running import first_rows


def run_key(dataset: Column, model: Column, top_k: Column, cot: Column, simplified: Column) -> dict[str, Column]:
    """Columns that identify a run, and the ledger file name older runs used."""
    exam = F.element_at(F.split(dataset, "/"), -1)
    base = F.element_at(F.split(model, "/"), -1)
    shots = F.when(top_k > 0, F.concat(F.lit("_top_"), top_k.cast("string"))).otherwise("")
    steps = F.when(cot, "_cot").otherwise("")
    script = F.when(simplified, "_zhs").otherwise("")
    return {
        "exam": exam,
        "model_base": base,
        "top_k": top_k,
        "cot": cot,
        "script": F.when(simplified, "simplified").otherwise("traditional"),
        "ledger_name": F.concat(exam, F.lit("_"), base, shots, steps, script, F.lit(".tsv")),
    }


def pending_tasks(tasks: DataFrame, ledger: DataFrame, by=("model", "subject")) -> DataFrame:
    """Tasks without a ledger row; ``by=["subject"]`` ignores the model."""
    return tasks.join(ledger.select(*by).distinct(), list(by), "left_anti")


def cap_samples(questions: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of every subject by ``row_idx``."""
    return first_rows(questions, ["subject"], "row_idx", n).drop("rank")


def questions_per_model(questions: DataFrame, tasks: DataFrame) -> DataFrame:
    """Each model's questions: tasks (model, subject) joined to the bank on subject.

    The tasks are one small row per model and subject, so the bank is not shuffled.
    """
    return join_small(questions, tasks, ["subject"], "inner")


def with_names(rows: DataFrame, subjects: DataFrame) -> DataFrame:
    """Subject display names; a subject that the table does not know is called by its id."""
    named = join_small(rows, subjects.select("subject", "name"), ["subject"], "left")
    return named.withColumn("name", F.coalesce("name", "subject"))


def with_categories(rows: DataFrame, subjects: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Category and supercategory of each row's subject."""
    dimension = subjects.select("subject", "category").join(hierarchy, "category", "left")
    return join_small(rows, dimension, ["subject"], "left")


def known_subjects(subjects: DataFrame, tasks: DataFrame) -> DataFrame:
    """Dimension rows whose subject is in the task list."""
    return join_small(subjects, tasks.select("subject").distinct(), ["subject"], "left_semi")


def distinct_models(ledger: DataFrame) -> DataFrame:
    return ledger.select("model").distinct()


def merge_runs(*runs: DataFrame) -> DataFrame:
    """Results of several runs as one table; repeats are kept."""
    return reduce(lambda a, b: a.unionByName(b), runs)
