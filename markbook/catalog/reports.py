"""Accuracy, category, completeness and leaderboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from markbook import fixed_values as fixed
from markbook import session
from markbook.catalog import fixtures as fx
from markbook.catalog.registry import query
from markbook.catalog.routes import exam_ledger, exam_marks
from markbook.functions import scoring
from markbook.operators import report
from markbook.plans import incremental
from markbook.plans.running import running_totals
from markbook.sources import commits, dims
from markbook.sources.results import accuracy_text

CATS = fx.SUPERCATEGORIES
WITH_LEDGER = f"WITH {fx.LEDGER_SQL}"
REGIONS = "regions AS (SELECT n_name AS subject, r_name AS supercategory FROM nation JOIN region ON n_regionkey = r_regionkey)"
MEANS = (
    f"{WITH_LEDGER}, {REGIONS}, means AS (SELECT model, supercategory, avg(accuracy) AS mean_accuracy, count(*) AS n_subjects "
    "FROM ledger JOIN regions ON ledger.subject = regions.subject GROUP BY model, supercategory)"
)


def sql_pivot(categories, column="supercategory"):
    """Category columns, rounded for comparing, named as in Spark."""
    return ", ".join(
        f"""round(max(CASE WHEN {column} = '{c.replace("'", "''")}' THEN mean_accuracy END), 6) AS "{c}" """ for c in categories
    )


def rounded(df, *names):
    return df.select(*[F.round(F.col(f"`{c}`"), 6).alias(c) if c in names else F.col(f"`{c}`") for c in df.columns])


def exam_means(spark, sf):
    return report.macro_by_category(exam_ledger(spark, sf), fx.subject_supercategory(spark, sf))


@query("accuracy_by_subject", f"{WITH_LEDGER} SELECT model, subject, n_rows, n_correct, accuracy FROM ledger")
def accuracy_by_subject(spark, sf):
    return report.accuracy_by_subject(exam_marks(spark, sf))


LINE_LEDGER = (
    f"WITH {fx.LINE_EXAM_SQL}, {fx.marked_sql('few_shot')}, ledger AS (SELECT model, subject, min(qid) AS seq, count(correctness) AS n_rows, "
    "CAST(sum(correctness) AS BIGINT) AS n_correct, 100.0 * sum(correctness) / count(correctness) AS accuracy FROM marked GROUP BY model, subject)"
)


@query("accuracy_by_subject_lines", f"{LINE_LEDGER} SELECT model, subject, n_rows, n_correct, accuracy FROM ledger")
def accuracy_by_subject_lines(spark, sf):
    return report.accuracy_by_subject(scoring.marks(fx.line_exam(spark, sf), "few_shot"))


@query(
    "accuracy_of_labels",
    "SELECT lang AS model, source AS subject, count(quality) AS n_rows, CAST(sum(quality) AS BIGINT) AS n_correct, "
    "100.0 * sum(quality) / count(quality) AS accuracy FROM documents JOIN labels ON documents.doc_id = labels.doc_id GROUP BY lang, source",
)
def accuracy_of_labels(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("model"), F.col("source").alias("subject"))
    return report.accuracy_by_subject(docs.join(fx.table(spark, sf, "labels"), "doc_id"), "quality")


@query("accuracy_text", f"{WITH_LEDGER} SELECT model, subject, printf('%.5f', accuracy) AS accuracy FROM ledger")
def accuracy_as_text(spark, sf):
    return exam_ledger(spark, sf).select("model", "subject", accuracy_text(F.col("accuracy")).alias("accuracy"))


@query("macro_by_category", f"{MEANS} SELECT model, supercategory, round(mean_accuracy, 6) AS mean_accuracy, n_subjects FROM means")
def macro_by_category(spark, sf):
    return rounded(exam_means(spark, sf), "mean_accuracy")


@query("category_pivot", f"{MEANS} SELECT model, {sql_pivot(CATS)} FROM means GROUP BY model")
def category_pivot(spark, sf):
    return rounded(report.category_pivot(exam_means(spark, sf), CATS), *CATS)


# Some models have not sat one category yet.
HELD = "(supercategory <> 'ASIA' OR length(model) % 2 = 1)"


@query(
    "overall_average",
    f"{MEANS}, micro AS (SELECT model, 100.0 * sum(n_correct) / sum(n_rows) AS micro FROM ledger GROUP BY model), "
    "macro AS (SELECT model, sum(mean_accuracy) / 5 AS fixed_divisor, avg(mean_accuracy) AS present_divisor FROM means "
    f"WHERE {HELD} GROUP BY model) "
    "SELECT macro.model, round(fixed_divisor, 6) AS fixed_divisor, round(present_divisor, 6) AS present_divisor, round(micro, 6) AS micro "
    "FROM macro JOIN micro ON macro.model = micro.model",
)
def overall_average(spark, sf):
    ledger = exam_ledger(spark, sf)
    means = report.macro_by_category(ledger, fx.subject_supercategory(spark, sf)).where(HELD)
    out = report.overall(means, len(CATS)).withColumnRenamed("average", "fixed_divisor")
    out = out.join(report.overall(means, None).withColumnRenamed("average", "present_divisor"), "model")
    out = out.join(report.micro_average(ledger).withColumnRenamed("average", "micro"), "model")
    return rounded(out, "fixed_divisor", "present_divisor", "micro")


@query(
    "complete_models",
    f"{WITH_LEDGER} SELECT model, count(*) AS n_rows, count(*) = {fx.N_SUBJECTS} AS complete, "
    f"count(DISTINCT subject) AS n_distinct FROM ledger GROUP BY model",
)
def complete_models(spark, sf):
    ledger = exam_ledger(spark, sf)
    counted = report.completeness(ledger, fx.N_SUBJECTS, distinct=True).select("model", F.col("n_rows").alias("n_distinct"))
    return report.completeness(ledger, fx.N_SUBJECTS).join(counted, "model")


def sql_report(source, categories, divisor):
    return (
        f"{source}, grouped AS (SELECT model, sum(n) AS n_rows, min(first) AS seq, sum(mean_accuracy) / {divisor} AS average, "
        f"{sql_pivot(categories)} FROM means GROUP BY model)"
    )


def means_with_order(ledger="ledger"):
    return (
        f", {REGIONS}, means AS (SELECT model, supercategory, avg(accuracy) AS mean_accuracy, count(*) AS n, min(seq) AS first "
        f"FROM {ledger} AS l JOIN regions ON l.subject = regions.subject GROUP BY model, supercategory)"
    )


QUOTED = ", ".join(f'"{c}"' for c in CATS)


@query(
    "leaderboard",
    sql_report(WITH_LEDGER + means_with_order(), CATS, len(CATS))
    + f" SELECT CAST(row_number() OVER (ORDER BY round(average, 9) DESC, seq, model) AS INT) AS rank, model, {QUOTED}, round(average, 6) AS average FROM grouped",
)
def leaderboard(spark, sf):
    board = report.leaderboard(exam_ledger(spark, sf), fx.subject_supercategory(spark, sf), CATS, None)
    return rounded(board, *CATS, "average")


@query(
    "leaderboard_gated",
    sql_report(WITH_LEDGER + means_with_order(), CATS, len(CATS))
    + f" SELECT CAST(row_number() OVER (ORDER BY round(average, 9) DESC, seq, model) AS INT) AS rank, model, {QUOTED}, round(average, 6) AS average "
    f"FROM grouped WHERE n_rows = {fx.N_SUBJECTS}",
)
def leaderboard_gated(spark, sf):
    board = report.leaderboard(exam_ledger(spark, sf), fx.subject_supercategory(spark, sf), CATS, fx.N_SUBJECTS)
    return rounded(board, *CATS, "average")


@query(
    "leaderboard_lines",
    sql_report(LINE_LEDGER + means_with_order(), CATS, len(CATS))
    + f" SELECT CAST(row_number() OVER (ORDER BY round(average, 9) DESC, seq, model) AS INT) AS rank, model, {QUOTED}, round(average, 6) AS average "
    f"FROM grouped WHERE n_rows = {fx.N_SUBJECTS}",
)
def leaderboard_lines(spark, sf):
    ledger = report.accuracy_by_subject(scoring.marks(fx.line_exam(spark, sf), "few_shot"), order="qid")
    board = report.leaderboard(ledger, fx.subject_supercategory(spark, sf), CATS, fx.N_SUBJECTS)
    return rounded(board, *CATS, "average")


# Users as models, event types as subjects: many have no value for some subject.
EVENT_CATEGORY = "CASE WHEN event_type IN ('click', 'view') THEN 'reading' ELSE 'acting' END"
# Whole pairs of user and event type stand for tasks not done yet.
DONE = "(user_id + length(event_type)) % 7 <> 0"
EVENT_MEANS = (
    f"WITH e AS (SELECT CAST(user_id AS STRING) AS model, event_type AS subject, avg(value) AS accuracy FROM events GROUP BY user_id, event_type HAVING {DONE}), "
    f"means AS (SELECT model, {EVENT_CATEGORY.replace('event_type', 'subject')} AS category, avg(accuracy) AS mean_accuracy, count(*) AS n, "
    "min(subject) AS first FROM e GROUP BY 1, 2)"
)


def event_ledger(spark, sf):
    rows = fx.table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("accuracy")).where(DONE)
    return rows.select(F.col("user_id").cast("string").alias("model"), F.col("event_type").alias("subject"), "accuracy")


def event_categories(spark, sf):
    kinds = fx.table(spark, sf, "events").select(F.col("event_type").alias("subject"), F.expr(EVENT_CATEGORY).alias("category"))
    return kinds.distinct()


@query(
    "incomplete_models",
    f"{EVENT_MEANS} SELECT model, CAST(sum(n) AS BIGINT) AS n_rows, {sql_pivot(['reading', 'acting'], 'category')}, "
    "round(sum(mean_accuracy) / 2, 6) AS average FROM means GROUP BY model HAVING sum(n) <> 5",
)
def incomplete_models(spark, sf):
    ledger = event_ledger(spark, sf).withColumn("seq", F.col("subject"))
    out = report.incomplete_models(ledger, event_categories(spark, sf), ["reading", "acting"], 5, "category")
    return rounded(out, "reading", "acting", "average")


# A run in progress: some models still lack whole subjects.
SAT = "NOT (model < 'C' AND right(subject, 1) IN ('1', '3'))"


@query(
    "incomplete_exam_models",
    f"WITH {fx.exam_sql()}, "
    + fx.marked_sql("zero_shot")
    + ", ledger AS (SELECT model, subject, min(qid) AS seq, 100.0 * sum(correctness) / count(correctness) AS accuracy FROM marked "
    f"GROUP BY model, subject HAVING {SAT})"
    + means_with_order()
    + f" SELECT model, CAST(sum(n) AS BIGINT) AS n_rows, {sql_pivot(CATS)}, round(sum(mean_accuracy) / 5, 6) AS average "
    f"FROM means GROUP BY model HAVING sum(n) <> {fx.N_SUBJECTS}",
)
def incomplete_exam_models(spark, sf):
    ledger = report.accuracy_by_subject(scoring.marks(fx.exam(spark, sf), "zero_shot"), order="qid").where(SAT)
    out = report.incomplete_models(ledger, fx.subject_supercategory(spark, sf), CATS, fx.N_SUBJECTS)
    return rounded(out, *CATS, "average")


STAT = "count(CASE WHEN split = '{}' THEN 1 END)"


@query(
    "bank_stats",
    f"WITH {fx.BANK_SQL}, {fx.SUBJECTS_SQL} SELECT category, subjects.subject, "
    "CAST(grouping(category) * 2 + grouping(subjects.subject) AS BIGINT) AS level, "
    + ", ".join(f"{STAT.format(s)} AS n_{s}" for s in ("train", "validation", "test"))
    + ", count(*) AS n_total FROM bank JOIN subjects ON bank.subject = subjects.subject GROUP BY ROLLUP (category, subjects.subject)",
)
def bank_stats(spark, sf):
    return report.bank_stats(fx.bank(spark, sf), fx.subjects(spark, sf))


# --- built-in subject sets -----------------------------------------------------------------


def _values(exam: str) -> str:
    rows = ", ".join(f"({i}, '{s}', '{c}')" for i, (s, _, c) in enumerate(dims.subject_rows(exam)))
    return f"d AS (SELECT * FROM (VALUES {rows}) AS t(place, subject, category))"


def built_in_ledger(spark, sf, exam):
    """Order prices as accuracies of the exam's subjects, one row per model and subject."""
    names = [s for s, _, _ in dims.subject_rows(exam)]
    rows = fx.table(spark, sf, "orders").join(fx.table(spark, sf, "customer"), F.expr("o_custkey = c_custkey"))
    subject = F.element_at(F.array(*map(F.lit, names)), (F.col("o_custkey") % len(names) + 1).cast("int"))
    grouped = rows.groupBy(F.col("c_mktsegment").alias("model"), subject.alias("subject"))
    return grouped.agg(F.avg("o_totalprice").alias("accuracy"), F.min("o_orderkey").alias("seq"))


def built_in_sql(exam):
    n = len(dims.subject_rows(exam))
    return (
        f"WITH {_values(exam)}, l AS (SELECT c_mktsegment AS model, o_custkey % {n} AS place, avg(o_totalprice) AS accuracy, "
        f"min(o_orderkey) AS seq FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"
    )


def _flat_category(name, exam):
    @query(
        name,
        built_in_sql(exam)
        + " SELECT model, category, round(avg(accuracy), 4) AS mean_accuracy, count(*) AS n_subjects "
        "FROM l JOIN d ON l.place = d.place GROUP BY model, category",
    )
    def run(spark, sf):
        means = report.macro_by_category(built_in_ledger(spark, sf, exam), dims.subjects(spark, exam), "category")
        return means.withColumn("mean_accuracy", F.round("mean_accuracy", 4))


_flat_category("macro_flat_category", "cmmlu")
_flat_category("macro_flat_category_levels", "ceval")

TOPS = list(fixed.HIERARCHY)
TOP_OF = "CASE " + " ".join(f"WHEN category = '{c}' THEN '{t}'" for t, names in fixed.HIERARCHY.items() for c in names) + " END"


@query(
    "leaderboard_default_exam",
    built_in_sql("traditional")
    + f", m AS (SELECT model, {TOP_OF} AS top, avg(accuracy) AS mean_accuracy, count(*) AS n, min(seq) AS first "
    "FROM l JOIN d ON l.place = d.place GROUP BY 1, 2), "
    "g AS (SELECT model, sum(n) AS n_rows, min(first) AS seq, sum(mean_accuracy) / 4 AS mean, "
    + ", ".join(f"""round(max(CASE WHEN top = '{t}' THEN mean_accuracy END), 4) AS "{t}" """ for t in TOPS)
    + " FROM m GROUP BY model) SELECT CAST(row_number() OVER (ORDER BY round(mean, 9) DESC, seq, model) AS INT) AS rank, model, "
    + ", ".join(f'"{t}"' for t in TOPS)
    + ", round(mean, 4) AS average FROM g WHERE n_rows = 66",
)
def leaderboard_default_exam(spark, sf):
    dimension = dims.subjects(spark, "traditional").join(dims.hierarchy_frame(spark), "category")
    board = report.leaderboard(built_in_ledger(spark, sf, "traditional"), dimension, TOPS, 66)
    return board.select("rank", "model", *[F.round(F.col(f"`{c}`"), 4).alias(c) for c in [*TOPS, "average"]])


# --- running counts -------------------------------------------------------------------------

RUNNING = (
    f"WITH {fx.exam_sql()}, {fx.marked_sql('zero_shot')} SELECT qid, model, subject, "
    "CAST(sum(correctness) OVER w AS BIGINT) AS n_correct, count(*) OVER w AS n_rows FROM marked "
    "WINDOW w AS (PARTITION BY model, subject ORDER BY qid ROWS UNBOUNDED PRECEDING)"
)


@query("running_accuracy", RUNNING)
def running_accuracy(spark, sf):
    marked = exam_marks(spark, sf).select("qid", "model", "subject", "correctness")
    totals = {"n_correct": F.col("correctness"), "n_rows": F.lit(1)}
    out = running_totals(marked, ["model", "subject"], "qid", totals)
    return out.select("qid", "model", "subject", "n_correct", "n_rows")


@query("accuracy_incremental", f"{WITH_LEDGER} SELECT model, subject, n_rows, n_correct, accuracy FROM ledger")
def accuracy_incremental(spark, sf):
    """Marks that arrive in three appends; the state is brought up to date after the first and after the last."""
    scored, state = session.fresh_path(spark, "marks"), session.fresh_path(spark, "totals")
    marked = exam_marks(spark, sf).select("model", "subject", "correctness", F.lit(False).alias("failed"), F.pmod("qid", F.lit(3)).alias("part"))
    marked = session.written(marked, "marked")
    for part in range(3):
        commits.append(marked.where(F.col("part") == part).drop("part"), scored)
        if part != 1:
            incremental.refresh(spark, scored, state)
    return incremental.accuracy(spark, state).select("model", "subject", "n_rows", "n_correct", "accuracy")
