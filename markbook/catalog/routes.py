"""Queries of scans, routing, templates, run bookkeeping, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from markbook import session
from markbook.catalog import fixtures as fx
from markbook.catalog.registry import query
from markbook.functions import scoring
from markbook.operators import report, routing, runs
from markbook.sources import bank as bank_source
from markbook.sources import commits, dims, results


@query(
    "scan_questions",
    f"WITH {fx.BANK_SQL} SELECT subject, row_idx, question, A AS a, B AS b, C AS c, D AS d, answer FROM bank WHERE split = 'test'",
)
def scan_questions(spark, sf):
    rows = bank_source.scan_split(fx.bank(spark, sf), "test")
    return rows.select("subject", "row_idx", "question", *[F.col(c).alias(c.lower()) for c in "ABCD"], "answer")


@query(
    "subject_semi",
    f"WITH {fx.SUBJECTS_SQL} SELECT * FROM subjects WHERE subject IN "
    "(SELECT n_name FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) % 3 <> 0)",
)
def subject_semi(spark, sf):
    rows = fx.table(spark, sf, "customer").join(fx.table(spark, sf, "nation"), F.expr("c_nationkey = n_nationkey"))
    tasks = rows.groupBy(F.col("n_name").alias("subject")).count().where("count % 3 <> 0")
    return runs.known_subjects(fx.subjects(spark, sf), tasks)


DATASET = (
    "CASE doc_id % 5 WHEN 0 THEN 'Exams/TW-' || lang WHEN 1 THEN 'host/CMMLU-' || source "
    "WHEN 2 THEN 'host/C-Eval-' || lang WHEN 3 THEN 'exams/tw/cmmlu' ELSE 'host/' || source END"
)


@query(
    "dataset_route",
    f"WITH d AS (SELECT doc_id, {DATASET} AS dataset FROM documents) SELECT doc_id, dataset, "
    "CASE WHEN contains(lower(dataset), 'exams/tw') THEN 'traditional' WHEN contains(lower(dataset), '/cmmlu') THEN 'cmmlu' "
    "WHEN contains(lower(dataset), '/c-eval') THEN 'ceval' END AS exam FROM d",
)
def dataset_route(spark, sf):
    rows = fx.table(spark, sf, "documents").select("doc_id", F.expr(DATASET).alias("dataset"))
    return rows.withColumn("exam", routing.exam_of(F.col("dataset"), "exams/tw", on_unknown="null"))


MODEL_NAMES = [
    "models/gemini-pro", "gpt-4-0613", "claude-2", "Qwen/Qwen-7B-Chat", "Qwen/Qwen-72B", "qwen-max",
    "mixtral-8x7b", "reka-flash", "meta/llama-3", "Gemini-ultra", "my-gpt-4-qwen", "QWEN-CHAT",
]
SERIES_NAMES = [*routing.SERIES, "", "dashscope", "mixtral"]
MODEL = "CASE c_custkey % 12 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MODEL_NAMES)) + " END || '-' || c_name"
SERIES = "CASE c_custkey % 14 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SERIES_NAMES)) + " END"


@query(
    "model_route",
    f"WITH m AS (SELECT c_custkey, {MODEL} AS model, {SERIES} AS series FROM customer) SELECT c_custkey, model, series, "
    "CASE " + " ".join(f"WHEN series = '{s}' THEN '{b}'" for s, b in routing.SERIES.items())
    + " WHEN model LIKE '%gemini%' THEN 'gemini' WHEN model LIKE '%gpt-%' THEN 'chatgpt' WHEN model LIKE '%claude%' THEN 'claude' "
    "WHEN model LIKE '%Qwen%' AND lower(model) LIKE '%chat%' THEN 'hf_chat' WHEN model LIKE '%Qwen%' THEN 'hf_base' "
    "WHEN model LIKE '%qwen%' THEN 'dashscope' WHEN model LIKE '%mixtral%' THEN 'mixtral' WHEN model LIKE '%reka-%' THEN 'reka' "
    "ELSE 'tgi' END AS backend FROM m",
)
def model_route(spark, sf):
    rows = fx.table(spark, sf, "customer").select("c_custkey", F.expr(MODEL).alias("model"), F.expr(SERIES).alias("series"))
    return rows.withColumn("backend", routing.backend_of(F.col("model"), F.col("series")))


BACKEND_NAMES = [
    "tgi", "groq", "together", "claude", "reka", "chatgpt", "breeze", "azure", "oai_complete", "dashscope", "gemini", "hf_chat", "mixtral",
]
BACKEND = "CASE c_custkey % 13 " + " ".join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(BACKEND_NAMES)) + " END"


@query(
    "gen_params",
    f"WITH m AS (SELECT c_custkey, {BACKEND} AS backend, floor(c_acctbal) % 2 = 0 AS cot FROM customer) SELECT c_custkey, backend, cot, "
    "CASE WHEN backend IN ('tgi', 'groq', 'together') THEN CASE WHEN cot THEN 800 ELSE 200 END "
    "WHEN backend = 'claude' THEN CASE WHEN cot THEN 1200 ELSE 400 END WHEN backend = 'reka' THEN CASE WHEN cot THEN 1000 ELSE 400 END "
    "WHEN backend IN ('chatgpt', 'breeze') THEN 800 END AS max_tokens, "
    "CASE WHEN backend = 'tgi' THEN 0.001 WHEN backend = 'claude' THEN 0.1 WHEN backend = 'mixtral' THEN 0.2 "
    "WHEN backend IN ('groq', 'together', 'reka', 'chatgpt', 'breeze', 'azure', 'oai_complete') THEN 0.0 END::DOUBLE AS temperature FROM m",
)
def gen_params(spark, sf):
    rows = fx.table(spark, sf, "customer").select(
        "c_custkey", F.expr(BACKEND).alias("backend"), F.expr("floor(c_acctbal) % 2 = 0").alias("cot")
    )
    params = rows.withColumn("p", routing.backend_params(F.col("backend"), F.col("cot")))
    return params.select("c_custkey", "backend", "cot", "p.max_tokens", "p.temperature")


# --- role tokens: one template row per part, brand names repeat ------------------------

TEMPLATE = {
    "model_name": "p_brand",
    "file_order": "CAST(p_partkey AS INT)",
    "system_token": "'<' || p_type || '>'",
    "end_token": "p_name",
    "assistant_token": "'A' || CAST(p_size AS STRING)",
    "user_token": "CASE WHEN p_size % 2 = 0 THEN '' ELSE 'U' || CAST(p_partkey AS STRING) END",
}
ASKED = "'Brand#' || CAST(s_suppkey % 30 AS STRING)"
GIVEN = "CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'usr' || CAST(s_suppkey AS STRING) END"
TOKENS = ["system_token", "end_token", "assistant_token", "user_token"]
FIRST_TEMPLATES = (
    f"WITH t AS (SELECT {fx.select_list(TEMPLATE)} FROM part), f AS (SELECT * FROM t "
    "QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY file_order) = 1), "
    f"m AS (SELECT s_suppkey, {ASKED} AS model_name, {GIVEN} AS usr FROM supplier) "
)


def templates(spark, sf):
    return fx.table(spark, sf, "part").select(*fx.columns(TEMPLATE))


@query("supported_models", "SELECT p_brand AS model_name FROM part")
def supported_models(spark, sf):
    return routing.supported_models(templates(spark, sf))


@query("template_lookup", FIRST_TEMPLATES + f"SELECT s_suppkey, m.model_name, {', '.join(TOKENS)} FROM m LEFT JOIN f ON m.model_name = f.model_name")
def template_lookup(spark, sf):
    models = fx.table(spark, sf, "supplier").select("s_suppkey", F.expr(ASKED).alias("model_name"))
    found = routing.with_tokens(models, templates(spark, sf), on_missing="null")
    return found.select("s_suppkey", "model_name", *[F.col("tokens")[t].alias(t) for t in TOKENS])


@query(
    "template_override",
    FIRST_TEMPLATES
    + "SELECT s_suppkey, m.model_name, "
    + ", ".join(
        f"CASE WHEN length(usr) > 0 THEN {given} ELSE {token} END AS {token}"
        for token, given in zip(TOKENS, ["'sys'", "'eos'", "'ast'", "usr"])
    )
    + " FROM m LEFT JOIN f ON m.model_name = f.model_name",
)
def template_override(spark, sf):
    given = F.struct(
        F.lit("sys").alias("system_token"), F.lit("eos").alias("end_token"), F.lit("ast").alias("assistant_token"), F.expr(GIVEN).alias("user_token")
    )
    models = fx.table(spark, sf, "supplier").select("s_suppkey", F.expr(ASKED).alias("model_name"), given.alias("given"))
    found = routing.with_tokens(models, templates(spark, sf), given="given", on_missing="null")
    return found.select("s_suppkey", "model_name", *[F.col("tokens")[t].alias(t) for t in TOKENS])


# --- run bookkeeping --------------------------------------------------------------------

KEY = {
    "dataset": "'org/' || lower(o_orderstatus) || '-exam'",
    "model": "'team/' || o_orderpriority",
    "top_k": "CAST(o_custkey % 6 AS INT)",
    "with_steps": "o_orderkey % 2 = 0",
    "simplified": "o_orderkey % 3 = 0",
}


@query(
    "run_key",
    f"WITH r AS (SELECT o_orderkey, {fx.select_list(KEY)} FROM orders) SELECT o_orderkey, split_part(dataset, '/', -1) AS exam, "
    "split_part(model, '/', -1) AS model_base, top_k, with_steps AS cot, "
    "CASE WHEN simplified THEN 'simplified' ELSE 'traditional' END AS script, "
    "split_part(dataset, '/', -1) || '_' || split_part(model, '/', -1) || CASE WHEN top_k > 0 THEN '_top_' || CAST(top_k AS STRING) ELSE '' END "
    "|| CASE WHEN with_steps THEN '_cot' ELSE '' END || CASE WHEN simplified THEN '_zhs' ELSE '' END || '.tsv' AS ledger_name FROM r",
)
def run_key(spark, sf):
    rows = fx.table(spark, sf, "orders").select("o_orderkey", *fx.columns(KEY))
    key = runs.run_key(*[F.col(c) for c in ("dataset", "model", "top_k", "with_steps", "simplified")])
    return rows.select("o_orderkey", *[c.alias(n) for n, c in key.items()])


def _capped(name, n, group):
    sql = (
        f"WITH {fx.exam_sql()} SELECT {group} AS subject, qid AS row_idx FROM exam "
        f"QUALIFY row_number() OVER (PARTITION BY {group} ORDER BY qid) <= {n}"
    )

    @query(name, sql)
    def run(spark, sf):
        rows = fx.exam(spark, sf).select(F.col(group).alias("subject"), F.col("qid").alias("row_idx"))
        return runs.cap_samples(rows, n)


_capped("max_samples", 20, "subject")
_capped("max_samples_large", 2000, "model")


@query("distinct_models", f"WITH {fx.LEDGER_SQL} SELECT DISTINCT model FROM ledger")
def distinct_models(spark, sf):
    return runs.distinct_models(exam_ledger(spark, sf))


FINISHED = "o_totalprice > 490000"


@query(
    "resume_anti",
    f"WITH {fx.exam_sql({'finished': FINISHED})}, tasks AS (SELECT DISTINCT model, subject FROM exam) SELECT model, subject FROM tasks "
    "WHERE (model, subject) NOT IN (SELECT (model, subject) FROM exam WHERE finished)",
)
def resume_anti(spark, sf):
    rows = fx.exam(spark, sf, {"finished": FINISHED})
    return runs.pending_tasks(rows.select("model", "subject").distinct(), rows.where("finished"))


BY_SUBJECT = "o_totalprice > 499500"


@query(
    "resume_anti_subject",
    f"WITH {fx.exam_sql({'finished': BY_SUBJECT})}, tasks AS (SELECT DISTINCT model, subject FROM exam) SELECT model, subject FROM tasks "
    "WHERE subject NOT IN (SELECT subject FROM exam WHERE finished)",
)
def resume_anti_subject(spark, sf):
    rows = fx.exam(spark, sf, {"finished": BY_SUBJECT})
    return runs.pending_tasks(rows.select("model", "subject").distinct(), rows.where("finished"), ["subject"])


@query(
    "subject_name_join",
    f"WITH {fx.exam_sql()}, {fx.SUBJECTS_SQL} SELECT qid, exam.subject, name FROM exam LEFT JOIN subjects ON exam.subject = subjects.subject",
)
def subject_name_join(spark, sf):
    return runs.with_names(fx.exam(spark, sf).select("qid", "subject"), fx.subjects(spark, sf)).select("qid", "subject", "name")


@query(
    "category_join",
    f"WITH {fx.exam_sql()}, {fx.SUBJECTS_SQL}, {fx.HIERARCHY_SQL} SELECT qid, exam.subject, subjects.category, hierarchy.supercategory "
    "FROM exam LEFT JOIN subjects ON exam.subject = subjects.subject LEFT JOIN hierarchy ON subjects.category = hierarchy.category",
)
def category_join(spark, sf):
    hierarchy = dims.invert_hierarchy(fx.hierarchy_map(spark, sf), "hierarchy")
    rows = fx.exam(spark, sf).select("qid", "subject")
    return runs.with_categories(rows, fx.subjects(spark, sf), hierarchy).select("qid", "subject", "category", "supercategory")


@query(
    "model_question_cross",
    f"WITH {fx.BANK_SQL}, tasks AS (SELECT DISTINCT c_mktsegment AS model, n_name AS subject FROM customer JOIN nation ON c_nationkey = n_nationkey) "
    "SELECT model, bank.subject, row_idx FROM bank JOIN tasks ON bank.subject = tasks.subject WHERE split = 'test'",
)
def model_question_cross(spark, sf):
    tasks = fx.table(spark, sf, "customer").join(fx.table(spark, sf, "nation"), F.expr("c_nationkey = n_nationkey"))
    tasks = tasks.select(F.col("c_mktsegment").alias("model"), F.col("n_name").alias("subject")).distinct()
    questions = fx.bank(spark, sf).where(F.col("split") == "test").select("subject", "row_idx")
    return runs.questions_per_model(questions, tasks).select("model", "subject", "row_idx")


@query(
    "merge_runs",
    "SELECT doc_id, 'quality' AS model, quality AS correctness FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels",
)
def merge_runs(spark, sf):
    labels = fx.table(spark, sf, "labels")
    parts = [labels.select("doc_id", F.lit(m).alias("model"), F.col(m).alias("correctness")) for m in ("quality", "toxic")]
    return runs.merge_runs(*parts)


# --- sinks -------------------------------------------------------------------------------


def exam_marks(spark, sf):
    return scoring.marks(fx.exam(spark, sf), "zero_shot")


def exam_ledger(spark, sf):
    return report.accuracy_by_subject(exam_marks(spark, sf), order="qid")


@query(
    "sink_roundtrip",
    f"WITH {fx.exam_sql()}, {fx.marked_sql('zero_shot')} SELECT qid, model, subject, response AS model_output, correctness FROM marked",
)
def sink_roundtrip(spark, sf):
    path = session.fresh_path(spark, "scored")
    marked = exam_marks(spark, sf).select("qid", "model", "subject", F.col("response").alias("model_output"), "correctness")
    results.write_scored(marked, path)
    return results.read_scored(spark, path, marked.schema).select(*marked.columns)


@query(
    "ledger_roundtrip",
    f"WITH {fx.LEDGER_SQL} SELECT model, subject, CAST(printf('%.5f', accuracy) AS DOUBLE) AS accuracy FROM ledger",
)
def ledger_roundtrip(spark, sf):
    path = session.fresh_path(spark, "ledger")
    results.append_ledger(exam_ledger(spark, sf), path)
    return results.read_ledger(spark, path).drop("seq")


@query(
    "ledger_committed",
    f"WITH {fx.LEDGER_SQL} SELECT 'run ' || CAST(n AS VARCHAR) AS run, model, subject, CASE WHEN n = 1 AND length(model) % 2 = 0 THEN 0.0 ELSE accuracy END AS accuracy "
    "FROM ledger, range(2) AS runs(n)",
)
def ledger_committed(spark, sf):
    """Two runs in one ledger: one appended twice, one corrected for some models, and an append that broke off before its commit."""
    path = session.fresh_path(spark, "ledger")
    ledger = exam_ledger(spark, sf).withColumn("content", F.lit("c"))
    first, second = (ledger.withColumn("run", F.lit(f"run {n}")) for n in range(2))
    for rows in (first, first, second, second.where("length(model) % 2 = 0").withColumn("accuracy", F.lit(0.0))):
        results.commit_ledger(rows, path)
    commits.write(first.withColumn("accuracy", F.lit(-1.0)).select("run", "model", "subject", "accuracy", "content"), path)
    return results.committed_ledger(spark, path).select("run", "model", "subject", "accuracy")


UPSERT_KEYS = "c_mktsegment AS model, 'nation ' || CAST(c_nationkey AS VARCHAR) AS subject, o_custkey % 50 AS row_idx"
UPSERT = {
    "correctness": "CAST(o_orderkey % 2 AS INT)",
    # One version per key at most: the order's number.
    "version": "o_orderkey",
}


@query(
    "merge_upsert",
    f"WITH r AS (SELECT {UPSERT_KEYS}, {fx.select_list(UPSERT)} FROM orders JOIN customer ON o_custkey = c_custkey) "
    "SELECT model, subject, row_idx, max_by(correctness, version) AS correctness, max(version) AS version FROM r GROUP BY model, subject, row_idx",
)
def merge_upsert(spark, sf):
    """Runs that overlap, one of them repeated, merged oldest last."""
    path = session.fresh_path(spark, "upsert")
    rows = fx.table(spark, sf, "orders").join(fx.table(spark, sf, "customer"), F.expr("o_custkey = c_custkey"))
    rows = rows.select(F.col("c_mktsegment").alias("model"), F.expr("'nation ' || CAST(c_nationkey AS STRING)").alias("subject"), F.expr("o_custkey % 50").alias("row_idx"), *fx.columns(UPSERT))
    for part in (rows.where("version % 3 = 2"), rows.where("version % 3 = 1"), rows.where("version % 3 = 1"), rows.where("version % 3 = 0 OR row_idx < 9")):
        results.upsert_scored(part, path, key=("model", "subject", "row_idx"))
    return results.read_scored(spark, path, rows.schema)
