"""Inference queries with deterministic stand-ins for a model, and whole evaluations.

A stand-in answers from the prompt text alone, so SQL can say what it replies.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from markbook import fixed_values as fixed
from markbook import session
from markbook.catalog import fixtures as fx
from markbook.catalog.prompting import BASE_STEM, BLOCK, INSTRUCT_STEM, K, OPTIONS, PAIR_ANSWER, PAIR_QUERY, SYSTEM, USER, sql_text
from markbook.catalog.registry import query
from markbook.functions import blocks, scoring
from markbook.functions.text import Script
from markbook.operators import inference
from markbook.operators.inference import ServerError
from markbook.plans.backends import BACKENDS
from markbook.plans.evaluate import build_prompts, evaluate
from markbook.sources import commits, replies, results

cloudpickle.register_pickle_by_value(sys.modules[__name__])



def options(spark) -> dict:
    """Stand-ins never wait; a prompt table in one file is spread over the cores."""
    return {"backoff": 0.0, "concurrency": spark.sparkContext.defaultParallelism}


def letter_model():
    """Replies with a letter that depends on the prompt's length."""
    return lambda prompts, params: [f"答案：{'ABCD'[len(p) % 4]}<|im_end|>more" for p in prompts]


def _letter(prompt):
    return "ABCD"[len(prompt) % 4]


def worked_model():
    """The same letter at the end of a worked answer."""
    return lambda prompts, params: [f"讓我們一步一步思考，\n所以答案是{_letter(p)}。" for p in prompts]


def bare_model():
    """The letter alone."""
    return lambda prompts, params: [_letter(p) for p in prompts]


def vector_model():
    """A score vector whose largest value is the letter's."""
    return lambda prompts, params: [str([float(c == _letter(p)) for c in "ABCD"]) for p in prompts]


def summed_model():
    """Two vectors that only together put the letter first."""

    def call(prompts, params):
        out = []
        for p in prompts:
            place = len(p) % 4
            one, two = [0.0] * 4, [0.0] * 4
            one[place], two[place], one[(place + 1) % 4], two[(place + 2) % 4] = 2.0, 2.0, 3.0, 3.0
            out.append(str([one, two]))
        return out

    return call


def failing_model():
    """Answers with a letter, but never where the prompt's length leaves 1 by 5."""
    return lambda prompts, params: [ConnectionError("down") if len(p) % 5 == 1 else f"答案：{_letter(p)}" for p in prompts]


def flaky_model():
    """Depending on the prompt's length: late twice, always failing, silent, or fine."""
    rounds: dict[str, int] = {}

    def call(prompts, params):
        for p in set(prompts):
            rounds[p] = rounds.get(p, 0) % 3 + 1
        out = []
        for p, o in zip(prompts, params):
            kind = len(p) % 5
            if kind == 0 and rounds[p] < 3:
                out.append(TimeoutError("timeout=600"))
            elif kind == 1:
                out.append(ValueError("bad reply"))
            else:
                out.append(None if kind == 2 else f"ok {o['max_tokens']}")
        return out

    return call


def picky_model():
    """Rejects exotic brackets outright, and texts of one length whatever they hold."""

    def call(prompts, params):
        return [
            ServerError("rejected") if any(c in p for c in "【】（）") or len(p) % 3 == 0 else f"{o['temperature']} {p}"
            for p, o in zip(prompts, params)
        ]

    return call


def judge_model():
    """Names the first answer letter of the response, wrapped in white space."""

    def call(prompts, params):
        out = []
        for prompt in prompts:
            response = prompt.split("RESPONSE: ", 1)[1]
            out.append(" " + next((c for c in response if c in "ABCD"), "unknown") + "\n")
        return out

    return call


@query(
    "batch_generate",
    f"WITH {fx.BANK_SQL} SELECT subject, row_idx, '答案：' || substr('ABCD', CAST(length({BLOCK}) % 4 AS INT) + 1, 1) AS response, "
    "'ok' AS status, 1 AS attempts FROM bank WHERE split = 'test'",
)
def batch_generate(spark, sf):
    rows = fx.bank(spark, sf).where(F.col("split") == "test").select("subject", "row_idx", blocks.question_block().alias("prompt"))
    out = inference.batch_generate(rows, letter_model, **options(spark))
    return inference.clean_response(out, F.lit("<|im_end|>")).select("subject", "row_idx", "response", "status", "attempts")


@query(
    "retry_status",
    "WITH k AS (SELECT doc_id, length(text) % 5 AS kind FROM documents) SELECT doc_id, "
    "CASE WHEN kind IN (0, 3, 4) THEN 'ok 200' END AS response, "
    "CASE kind WHEN 1 THEN 'error' WHEN 2 THEN 'empty' ELSE 'ok' END AS status, "
    "CASE WHEN kind IN (0, 1) THEN 3 ELSE 1 END AS attempts, CASE WHEN kind = 1 THEN 'ValueError: bad reply' END AS error FROM k",
)
def retry_status(spark, sf):
    rows = fx.table(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt"))
    params = F.struct(F.lit(200).alias("max_tokens"), F.lit(0.0).alias("temperature"))
    out = inference.batch_generate(rows, flaky_model, params=params, max_attempts=3, **options(spark))
    return out.select("doc_id", "response", "status", "attempts", "error")


ASKED = "CASE WHEN doc_id % 2 = 0 THEN translate(text, 'aeio', '【】（）') ELSE text END"
FOLDED = f"translate({ASKED}, '【】（）', '[]()')"


@query(
    "retry_alternate",
    f"WITH p AS (SELECT doc_id, {ASKED} AS asked, {FOLDED} AS folded FROM documents), "
    "r AS (SELECT *, asked <> folded AS exotic, length(asked) % 3 = 0 AS odd FROM p) SELECT doc_id, "
    "CASE WHEN odd THEN NULL WHEN exotic THEN '0.3 ' || folded ELSE '0.0 ' || asked END AS response, "
    "CASE WHEN odd THEN 'server_error' ELSE 'ok' END AS status, CASE WHEN odd OR exotic THEN 2 ELSE 1 END AS attempts FROM r",
)
def retry_alternate(spark, sf):
    rows = fx.table(spark, sf, "documents").select("doc_id", F.expr(ASKED).alias("prompt"))
    params = F.struct(F.lit(800).alias("max_tokens"), F.lit(0.0).alias("temperature"))
    out = inference.batch_generate(rows, picky_model, params=params, fold_on_server_error=True, **options(spark))
    return out.select("doc_id", "response", "status", "attempts")


TRIMMED = fx.sql_strip("coalesce(response, '')")
JUDGED = f"CASE WHEN {TRIMMED} = '' THEN '' ELSE coalesce(nullif(regexp_extract({TRIMMED}, '[A-D]'), ''), 'unknown') END"


@query("judge_extract", f"WITH {fx.exam_sql()} SELECT qid, {JUDGED} AS judged FROM exam")
def judge_extract(spark, sf):
    return inference.judge(fx.exam(spark, sf), judge_model, **options(spark)).select("qid", "judged")


@query(
    "judge_callable",
    "SELECT item_id, ' ' || coalesce(nullif(regexp_extract(text, '[A-D]'), ''), 'unknown') || chr(10) AS judged FROM benchmark",
)
def judge_callable(spark, sf):
    rows = fx.table(spark, sf, "benchmark")
    return inference.judge(rows, judge_model, "text", unknown=True, strip_reply=False, **options(spark)).select("item_id", "judged")


@query(
    "score_judge",
    f"WITH {fx.exam_sql()}, j AS (SELECT qid, answer, {TRIMMED} AS text, {JUDGED} AS judged FROM exam) "
    "SELECT qid, judged, CASE WHEN text <> '' AND judged = answer THEN 1 ELSE 0 END AS correctness FROM j",
)
def score_judge(spark, sf):
    judged = inference.judge(fx.exam(spark, sf), judge_model, **options(spark))
    return scoring.marks(judged, "judge", judged="judged").select("qid", "judged", "correctness")


# --- whole evaluations: bank x models, prompts, replies, marks, accuracies --------------------

TASKS_SQL = "tasks AS (SELECT DISTINCT c_mktsegment AS model, n_name AS subject FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def tasks(spark, sf):
    rows = fx.table(spark, sf, "customer").join(fx.table(spark, sf, "nation"), F.expr("c_nationkey = n_nationkey"))
    return rows.select(F.col("c_mktsegment").alias("model"), F.col("n_name").alias("subject")).distinct()


def _evaluation(name, backend, sql, model=letter_model, **settings):
    @query(name, sql)
    def run(spark, sf):
        out = session.fresh_path(spark, name)
        done = evaluate(fx.bank(spark, sf), tasks(spark, sf), BACKENDS[backend], model, out, fx.subjects(spark, sf), **settings, **options(spark))
        return done.select("model", "subject", "n_rows", "n_correct", "accuracy")


ACCURACY = (
    "SELECT tasks.model, p.subject, count(*) AS n_rows, CAST(sum(hit) AS BIGINT) AS n_correct, 100.0 * sum(hit) / count(*) AS accuracy "
    "FROM p JOIN tasks ON p.subject = tasks.subject GROUP BY tasks.model, p.subject"
)
HIT = "CASE WHEN substr('ABCD', CAST(length({}) % 4 AS INT) + 1, 1) = answer THEN 1 ELSE 0 END AS hit"
SHOTS = (
    "shots AS (SELECT subject, string_agg({}, '' ORDER BY row_idx) AS context FROM (SELECT bank.*, name, "
    "row_number() OVER (PARTITION BY bank.subject ORDER BY row_idx) AS place FROM bank JOIN subjects ON bank.subject = subjects.subject "
    f"WHERE split = 'train') WHERE place <= {K} GROUP BY subject)"
)
TEST = "FROM bank JOIN subjects ON bank.subject = subjects.subject"


def chatml(role, content):
    return f"'<|im_start|>{role}' || chr(10) || {content} || '<|im_end|>'"


_evaluation(
    "evaluate_zero_shot",
    "tgi",
    f"WITH {fx.BANK_SQL}, {fx.SUBJECTS_SQL}, {TASKS_SQL}, p AS (SELECT bank.subject, "
    + HIT.format(f"{chatml('system', SYSTEM)} || {chatml('user', f'{USER} || {BLOCK}')} || '<|im_start|>assistant' || chr(10)")
    + f" {TEST} WHERE split = 'test') {ACCURACY}",
)
_evaluation(
    "evaluate_few_shot",
    "tgi",
    f"WITH {fx.BANK_SQL}, {fx.SUBJECTS_SQL}, {TASKS_SQL}, "
    + SHOTS.format(chatml("user", f"CASE WHEN place = 1 THEN {USER} ELSE '' END || {BLOCK}") + " || " + chatml("assistant", "answer"))
    + ", p AS (SELECT bank.subject, "
    + HIT.format(f"{chatml('system', SYSTEM)} || context || {chatml('user', BLOCK)} || '<|im_start|>assistant' || chr(10)")
    + f" {TEST} JOIN shots ON bank.subject = shots.subject WHERE split = 'test') {ACCURACY}",
    k=K,
)
_evaluation(
    "evaluate_lines",
    "dashscope",
    f"WITH {fx.BANK_SQL}, {fx.SUBJECTS_SQL}, {TASKS_SQL}, "
    + SHOTS.format(
        f"CASE WHEN place = 1 THEN {USER} ELSE '' END || {BLOCK} || chr(10) || "
        + sql_text("讓我們一步一步思考，\n{e}\n所以答案是{a}。", e="explanation", a="answer")
        + " || chr(10)"
    )
    + ", p AS (SELECT bank.subject, "
    + HIT.format(f"{SYSTEM} || chr(10) || context || {BLOCK} || chr(10)")
    + f" {TEST} JOIN shots ON bank.subject = shots.subject WHERE split = 'test') {ACCURACY}",
    worked_model,
    k=K,
    cot=True,
)
_evaluation(
    "evaluate_exact_only",
    "oai_complete",
    f"WITH {fx.BANK_SQL}, {fx.SUBJECTS_SQL}, {TASKS_SQL}, "
    + SHOTS.format(f"CASE WHEN place = 1 THEN {USER} ELSE '' END || {BLOCK} || chr(10) || answer || chr(10)")
    + ", p AS (SELECT bank.subject, "
    + HIT.format(f"{SYSTEM} || chr(10) || context || {BLOCK} || chr(10)")
    + f" {TEST} JOIN shots ON bank.subject = shots.subject WHERE split = 'test') {ACCURACY}",
    bare_model,
    k=K,
)


def sql_json(text):
    """A text as a JSON string."""
    return f"""('"' || replace(replace({text}, '"', '\\"'), chr(10), '\\n') || '"')"""


def sql_message(role, content):
    return f"""('{{"role":"{role}","content":' || {sql_json(content)} || '}}')"""


SEGMENT = f"{SYSTEM} || chr(10) || '問題: ' || {USER} || {BLOCK} || chr(10)"
_evaluation(
    "evaluate_segments",
    "gemini",
    f"WITH {fx.BANK_SQL}, {fx.SUBJECTS_SQL}, {TASKS_SQL}, p AS (SELECT bank.subject, "
    + HIT.format(f"'[' || {sql_json(SEGMENT)} || ']'")
    + f" {TEST} WHERE split = 'test') {ACCURACY}",
)
_evaluation(
    "evaluate_first_only",
    "chatgpt",
    f"WITH {fx.BANK_SQL}, {fx.SUBJECTS_SQL}, {TASKS_SQL}, "
    + SHOTS.format(f"CASE WHEN place = 1 THEN {sql_message('user', f'{USER} || {BLOCK}')} || ',' || {sql_message('assistant', 'answer')} ELSE '' END")
    + ", p AS (SELECT bank.subject, "
    + HIT.format(f"'[' || {sql_message('system', SYSTEM)} || ',' || context || ',' || {sql_message('user', BLOCK)} || ']'")
    + f" {TEST} JOIN shots ON bank.subject = shots.subject WHERE split = 'test') {ACCURACY}",
    k=K,
)
SYSTEM_MESSAGE, WHOLE_MESSAGE, BARE_MESSAGE = sql_message("system", SYSTEM), sql_message("user", f"{USER} || {BLOCK}"), sql_message("user", BLOCK)
ZERO_MESSAGES = f"'[' || {SYSTEM_MESSAGE} || ',' || {WHOLE_MESSAGE} || ']'"
_evaluation(
    "evaluate_groq",
    "groq",
    f"WITH {fx.BANK_SQL}, {fx.SUBJECTS_SQL}, {TASKS_SQL}, p AS (SELECT bank.subject, " + HIT.replace("{}", ZERO_MESSAGES) + f" {TEST} WHERE split = 'test') {ACCURACY}",
)
_evaluation(
    "evaluate_together",
    "together",
    f"WITH {fx.BANK_SQL}, {fx.SUBJECTS_SQL}, {TASKS_SQL}, "
    + SHOTS.replace("{}", "CASE WHEN place = 1 THEN '' ELSE ',' END || " + sql_message("user", f"CASE WHEN place = 1 THEN {USER} ELSE '' END || {BLOCK}") + " || ',' || " + sql_message("assistant", "answer"))
    + ", p AS (SELECT bank.subject, "
    + HIT.replace("{}", f"'[' || {SYSTEM_MESSAGE} || ',' || context || ',' || {BARE_MESSAGE} || ']'")
    + f" {TEST} JOIN shots ON bank.subject = shots.subject WHERE split = 'test') {ACCURACY}",
    k=K,
)
_evaluation(
    "evaluate_azure",
    "azure",
    f"WITH {fx.BANK_SQL}, {fx.SUBJECTS_SQL}, {TASKS_SQL}, "
    + SHOTS.replace("{}", f"CASE WHEN place = 1 THEN {WHOLE_MESSAGE} || ',' || {sql_message('assistant', 'answer')} ELSE '' END")
    + ", p AS (SELECT bank.subject, "
    + HIT.replace("{}", f"'[' || {SYSTEM_MESSAGE} || ',' || context || ',' || {BARE_MESSAGE} || ']'")
    + f" {TEST} JOIN shots ON bank.subject = shots.subject WHERE split = 'test') {ACCURACY}",
    k=K,
)
_evaluation(
    "evaluate_reka",
    "reka",
    f"WITH {fx.BANK_SQL}, {fx.SUBJECTS_SQL}, {TASKS_SQL}, p AS (SELECT bank.subject, "
    + HIT.replace("{}", f"{SYSTEM} || chr(10) || {USER} || {BLOCK} || chr(10)")
    + f" {TEST} WHERE split = 'test') {ACCURACY}",
)
SHOT_PAIR = (
    "CASE WHEN place = 1 THEN '' ELSE ',' END || '{{\"query\":' || "
    + sql_json(f"CASE WHEN place = 1 THEN {USER} ELSE '' END || {PAIR_QUERY}")
    + " || ',\"answer\":' || "
    + sql_json(PAIR_ANSWER)
    + " || '}}'"
)
_evaluation(
    "evaluate_pairs",
    "hf_chat",
    f"WITH {fx.BANK_SQL}, {fx.SUBJECTS_SQL}, {TASKS_SQL}, "
    + SHOTS.replace("{}", SHOT_PAIR.replace("{{", "{").replace("}}", "}"))
    + ", p AS (SELECT bank.subject, "
    + HIT.replace("{}", "'{\"history\":[' || context || '],\"query\":' || " + sql_json(PAIR_QUERY) + " || '}'")
    + f" {TEST} JOIN shots ON bank.subject = shots.subject WHERE split = 'test') {ACCURACY}",
    k=K,
)
_evaluation(
    "evaluate_scores",
    "hf_base",
    f"WITH {fx.BANK_SQL}, {fx.SUBJECTS_SQL}, {TASKS_SQL}, p AS (SELECT bank.subject, "
    + HIT.format(f"{BASE_STEM} || chr(10) || '答案：'")
    + f" {TEST} WHERE split = 'test') {ACCURACY}",
    vector_model,
)
_evaluation(
    "evaluate_summed_scores",
    "mixtral",
    f"WITH {fx.BANK_SQL}, {fx.SUBJECTS_SQL}, {TASKS_SQL}, p AS (SELECT bank.subject, "
    + HIT.format(f"'[INST] ' || {INSTRUCT_STEM} || chr(10) || '答案是什麼？讓我們一步一步思考，' || chr(10) || '1.' || ' [/INST]'")
    + f" {TEST} WHERE split = 'test') {ACCURACY}",
    summed_model,
    cot=True,
    with_prompt=True,
)
TOKENS = {"system": "S:", "end": "|", "assistant": "A:", "user": "U:"}
_evaluation(
    "evaluate_given_tokens",
    "tgi",
    f"WITH {fx.BANK_SQL}, {fx.SUBJECTS_SQL}, {TASKS_SQL}, p AS (SELECT bank.subject, "
    + HIT.format(f"'S:' || {SYSTEM} || '|U:' || {USER} || {BLOCK} || '|A:'")
    + f" {TEST} WHERE split = 'test') {ACCURACY}",
    tokens=TOKENS,
)
PLAIN_CHAT = f"{chatml('system', SYSTEM)} || {chatml('user', f'{USER} || {BLOCK}')} || '<|im_start|>assistant' || chr(10)"


@query(
    "evaluate_with_failures",
    f"WITH {fx.BANK_SQL}, {fx.SUBJECTS_SQL}, {TASKS_SQL}, p AS (SELECT bank.subject, length({PLAIN_CHAT}) % 5 = 1 AS failed, "
    + HIT.format(PLAIN_CHAT)
    + f" {TEST} WHERE split = 'test') "
    "SELECT tasks.model, p.subject, count(*) FILTER (WHERE NOT failed) AS n_rows, CAST(sum(hit) FILTER (WHERE NOT failed) AS BIGINT) AS n_correct, "
    "100.0 * sum(hit) FILTER (WHERE NOT failed) / nullif(count(*) FILTER (WHERE NOT failed), 0) AS accuracy, count(*) FILTER (WHERE failed) AS n_failed, "
    "bool_or(failed) AS pending FROM p JOIN tasks ON p.subject = tasks.subject GROUP BY tasks.model, p.subject",
)
def evaluate_with_failures(spark, sf):
    out = session.fresh_path(spark, "failures")
    done = evaluate(
        fx.bank(spark, sf), tasks(spark, sf), BACKENDS["tgi"], failing_model, out, fx.subjects(spark, sf), max_attempts=2, **options(spark)
    )
    ledger = results.committed_ledger(spark, f"{out}/ledger").select("model", "subject", F.lit(True).alias("finished"))
    done = done.join(ledger, ["model", "subject"], "left")
    return done.select("model", "subject", "n_rows", "n_correct", "accuracy", "n_failed", F.col("finished").isNull().alias("pending"))


AGAIN = "CASE WHEN row_idx % 7 = 0 THEN question || ' (new)' ELSE question END"


@query(
    "replies_reused",
    f"WITH {fx.BANK_SQL}, {fx.SUBJECTS_SQL}, {TASKS_SQL}, old AS (SELECT bank.subject, row_idx % 7 = 0 AS changed, {PLAIN_CHAT} AS prompt {TEST} WHERE split = 'test'), "
    f"bank2 AS (SELECT * REPLACE ({AGAIN} AS question) FROM bank), "
    f"p AS (SELECT bank.subject, row_idx % 7 = 0 AS changed, {PLAIN_CHAT} AS prompt, {HIT.format(PLAIN_CHAT)} {TEST.replace('FROM bank', 'FROM bank2 AS bank')} WHERE split = 'test'), "
    "asked AS (SELECT subject, count(DISTINCT prompt) AS n_first FROM old GROUP BY subject), "
    "again AS (SELECT subject, count(DISTINCT CASE WHEN changed THEN prompt END) AS n_second, count(*) AS n_rows, CAST(sum(hit) AS BIGINT) AS n_correct FROM p GROUP BY subject) "
    "SELECT tasks.model, subject, n_first, n_second, n_rows, n_correct FROM tasks JOIN asked USING (subject) JOIN again USING (subject) WHERE n_second > 0",
)
def replies_reused(spark, sf):
    """A bank is marked, some of its questions change, and it is marked again: only what changed is asked."""
    out = session.fresh_path(spark, "reused")
    bank, todo = fx.bank(spark, sf), tasks(spark, sf)

    def run(bank):
        return evaluate(bank, todo, BACKENDS["tgi"], letter_model, out, fx.subjects(spark, sf), **options(spark))

    run(bank)
    last = commits.records(spark, f"{out}/replies").agg(F.max("number")).first()[0]
    done = run(bank.withColumn("question", F.expr(AGAIN)))
    asked = commits.read(spark, f"{out}/replies", replies.STORED).groupBy("model", "subject").agg(
        F.count_if(F.col("number") <= last).alias("n_first"), F.count_if(F.col("number") > last).alias("n_second"))
    return done.join(asked, ["model", "subject"]).select("model", "subject", "n_first", "n_second", "n_rows", "n_correct")


SCRIPT = {"".join(fixed.SCRIPT_CHARS): "".join(fixed.SCRIPT_CHARS.values())}


@query(
    "prompt_simplified_segments",
    f"WITH {fx.BANK_SQL}, {fx.SUBJECTS_SQL} SELECT bank.subject, row_idx, "
    + "".join(f"translate('[' || {sql_json(SEGMENT)} || ']', '{a}', '{b}') AS prompt" for a, b in SCRIPT.items())
    + f" {TEST} WHERE split = 'test'",
)
def prompt_simplified_segments(spark, sf):
    rows = fx.bank(spark, sf).where(F.col("split") == "test").join(fx.subjects(spark, sf).select("subject", "name"), "subject")
    return build_prompts(rows, None, BACKENDS["gemini"], script=Script()).select("subject", "row_idx", "prompt")


@query(
    "evaluate_judged",
    f"WITH {fx.BANK_SQL}, {fx.SUBJECTS_SQL}, {TASKS_SQL}, p AS (SELECT bank.subject, "
    + HIT.format(
        sql_text("\n\nHuman: ")
        + f" || {sql_text('你是一位專業的中文AI助理，以下是關於{s}考試單選題，請直接選出正確的答案。', s='name')} || "
        + sql_text("\n\nHuman: ")
        + f" || {sql_text('以下是關於{s}考試單選題，請直接選出正確的答案。', s='name')} || chr(10) || chr(10) || "
        + f"question || {OPTIONS} || chr(10) || '答案：' || "
        + sql_text("\n\nAssistant:")
    )
    + f" {TEST} WHERE split = 'test') {ACCURACY}",
)
def evaluate_judged(spark, sf):
    out = session.fresh_path(spark, "judged")
    done = evaluate(
        fx.bank(spark, sf), tasks(spark, sf), BACKENDS["claude"], letter_model, out, fx.subjects(spark, sf),
        parsing="llm", judge_make=judge_model, **options(spark),
    )
    return done.select("model", "subject", "n_rows", "n_correct", "accuracy")


@query(
    "evaluate_breeze",
    f"WITH {fx.BANK_SQL}, {fx.SUBJECTS_SQL}, {TASKS_SQL}, p AS (SELECT bank.subject, " + HIT.replace("{}", ZERO_MESSAGES) + f" {TEST} WHERE split = 'test') {ACCURACY}",
)
def evaluate_breeze(spark, sf):
    """A backend whose replies are always judged."""
    out = session.fresh_path(spark, "breeze")
    done = evaluate(
        fx.bank(spark, sf), tasks(spark, sf), BACKENDS["breeze"], letter_model, out, fx.subjects(spark, sf), judge_make=judge_model, **options(spark)
    )
    return done.select("model", "subject", "n_rows", "n_correct", "accuracy")
