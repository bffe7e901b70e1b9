"""Prompt assembly queries over the question bank and the conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from markbook import fixed_values as fixed
from markbook import session
from markbook.catalog import fixtures as fx
from markbook.catalog.registry import query
from markbook.functions import blocks, render
from markbook.operators import fewshot
from markbook.operators.conversations import ordered_messages
from markbook.sources import bank as bank_source

NL = "chr(10)"


def sql_text(template: str, **fields: str) -> str:
    """A wording as a SQL expression, with newlines and fields spliced in."""
    out = "'" + template.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for name, expr in fields.items():
        out = out.replace("{" + name + "}", f"' || {expr} || '")
    return "(" + out + ")"


OPTIONS = " || ".join(f"chr(10) || '{c}. ' || {c}" for c in "ABCD")
OPTION_LINES = " || ".join(f"'{c}. ' || {c} || chr(10)" for c in "ABCD")
BLOCK = f"(question || {OPTIONS} || chr(10) || '{fixed.ANSWER_CUE}')"
WORKED = sql_text("讓我們一步一步思考，\n{e}\n所以答案是{a}。", e="explanation", a="answer")
BASE_STEM = f"('問題：' || question || {OPTIONS} || chr(10) || '答案：')"
BASE_SHOT = f"({BASE_STEM} || chr(10) || '答案：' || answer || chr(10) || chr(10))"
PAIR_QUERY = f"('問題：' || question || chr(10) || chr(10) || {OPTION_LINES} || chr(10) || '答案：')"
PAIR_ANSWER = "(chr(10) || '答案：' || answer || chr(10) || chr(10))"
INSTRUCT_STEM = f"('問題：' || question || chr(10) || chr(10) || {OPTIONS} || chr(10) || '答案：')"
WITH_BANK = f"WITH {fx.BANK_SQL} "
SYSTEM, USER = sql_text(fixed.SYSTEM_HEADER, subject="name"), sql_text(fixed.USER_HEADER, subject="name")


def _rows(split, exprs, sql):
    """A query of expressions over one split of the bank."""
    where = f"WHERE split = '{split}'"
    statement = WITH_BANK + f"SELECT subject, row_idx, {fx.select_list(sql)} FROM bank {where}"

    def run(spark, sf):
        rows = fx.bank(spark, sf).where(F.col("split") == split)
        return rows.select("subject", "row_idx", *[c().alias(n) for n, c in exprs.items()])

    return run, statement


def _expressions(name, split, exprs, sql):
    run, statement = _rows(split, exprs, sql)
    query(name, statement)(run)


def flat(messages):
    """Messages as one comparable text."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit("\x1f"), m["content"])), "\x1e")


_expressions("format_question", "test", {"block": blocks.question_block}, {"block": BLOCK})
_expressions(
    "format_exemplar", "train", {"block": blocks.exemplar_block}, {"block": f"{BLOCK} || answer || chr(10) || chr(10)"}
)
_expressions(
    "exemplar_messages",
    "train",
    {"messages": lambda: flat(blocks.exemplar_messages())},
    {"messages": f"'user' || chr(31) || {BLOCK} || chr(30) || 'assistant' || chr(31) || answer"},
)
_expressions(
    "exemplar_cot",
    "train",
    {"messages": lambda: flat(blocks.exemplar_messages(cot=True))},
    {"messages": f"'user' || chr(31) || {BLOCK} || chr(30) || 'assistant' || chr(31) || {WORKED}"},
)
_expressions(
    "format_base",
    "test",
    {
        "query": blocks.base_block,
        "query_cot": lambda: blocks.base_block(cot=True),
        "exemplar": lambda: blocks.base_block(answered=True),
        "exemplar_cot": lambda: blocks.base_block(answered=True, cot=True),
    },
    {
        "query": f"{BASE_STEM} || chr(10) || '答案：'",
        "query_cot": f"{BASE_STEM} || chr(10) || '答案：讓我們一步一步思考，' || chr(10)",
        "exemplar": BASE_SHOT,
        "exemplar_cot": f"{BASE_STEM} || {WORKED} || chr(10) || chr(10)",
    },
)
_expressions(
    "format_history",
    "test",
    {
        "query": lambda: blocks.history_pair()["query"],
        "reply": lambda: blocks.history_pair()["answer"],
        "reply_cot": lambda: blocks.history_pair(cot=True)["answer"],
    },
    {"query": PAIR_QUERY, "reply": PAIR_ANSWER, "reply_cot": f"{WORKED} || chr(10) || chr(10)"},
)
_expressions(
    "format_instruct",
    "test",
    {
        "query": blocks.instruct_block,
        "query_cot": lambda: blocks.instruct_block(cot=True),
        "query_prompted": lambda: blocks.instruct_wrap(blocks.instruct_block(cot=True, with_prompt=True)),
        "exemplar": lambda: blocks.instruct_block(answered=True),
        "exemplar_compat": lambda: blocks.instruct_block(answered=True, cot=True, compat=True),
    },
    {
        "query": f"{INSTRUCT_STEM} || chr(10) || '答案：'",
        "query_cot": f"{INSTRUCT_STEM} || chr(10) || '答案：讓我們一步一步思考，' || chr(10) || '1.'",
        "query_prompted": f"'[INST] ' || {INSTRUCT_STEM} || chr(10) || '答案是什麼？讓我們一步一步思考，' || chr(10) || '1.' || ' [/INST]'",
        "exemplar": f"{INSTRUCT_STEM} || chr(10) || '答案：' || answer || chr(10) || chr(10)",
        "exemplar_compat": INSTRUCT_STEM,
    },
)

# --- few-shot contexts ---------------------------------------------------------------

K = 5
SHOTS = (
    f"WITH {fx.BANK_SQL}, {fx.SUBJECTS_SQL}, ranked AS (SELECT bank.*, name, "
    "row_number() OVER (PARTITION BY bank.subject ORDER BY row_idx) AS place "
    "FROM bank JOIN subjects ON bank.subject = subjects.subject WHERE split = 'train') "
)


def sql_message_context(limit: str) -> str:
    return (
        f"SELECT subject, 'system' || chr(31) || any_value({SYSTEM}) || chr(30) || string_agg("
        f"'user' || chr(31) || CASE WHEN place = 1 THEN {USER} ELSE '' END || {BLOCK} || chr(30) || "
        f"'assistant' || chr(31) || answer, chr(30) ORDER BY row_idx) AS context FROM ranked {limit} GROUP BY subject"
    )


def train(spark, sf):
    return fx.bank(spark, sf).where(F.col("split") == "train")


def _context(name, make, sql):
    @query(name, SHOTS + sql)
    def run(spark, sf):
        return make(train(spark, sf), fx.subjects(spark, sf))


_context(
    "fewshot_topk",
    lambda dev, names: fewshot.message_context(dev, K, names).select("subject", flat(F.col("context")).alias("context")),
    sql_message_context(f"WHERE place <= {K}"),
)
_context(
    "fewshot_all",
    lambda dev, names: fewshot.message_context(dev, -1, names).select("subject", flat(F.col("context")).alias("context")),
    sql_message_context(""),
)
_context(
    "fewshot_first_only",
    lambda dev, names: fewshot.message_context(dev, K, names, policy="first_only").select(
        "subject", flat(F.col("context")).alias("context")
    ),
    sql_message_context("WHERE place = 1"),
)
_context(
    "fewshot_text",
    lambda dev, names: fewshot.text_context(dev, K, blocks.base_block(answered=True), names),
    f"SELECT subject, any_value({USER}) || string_agg({BASE_SHOT}, '' ORDER BY row_idx) AS context "
    f"FROM ranked WHERE place <= {K} GROUP BY subject",
)
_context(
    "fewshot_inst",
    lambda dev, names: fewshot.transcript_context(dev, K, names),
    "SELECT subject, any_value("
    + sql_text(fixed.INSTRUCT_OPENING, subject="name")
    + f") || string_agg('[INST] ' || question || {OPTIONS} || chr(10) || '答案： [/INST]' || answer || chr(10), '' ORDER BY row_idx) "
    f"AS context FROM ranked WHERE place <= {K} GROUP BY subject",
)
_context(
    "fewshot_pairs",
    lambda dev, names: fewshot.pair_context(dev, K, names).select("subject", render.render_pairs(F.col("context")).alias("context")),
    f"SELECT subject, string_agg(CASE WHEN place = 1 THEN {USER} ELSE '' END || {PAIR_QUERY} || {PAIR_ANSWER}, '' ORDER BY row_idx) "
    f"AS context FROM ranked WHERE place <= {K} GROUP BY subject",
)


@query(
    "fewshot_attach",
    SHOTS
    + f", context AS ({sql_message_context(f'WHERE place <= {K}')}) "
    f"SELECT bank.subject, row_idx, context || chr(30) || 'user' || chr(31) || {BLOCK} AS messages "
    "FROM bank JOIN context ON bank.subject = context.subject WHERE split = 'test'",
)
def fewshot_attach(spark, sf):
    rows = fx.bank(spark, sf).where(F.col("split") == "test")
    context = fewshot.message_context(train(spark, sf), K, fx.subjects(spark, sf))
    joined = fewshot.attach_context(rows, context)
    return joined.select("subject", "row_idx", flat(fewshot.few_shot_messages(F.col("context"))).alias("messages"))


ZERO = (
    f"WITH {fx.BANK_SQL}, {fx.SUBJECTS_SQL} SELECT bank.subject, row_idx, {{}} AS prompt FROM bank "
    "JOIN subjects ON bank.subject = subjects.subject WHERE split = 'test'"
)


@query("zero_shot", ZERO.format(f"'system' || chr(31) || {SYSTEM} || chr(30) || 'user' || chr(31) || {USER} || {BLOCK}"))
def zero_shot(spark, sf):
    rows = fx.bank(spark, sf).where(F.col("split") == "test").join(fx.subjects(spark, sf).select("subject", "name"), "subject")
    return rows.select("subject", "row_idx", flat(fewshot.zero_shot_messages(F.col("name"))).alias("prompt"))


@query(
    "zero_shot_direct",
    ZERO.format(
        f"'system' || chr(31) || {sql_text(fixed.SYSTEM_HEADER_DIRECT, subject='name')} || chr(30) || "
        f"'user' || chr(31) || {sql_text(fixed.USER_HEADER_DIRECT, subject='name')} || {BLOCK}"
    ),
)
def zero_shot_direct(spark, sf):
    rows = fx.bank(spark, sf).where(F.col("split") == "test").join(fx.subjects(spark, sf).select("subject", "name"), "subject")
    return rows.select("subject", "row_idx", flat(fewshot.zero_shot_messages(F.col("name"), direct=True)).alias("prompt"))


# --- banks of one file per subject ---------------------------------------------------------

TREE_CHOICES = {"ABCD": "length(subject) % 2 = 0", "ABCDE": "length(subject) % 2 = 1"}
OPTION_E = "'none of ' || A || ' and ' || B"


@query(
    "bank_tree",
    WITH_BANK + ", ".join(["", "five AS (SELECT *, length(subject) % 2 = 1 AS longer FROM bank)"])
    + "SELECT subject, split, row_idx, CASE WHEN longer THEN 'A,B,C,D,E' ELSE 'A,B,C,D' END AS letters, "
    f"question || {OPTIONS} || CASE WHEN longer THEN chr(10) || 'E. ' || {OPTION_E} ELSE '' END || chr(10) || '{fixed.ANSWER_CUE}' AS block FROM five",
)
def bank_tree(spark, sf):
    """A folder per subject and split, some with a fifth choice, written as CSV and read without being told which."""
    path = session.fresh_path(spark, "tree")
    bank = fx.bank(spark, sf).withColumn("E", F.expr(OPTION_E))
    for letters, which in TREE_CHOICES.items():
        columns = ["row_idx", "question", *letters, "answer", "explanation"]
        rows = bank.where(which).select("subject", "split", *columns)
        rows.write.mode("append").partitionBy("subject", "split").option("header", True).option("escape", '"').csv(path)
    tree = bank_source.read_tree(spark, path)
    parts = [bank_source.by_choices(tree, tuple(letters)).select("subject", "split", "row_idx", F.lit(",".join(letters)).alias("letters"), blocks.question_block(tuple(letters)).alias("block"))
             for letters in TREE_CHOICES]
    return parts[0].union(parts[1])


# --- rendering conversations -----------------------------------------------------------

TURNS = "WITH t AS (SELECT conv_id, turn, role, text, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations) "


def _rendered(name, column, piece, ending="''"):
    """One prompt per conversation, whatever its length."""

    @query(name, TURNS + f"SELECT conv_id, string_agg({piece}, '' ORDER BY turn) || {ending} AS prompt FROM t GROUP BY conv_id")
    def run(spark, sf):
        rows = ordered_messages(fx.table(spark, sf, "conversations"), "conv_id", "turn", content="text")
        return rows.select("conv_id", column(F.col("messages")).alias("prompt"))


_rendered(
    "render_chat",
    render.render_chat,
    "'<|im_start|>' || role || chr(10) || text || '<|im_end|>'",
    "'<|im_start|>assistant' || chr(10)",
)
_rendered(
    "render_turns",
    render.render_turns,
    "chr(10) || chr(10) || CASE WHEN role = 'assistant' THEN 'Assistant:' ELSE 'Human:' END || ' ' || text",
    "chr(10) || chr(10) || 'Assistant:'",
)
_rendered("render_lines", render.render_lines, "text || chr(10)")
_rendered(
    "render_segments",
    lambda m: F.array_join(render.render_segments(m), "\x1e"),
    "CASE WHEN previous IS NULL OR (role = 'user' AND previous = 'system') THEN '' ELSE chr(30) END || "
    "CASE WHEN role = 'user' THEN '問題: ' ELSE '' END || text || chr(10)",
)
