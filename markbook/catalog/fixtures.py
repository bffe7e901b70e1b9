"""Exam tables read out of the driver's tables.

Scalar expressions are written in the SQL that Spark and the checking engine share,
so both sides start from the same rows; the operators under test are written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markbook import fixed_values as fixed

SUPERCATEGORIES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
N_SUBJECTS = 25


# Given to the reader, so that no job reads file footers to find them.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def columns(exprs: dict[str, str]) -> list:
    return [F.expr(text).alias(name) for name, text in exprs.items()]


def select_list(exprs: dict[str, str]) -> str:
    return ", ".join(f"{text} AS {name}" for name, text in exprs.items())


# --- exam replies: one per order, or per order line -----------------------------

GOLD = "substr('ABCD', CAST(o_orderkey % 4 AS INT) + 1, 1)"
PICK = "substr('ABCD', CAST((o_orderkey * 3 + o_custkey) % 4 AS INT) + 1, 1)"
OTHER = "substr('ABCD', CAST((o_orderkey + o_custkey * 3 + 1) % 4 AS INT) + 1, 1)"

REPLIES = [
    "{p}",
    "'答案：' || {p}",
    "'答案應為: 選項 ' || {p}",
    "'正確答案為(' || {p} || ')'",
    "'The correct answer is:' || chr(10) || {p} || '. as shown'",
    "'首先排除' || {o} || '，答案為：' || {p} || '，所以選它'",
    "''",
    "'這一題沒有辦法判斷 ' || lower(o_orderpriority)",
    "'   ' || {p} || chr(10)",
    "'答案是 ' || {o} || '，不對，答案是 ' || {p} || '。'",
    "'正确的答案应该是:看 ' || {p} || ' 這項'",
    "'選' || {p} || '沒有問題'",
    "'讓我們一步一步思考，' || chr(10) || o_orderpriority || chr(10) || '所以答案是' || {p} || '。'",
    "lower({p})",
    "'(' || {p} || ')'",
    "'所以答案為' || {p}",
    "'我想選項 ' || {p} || ' 正確'",
    "'因此，選項' || {p} || '是正確的'",
    "'答案為 **' || {p} || '**'",
    "NULL",
    "'Option ' || {o} || ' fails; ' || {p} || ' fits ' || o_orderpriority",
    "'看來答案' || {p} || ' 比 ' || {o} || ' 好'",
    "'因此，选项' || {p} || '是正确的，答案为' || {p}",
    "{p} || '. ' || o_orderpriority",
]
RESPONSE = (
    f"CASE (o_orderkey + o_custkey) % {len(REPLIES)} "
    + " ".join(f"WHEN {i} THEN {r.format(p='(' + PICK + ')', o='(' + OTHER + ')')}" for i, r in enumerate(REPLIES))
    + " END"
)
EXAM = {
    "qid": "o_orderkey",
    "model": "c_mktsegment",
    "subject": "n_name",
    "supercategory": "r_name",
    "answer": GOLD,
    "response": RESPONSE,
}


def exam(spark: SparkSession, sf: str, extra: dict[str, str] | None = None) -> DataFrame:
    """(qid, model, subject, supercategory, answer, response) of every order."""
    rows = (
        table(spark, sf, "orders")
        .join(table(spark, sf, "customer"), F.expr("o_custkey = c_custkey"))
        .join(table(spark, sf, "nation"), F.expr("c_nationkey = n_nationkey"))
        .join(table(spark, sf, "region"), F.expr("n_regionkey = r_regionkey"))
    )
    return rows.select(*columns({**EXAM, **(extra or {})}))


def exam_sql(extra: dict[str, str] | None = None) -> str:
    return (
        f"exam AS (SELECT {select_list({**EXAM, **(extra or {})})} FROM orders "
        "JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey "
        "JOIN region ON n_regionkey = r_regionkey)"
    )


# The same replies given once per order line, for a longer run: the line's supplier
# stands for the model.
LINE_EXAM = {
    "qid": "l_orderkey * 8 + l_linenumber",
    "model": "'model ' || CAST(l_suppkey % 40 AS STRING)",
    "subject": "n_name",
    "answer": GOLD,
    "response": RESPONSE,
}


def _per_line(exprs: dict[str, str]) -> dict[str, str]:
    """The order expressions over a line's columns; the return flag stands for the priority."""
    swaps = {"o_orderkey": "(l_orderkey + l_partkey)", "o_custkey": "l_suppkey", "o_orderpriority": "l_returnflag"}
    out = {}
    for name, text in exprs.items():
        for old, new in swaps.items():
            text = text.replace(old, new)
        out[name] = text
    return out


def line_exam(spark: SparkSession, sf: str) -> DataFrame:
    """(qid, model, subject, answer, response) of every order line."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "nation"), F.expr("l_partkey % 25 = n_nationkey"))
    return rows.select(*columns(_per_line(LINE_EXAM)))


LINE_EXAM_SQL = (
    f"exam AS (SELECT {select_list(_per_line(LINE_EXAM))} FROM lineitem JOIN nation ON l_partkey % 25 = n_nationkey)"
)

# --- question bank: one question per part ----------------------------------------

BANK = {
    "subject": "n_name",
    "split": "CASE CAST(floor(p_partkey / 25.0) AS BIGINT) % 10 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END",
    "row_idx": "p_partkey",
    "question": "'下列何者是' || p_name || '？'",
    "A": "p_brand",
    "B": "p_type",
    "C": "'size ' || CAST(p_size AS STRING)",
    "D": "'price ' || CAST(CAST(round(p_retailprice) AS BIGINT) AS STRING)",
    "answer": "substr('ABCD', CAST(p_partkey % 4 AS INT) + 1, 1)",
    "explanation": "'因為' || p_type || '與' || p_name",
}


def bank(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").join(table(spark, sf, "nation"), F.expr("p_partkey % 25 = n_nationkey"))
    return rows.select(*columns(BANK))


BANK_SQL = f"bank AS (SELECT {select_list(BANK)} FROM part JOIN nation ON p_partkey % 25 = n_nationkey)"

# --- subject dimension: nation -> category -> region ------------------------------

SUBJECTS = {
    "subject": "n_name",
    "name": "lower(n_name) || '學'",
    "category": "'category ' || CAST(n_regionkey * 2 + n_nationkey % 2 AS STRING)",
}


def subjects(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(*columns(SUBJECTS))


SUBJECTS_SQL = f"subjects AS (SELECT {select_list(SUBJECTS)} FROM nation)"


def hierarchy_map(spark: SparkSession, sf: str) -> DataFrame:
    """One row with the map supercategory -> categories."""
    pairs = table(spark, sf, "nation").join(table(spark, sf, "region"), F.expr("n_regionkey = r_regionkey"))
    lists = pairs.groupBy("r_name").agg(F.array_sort(F.collect_set(F.expr(SUBJECTS["category"]))).alias("names"))
    return lists.agg(F.map_from_entries(F.collect_list(F.struct("r_name", "names"))).alias("hierarchy"))


HIERARCHY_SQL = (
    f"hierarchy AS (SELECT DISTINCT {SUBJECTS['category']} AS category, r_name AS supercategory "
    "FROM nation JOIN region ON n_regionkey = r_regionkey)"
)


def subject_supercategory(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "nation").join(table(spark, sf, "region"), F.expr("n_regionkey = r_regionkey"))
    return pairs.select(F.col("n_name").alias("subject"), F.col("r_name").alias("supercategory"))


# --- the operators under test, in SQL ---------------------------------------------

SQL_SPACE = r"\s"
QUOTED_PUNCTUATION = fixed.PUNCTUATION.replace("'", "''")


def sql_strip(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def sql_normalize(text: str) -> str:
    return rf"trim(regexp_replace(translate(lower({text}), '{QUOTED_PUNCTUATION}', ''), '\s+', ' ', 'g'))"


def sql_cascade(text: str, patterns: list[str]) -> str:
    steps = [
        f"CASE WHEN regexp_matches({text}, '{p}') THEN list_extract(regexp_extract_all({text}, '{p}', 1), -1) END"
        for p in patterns
    ]
    return "coalesce(" + ", ".join(steps) + ")"


def sql_last_choice(text: str, patterns: list[str] = fixed.CASCADE) -> str:
    return (
        f"CASE WHEN left({text}, 1) IN ('A', 'B', 'C', 'D') THEN left({text}, 1) "
        f"ELSE {sql_cascade(text, patterns)} END"
    )


def marked_sql(policy: str) -> str:
    """``text``, ``extracted`` and ``correctness`` for every exam reply."""
    text = "coalesce(response, '')" if policy == "cot" else sql_strip("coalesce(response, '')")
    extracted = {
        "zero_shot": sql_last_choice("text"),
        "few_shot": sql_last_choice("text"),
        "exact_only": "text",
        "cot": sql_cascade("text", fixed.COT_TRADITIONAL),
    }[policy]
    exact = f"{sql_normalize('extracted')} = {sql_normalize('answer')}"
    right = {
        "zero_shot": "extracted = answer",
        "few_shot": f"({sql_normalize('text')} = {sql_normalize('answer')} OR coalesce(extracted = answer, false))",
        "exact_only": exact,
        "cot": exact,
    }[policy]
    return (
        f"trimmed AS (SELECT *, {text} AS text FROM exam), "
        f"read AS (SELECT *, CASE WHEN text <> '' THEN {extracted} END AS extracted FROM trimmed), "
        f"marked AS (SELECT *, CASE WHEN text <> '' AND coalesce({right}, false) THEN 1 ELSE 0 END AS correctness FROM read)"
    )


LEDGER_SQL = (
    f"{exam_sql()}, {marked_sql('zero_shot')}, ledger AS (SELECT model, subject, "
    "count(correctness) AS n_rows, CAST(sum(correctness) AS BIGINT) AS n_correct, min(qid) AS seq, "
    "100.0 * sum(correctness) / count(correctness) AS accuracy FROM marked GROUP BY model, subject)"
)
