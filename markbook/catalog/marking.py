"""Extraction and scoring queries over the exam replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from markbook import fixed_values as fixed
from markbook.catalog import fixtures as fx
from markbook.catalog.registry import query
from markbook.functions import blocks, extract, scores, scoring
from markbook.functions.text import Script, cut_at_stop, exact_match, fold_brackets, normalize, strip, text_or_empty

TEXT = fx.sql_strip("coalesce(response, '')")
TRIMMED = f"WITH {fx.exam_sql()}, t AS (SELECT qid, {TEXT} AS text FROM exam) "


def trimmed(spark, sf):
    return fx.exam(spark, sf).select("qid", strip(text_or_empty(F.col("response"))).alias("text"))


def _extraction(name, column, sql):
    @query(name, TRIMMED + f"SELECT qid, {sql} AS extracted FROM t")
    def run(spark, sf):
        return trimmed(spark, sf).select("qid", column(F.col("text")).alias("extracted"))


CODES = {c: fixed.SCRIPT_CHARS[c] for c in "確應該為選項"}

_extraction("extract_leading", extract.leading_choice, "CASE WHEN left(text, 1) IN ('A', 'B', 'C', 'D') THEN left(text, 1) END")
_extraction("extract_cascade", extract.last_choice, fx.sql_last_choice("text"))
_extraction("extract_loose_first", extract.loose_choice, fx.sql_last_choice("text", fixed.LOOSE_FIRST))
_extraction("cot_extract_trad", extract.worked_choice, fx.sql_cascade("text", fixed.COT_TRADITIONAL))
_extraction("cot_extract_simp", lambda t: extract.worked_choice(t, True), fx.sql_cascade("text", fixed.COT_SIMPLIFIED))
_extraction(
    "cot_fallback",
    extract.loose_then_worked,
    f"coalesce({fx.sql_last_choice('text', fixed.LOOSE_FIRST)}, {fx.sql_cascade('text', fixed.COT_TRADITIONAL[:3])})",
)


@query(
    "extract_all_matches",
    TRIMMED
    + "SELECT qid, CASE WHEN left(text, 1) IN ('A', 'B', 'C', 'D') THEN left(text, 1) ELSE coalesce("
    + ", ".join(
        f"CASE WHEN regexp_matches(text, '{p}') THEN array_to_string(regexp_extract_all(text, '{p}', 1), ',') END"
        for p in fixed.CASCADE
    )
    + ") END AS matches FROM t",
)
def extract_all_matches(spark, sf):
    return trimmed(spark, sf).select("qid", F.array_join(extract.all_choices(F.col("text")), ",").alias("matches"))


def _simple(patterns):
    return [p.translate(str.maketrans(CODES)) for p in patterns]


@query(
    "extract_simplified",
    f"WITH {fx.exam_sql()}, t AS (SELECT qid, translate({TEXT}, '{''.join(CODES)}', '{''.join(CODES.values())}') AS text FROM exam) "
    f"SELECT qid, {fx.sql_last_choice('text', list(dict.fromkeys(_simple(fixed.CASCADE))))} AS extracted FROM t",
)
def extract_simplified(spark, sf):
    script = Script(CODES)
    rows = trimmed(spark, sf).select("qid", script.column(F.col("text")).alias("text"))
    return rows.select("qid", extract.last_choice(F.col("text"), script=script).alias("extracted"))


# --- text ------------------------------------------------------------------------


@query("normalize_answer", f"SELECT doc_id, {fx.sql_normalize('text')} AS normalized FROM documents")
def normalize_answer(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", normalize(F.col("text")).alias("normalized"))


@query(
    "exact_match",
    f"WITH {fx.exam_sql()} SELECT qid, {fx.sql_normalize('response')} = {fx.sql_normalize('answer')} AS matched FROM exam",
)
def exact(spark, sf):
    return fx.exam(spark, sf).select("qid", exact_match(F.col("response"), F.col("answer")).alias("matched"))


PADDED = "chr(9) || ' ' || text || chr(10) || chr(13) || ' '"


@query("strip_text", f"SELECT doc_id, {fx.sql_strip(PADDED)} AS stripped FROM documents")
def strip_text(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", strip(F.expr(PADDED)).alias("stripped"))


BRACKETED = "translate(text, 'aeiou()n', '【】（）⟦⟧⦃⟯')"


@query(
    "fold_brackets",
    f"SELECT doc_id, translate({BRACKETED}, '{''.join(fixed.BRACKETS)}', '{''.join(fixed.BRACKETS.values())}') AS folded FROM documents",
)
def folded(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", fold_brackets(F.expr(BRACKETED)).alias("folded"))


TRADITIONAL_TEXT = "translate(text, 'aeiou', '為應該選項')"
PHRASES = {"應該": "應當", "該應該": "都該", "為n": "因为"}
PHRASE_PATTERN = "(?s)(該應該|應該|為n|[^應該為]+|.)"


@query(
    "to_simplified",
    f"SELECT doc_id, translate({TRADITIONAL_TEXT}, '{''.join(CODES)}', '{''.join(CODES.values())}') AS by_char, "
    f"array_to_string(list_transform(regexp_extract_all({TRADITIONAL_TEXT}, '{PHRASE_PATTERN}', 1), lambda p: "
    "CASE p WHEN '應該' THEN '應當' WHEN '該應該' THEN '都該' WHEN '為n' THEN '因为' "
    f"ELSE translate(p, '{''.join(CODES)}', '{''.join(CODES.values())}') END), '') AS by_phrase FROM documents",
)
def to_simplified(spark, sf):
    rows = fx.table(spark, sf, "documents").select("doc_id", F.expr(TRADITIONAL_TEXT).alias("text"))
    by_char, by_phrase = Script(CODES).column(F.col("text")), Script(CODES, PHRASES).column(F.col("text"))
    return rows.select("doc_id", by_char.alias("by_char"), by_phrase.alias("by_phrase"))


WORDS = "SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{3,}')) AS source FROM benchmark"
ACCENTS = {"é": "e", "ß": "s", "ñ": "n"}


@query(
    "script_table",
    f"WITH w AS ({WORDS}), p AS (SELECT '(' || string_agg(source, '|' ORDER BY length(source) DESC, source) || '|(?s:.))' AS pattern FROM w), "
    "pieces AS (SELECT doc_id, regexp_extract_all(text, pattern, 1) AS all_pieces FROM documents, p), "
    "one AS (SELECT doc_id, unnest(all_pieces) AS piece, generate_subscripts(all_pieces, 1) AS i FROM pieces) "
    f"SELECT doc_id, string_agg(coalesce(reverse(source), translate(piece, '{''.join(ACCENTS)}', '{''.join(ACCENTS.values())}')), '' ORDER BY i) AS converted "
    "FROM one LEFT JOIN w ON piece = source GROUP BY doc_id",
)
def script_table(spark, sf):
    """A phrase table read from data: every word of the benchmark, also inside longer words, written backwards."""
    words = fx.table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))).alias("source")).distinct()
    chars = spark.createDataFrame(list(ACCENTS.items()), "source string, target string")
    script = Script.from_table(words.withColumn("target", F.reverse("source")).union(chars))
    return fx.table(spark, sf, "documents").select("doc_id", script.column(F.col("text")).alias("converted"))


STOP = "CASE WHEN doc_id % 7 = 0 THEN '' ELSE substr(text, 11, 2) END"


@query(
    "stop_truncate",
    f"SELECT doc_id, CASE WHEN length({STOP}) > 0 THEN split_part(text, {STOP}, 1) ELSE text END AS kept FROM documents",
)
def stop_truncate(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", cut_at_stop(F.col("text"), F.expr(STOP)).alias("kept"))


@query("null_response", f"WITH {fx.exam_sql()} SELECT qid, coalesce(response, '') AS response FROM exam")
def null_response(spark, sf):
    return fx.exam(spark, sf).select("qid", text_or_empty(F.col("response")).alias("response"))


@query(
    "judge_prompt",
    "SELECT item_id, 'Read the RESPONSE below and name its final answer with exactly one of these labels: A, B, C, D. "
    "Give the label alone, without brackets or line breaks.' || chr(10) || 'RESPONSE: ' || text AS prompt FROM benchmark",
)
def judge_prompt(spark, sf):
    return fx.table(spark, sf, "benchmark").select("item_id", blocks.judge_prompt(F.col("text")).alias("prompt"))


# --- score vectors ----------------------------------------------------------------

LOGITS = "CAST(embedding AS DOUBLE[])"


@query(
    "softmax_choices",
    f"WITH v AS (SELECT vec_id, {LOGITS} AS x FROM embeddings), "
    "z AS (SELECT vec_id, x, list_max(x) AS m, list_sum(list_transform(x, lambda e: exp(e - list_max(x)))) AS s FROM v), "
    "g AS (SELECT vec_id, list_transform(x[1:4], lambda e: exp(e - m) / s) AS p FROM z), "
    "e AS (SELECT vec_id, list_transform(p, lambda q: exp(q - list_max(p))) AS w FROM g), "
    "r AS (SELECT vec_id, list_transform(w, lambda q: round(q / list_sum(w), 9)) AS q FROM e) "
    "SELECT vec_id, q[1] AS prob_a, q[2] AS prob_b, q[3] AS prob_c, q[4] AS prob_d FROM r",
)
def softmax_choices(spark, sf):
    rows = fx.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    probs = rows.select("vec_id", scores.choice_probabilities(F.col("x"), [0, 1, 2, 3]).alias("p"))
    return probs.select("vec_id", *[F.round(F.col("p")[i], 9).alias(f"prob_{c}") for i, c in enumerate("abcd")])


FIRST4 = "list_transform(x[1:4], lambda e: round(e, 1))"


@query(
    "argmax_choice",
    f"WITH v AS (SELECT vec_id, {LOGITS} AS x FROM embeddings) "
    f"SELECT vec_id, substr('ABCD', CAST(list_position({FIRST4}, list_max({FIRST4})) AS INT), 1) AS choice FROM v",
)
def argmax_choice(spark, sf):
    # Rounded, so that ties occur.
    vector = F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, 4), lambda e: F.round(e, 1))
    rows = fx.table(spark, sf, "embeddings").select("vec_id", vector.alias("scores"))
    return rows.select("vec_id", scores.argmax_choice(F.col("scores")).alias("choice"))


SUMMED = "list_transform([1, 2, 3, 4], lambda i: x[i] + x[i + 4])"


@query(
    "argmax_sum",
    f"WITH v AS (SELECT vec_id, {LOGITS} AS x FROM embeddings) "
    f"SELECT vec_id, substr('ABCD', CAST(list_position({SUMMED}, list_max({SUMMED})) AS INT), 1) AS choice FROM v",
)
def argmax_sum(spark, sf):
    rows = fx.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return rows.select("vec_id", scores.argmax_sum(F.slice("x", 1, 4), F.slice("x", 5, 4)).alias("choice"))


@query(
    "score_argmax",
    f"WITH v AS (SELECT vec_id, label, {LOGITS} AS x FROM embeddings), "
    f"c AS (SELECT vec_id, substr('ABCD', label % 4 + 1, 1) AS answer, "
    "substr('ABCD', CAST(list_position(x[1:4], list_max(x[1:4])) AS INT), 1) AS extracted FROM v) "
    "SELECT vec_id, answer, extracted, CASE WHEN answer = extracted THEN 1 ELSE 0 END AS correctness FROM c",
)
def score_argmax(spark, sf):
    rows = fx.table(spark, sf, "embeddings").select(
        "vec_id",
        F.expr("substr('ABCD', label % 4 + 1, 1)").alias("answer"),
        F.slice(F.col("embedding").cast("array<double>"), 1, 4).alias("scores"),
    )
    return scoring.mark_scores(rows).drop("scores")


# --- scoring policies --------------------------------------------------------------


def _policy(name, policy):
    @query(name, f"WITH {fx.exam_sql()}, {fx.marked_sql(policy)} SELECT qid, extracted, correctness FROM marked")
    def run(spark, sf):
        return scoring.marks(fx.exam(spark, sf), policy).select("qid", "extracted", "correctness")


_policy("score_zero_shot", "zero_shot")
_policy("score_few_shot", "few_shot")
_policy("score_exact_only", "exact_only")
_policy("score_cot", "cot")


@query("score_blind", f"WITH {fx.exam_sql()} SELECT qid, 'NA' AS answer, 0 AS correctness FROM exam")
def score_blind(spark, sf):
    return scoring.marks(scoring.blind(fx.exam(spark, sf)), "zero_shot").select("qid", "answer", "correctness")


MISSING_GOLD = f"CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE {fx.GOLD} END"


@query(
    "score_missing_gold",
    f"WITH {fx.exam_sql({'answer': MISSING_GOLD})}, {fx.marked_sql('zero_shot')} "
    "SELECT qid, CASE WHEN answer IS NOT NULL THEN correctness END AS correctness FROM marked",
)
def score_missing_gold(spark, sf):
    rows = fx.exam(spark, sf, {"answer": MISSING_GOLD})
    return scoring.marks(rows, "zero_shot").select("qid", "correctness")


RUN = {
    "parsing": "CASE WHEN o_orderkey % 5 = 0 THEN 'llm' ELSE 'string' END",
    "few_shot": "o_orderkey % 2 = 0",
    "cot": "o_orderkey % 3 = 0",
    "exact_backend": "o_custkey % 2 = 0",
    "judged": "' ' || (" + fx.PICK + ") || chr(10)",
}


@query(
    "score_dispatch",
    f"WITH {fx.exam_sql(RUN)}, p AS (SELECT *, CASE WHEN parsing = 'llm' THEN 'judge' WHEN cot THEN 'cot' "
    "WHEN few_shot AND exact_backend THEN 'exact_only' WHEN few_shot THEN 'few_shot' ELSE 'zero_shot' END AS policy FROM exam), "
    f"t AS (SELECT *, CASE WHEN policy = 'cot' THEN coalesce(response, '') ELSE {TEXT} END AS text FROM p), "
    f"e AS (SELECT *, CASE WHEN text = '' THEN NULL WHEN policy IN ('zero_shot', 'few_shot') THEN {fx.sql_last_choice('text')} "
    f"WHEN policy = 'exact_only' THEN text WHEN policy = 'cot' THEN {fx.sql_cascade('text', fixed.COT_TRADITIONAL)} "
    f"ELSE {fx.sql_strip('judged')} END AS extracted FROM t) "
    "SELECT qid, policy, extracted, CASE WHEN text <> '' AND coalesce(CASE "
    "WHEN policy IN ('zero_shot', 'judge') THEN extracted = answer "
    f"WHEN policy = 'few_shot' THEN {fx.sql_normalize('text')} = {fx.sql_normalize('answer')} OR coalesce(extracted = answer, false) "
    f"ELSE {fx.sql_normalize('extracted')} = {fx.sql_normalize('answer')} END, false) THEN 1 ELSE 0 END AS correctness FROM e",
)
def score_dispatch(spark, sf):
    rows = fx.exam(spark, sf, RUN)
    shot = F.when(F.col("exact_backend"), "exact_only").otherwise("few_shot")
    rows = rows.withColumn("policy", scoring.policy_of(F.col("parsing"), F.col("few_shot"), F.col("cot"), shot))
    return scoring.marks(rows, F.col("policy"), judged="judged").select("qid", "policy", "extracted", "correctness")
