import decimal
import random

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from markbook.operators import report, routing, runs
from markbook.plans import joins, running
from markbook.sources import bank, dims, results


# --- running totals and caps, against brute force, with one hot group -------------


def hot_rows(seed=1, n=3000):
    rng = random.Random(seed)
    order = rng.sample(range(50_000), n)
    names = [None, "", *(f"g{i}" for i in range(20))]
    return [(("hot" if rng.random() < 0.5 else rng.choice(names)), o, rng.randint(0, 1)) for o in order]


def test_running_totals_equal_brute_force(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "g string, o long, v int")
    got = running.running_totals(df, ["g"], "o", {"total": F.col("v"), "n": F.lit(1)}, parts=40).collect()
    want, seen = {}, {}
    for g, o, v in sorted(rows, key=lambda r: r[1]):
        total, n = seen.get(g, (0, 0))
        seen[g] = want[g, o] = (total + v, n + 1)
    assert {(r["g"], r["o"]): (r["total"], r["n"]) for r in got} == want


def test_running_totals_bound_the_rows_of_a_range(spark):
    """One hot group with sparse, repeated and null order values is still dealt out evenly."""
    order = [None] * 2000 + [7] * 2000 + [i**3 for i in range(4000)]
    df = spark.createDataFrame([("hot", o, i) for i, o in enumerate(order)], "g string, o long, i long")
    dealt = running.running_totals(df, ["g"], "o", {"n": F.lit(1)}, parts=40)
    ranges = spark.read.parquet(*dealt.inputFiles())
    sizes = [r["count"] for r in ranges.groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 8000 and max(sizes) < 3 * 8000 / 40
    assert "BroadcastHashJoin" in plan_of(dealt) and "SortMergeJoin" not in plan_of(dealt)  # the rows are not exchanged again
    ranks = dealt.orderBy("n").collect()
    assert [r["n"] for r in ranks] == list(range(1, 8001)) and [r["o"] for r in ranks] == sorted(order, key=lambda o: (o is not None, o))


def test_running_totals_of_a_whole_table(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(500)], "`a.b` long, i long")
    got = running.running_totals(df, [], [F.col("`a.b`").desc(), F.col("i")], {"rank": F.lit(1)}).collect()
    assert [r["i"] for r in sorted(got, key=lambda r: r["rank"])] == sorted(range(500), key=lambda i: (-(i % 7), i))


def test_running_totals_keep_columns_of_any_name(spark):
    df = spark.createDataFrame([("a", i, "mine", "too", 0.5, decimal.Decimal("0.10")) for i in range(50)], "g string, o long, _range string, __edge string, x double, d decimal(5,2)")
    got = running.running_totals(df, ["g"], "o", {"sum": F.col("x"), "money": F.col("d"), "n": F.lit(1)}, parts=7)
    assert got.columns == [*df.columns, "sum", "money", "n"]
    rows = sorted(got.collect(), key=lambda r: r["o"])
    assert all((r["_range"], r["__edge"]) == ("mine", "too") for r in rows)
    assert [r["n"] for r in rows] == list(range(1, 51)) and rows[-1]["sum"] == 25.0 and rows[-1]["money"] == decimal.Decimal("5.00")
    assert running.running_totals(df.limit(0), ["g"], "o", {"n": F.lit(1)}).count() == 0


@pytest.mark.parametrize("parts", [1, 2, 3, 9, 30])
def test_running_totals_where_groups_end_at_ranges(spark, parts):
    """Many small groups, with and without nulls among keys and values."""
    rows = [(f"k{i // 4}" if i % 11 else None, i % 3, i, None if i % 5 == 0 else i) for i in range(90)]
    df = spark.createDataFrame(rows, "a string, b int, o long, v long")
    want, seen = {}, {}
    for a, b, o, v in sorted(rows, key=lambda r: r[2]):
        seen[a, b] = want[a, b, o] = seen.get((a, b), 0) + (v or 0)
    got = running.running_totals(df, ["a", "b"], "o", {"t": F.col("v")}, parts=parts).collect()
    assert {(r["a"], r["b"], r["o"]): r["t"] for r in got} == want


@pytest.mark.parametrize("n", [1, 50, 400])
def test_first_rows_both_ways(spark, monkeypatch, n):
    rows = hot_rows(2)
    df = spark.createDataFrame(rows, "g string, o long, v int")
    groups = {}
    for g, o, _ in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(g, []).append(o)
    want = {(g, o, i + 1) for g, os in groups.items() for i, o in enumerate(os[:n])}
    for limit in (1000, 0):
        monkeypatch.setattr(running, "WINDOW_LIMIT", limit)
        got = running.first_rows(df, ["g"], "o", n).collect()
        assert {(r["g"], r["o"], r["rank"]) for r in got} == want


# --- joins ---------------------------------------------------------------------------


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_join_beyond_the_limit_gives_the_same_rows(spark, how):
    big = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 7}") for i in range(600)], "i long, k string")
    small = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3), ("absent", 4)], "k string, v int")
    near = joins.join_small(big, small, ["k"], how)
    far = joins.join_small(big, small, ["k"], how, limit=1)
    assert sorted(map(str, near.collect())) == sorted(map(str, far.select(*near.columns).collect()))
    assert "BroadcastHashJoin" in plan_of(near)
    if how in ("left", "inner"):
        assert "_salt" in plan_of(far)


def test_constant_dimension_needs_no_measuring_job(spark):
    assert joins.constant_bytes(dims.subjects(spark, "cmmlu")) < 100_000


def test_sides_over_the_limit_are_not_broadcast_whatever_their_estimate(spark, tmp_path):
    limit = 1 << 20
    big = spark.range(100).select((F.col("id") % 10).alias("k"))
    spark.range(4000).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 1000).alias("v")).write.parquet(str(tmp_path / "t"))
    squeezed = spark.read.parquet(str(tmp_path / "t"))
    exploded = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(200_000))).alias("k"))
    collected = squeezed.groupBy((F.col("k") % 10).alias("k")).agg(F.collect_list("v").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for side in (squeezed, exploded, collected):
            assert not joins.fits_broadcast(side, limit)
            assert "Broadcast" not in plan_of(joins.join_small(big, side, ["k"], "left", limit=limit))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# --- unknown subjects ----------------------------------------------------------------


def test_unknown_subjects_count_nowhere(spark):
    ledger = spark.createDataFrame([("m", "s1", 50.0, 1), ("m", "new", 100.0, 2), ("n", "s1", 40.0, 3), ("n", "s2", 60.0, 4), ("x", "new", 9.0, 5)], "model string, subject string, accuracy double, seq long")
    dimension = spark.createDataFrame([("s1", "c"), ("s2", "c")], "subject string, supercategory string")
    board = report.leaderboard(ledger, dimension, ["c"], 2).collect()
    assert [(r["rank"], r["model"], r["average"]) for r in board] == [(1, "n", 50.0)]
    rest = {r["model"]: r["n_rows"] for r in report.incomplete_models(ledger, dimension, ["c"], 2).collect()}
    assert rest == {"m": 1, "x": 0}
    means = {r["model"]: (r["mean_accuracy"], r["n_subjects"]) for r in report.macro_by_category(ledger, dimension).collect()}
    assert means == {"m": (50.0, 1), "n": (50.0, 2)}


def test_unknown_subjects_are_called_by_their_id(spark):
    names = spark.createDataFrame([("s1", "One")], "subject string, name string")
    got = runs.with_names(spark.createDataFrame([("s1",), ("s2",)], "subject string"), names).collect()
    assert {r["subject"]: r["name"] for r in got} == {"s1": "One", "s2": "s2"}


# --- dimensions ------------------------------------------------------------------------


def test_subject_sets(spark):
    sizes = {exam: dims.subjects(spark, exam).count() for exam in dims.EXAMS}
    assert sizes == {"traditional": 66, "cmmlu": 67, "ceval": 52}
    counts = {r["category"]: r["count"] for r in dims.subjects(spark, "cmmlu").groupBy("category").count().collect()}
    assert counts == {"STEM": 22, "specific": 15, "Science": 13, "Humanities": 11, "Other": 6}
    counts = {r["category"]: r["count"] for r in dims.subjects(spark, "ceval").groupBy("category").count().collect()}
    assert counts == {"STEM": 20, "Humanities": 11, "Other": 11, "Social Science": 10}
    hierarchy = dims.hierarchy_frame(spark)
    assert hierarchy.count() == 18
    assert dims.subjects(spark, "traditional").join(hierarchy, "category", "left_anti").count() == 0


def test_templates_first_row_wins(spark):
    table = dims.templates(spark)
    first = routing.first_templates(table)
    assert table.count() - first.count() == 3
    row = first.where("model_name = 'deepseek-ai/deepseek-llm-7b-chat'").collect()[0]["tokens"]
    assert (row["system_token"], row["end_token"], row["assistant_token"], row["user_token"]) == ("", "\\n\\n", "Assistant:", "User:")


def test_read_templates_from_file(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(
        "model_name,systemMessageToken,messageEndToken,assistantMessageToken,userMessageToken\nm,,\\n,A: ,U\nm,s,e,a,u\n", encoding="utf8"
    )
    rows = routing.first_templates(dims.read_templates(spark, str(path))).collect()
    assert [tuple(r["tokens"]) for r in rows] == [("", "\\n", "A: ", "U")]


def test_read_templates_keeps_the_order_of_many_splits(spark, tmp_path):
    path = tmp_path / "t.csv"
    head = "model_name,systemMessageToken,messageEndToken,assistantMessageToken,userMessageToken\n"
    path.write_text(head + "".join(f"m{i},s,e,a,u{i}\n" for i in range(3000)), encoding="utf8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = dims.read_templates(spark, str(path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r["model_name"]: r["file_order"] for r in rows} == {f"m{i}": i for i in range(3000)}


def test_read_subjects_from_file(spark, tmp_path):
    path = tmp_path / "s.tsv"
    path.write_text("subject\tname\tcategory\nmath\t數學\tSTEM\nlaw\t法律\thumanities\n", encoding="utf8")
    assert sorted(map(tuple, dims.read_subjects(spark, str(path)).collect())) == [("law", "法律", "humanities"), ("math", "數學", "STEM")]


# --- routing -----------------------------------------------------------------------------


def test_backend_of(spark):
    cases = [
        ("Qwen/Qwen-7B-Chat", "", "hf_chat"), ("Qwen/Qwen-72B", "", "hf_base"), ("qwen-max", "", "dashscope"),
        ("gpt-4", "azure", "azure"), ("gpt-3.5-turbo-instruct", "openai_complete", "oai_complete"), ("gpt-4", "", "chatgpt"),
        ("llama3-8b-8192", "groq", "groq"), ("GPT-4", None, "tgi"), ("reka-flash", "unknown", "reka"), ("mixtral", "", "mixtral"),
    ]
    df = spark.createDataFrame(cases, "m string, s string, want string")
    for r in df.select("*", routing.backend_of(F.col("m"), F.col("s")).alias("got")).collect():
        assert r["got"] == r["want"], r


def test_exam_of(spark):
    df = spark.createDataFrame([("Maker/Exam-Plus",), ("h/CMMLU",), ("x/c-eval-exam",)], "d string")
    assert [r[0] for r in df.select(routing.exam_of(F.col("d"), "maker/exam")).collect()] == ["traditional", "cmmlu", "ceval"]
    other = spark.createDataFrame([("h/other",)], "d string")
    assert other.select(routing.exam_of(F.col("d"), on_unknown="null")).collect()[0][0] is None
    with pytest.raises(Exception, match="dataset not supported"):
        other.select(routing.exam_of(F.col("d"))).collect()


def test_rows_of_a_file_complete_the_built_in_templates(spark, tmp_path):
    """Models that the built-in table lacks come from a file; where both name one, the built-in row stays first."""
    path = tmp_path / "more.csv"
    built_in = dims.templates(spark)
    known = built_in.first()["model_name"]
    path.write_text(f"model_name,systemMessageToken,messageEndToken,assistantMessageToken,userMessageToken\norg/one,<s>,</s>,<a>,<u>\norg/two,,|,,\n{known},x,x,x,x\n")
    more = dims.read_templates(spark, str(path)).withColumn("file_order", F.col("file_order") + built_in.count())
    rows = {r["model_name"]: r["tokens"] for r in routing.first_templates(built_in.unionByName(more)).collect()}
    assert rows["org/one"]["user_token"] == "<u>" and rows["org/two"]["system_token"] == "" and rows[known]["system_token"] != "x"
    assert len(rows) == built_in.select("model_name").distinct().count() + 2


def test_missing_template_fails(spark):
    models = spark.createDataFrame([("nobody",)], "model_name string")
    with pytest.raises(Exception, match="no role tokens"):
        routing.with_tokens(models, dims.templates(spark)).collect()
    given = models.withColumn("given", F.expr("named_struct('system_token', 's', 'end_token', 'e', 'assistant_token', 'a', 'user_token', 'u')"))
    assert routing.with_tokens(given, dims.templates(spark), given="given").collect()[0]["tokens"]["user_token"] == "u"


def test_run_key(spark):
    df = spark.createDataFrame([("h/exam", "a/b", 5, True, True), ("exam", "b", 0, False, False)], "d string, m string, k int, c boolean, z boolean")
    key = runs.run_key(*[F.col(c) for c in "dmkcz"])
    assert [r[0] for r in df.select(key["ledger_name"]).collect()] == ["exam_b_top_5_cot_zhs.tsv", "exam_b.tsv"]


# --- reports -------------------------------------------------------------------------------


@pytest.fixture
def ledger(spark):
    rows = [("late", "s1", 50.0, 4), ("late", "s2", 70.0, 5), ("early", "s1", 60.0, 1), ("early", "s2", 60.0, 2), ("part", "s1", 99.0, 3)]
    return spark.createDataFrame(rows, "model string, subject string, accuracy double, seq long")


@pytest.fixture
def dimension(spark):
    return spark.createDataFrame([("s1", "X"), ("s2", "Y (a.b)")], "subject string, supercategory string")


def test_leaderboard_ties_keep_first_appearance(ledger, dimension):
    board = report.leaderboard(ledger, dimension, ["X", "Y (a.b)", "absent"], 2).collect()
    assert [(r["rank"], r["model"]) for r in board] == [(1, "early"), (2, "late")]
    assert board[0]["average"] == 40.0 and board[0]["absent"] is None
    present = report.leaderboard(ledger, dimension, ["X", "Y (a.b)", "absent"], 2, n_categories=None).collect()
    assert present[0]["average"] == 60.0
    part = report.incomplete_models(ledger, dimension, ["X", "Y (a.b)"], 2).collect()
    assert [(r["model"], r["n_rows"], r["average"]) for r in part] == [("part", 1, 49.5)]


def test_completeness_counts_rows_unless_told(ledger):
    twice = ledger.unionByName(ledger.where("model = 'part'"))
    got = {r["model"]: r["complete"] for r in report.completeness(twice, 2).collect()}
    assert got == {"late": True, "early": True, "part": True}
    assert not {r["model"]: r["complete"] for r in report.completeness(twice, 2, distinct=True).collect()}["part"]


def test_accuracy_of_nothing_is_null(spark):
    df = spark.createDataFrame([("m", "s", None)], "model string, subject string, correctness int")
    assert report.accuracy_by_subject(df).collect()[0]["accuracy"] is None


def test_first_aggregation_is_combined_before_the_shuffle(spark):
    marks = spark.range(100).selectExpr("'m' AS model", "'s' AS subject", "cast(id % 2 AS int) AS correctness")
    plan = plan_of(report.accuracy_by_subject(marks))
    assert plan.index("HashAggregate") < plan.index("Exchange") and "partial_sum" in plan


# --- sources -----------------------------------------------------------------------------------


def test_bank_scan_pushes_filter_and_prunes_columns(spark, tmp_path):
    path = str(tmp_path / "bank")
    rows = [("s", "test", 1, "q", "a", "b", "c", "d", "A", None), ("s", "train", 2, "q", "a", "b", "c", "d", "B", "e")]
    spark.createDataFrame(rows, bank.bank_schema()).write.parquet(path)
    scan = bank.scan_split(bank.read_bank(spark, path), "test", ["s"]).select("row_idx")
    plan = plan_of(scan)
    assert "EqualTo(split,test)" in plan and "question" not in plan.split("ReadSchema:")[1].splitlines()[0]
    assert [r[0] for r in scan.collect()] == [1]


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_bank_formats(spark, tmp_path, fmt):
    path = str(tmp_path / fmt)
    rows = [("s", "test", 1, 'q "x",\nnext', "a", "b", "c", "d", "A", None)]
    writer = spark.createDataFrame(rows, bank.bank_schema()).write.option("escape", '"')
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)
    assert bank.read_bank(spark, path, fmt).collect()[0]["question"] == 'q "x",\nnext'


def test_ledger_keeps_append_order(spark, tmp_path):
    path = str(tmp_path / "ledger")
    for i, models in enumerate([["b", "a"], ["c"], ["a"]]):
        df = spark.createDataFrame([(m, f"s{i}", 12.3456789) for m in models], "model string, subject string, accuracy double")
        results.append_ledger(df.coalesce(1), path)
        import time

        time.sleep(1.1)  # file times may have whole seconds only
    rows = results.read_ledger(spark, path).orderBy("seq").collect()
    assert [r["model"] for r in rows] == ["b", "a", "c", "a"]
    assert {r["accuracy"] for r in rows} == {12.34568}


def test_scored_rewrite_replaces_only_its_folders(spark, tmp_path):
    path = str(tmp_path / "scored")
    schema = "model string, subject string, x long"
    results.write_scored(spark.createDataFrame([("org/m", "s1", 1), ("org/m", "s2", 2)], schema), path)
    results.write_scored(spark.createDataFrame([("org/m", "s2", 3)], schema), path)
    got = results.read_scored(spark, path, schema).select("model", "subject", "x").collect()
    assert sorted(map(tuple, got)) == [("org/m", "s1", 1), ("org/m", "s2", 3)]
