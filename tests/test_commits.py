import itertools

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from markbook.sources import commits, replies, results

ROW = "k string, v int"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), ROW)


def seen(spark, path):
    return {(r["k"], r["v"]) for r in commits.latest(commits.read(spark, path, ROW), ["k"]).collect()}


def test_nothing_written_yet(spark, tmp_path):
    assert seen(spark, str(tmp_path / "none")) == set()


def test_the_last_commit_of_a_key_counts(spark, tmp_path):
    path = str(tmp_path / "t")
    commits.append(rows(spark, ("a", 1), ("b", 1)), path)
    commits.append(rows(spark, ("b", 2), (None, 2)), path)
    commits.append(rows(spark, ("c", 0)), path)
    assert seen(spark, path) == {("a", 1), ("b", 2), ("c", 0), (None, 2)}
    assert [r["number"] for r in commits.records(spark, path).orderBy("number").collect()] == [1, 2, 3]


def test_a_torn_append_is_not_seen_and_a_doubled_one_counts_once(spark, tmp_path):
    path = str(tmp_path / "t")
    commits.append(rows(spark, ("a", 1)), path)
    torn = commits.write(rows(spark, ("a", 9), ("z", 9)), path)
    assert seen(spark, path) == {("a", 1)}
    commits.append(rows(spark, ("a", 1)), path)
    assert commits.latest(commits.read(spark, path, ROW), ["k"]).count() == 1
    commits.commit(spark, path, torn)  # a commit that came late is the last
    assert seen(spark, path) == {("a", 9), ("z", 9)}


def test_a_file_left_by_a_task_that_died_is_not_read(spark, tmp_path):
    path = str(tmp_path / "t")
    attempt = commits.write(rows(spark, ("a", 1)), path)
    broken = tmp_path / "t" / "data" / f"attempt={attempt}" / "_temporary"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"torn")
    commits.commit(spark, path, attempt)
    assert seen(spark, path) == {("a", 1)}


def test_two_commits_of_one_number(spark, tmp_path):
    path = str(tmp_path / "t")
    names = [commits.write(rows(spark, ("a", i)), path) for i in range(2)]
    record = spark.createDataFrame([(n, 1) for n in names], "attempt string, number long").withColumn("written", F.current_timestamp())
    record.write.parquet(f"{path}/commits")
    assert seen(spark, path) == {("a", names.index(max(names)))}


def test_partition_columns_prune(spark, tmp_path):
    path = str(tmp_path / "t")
    commits.append(spark.createDataFrame([("a", 1, 0), ("b", 1, 1)], "k string, v int, p int"), path, ["p"])
    found = commits.read(spark, path, "k string, v int, p int").where("p = 1")
    assert [r["k"] for r in found.collect()] == ["b"] and "PartitionFilters" in found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")


def test_ledger_keeps_runs_apart(spark, tmp_path):
    path = str(tmp_path / "ledger")
    ledger = spark.createDataFrame([("r", "m", "s", 50.0, "x"), ("q", "m", "s", 10.0, "x")], results.LEDGER_ROW)
    results.commit_ledger(ledger, path)
    results.commit_ledger(ledger.where("run = 'r'").withColumn("accuracy", F.lit(60.0)), path)
    got = {(r["run"], r["accuracy"]) for r in results.committed_ledger(spark, path).collect()}
    assert got == {("r", 60.0), ("q", 10.0)}
    assert results.committed_ledger(spark, path, "q").count() == 1


def test_every_part_of_a_question_to_a_model_is_in_its_key(spark):
    base = {"prompt": "p", "tokens": 5, "model": "m"}
    changed = [base, {**base, "prompt": "p2"}, {**base, "tokens": None}, {**base, "model": "n"}, {**base, "prompt": None}]
    df = spark.createDataFrame([(c["prompt"], c["tokens"], c["model"]) for c in changed], "prompt string, tokens int, model string")
    keys = [r[0] for b in ("x", "y") for r in df.select(replies.reply_key(F.col("prompt"), F.struct("tokens"), F.col("model"), b)).collect()]
    assert len(set(keys)) == 10 and all(len(k) == 64 for k in keys)


def test_an_answer_stays_and_a_failure_is_replaced(spark, tmp_path):
    path = str(tmp_path / "replies")
    for status, text in (("timeout", None), ("error", None), ("ok", "first"), ("ok", "second"), ("error", None)):
        row = spark.createDataFrame([("k", "m", "s", text, status, 1, None, 3)], replies.STORED)
        commits.append(row, path, ["place"])
        got = replies.outcomes(spark, path, replies.STORED, "status").collect()[0]
        assert (got["status"], got["response"]) == (("ok", "first") if commits.records(spark, path).count() >= 3 else (status, text))
    assert replies.outcomes(spark, path, replies.STORED, "status", 0, 3).count() == 0


SCORED = "model string, subject string, row_idx long, attempt int, correctness int, version int"
RUNS = [
    [("m", "s", 1, 0, 0, 1), ("m", "s", 2, 0, 1, 1), ("m", "t", 1, 0, 1, 1), ("n", "s", None, 0, 1, 1)],
    [("m", "s", 1, 0, 1, 2), ("m", "s", 3, 0, 1, 2), ("n", "s", None, 0, 0, 2)],
    [("m", "s", 1, 0, 5, 0), ("m", "s", 1, 1, 7, 0), ("new", "s", 1, 0, 1, 0)],  # late rows of a lower version
]


@pytest.mark.parametrize("order", list(itertools.permutations(range(3))))
def test_upserts_in_any_order_and_repeated_give_the_same_rows(spark, tmp_path, order):
    path = str(tmp_path / "scored")
    for i in (*order, order[0]):
        results.upsert_scored(spark.createDataFrame(RUNS[i], SCORED), path)
    got = {tuple(r[c] for c in ("model", "subject", "row_idx", "attempt", "correctness")) for r in spark.read.schema(SCORED).parquet(path).collect()}
    assert got == {("m", "s", 1, 0, 1), ("m", "s", 2, 0, 1), ("m", "s", 3, 0, 1), ("m", "s", 1, 1, 7), ("m", "t", 1, 0, 1), ("n", "s", None, 0, 0), ("new", "s", 1, 0, 1)}


def test_an_upsert_leaves_other_folders_alone(spark, tmp_path):
    path = tmp_path / "scored"
    results.upsert_scored(spark.createDataFrame(RUNS[0], SCORED), str(path))
    before = sorted(p.name for p in (path / "model=m" / "subject=t").iterdir())
    results.upsert_scored(spark.createDataFrame(RUNS[1], SCORED), str(path))
    assert sorted(p.name for p in (path / "model=m" / "subject=t").iterdir()) == before


MARKS = "model string, subject string, correctness int, failed boolean"


def test_a_refresh_reads_new_appends_only(spark, tmp_path):
    from markbook.plans import incremental

    scored, state = str(tmp_path / "scored"), str(tmp_path / "state")
    batches = [
        [("m", "s", 1, False), ("m", "s", 0, False), ("n", "s", None, True)],
        [("m", "s", 1, None), ("n", None, 0, False)],
        [],
    ]
    assert incremental.refresh(spark, scored, state) == 0 and incremental.accuracy(spark, state).count() == 0
    for rows in batches:
        commits.append(spark.createDataFrame(rows, MARKS), scored)
        (new,) = incremental.unseen(spark, scored, state)
        plan = plan_of(incremental.new_marks(spark, scored, [new], MARKS))
        assert any("PartitionFilters" in line and new in line for line in plan.splitlines())
        assert incremental.refresh(spark, scored, state) == 1
    torn = commits.write(spark.createDataFrame([("m", "s", 1, False)] * 5, MARKS), scored)
    assert incremental.refresh(spark, scored, state) == 0
    got = {(r["model"], r["subject"]): (r["n_rows"], r["n_correct"], r["n_failed"]) for r in incremental.accuracy(spark, state).collect()}
    assert got == {("m", "s"): (3, 2, 0), ("n", "s"): (0, 0, 1), ("n", None): (1, 0, 0)}
    commits.commit(spark, scored, torn)
    assert incremental.refresh(spark, scored, state) == 1
    assert {r["n_rows"] for r in incremental.accuracy(spark, state).where("model = 'm'").collect()} == {8}
