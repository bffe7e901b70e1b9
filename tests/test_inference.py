import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from markbook.operators import inference
from markbook.plans.backends import BACKENDS
from markbook.plans.evaluate import evaluate
from markbook.sources import results

OPTIONS = {"backoff": 0.0}


def prompts(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, prompt string")


def collect(df):
    return {r["i"]: (r["response"], r["status"], r["attempts"]) for r in df.collect()}


def test_statuses(spark):
    def make():
        seen = {}

        def one(text):
            seen[text] = seen.get(text, 0) + 1
            if text == "late" or (text == "slow" and seen[text] < 3):
                return TimeoutError("timeout=600")
            if text == "bad":
                return KeyError("reply")
            if text == "rejected":
                return inference.ServerError("no")
            return None if text == "silent" else text.upper()

        return lambda texts, params: [one(t) for t in texts]

    df = prompts(spark, ["ok", "late", "slow", "bad", "silent", "rejected", None])
    got = collect(inference.batch_generate(df.coalesce(1), make, max_attempts=4, **OPTIONS))
    assert got == {
        0: ("OK", "ok", 1), 1: (None, "timeout", 4), 2: ("SLOW", "ok", 3), 3: (None, "error", 4),
        4: (None, "empty", 1), 5: (None, "server_error", 4), 6: (None, "skipped", 0),
    }


def counting(path, reply):
    """A maker whose calls leave the prompts they were given in files."""

    def make():
        def call(texts, params):
            import uuid

            with open(f"{path}/{uuid.uuid4().hex}", "w") as f:
                f.write("\x1f".join(texts))
            return [reply(t) for t in texts]

        return call

    return make


def sent(path):
    return [t for f in path.iterdir() for t in f.read_text().split("\x1f")]


def test_one_failing_prompt_is_retried_alone(spark, tmp_path):
    df = prompts(spark, [f"p{i}" for i in range(64)]).coalesce(1)
    make = counting(str(tmp_path), lambda t: ConnectionError("x") if t == "p9" else t)
    got = collect(inference.batch_generate(df, make, max_attempts=3, **OPTIONS))
    assert got[9] == (None, "error", 3) and all(got[i] == (f"p{i}", "ok", 1) for i in range(64) if i != 9)
    assert len(sent(tmp_path)) == 64 + 2


def test_a_call_that_fails_as_a_whole_is_split(spark):
    def make():
        def call(texts, params):
            if "bad" in texts:
                raise ConnectionError("batch refused")
            return texts

        return call

    got = collect(inference.batch_generate(prompts(spark, ["a", "bad", "b"]).coalesce(1), make, max_attempts=3, **OPTIONS))
    assert got == {0: ("a", "ok", 2), 1: (None, "error", 3), 2: ("b", "ok", 2)}


def test_a_fault_of_the_function_ends_the_job(spark):
    def make():
        return lambda texts, params: [undefined_name for t in texts]  # noqa: F821

    with pytest.raises(Exception, match="undefined_name"):
        inference.batch_generate(prompts(spark, ["a"]), make, **OPTIONS).collect()


def test_rejected_prompt_is_resent_folded_and_warmer(spark):
    def make():
        def call(texts, params):
            return [inference.ServerError("no") if "【" in t or "never" in t else f"{t} {p['temperature']}" for t, p in zip(texts, params)]

        return call

    df = prompts(spark, ["【x】", "never", "plain"])
    params = F.struct(F.lit(9).alias("max_tokens"), F.lit(0.0).alias("temperature"))
    got = collect(inference.batch_generate(df, make, params=params, fold_on_server_error=True, **OPTIONS))
    assert got == {0: ("[x] 0.3", "ok", 2), 1: (None, "server_error", 2), 2: ("plain 0.0", "ok", 1)}


def test_wrong_reply_count_is_retried_per_row(spark):
    def make():
        return lambda texts, params: texts[:1]

    got = collect(inference.batch_generate(prompts(spark, ["a", "b", "c"]).coalesce(1), make, **OPTIONS))
    assert got == {0: ("a", "ok", 2), 1: ("b", "ok", 2), 2: ("c", "ok", 2)}


def test_maker_runs_once_per_task_and_only_prompts_cross(spark):
    def make():
        import uuid

        name = uuid.uuid4().hex
        return lambda texts, params: [name] * len(texts)

    df = prompts(spark, [str(i) for i in range(400)]).withColumn("wide", F.repeat("prompt", 50))
    out = inference.batch_generate(df, make, concurrency=3, batch=16, **OPTIONS)
    assert out.select("response").distinct().count() <= 3
    plan = plan_of(out)
    node = [line for line in plan.splitlines() if line.startswith("Arguments: [run(")]
    assert plan.count("ArrowEvalPython") >= 1 and all("wide" not in line.split("[run(")[1].split(")")[0] for line in node)


def test_judge_skips_empty_responses(spark):
    def make():
        return lambda texts, params: [" A\n" if "pick A" in t else "unknown" for t in texts]

    df = spark.createDataFrame([(0, "I pick A"), (1, "  "), (2, None), (3, "?")], "i long, response string")
    got = {r["i"]: (r["judged"], r["judge_status"]) for r in inference.judge(df, make, **OPTIONS).collect()}
    assert got == {0: ("A", "ok"), 1: ("", "skipped"), 2: ("", "skipped"), 3: ("unknown", "ok")}


BANK = "subject string, split string, row_idx long, question string, A string, B string, C string, D string, answer string, explanation string"


@pytest.fixture
def bank(spark):
    rows = [
        (s, split, i, f"{s} {i}", "w", "x", "y", "z", "ABCD"[i % 4], "e")
        for s in ("s1", "s2")
        for i, split in enumerate(["train"] * 2 + ["test"] * 6)
    ]
    return spark.createDataFrame(rows, BANK)


def always(letter):
    def make():
        return lambda texts, params: [f"答案：{letter}"] * len(texts)

    return make


def tasks(spark, *pairs):
    return spark.createDataFrame(list(pairs), "model string, subject string")


def test_evaluate_resumes_and_keeps_a_ledger(spark, bank, tmp_path):
    out = str(tmp_path / "run")
    todo = tasks(spark, ("m/1", "s1"), ("m/2", "s1"))
    first = evaluate(bank, todo, BACKENDS["groq"], always("C"), out, k=1, **OPTIONS)
    assert {(r["model"], r["subject"]): (r["n_rows"], r["n_correct"]) for r in first.collect()} == {("m/1", "s1"): (6, 2), ("m/2", "s1"): (6, 2)}
    more = tasks(spark, ("m/1", "s1"), ("m/1", "s2"), ("m/2", "s2"))
    second = evaluate(bank, more, BACKENDS["groq"], always("D"), out, k=1, **OPTIONS)
    assert {(r["model"], r["subject"]) for r in second.collect()} == {("m/1", "s2"), ("m/2", "s2")}
    ledger = results.committed_ledger(spark, f"{out}/ledger")
    assert ledger.count() == 4
    scored = spark.read.parquet(f"{out}/scored")
    assert scored.count() == 24 and {"response", "extracted", "correctness", "status"} <= set(scored.columns)


def test_evaluate_vector_and_judge_backends(spark, bank, tmp_path):
    def scores():
        return lambda texts, params: ["[0.1, 0.2, 0.9, 0.9]"] * len(texts)

    done = evaluate(bank, tasks(spark, ("m", "s1")), BACKENDS["hf_base"], scores, str(tmp_path / "v"), max_samples=4, **OPTIONS).collect()
    assert (done[0]["n_rows"], done[0]["n_correct"]) == (4, 1)

    def summed():
        return lambda texts, params: ["[[0, 1, 0, 0], [0, 0, 0, 9]]"] * len(texts)

    done = evaluate(bank, tasks(spark, ("m", "s1")), BACKENDS["mixtral"], summed, str(tmp_path / "m"), **OPTIONS).collect()
    assert done[0]["n_correct"] == 2

    def judge():
        return lambda texts, params: ["C\n"] * len(texts)

    done = evaluate(
        bank, tasks(spark, ("m", "s2")), BACKENDS["gemini"], always("A"), str(tmp_path / "j"), parsing="llm", judge_make=judge, **OPTIONS
    ).collect()
    assert done[0]["n_correct"] == 2
    with pytest.raises(ValueError, match="does not support judge"):
        evaluate(bank, tasks(spark, ("m", "s1")), BACKENDS["groq"], always("A"), str(tmp_path / "x"), parsing="llm")


def test_an_endpoint_that_is_down_finishes_nothing(spark, bank, tmp_path):
    todo, out = tasks(spark, ("m", "s1"), ("m", "s2")), str(tmp_path / "run")
    (tmp_path / "seen").mkdir()
    first = evaluate(bank, todo, BACKENDS["groq"], counting(str(tmp_path / "seen"), lambda t: ConnectionError("down")), out, max_attempts=1, **OPTIONS).collect()
    assert {(r["n_rows"], r["n_correct"], r["accuracy"], r["n_failed"]) for r in first} == {(0, None, None, 6)}
    assert results.committed_ledger(spark, f"{out}/ledger").count() == 0
    second = evaluate(bank, todo, BACKENDS["groq"], always("C"), out, **OPTIONS).collect()
    assert {(r["subject"], r["n_rows"], r["n_correct"], r["n_failed"]) for r in second} == {("s1", 6, 2, 0), ("s2", 6, 2, 0)}
    assert results.committed_ledger(spark, f"{out}/ledger").count() == 2
    assert evaluate(bank, todo, BACKENDS["groq"], always("C"), out, **OPTIONS).count() == 0


def test_no_prompt_is_sent_twice(spark, bank, tmp_path, monkeypatch):
    """Half the prompts fail in the first run, whose marking then breaks; the second run asks the other half only."""
    from markbook.plans import evaluate as module

    todo, out = tasks(spark, ("m", "s1"), ("m", "s2"), ("n", "s1")), str(tmp_path / "run")
    one, two = tmp_path / "one", tmp_path / "two"
    one.mkdir()
    two.mkdir()
    half = counting(str(one), lambda t: ConnectionError("x") if "s1 3" in t else "答案：C")
    with monkeypatch.context() as m:
        m.setattr(module, "mark_replies", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            evaluate(bank, todo, BACKENDS["dashscope"], half, out, max_attempts=1, wave=1, concurrency=2, **OPTIONS)
    assert len(sent(one)) == 18
    done = evaluate(bank, todo, BACKENDS["dashscope"], counting(str(two), lambda t: "答案：C"), out, concurrency=2, **OPTIONS).collect()
    assert len(sent(two)) == 2 and all("s1 3" in t for t in sent(two))
    assert {(r["model"], r["subject"]): (r["n_rows"], r["n_failed"]) for r in done} == {("m", "s1"): (6, 0), ("m", "s2"): (6, 0), ("n", "s1"): (6, 0)}


def test_failed_judge_rows_stay_open(spark, bank, tmp_path):
    out = str(tmp_path / "run")

    def judge_down():
        return lambda texts, params: [TimeoutError("timeout")] * len(texts)

    def judge():
        return lambda texts, params: ["C\n"] * len(texts)

    args = (bank, tasks(spark, ("m", "s1")), BACKENDS["gemini"], always("C"), out)
    first = evaluate(*args, parsing="llm", judge_make=judge_down, max_attempts=1, **OPTIONS).collect()
    assert (first[0]["n_rows"], first[0]["n_failed"]) == (0, 6)
    second = evaluate(*args, parsing="llm", judge_make=judge, **OPTIONS).collect()
    assert (second[0]["n_rows"], second[0]["n_correct"], second[0]["n_failed"]) == (6, 2, 0)


def test_concurrency_bounds_generation_and_judge(spark, bank, tmp_path, monkeypatch):
    from markbook.plans import joins

    def maker(path):
        def make():
            import uuid

            open(f"{path}/{uuid.uuid4().hex}", "w").close()
            return lambda texts, params: ["C"] * len(texts)

        return make

    for limit in (joins.BROADCAST_BYTES, 0):  # broadcast and salted joins
        monkeypatch.setattr(joins.join_small, "__defaults__", ("left", limit))
        one, two = tmp_path / f"g{limit}", tmp_path / f"j{limit}"
        one.mkdir()
        two.mkdir()
        evaluate(bank, tasks(spark, ("m", "s1"), ("m", "s2")), BACKENDS["gemini"], maker(str(one)), str(tmp_path / f"run{limit}"),
                 parsing="llm", judge_make=maker(str(two)), k=1, concurrency=2, **OPTIONS)
        assert len(list(one.iterdir())) <= 2 and len(list(two.iterdir())) <= 2


def test_workers_need_no_installed_copy(tmp_path):
    """Run from another folder: the functions must travel with the job."""
    import os
    import subprocess
    import sys

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("tables not present")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {root!r}); import __spark_entry__ as e; sys.path.remove({root!r})\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "print('rows', e.queries()['retry_alternate'](spark, '/root/testdata/sf0.001').count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "rows 200" in done.stdout, done.stderr[-2000:]


CHAT = "file_order int, model_name string, system_token string, end_token string, assistant_token string, user_token string"


def test_only_changed_prompts_are_asked_again(spark, bank, tmp_path):
    """One question and one model's template change: exactly the prompts that these are part of are sent."""
    todo, out = tasks(spark, ("m", "s1"), ("m", "s2"), ("n", "s1")), str(tmp_path / "run")
    seen = [tmp_path / name for name in ("one", "two", "three", "four")]
    for folder in seen:
        folder.mkdir()

    def run(bank, templates, folder):
        table = spark.createDataFrame(templates, CHAT)
        return evaluate(bank, todo, BACKENDS["tgi"], counting(str(folder), lambda t: "答案：C"), out, templates=table, concurrency=2, **OPTIONS).collect()

    old = [(0, "m", "<s>", "</s>", "<a>", "<u>"), (1, "n", "[s]", "[/s]", "[a]", "[u]")]
    run(bank, old, seen[0])
    assert len(sent(seen[0])) == 18
    changed = bank.withColumn("question", F.when((F.col("subject") == "s2") & (F.col("row_idx") == 4), "new text").otherwise(F.col("question")))
    done = run(changed, old, seen[1])
    assert [t for t in sent(seen[1]) if "new text" in t] == sent(seen[1]) and len(sent(seen[1])) == 1
    assert [(r["model"], r["subject"], r["n_rows"]) for r in done] == [("m", "s2", 6)]
    done = run(changed, [old[0], (1, "n", "[s]", "[/s]", "[A]", "[u]")], seen[2])
    assert len(sent(seen[2])) == 6 and all("[A]" in t for t in sent(seen[2]))
    assert [(r["model"], r["subject"], r["n_rows"]) for r in done] == [("n", "s1", 6)]
    # Back to the first bank: every reply is known, the tasks are only marked again.
    done = run(bank, old, seen[3])
    assert sent(seen[3]) == [] and {(r["model"], r["subject"], r["n_rows"]) for r in done} == {("m", "s2", 6), ("n", "s1", 6)}
    assert results.committed_ledger(spark, f"{out}/ledger").count() == 3


def test_runs_of_other_settings_have_their_own_ledger_rows(spark, bank, tmp_path):
    todo, out = tasks(spark, ("m", "s1")), str(tmp_path / "run")
    for k in (0, 5, 0):
        evaluate(bank, todo, BACKENDS["groq"], always("C"), out, k=k, **OPTIONS)
    ledger = results.committed_ledger(spark, f"{out}/ledger").collect()
    assert len(ledger) == 2 and sorted("top_5" in r["run"] for r in ledger) == [False, True]
    assert spark.read.parquet(f"{out}/scored").groupBy("run").count().count() == 2


def test_equal_prompts_are_asked_once_and_equal_replies_judged_once(spark, tmp_path):
    rows = [("s1", "test", i, "the same", "w", "x", "y", "z", "C", None) for i in range(5)]
    one, two = tmp_path / "one", tmp_path / "two"
    one.mkdir()
    two.mkdir()
    done = evaluate(spark.createDataFrame(rows, BANK), tasks(spark, ("m", "s1")), BACKENDS["gemini"], counting(str(one), lambda t: "C it is"), str(tmp_path / "run"),
                    parsing="llm", judge_make=counting(str(two), lambda t: "C"), **OPTIONS).collect()
    assert (done[0]["n_rows"], done[0]["n_correct"]) == (5, 5)
    assert len(sent(one)) == 1 and len(sent(two)) == 1


@pytest.mark.parametrize("parts, n", [(1, 4000), (5, 4000), (16, 20_000)])
def test_callers_get_prompts_of_equal_length_in_total(spark, parts, n):
    import random

    rng = random.Random(parts)
    lengths = [int(40 * rng.paretovariate(1.3)) % 3000 for _ in range(n)]
    df = prompts(spark, ["x" * n for n in lengths] + [None] * 9).repartition(parts)
    dealt = inference.dealt_by_length(df, F.col("prompt"), 8)
    assert dealt.columns == df.columns and dealt.rdd.getNumPartitions() == 8
    totals = [r[1] for r in dealt.groupBy(F.spark_partition_id()).agg(F.sum(F.length("prompt"))).collect()]
    assert sum(totals) == sum(lengths) and len(totals) == 8
    assert max(totals) - min(totals) < 0.05 * sum(totals) / 8


def test_dealing_few_rows_and_none(spark):
    df = prompts(spark, ["a", None, "bbb"])
    assert sorted(r["i"] for r in inference.dealt_by_length(df, F.col("prompt"), 5).collect()) == [0, 1, 2]
    assert inference.dealt_by_length(df.limit(0), F.col("prompt"), 5).count() == 0


@pytest.mark.parametrize("k", [0, 2, -1])
def test_a_task_builds_a_bounded_part_of_the_prompts(spark, tmp_path, monkeypatch, k):
    from markbook.plans import evaluate as module

    seen = []

    def spy(df, name, partitions=()):
        if name == "prompts":
            parts = df.groupBy(F.spark_partition_id()).agg(F.sum(F.length("prompt")).alias("n"), F.count("*").alias("rows")).collect()
            seen.append((max(p.n for p in parts), sum(p.rows for p in parts)))
        return written(df, name, partitions)

    written = module.written
    monkeypatch.setattr(module, "written", spy)
    monkeypatch.setattr(module, "PROMPT_BYTES", 40_000, raising=False)
    rows = [(f"s{i % 3}", "train" if i < 12 else "test", i, f"question {i} " + "long " * 20, "a", "b", "c", "d", "ABCD"[i % 4], "why") for i in range(900)]
    columns = "subject string, split string, row_idx long, question string, A string, B string, C string, D string, answer string, explanation string"
    one_file = spark.createDataFrame(rows, columns).coalesce(1)
    done = evaluate(one_file, tasks(spark, ("m1", "s0"), ("m2", "s0"), ("m1", "s1"), ("m1", "s2")), BACKENDS["groq"], always("A"), str(tmp_path / "o"), k=k, **OPTIONS)
    assert sum(r.n_rows for r in done.collect()) == seen[0][1] == 4 * 296
    assert seen[0][0] < 2 * 40_000
