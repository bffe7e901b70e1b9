import pytest
from pyspark.sql import functions as F

from markbook.functions import scores, scoring
from test_extract import last, matches, random_replies
from test_text import normalized

from markbook import fixed_values as fixed


def expected(policy, reply, answer):
    if policy == "cot":
        found = last(matches(reply, fixed.COT_TRADITIONAL, lead=False))
        return int(found is not None and normalized(found) == normalized(answer))
    reply = reply.strip()
    if not reply:
        return 0
    exact = normalized(reply) == normalized(answer)
    found = last(matches(reply, fixed.CASCADE))
    return int({"zero_shot": found == answer, "few_shot": exact or found == answer, "exact_only": exact}[policy])


@pytest.mark.parametrize("policy", ["zero_shot", "few_shot", "exact_only", "cot"])
def test_policy_equals_python(spark, policy):
    replies = random_replies(3000, seed=21) + ["", " ", "b", "(B)", "B.", "答案為B", None]
    rows = [(i, r, "ABCD"[i % 4]) for i, r in enumerate(replies)]
    df = spark.createDataFrame(rows, "i long, response string, answer string")
    want = [expected(policy, r or "", a) for _, r, a in rows]
    fixed_policy = scoring.marks(df, policy).orderBy("i").collect()
    per_row = scoring.marks(df, F.lit(policy)).orderBy("i").collect()
    assert [r["correctness"] for r in fixed_policy] == want
    assert [r["correctness"] for r in per_row] == want


def test_missing_gold_and_blind(spark):
    df = spark.createDataFrame([("A", None), ("A", "A")], "response string, answer string")
    assert sorted(scoring.marks(df, "zero_shot").select("correctness").collect(), key=str) == [(1,), (None,)]
    assert {r["correctness"] for r in scoring.marks(scoring.blind(df), "zero_shot").collect()} == {0}


def test_judge_policy(spark):
    df = spark.createDataFrame([("x", " A\n", "A"), ("", "A", "A"), ("x", "", "A"), ("x", "unknown", "A")], "response string, j string, answer string")
    assert [r["correctness"] for r in scoring.marks(df, "judge", judged="j").collect()] == [1, 0, 0, 0]


def test_dispatch(spark):
    rows = [("llm", True, True, "judge"), ("string", True, True, "cot"), ("string", True, False, "few_shot"), ("string", False, False, "zero_shot")]
    df = spark.createDataFrame(rows, "p string, f boolean, c boolean, want string")
    got = df.select("want", scoring.policy_of(F.col("p"), F.col("f"), F.col("c")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_argmax_ties_and_nan(spark):
    nan, inf = float("nan"), float("inf")
    rows = [([1.0, 3.0, 3.0, 0.0], "B"), ([2.0, 2.0, 2.0, 2.0], "A"), ([0.0, nan, 5.0, nan], "B"), ([-inf, -1.0, -2.0, -3.0], "B")]
    df = spark.createDataFrame(rows, "s array<double>, want string")
    assert all(r["want"] == r["got"] for r in df.select("want", scores.argmax_choice(F.col("s")).alias("got")).collect())


def test_argmax_sum_refuses_infinite_sums(spark):
    df = spark.createDataFrame([([0.0, 1.0, 0.0, 0.0], [0.0, float("inf"), 0.0, 0.0])], "a array<double>, b array<double>")
    assert df.select(scores.argmax_sum(F.col("a"), F.col("b"), on_invalid="null")).collect()[0][0] is None
    with pytest.raises(Exception, match="not finite"):
        df.select(scores.argmax_sum(F.col("a"), F.col("b"))).collect()


def test_choice_probabilities_equal_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(20, 30)) * 50
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(vectors)], "i long, v array<double>")
    got = [r[0] for r in df.orderBy("i").select(scores.choice_probabilities(F.col("v"), [3, 7, 11, 29])).collect()]

    def softmax(x):
        e = np.exp(x - x.max())
        return e / e.sum()

    want = [softmax(softmax(v)[[3, 7, 11, 29]]) for v in vectors]
    assert np.allclose(got, want, atol=1e-12)
