import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from markbook import fixed_values as fixed
from markbook.functions import extract
from markbook.functions.text import Script

TEXT = F.col("text")
PIECES = [
    "答案", "是", "為", "为", "應", "应", "該", "该", ":", "：", "選", "项", "選項", "选项", "选", "A", "B", "C", "D", " ", "\n",
    "　", "\r", " ", "正確", "正确", "的", "**", "(", ")", "（", "）", "因此，", "是正確的", "是正确的", "correct answer is:",
    "所以", "x", "é", "①", "\x1c", "\U0001F600", ". ", "。",
]


def random_replies(n=6000, seed=11):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def matches(reply, patterns, lead=True):
    if lead and reply[:1] in ("A", "B", "C", "D"):
        return [reply[0]]
    for pattern in patterns:
        found = re.findall(pattern, reply)
        if found:
            return found
    return []


def last(found):
    return found[-1] if found else None


@pytest.mark.parametrize("patterns", [fixed.CASCADE, fixed.LOOSE_FIRST], ids=["cascade", "loose"])
def test_cascade_equals_python_loop(values, patterns):
    texts = random_replies()
    got = values(texts, extract.last_choice(TEXT, patterns), extract.all_choices(TEXT, patterns))
    want = [matches(t, patterns) for t in texts]
    assert [g[0] for g in got] == [last(w) for w in want]
    assert [g[1] or [] for g in got] == want


@pytest.mark.parametrize("simplified", [False, True])
def test_worked_choice_equals_python_loop(values, simplified):
    texts = random_replies(seed=12)
    patterns = fixed.COT_SIMPLIFIED if simplified else fixed.COT_TRADITIONAL
    assert values(texts, extract.worked_choice(TEXT, simplified)) == [last(matches(t, patterns, lead=False)) for t in texts]
    want = [last(matches(t, fixed.LOOSE_FIRST) or matches(t, patterns[:3], lead=False)) for t in texts]
    assert values(texts, extract.loose_then_worked(TEXT, simplified)) == want


# Expected values are Python's ``re.findall``.
EDGES = [
    (r"正確的答案應該是:.*?\b([A-D])\b", "正確的答案應該是:選A", []),
    (r"正確的答案應該是:.*?\b([A-D])\b", "正確的答案應該是:\r A", ["A"]),
    (r"答案:\s?([A-D])", "答案:　B", ["B"]),
    (r"([A-D]).", "xA C", ["A"]),
    (r"([A-D]).", "A", []),
    (r"([A-D]).", "ABCD", ["A", "C"]),
    (r"答案為(.+?)", "答案為AB 答案為C", ["A", "C"]),
    (r"答案為(.+?)", "答案為\U0001F600C", ["\U0001F600"]),
    (r"答案:\s?([A-D])", "答案:\x1cB", ["B"]),
]


@pytest.mark.parametrize("pattern, reply, want", EDGES)
def test_dialect_edges(values, pattern, reply, want):
    jvm = F.lit(extract.jvm_pattern(pattern))
    assert re.findall(pattern, reply) == want
    assert values([reply], F.regexp_extract_all(TEXT, jvm, F.lit(1))) == [want]


def test_long_reply_starting_with_its_letter(values):
    reply = "C。" + "從題目可知，A 選項與 B 選項都不對。" * 400 + "答案是D"
    assert values([reply], extract.last_choice(TEXT)) == ["C"]


def test_empty_and_null(values):
    assert values(["", None, "無"], extract.last_choice(TEXT)) == [None, None, None]


def test_other_choice_letters(values):
    got = values(["答案：E", "F", "答案：F"], extract.last_choice(TEXT, choices=("A", "B", "C", "D", "E")))
    assert got == ["E", None, None]


def test_patterns_converted_for_simplified_text(values):
    texts = ["答案应为: 选项 B", "正确答案为(C)"]
    assert values(texts, extract.last_choice(TEXT, script=Script())) == [
        last(matches(t, [Script().text(p) for p in fixed.CASCADE])) for t in texts
    ]


def test_cascade_is_one_native_projection(spark):
    plan = plan_of(spark.range(5).select(F.col("id").cast("string").alias("text")).select(extract.last_choice(TEXT)))
    assert "Python" not in plan and "Exchange" not in plan


def test_own_patterns(values):
    patterns = [r"it's ([A-D])|so ([A-D])", r"x{0,2}=(\d)", r"選?項([A-D])"]
    texts = ["it's B", "so C", "=7", "xx=8 =9", "項D", "none"]
    want = ["B", "", "7", "9", "D", None]
    assert values(texts, extract.last_choice(TEXT, patterns)) == want
