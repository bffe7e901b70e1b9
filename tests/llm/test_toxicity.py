import random

import numpy as np
import pytest

from markbook.llm import toxicity as T

from .cases import LONG, documents, empty


def corpus(n=400, seed=3):
    rnd = random.Random(seed)
    common = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 9))) for _ in range(300)]
    bad = ["blockhead", "nitwit", "vermin", "dunce"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = [rnd.choice(bad) if toxic and rnd.random() < 0.06 else rnd.choice(common) for _ in range(rnd.randint(40, 200))]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_windows_hold_the_whole_text():
    for text in ("", "a", "x" * 500, "some words é " * 90, "\n\n a"):
        assert b"".join(T.windows(text)) == text.lower().encode() and all(len(w) <= T.WINDOW for w in T.windows(text))


def test_held_out_accuracy_and_awkward_rows(spark):
    rows, labels = corpus()
    odd = [(1000, ""), (1001, None), (None, rows[0][1]), (1002, " ".join(t for i, t in rows[:300] if i % 4)), (1003, LONG), (3, rows[3][1])]
    docs = documents(spark, rows + odd)
    marks = spark.createDataFrame(labels + [(None, 1, 1), (7, None, None), (2000, 0, 1)], "doc_id long, quality int, toxic int")
    scored = T.score(docs, *T.learn(docs, marks), name="toxic_score").withColumn("out", T.held_out(docs.doc_id, 3, 1)).collect()
    assert len(scored) == len(rows + odd) and all(0 <= r.toxic_score <= 1 for r in scored)
    truth = {i: t for i, _, t in labels}
    tested = [(r.toxic_score >= 0.5) == truth[r.doc_id] for r in scored if r.out and r.doc_id in truth]
    assert len(tested) > 80 and np.mean(tested) > 0.95
    by_id = {r.doc_id: r.toxic_score for r in scored}
    assert by_id[1000] == by_id[1001] < 0.5 and by_id[1002] < 0.5


def test_held_out_rows_and_labels_are_not_learned(spark):
    rows, labels = corpus(120)
    docs = documents(spark, rows, extra=False)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r.doc_id for r in docs.where(T.held_out(docs.doc_id, 3, 1)).collect()}
    changed = documents(spark, [(i, "changed" if i in out else t) for i, t in rows], extra=False)
    flipped = spark.createDataFrame([(i, q, 1 - t if i in out else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    (a, m), (b, n) = T.learn(docs, marks), T.learn(changed, flipped)
    assert a.toxic == b.toxic and a.ordinary == b.ordinary and m.w == pytest.approx(n.w)


def test_nothing_to_learn_from(spark):
    docs = documents(spark, [(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in T.score(docs.select("doc_id", "text"), *T.learn(docs, none)).collect()] == [0.0, 0.0]
    assert T.score(empty(spark), *T.learn(empty(spark), none)).count() == 0
