import math
import random

import numpy as np
from pyspark.sql import functions as F

from markbook.llm import topk as T


def brute(rows, every, k):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in sorted({(i, tuple(v)) for i, v in good if i % every == 0}):
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def found(spark, rows, every=10, k=5):
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, lane int, score string")
    vectors = T.quantised(df)
    queries = vectors.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in T.top_k(vectors, queries, k).collect())


def test_equals_brute_force(spark):
    rnd = random.Random(1)
    f = lambda x: float(np.float32(x))
    rows = [(i, [f(rnd.gauss(0, 0.3)) for _ in range(40)]) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(40)]  # ties
    rows += [(None, rows[1][1]), (300, None), (301, [None] * 40), (302, [float("nan")] * 40), (303, [float("inf")] * 40), (310, [0.5] * 3), (311, [0.25] * 3), (320, []), (321, []), (5, rows[5][1])]
    assert found(spark, rows) == brute(rows, 10, 5)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(np.float32(2e5 * (i + 1))), float(np.float32(-6.0e4 * i)), 1.0]) for i in range(30)]
    assert found(spark, rows) == brute(rows, 10, 5)


def test_compaction_over_small_blocks(monkeypatch):
    monkeypatch.setattr(T, "DIMS", 2)
    rng = np.random.default_rng(3)
    c, q = rng.integers(-40, 40, (9, 500)).astype(float), rng.integers(-40, 40, (9, 7)).astype(float)
    ids = np.arange(500)
    got = list(T.search_block(np.arange(1000, 1007), q, ids, c, 4))
    scores = q.T @ c
    want = [(1000 + j, i, int(scores[j, i])) for j in range(7) for i in np.lexsort((ids, -scores[j]))[:4]]
    assert got == want


def test_empty_table(spark):
    assert found(spark, []) == []
