import random
from itertools import combinations

import numpy as np
import pytest

from markbook.llm import near_duplicates as N
from markbook.llm.graph import components

from .cases import LONG, documents, empty


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i: i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, x), (b, y) in combinations(sets, 2):
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            p, q = top(a), top(b)
            parent[max(p, q)] = min(p, q)
    return sorted(((i, len(shingles(t)), top(i) if i is not None else None) for i, t in rows), key=str)


def near_rows(seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    rows, n = [], 0
    for size, copies, changes in ((120, 60, 3), (60, 12, 1), (200, 25, 9), (8, 6, 0)):
        base = [word() for _ in range(size)]
        for _ in range(copies):
            words = list(base)
            for _ in range(rnd.randint(0, changes)):
                words[rnd.randrange(size)] = word()
            rows.append((n, " ".join(words)))
            n += 1
    chain = [word() for _ in range(80)]  # neighbours alike, ends not
    for _ in range(15):
        rows.append((n, " ".join(chain)))
        chain[rnd.randrange(80)] = word()
        n += 1
    rows += [(n + i, " ".join(word() for _ in range(30))) for i in range(40)]
    shared = " ".join(word() for _ in range(40))
    rows += [(n + 100 + i, shared + " " + " ".join(word() for _ in range(20))) for i in range(30)]
    rnd.shuffle(rows)
    return rows + [(5000, ""), (5001, None), (5002, " \t\n"), (5003, "a b"), (5004, "A  B"), (5005, "a b c"), (None, rows[0][1]), (5006, LONG), (5007, LONG + "end"), rows[3]]


@pytest.mark.parametrize("block,best", [(1024, 8), (4, 1)])
def test_equals_brute_force(spark, monkeypatch, block, best):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "FIRST_BEST", best)
    monkeypatch.setattr(N, "SALT_ROWS", 4)
    rows = near_rows()
    got = N.groups(documents(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_pairs_across_components_are_not_lost(spark):
    """Members that only meet each other, not the bucket's first member, are linked all the same."""
    sketch = lambda seed: N.odd_sketch(np.random.default_rng(seed).integers(0, 2**32, N.SAMPLES, dtype=np.uint64).astype(np.uint32)).tobytes()
    rows = [(7, i, i if i < 90 else 0, 0, 100, 50, sketch(i // 2), N.parity(np.arange(i // 2 * 50, i // 2 * 50 + 50, dtype=np.uint64)).tobytes()) for i in range(100)]
    mixed = spark.createDataFrame(rows, "band long, doc_id long, component long, main long, members long, n_shingles long, sketch binary, parity binary")
    got = {(r.a, r.b) for r in N._across(mixed, 8).collect()}
    assert got >= {(i + 1, i) for i in range(0, 88, 2)} and all(a // 2 == b // 2 for a, b in got)


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    for share in (1.0, 0.9, 0.75):
        cut = int(3000 * 2 * share / (1 + share))
        y = np.r_[x[:cut], rng.integers(0, 2**63, 3000 - cut, dtype=np.uint64)]
        a, b = N.minhash(x), N.minhash(y)
        assert abs(float(N.estimate(N.odd_sketch(a), N.odd_sketch(b))) - share) < 0.12


def test_parity_rules_out_only_what_differs_too_much():
    rng = np.random.default_rng(6)
    for size in (20, 166, 3000):
        x = rng.integers(0, 2**63, size, dtype=np.uint64)
        for cut in (int(size * 0.86), int(size * 0.7), 0):
            y = np.r_[x[:cut], rng.integers(0, 2**63, size - cut, dtype=np.uint64)]
            alike = 100 * cut >= N.PERCENT * (2 * size - cut)
            assert N.possible(N.parity(x), N.parity(y), np.int64(2 * size)) >= alike
            if size < 500 and not alike and cut < 0.8 * size:
                assert not N.possible(N.parity(x), N.parity(y), np.int64(2 * size))


def test_components_of_long_paths_hubs_and_cycles(spark):
    links = [(i, i + 1) for i in range(70)] + [(500, i) for i in range(501, 900)] + [(1000, 1001), (1001, 1002), (1002, 1000), (1000, 1000)]
    rnd = random.Random(0)
    links = [(a, b) if rnd.random() < 0.5 else (b, a) for a, b in links]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(71)} | {i: 500 for i in range(500, 900)} | {i: 1000 for i in (1000, 1001, 1002)}


def test_empty_table(spark):
    assert N.groups(empty(spark)).count() == 0
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
