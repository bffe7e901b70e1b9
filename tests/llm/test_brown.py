import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from markbook.llm import brown as B

from .cases import LONG, documents, empty


def tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    return [w for w in lowered.split(" ") if w] + [None]


def trains(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 != 0


def sentences(n, seed=3):
    """Alternating nouns and verbs, with an article before nouns."""
    rnd = random.Random(seed)
    nouns, verbs = [f"noun{i}" for i in range(40)], [f"verb{i}" for i in range(40)]
    return [" ".join(w for _ in range(rnd.randint(1, 12)) for w in ("the", rnd.choice(nouns), rnd.choice(verbs))) for _ in range(n)]


AWKWARD = ["", None, "ÀB c d\x0be", "Only once", "A a A", " \t\n", LONG]


def scored(spark, rows, **options):
    docs = documents(spark, rows)
    return B.score(docs, F.col("doc_id").isNotNull() & ~B.held_out(F.col("doc_id")), **options).collect()


def base_by_hand(rows):
    counts = Counter(t for i, text in rows if trains(i) for t in tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for i, text in rows:
        found = [counts[t] for t in tokens(text)]
        out.append((i is not None, i or 0, len(found), sum(c > 0 for c in found), total, sum(math.log10((c + 0.1) / (total + 0.1 * (distinct + 1))) for c in found)))
    return sorted(out)


@pytest.mark.parametrize("chunk", [50, 1 << 20])
def test_base_counts_equal_a_walk(spark, monkeypatch, chunk):
    monkeypatch.setattr(B, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(B, "SHARE", 40)  # most words are outside the rounds
    rows = [*enumerate(AWKWARD + sentences(60)), (5, "A a A"), (None, "never learned")]
    got = scored(spark, rows, classes=4, rounds=3)
    want = base_by_hand(rows)
    mine = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    assert [m[:5] for m in mine] == [w[:5] for w in want]
    assert all(math.isclose(m[5], w[5], rel_tol=1e-9) for m, w in zip(mine, want))
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_a_worker_takes_up_and_hands_on_little_at_once(monkeypatch):
    class Docs:
        def mapInArrow(self, run, schema):
            return run

    class Context:
        get = classmethod(lambda cls: cls)
        partitionId = classmethod(lambda cls: 2)

    class Shared:
        value = {b"a": 0}

    monkeypatch.setattr(B, "TaskContext", Context)
    rows = [f"a w{i} a" + " padding" * 400 for i in range(2000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(2000)), "train": [True] * 2000, "text": rows})
    out = list(B.numbered(Docs(), Shared, 1, np.array([0, 4, 5]))(iter([batch])))
    assert max(b.num_rows for b in out if b["ids"].null_count == 0) <= 256
    assert sum(b.num_rows for b in out if b["ids"].null_count == 0) == 2000
    assert {w for b in out for w in b["word"].to_pylist() if w} == {"padding", *(f"w{i}" for i in range(2000))}
    tracemalloc.start()
    size = sum(len(t) for t in B._texts(batch))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < size / 4


def test_chunks_do_not_change_scores(spark, monkeypatch):
    rows = [*enumerate(AWKWARD + sentences(40))]
    monkeypatch.setattr(B, "SHARE", 40)
    whole = {(r.doc_id): r.score for r in scored(spark, rows, classes=5)}
    monkeypatch.setattr(B, "CHUNK_WORDS", 5)
    split = {(r.doc_id): r.score for r in scored(spark, rows, classes=5)}
    assert all(math.isclose(whole[i], split[i], rel_tol=1e-9) for i in whole)


def test_classes_find_the_parts_of_speech_and_beat_single_words(spark):
    rows = [*enumerate(sentences(400))]
    got = [r for r in scored(spark, rows, classes=4) if not trains(r.doc_id)]
    single, classed = (sum(getattr(r, c) for r in got) / sum(r.n_tokens for r in got) for c in ("base_score", "score"))
    assert classed > single + 0.25
    learned = documents(spark, rows).select("text")
    frequent, member, counts, total, distinct, ends = B.clusters(learned, 4, 8)
    groups = {}
    for (word, _), label in zip(frequent, member):
        groups.setdefault(int(label), set()).add(word[:4])
    assert all(len(kinds) == 1 for kinds in groups.values())
    assert (total, ends) == (sum(len(tokens(t)) for _, t in rows), len(rows)) and counts.sum() == total


def test_rare_words_follow_their_neighbours(spark, monkeypatch):
    monkeypatch.setattr(B, "SHARE", 125)  # about half of the nouns and verbs are frequent
    texts = sentences(300) + ["the rarenoun verb1 the noun3 rareverb the rarenoun verb2"] * 3
    rows = [*enumerate(texts)]
    frequent, member, counts, *_ = B.clusters(documents(spark, rows).select("text"), 4, 8)
    names = {w.decode(): int(c) for (w, _), c in zip(frequent, member)}
    numbers = spark.sparkContext.broadcast({w: i for i, (w, _) in enumerate(frequent)})
    listed = B.numbered(documents(spark, rows).withColumn("train", F.lit(True)), numbers, len(frequent), member).where("word IS NOT NULL")
    rare = {r.word: (r.n, r["class"]) for r in B.placed(listed.repartition(3), B.placing(counts, 4), names=True).collect()}
    want = Counter(t for _, text in rows for t in tokens(text))
    assert {w: n for w, (n, _) in rare.items()} == {w: n for w, n in want.items() if w is not None and w not in names}
    other = {w: c for w, (_, c) in rare.items()}
    assert other["rarenoun"] in {other[w] for w in other if w.startswith("noun")} | {names[w] for w in names if w.startswith("noun")}
    assert other["rarenoun"] != other["rareverb"]


@pytest.mark.parametrize("seed", range(4))
def test_best_class_equals_trying_all(seed):
    rng = np.random.default_rng(seed)
    classes, n = 4, 9
    member = np.append(rng.integers(0, classes, n), [classes, classes + 1])
    text = rng.integers(0, n + 2, 300)
    pairs = list(zip(text, np.roll(text, -1)))  # a ring, so that every token has two neighbours

    def table(member):
        out = np.zeros((classes + 2, classes + 2))
        for a, b in pairs:
            out[member[a], member[b]] += 1
        return out

    for word in range(n):
        left, right, alone = np.zeros(classes + 2), np.zeros(classes + 2), 0.0
        for a, b in pairs:
            alone += a == word == b
            right[member[b]] += a == word != b
            left[member[a]] += b == word != a
        tried = []
        for c in range(classes):
            changed = member.copy()
            changed[word] = c
            tried.append(B.likelihood(table(changed)))
        chosen = B.best_class(table(member), member[word], left, right, alone, classes)
        assert math.isclose(tried[chosen], max(tried), rel_tol=1e-12)


def test_chances_add_up_to_one():
    rng = np.random.default_rng(1)
    counts = np.zeros((256, 256), np.int64)
    codes = [0, 1, 2, 3, B.HAPAX, B.HAPAX + 2]  # three classes, the end as 3
    for a in codes:
        for b in codes:
            counts[a, b] = rng.integers(0, 9)
    model = B.Model(counts, 3)
    for before in (0, 1, 2, 3, B.UNSEEN):
        assert math.isclose(model.spread[before].sum() + model.chance[before], 1.0, rel_tol=1e-12)


def test_nothing_to_learn_from(spark):
    got = scored(spark, [(None, "a b"), (None, None)])
    assert [(r.n_known, r.train_tokens, r.base_score) for r in got] == [(0, 0, 0.0)] * 2
    assert all(math.isfinite(r.score) for r in got)


def test_empty_table(spark):
    assert B.score(empty(spark), F.lit(True)).count() == 0
