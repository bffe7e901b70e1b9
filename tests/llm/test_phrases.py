import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from markbook.llm import phrases as P

from .cases import LONG, empty


def pieces(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n\x0b\x0c\r]", lowered)]


def counts_by_hand(rows, longest=4):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        totals[lang] += 0
        for words in pieces(text):
            totals[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    counts[lang, " ".join(words[i: i + m])] += 1
    return counts, totals


def report_by_hand(rows, least=30, first=2000):
    counts, totals = counts_by_hand(rows)
    frequent = {k: n for k, n in counts.items() if n >= least}
    out = defaultdict(list)
    for (lang, phrase), a in frequent.items():
        words = phrase.split(" ")
        if len(words) < 2:
            continue
        if any(f" {phrase} " in f" {p} " and 100 * b >= 80 * a for (g, p), b in frequent.items() if g == lang and p != phrase):
            continue
        cuts = []
        for k in range(1, len(words)):
            le, r = counts[lang, " ".join(words[:k])], counts[lang, " ".join(words[k:])]
            cuts.append((2000000 * a // (le + r), k, le, r))
        score, _, le, r = min(cuts)
        out[lang].append((-score, -a, phrase.encode(), le, r))
    return sorted((lang, i + 1, p.decode(), -a, le, r, totals[lang], -s) for lang, found in out.items() for i, (s, a, p, le, r) in enumerate(sorted(found)[:first]))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string")


def report(spark, rows, **options):
    df = docs_of(spark, rows).withColumn("n", F.lit("x")).withColumn("_hash", F.lit(0))
    found = P.collocations(P.mine(df.select("doc_id", "lang", "text"), **{k: v for k, v in options.items() if k != "first"}), **{k: v for k, v in options.items() if k == "first"})
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in found.collect())


def texts(seed, n=300, vocabulary=14):
    rnd = random.Random(seed)
    words = ["Aa", "bé", "c-c", "dd", "e e", "ff", "<g>", "語", "i", "j", "k", "l", "m", "n"][:vocabulary]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [(rnd.choice(["en", "fr", None]), "".join(w + rnd.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for w in rnd.choices(words, weights, k=rnd.randint(1, 40)))) for _ in range(n)]


AWKWARD = [("en", None), ("en", ""), (None, " \t.,"), ("de", None), ("en", LONG), ("en", "AKA AKA AKA AKA AKA " * 20)]


@pytest.mark.parametrize("options", [{}, {"sample": 1}, {"sample": 1000}, {"slack": 5.0}])
def test_equals_brute_force_whatever_the_sample(spark, options):
    rows = texts(1) + AWKWARD
    assert report(spark, rows, **options) == report_by_hand(rows)


def test_small_chunks_and_a_filter_that_is_full(spark, monkeypatch):
    rows = texts(2, 200)
    monkeypatch.setattr(P, "CHUNK_TOKENS", 40)
    monkeypatch.setattr(P, "SLICE", 7)
    monkeypatch.setattr(P, "holds", lambda bits, hashes: np.ones(len(hashes), bool))
    assert report(spark, rows) == report_by_hand(rows)


def test_slices_do_not_change_counts(spark, monkeypatch):
    rows = texts(6, 200)
    monkeypatch.setattr(P, "SLICE", 11)
    assert report(spark, rows, slack=0.8) == report_by_hand(rows)


def test_rare_border_phrases_are_not_exchanged(spark, monkeypatch):
    passes, counted = [], P.phrase_counts

    def kept(*given, **named):
        passes.append(counted(*given, **named))
        return passes[-1]

    monkeypatch.setattr(P, "phrase_counts", kept)
    rows = texts(4, 400)
    P.mine(docs_of(spark, rows))
    whole = passes[P.LONGEST - 1]  # the first pass over all texts
    found = {(r.lang, r.phrase): r.n for r in whole.where("words > 0").collect()}
    want, _ = counts_by_hand(rows)
    assert found and all(n == want[k] for k, n in found.items())
    rare = sum(n < P.LEAST for n in found.values())
    assert rare <= len(found) // 50  # those that share bits with frequent ones


@pytest.mark.parametrize("slack", [0.4, 5.0])
def test_many_ranges_of_hashes_and_few_texts_at_once(spark, monkeypatch, slack):
    rows = texts(5, 200) + AWKWARD
    for name, value in {"RANGE_BYTES": 64, "READ": 3, "CHUNK_TOKENS": 100, "SLICE": 13}.items():
        monkeypatch.setattr(P, name, value)
    assert report(spark, rows, slack=slack) == report_by_hand(rows)


def test_later_passes_look_near_new_phrases_only():
    words = [b"a", b"b", b"c", b"d"]
    hashes = P.word_hashes(words, P.seed_of("en"))
    ids = np.array([0, 1, 2, 3, -1, 1, 0, -1, 0, 1, -1], np.int32)
    bits = np.zeros(1 << 13, np.uint8)
    for at in P._bits(P.extend(hashes[:1], hashes[1:2]), len(bits) * 8):
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    assert np.flatnonzero(P.covered(ids, hashes, bits, 3)).tolist() == [0, 1, 8, 9]  # of "a b", not of its words


def test_a_failed_sample_needs_more_passes(spark, monkeypatch):
    passes = []
    counted = P.phrase_counts
    monkeypatch.setattr(P, "phrase_counts", lambda docs, known=None, before=None, *more, **named: passes.append(before is not None) or counted(docs, known, before, *more, **named))
    rows = texts(3, 900)
    report(spark, rows, slack=1e9)  # nothing is frequent in the sample
    assert sum(passes) == 3  # words, then pairs, then triples are failures


def test_later_passes_read_excerpts_only(spark, monkeypatch):
    read, counted = [], P.phrase_counts

    def seen(docs, *more, **named):
        read.append(docs)
        return counted(docs, *more, **named)

    monkeypatch.setattr(P, "phrase_counts", seen)
    monkeypatch.setattr(P, "discard", lambda *frames: None)
    rare = [("en", " ".join(f"w{i}x{j}" for j in range(100)) + " a b c d e " + f"z{i}") for i in range(40)]
    rows = rare + texts(7, 60) + AWKWARD
    assert report(spark, rows, slack=1e9) == report_by_hand(rows)
    first, *later = read[P.LONGEST - 1:]  # the passes over all texts
    left = later[0].select(F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")).collect()
    left = [part.split() for r in left for part in r.text.decode().split("\n")]
    assert len(later) == 3 and all(r is later[0] for r in later)
    assert first.count() == len(rows)
    cut = sorted(part for part in left if any("x9" in word for word in part))
    assert cut == sorted([f"w{i}x{j}" for j in (97, 98, 99)] + ["a", "b", "c", "d", "e", f"z{i}"] for i in range(40))


def test_excerpts_hold_what_is_near(spark, monkeypatch):
    for name, value in {"CHUNK_TOKENS": 100, "EXCERPT": 4, "BATCH": 9, "SLICE": 13}.items():
        monkeypatch.setattr(P, name, value)
    rows = [(lang or "und", text) for lang, text in texts(8, 80) + AWKWARD]
    fresh = [("en", "c-c aa"), ("und", "dd"), ("fr", "bé 語 aa"), ("en", "aka")]
    bits = P.phrase_filter(spark.createDataFrame(fresh, "lang string, phrase string"), 64)
    got, want = Counter(), Counter()
    for r in P.excerpts(docs_of(spark, rows), bits).collect():
        got.update((r.lang, " ".join(words)) for words in pieces(r.text.decode()) if words)
    for lang, text in rows:
        for words in pieces(text):
            near = set()
            for phrase in (p.split(" ") for g, p in fresh if g == lang):
                for i in range(len(words)):
                    if words[i: i + len(phrase)] == phrase:
                        near |= set(range(max(0, i - 3), min(len(words), i + len(phrase) + 3)))
            want.update((lang, " ".join(words[j] for j in range(i, len(words)) if set(range(i, j + 1)) <= near)) for i in near if i - 1 not in near)
    assert got == want


def test_filters_that_differ_from_pass_to_pass(spark, monkeypatch):
    exact = P.holds
    monkeypatch.setattr(P, "holds", lambda bits, hashes: exact(bits, hashes) | (P._mix(hashes + bits.sum(dtype=np.uint64)) % np.uint64(3) == 0))
    rows = texts(9, 300, 14) + AWKWARD
    for slack in (2.0, 5.0, 1e9):
        assert report(spark, rows, slack=slack) == report_by_hand(rows)


def test_later_passes_keep_what_has_a_failure_as_a_part(spark):
    phrases = spark.createDataFrame([("en", p, len(p.split()), 40) for p in ("a b c", "b c", "c b", "x a b", "a c b")] + [("fr", "a b c", 3, 40)], "lang string, phrase string, words int, n long")
    parts = spark.createDataFrame([("en", "a b"), ("en", "c")], "lang string, phrase string")
    assert sorted(r.phrase for r in P._holding(phrases, parts).collect()) == ["a b c", "b c", "c b", "x a b"]


@pytest.mark.parametrize("limits", [{}, {"WAITING": 1, "CHUNK_WORDS": 1}, {"WAITING": 30, "CHUNK_WORDS": 10}, {"WAITING_BYTES": 50}])
def test_texts_that_wait_are_split_alike(monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(P, name, value)
    rows = [(lang or "und", text) for lang, text in texts(10, 60) + AWKWARD] + [("xx", "  ")]
    chunk = P._Chunk()
    for lang, text in rows:
        chunk.add(lang, text and text.encode())
    assert limits or not chunk.tables  # by themselves so few texts wait
    chunk.take_up()
    lang, listed = (column.to_pylist() for column in chunk.listing())
    hashes, found, piece = chunk.hashes(), Counter(), []
    assert len(listed) == chunk.width() == len({*zip(lang, listed)}) and chunk.tokens == len(chunk.ids())
    assert all(h == P.word_hashes([w], P.seed_of(g))[0] for g, w, h in zip(lang, listed, hashes))
    for i in chunk.ids().tolist():
        if i >= 0:
            piece.append(i)
        else:
            found[tuple((lang[j], listed[j].decode()) for j in piece)] += 1
            piece = []
    want = Counter(tuple((g, w) for w in words) for g, text in rows for words in pieces(text) if words)
    del found[()]
    assert found == want and not piece


def test_first_rows_and_ties(spark):
    rows = [("en", " ".join(f"a{i} b{i}" for i in range(12)))] * 30
    got = report(spark, rows, first=3)
    assert got == report_by_hand(rows, first=3)


def test_overlapping_occurrences_count(spark):
    found = {(r.phrase, r.n) for r in P.mine(docs_of(spark, [("en", "ha " * 40)])).collect()}
    assert found == {("", 40), ("ha", 40), ("ha ha", 39), ("ha ha ha", 38), ("ha ha ha ha", 37)}


def test_counts_past_64_bits(spark):
    big = 6 * 10**12
    df = spark.createDataFrame([("en", "a", 1, big + 1), ("en", "b", 1, big), ("en", "a b", 2, big), ("en", "", 0, 3 * big)], "lang string, phrase string, words int, n long")
    assert [(r.score, r.l, r.r) for r in P.collocations(df).collect()] == [(2000000 * big // (2 * big + 1), big + 1, big)]


def test_empty_table(spark):
    assert P.collocations(P.mine(empty(spark).select("doc_id", "lang", "text"))).count() == 0
