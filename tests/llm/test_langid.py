import random

import numpy as np

from markbook.llm import langid as L

from .cases import LONG, empty

SCHEMA = "doc_id long, text string, lang string, lang_pred string, score string"


def corpus(n=240):
    rnd = random.Random(1)
    words = {"en": ["the", "and", "with", "thing", "other"], "de": ["der", "und", "nicht", "schön", "über"], "es": ["que", "señor", "los", "para", "así"]}
    return [(i, " ".join(rnd.choice(words[lang]) for _ in range(rnd.randint(3, 120))), lang) for i, lang in enumerate(rnd.choices(list(words), k=n))]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def test_scoring_equals_the_plain_network():
    net = L.Network(["a", "b", "c"])
    x = np.frombuffer(random.Random(2).randbytes(L.WINDOW * 5), np.uint8).reshape(5, -1)
    pooled = [sum(net.tables[w][j][x[:, j: L.WINDOW - w + 1 + j]] for j in range(w)).max(axis=1) for w in L.WIDTHS]
    logits = np.maximum(np.hstack(pooled) + net.bias, 0) @ net.out + net.out_bias
    want = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
    assert np.allclose(net.scorer()(x), want, atol=1e-4)


def test_windows_hold_every_byte():
    for raw in (b"", b"a", b"x" * L.WINDOW, b"y" * (3 * L.WINDOW + 1)):
        assert L.windows(raw).tobytes().rstrip(b"\0") == raw


def test_held_out_accuracy_and_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(L, "STEPS", 120)
    rows = corpus()
    odd = [(900, None, "en"), (901, "", None), (902, "12 34 !?", "de"), (None, "the and other thing", "en"), (903, LONG, None), (3, rows[3][1], rows[3][2])]
    docs = table(spark, rows + odd)
    net = L.learn(docs.select("doc_id", "text", "lang"))
    assert net.languages == ["de", "en", "es"]
    got = L.predict(docs.select("doc_id", "text"), net).withColumn("out", L.held_out(docs.doc_id)).collect()
    truth = {i: lang for i, _, lang in rows}
    tested = [r.lang_pred == truth[r.doc_id] for r in got if r.out and r.doc_id in truth]
    assert len(tested) > 40 and np.mean(tested) > 0.97
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (900, 901, 902)) and by_id[903].lang_pred == "en"
    assert len(got) == len(rows + odd) and all(0 <= r.score <= 1 for r in got)


def test_nothing_to_learn_from(spark):
    docs = table(spark, [(1, "text", None)])
    assert L.learn(docs) is None
    assert [r.lang_pred for r in L.predict(docs.select("doc_id", "text"), None).collect()] == ["und"]
    assert L.predict(empty(spark).select("doc_id", "text"), None).count() == 0


def test_learns_from_all_over_a_text(spark):
    """What tells the languages apart begins after ten thousand characters."""
    front = "0123 4567 89 - " * 700
    words = {"aa": "lorem ipsum dolor sit amet ", "zz": "žluťoučký kůň úpěl ďábelské ódy "}
    rows = [(i, front + words[lang] * (300 + i), lang) for i, lang in enumerate(["aa", "zz"] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    network = L.learn(docs)
    fresh = spark.createDataFrame([(1, words["aa"] * 9), (2, words["zz"] * 9)], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in L.predict(fresh, network).collect()} == {1: "aa", 2: "zz"}


def test_any_number_of_languages_is_learned(spark, monkeypatch):
    monkeypatch.setattr(L, "SAMPLES", 600)
    docs = spark.range(1300).selectExpr("id AS doc_id", "'lang ' || id % 650 AS lang", "'word' || id % 650 AS text")
    monkeypatch.setattr(L, "STEPS", 1)
    network = L.learn(docs)
    assert len(network.languages) > 512 and network.out.shape[1] == len(network.languages)
