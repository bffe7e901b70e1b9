import hashlib
import random

import pytest
from pyspark.sql import functions as F

from markbook.llm.middle import Blocks, draws, fill_in_middle, restored, transform_text, unit_starts

from .cases import LONG, documents, empty

ALPHABET = ["a", "é", "語", "😀", " ", "\n", "\t", "̂", "z"]


def units_by_hand(text, unit):
    """Offsets, in code points, at which units begin."""
    if unit == "code_point":
        return list(range(len(text)))
    if unit == "line":
        return [i for i in range(len(text)) if i == 0 or text[i - 1] == "\n"]
    starts = [i for i in range(len(text)) if not text[i] in " \n\t" and (i == 0 or text[i - 1] in " \n\t")]
    return [0, *starts[1:]] if text else []


@pytest.mark.parametrize("unit", ["code_point", "word", "line"])
@pytest.mark.parametrize("block", [1, 3, 8, 64])
def test_cuts_equal_a_walk(unit, block):
    rnd = random.Random(block)
    for size in (0, 1, 2, 7, 30, 200):
        text = "".join(rnd.choices(ALPHABET, k=size))
        raw = text.encode()
        starts = units_by_hand(text, unit)
        blocks = Blocks(raw, unit, block)
        assert blocks.n_units == len(starts) and blocks.n_points == len(text)
        for k, at in enumerate([*starts, len(text)]):
            assert blocks.cut(k) == (len(text[:at].encode()), at)


def test_unknown_unit():
    with pytest.raises(ValueError):
        Blocks(b"a", "syllable")
    assert unit_starts(Blocks(b"").raw, "line").tolist() == []


def by_hand(text, doc_id):
    text = text or ""
    h1, h2, h3, h4 = (0, 0, 99, 0) if doc_id is None else draws(doc_id)
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_draws_are_the_first_groups_of_the_hash():
    hexed = hashlib.sha256(b"1:42").hexdigest()
    assert draws(42) == [int(hexed[:8], 16), int(hexed[8:16], 16), int(hexed[16:24], 16), int(hexed[24:32], 16)]


def test_rows_equal_slices_and_come_back(spark):
    rnd = random.Random(5)
    texts = ["", None, "x", "a <P> in it", "<S>", "<M", "tab\tand\r\nend", LONG, "日本語の文章" * 3000]
    texts += ["".join(rnd.choices(ALPHABET, k=rnd.randint(1, 60))) for _ in range(300)]
    rows = [*enumerate(texts), (7, LONG), (None, "no id"), (-3, "below zero")]
    docs = documents(spark, rows).withColumn("form", F.lit("mine")).withColumn("output", F.lit("mine"))
    made = fill_in_middle(docs)
    assert {r.form for r in made.select("form").distinct().collect()} == {"mine"}
    out = made.select("doc_id", "text", "_middle.*", restored(F.col("_middle.output"), F.col("_middle.form")).alias("back")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == by_hand(r.text, r.doc_id)
        assert r.back == (r.text or "")
    assert {"psm", "spm", "plain"} == {r.form for r in out}


def test_words_are_never_cut():
    for i in range(200):
        n, form, before, inside, output = transform_text("one  two\nthree four ", i, unit="word")
        if form != "plain":
            assert n == 4 and before in (0, 5, 9, 15, 20) and before + inside in (0, 5, 9, 15, 20)


def test_empty_table(spark):
    assert fill_in_middle(empty(spark)).count() == 0
