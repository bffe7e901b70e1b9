import gc
import random
import weakref
import zlib

import numpy as np
import pandas as pd
import pytest
from tokenizers import Tokenizer

from markbook.llm import near_duplicates, secrets
from markbook.llm.packing import encoder, pack, plan, public_tokenizer

from .cases import LONG, documents, empty


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_tail_once_without_gaps(seed):
    rnd = random.Random(seed)
    histogram = {n: rnd.randint(0, 30) for n in rnd.sample(range(1, 2048), rnd.choice([1, 5, 400]))}
    filled, covered = {}, {}
    for length, rank, n, start, part, first, offset in plan(histogram):
        for i in range(n):
            filled.setdefault(first + i, []).append((offset, part))
            covered.setdefault((length, rank + i), []).append((start, part))
    for pieces in [*filled.values(), *covered.values()]:
        at = 0
        for start, part in sorted(pieces):
            assert start == at
            at += part
    assert all(sum(p for _, p in v) <= 2048 for v in filled.values())
    assert {k: sum(p for _, p in v) for k, v in covered.items()} == {(n, i): n for n, c in histogram.items() for i in range(c)}
    total = sum(n * c for n, c in histogram.items())
    assert len(filled) * 2048 - total < 2048 + 8 * len(filled)


TEXTS = ["", "the cat", "Don't I'll ÀÉÎ ÿ ß İstanbul ΣΑΣ é Å\n\t x  z <|endoftext|>word", "the<|endoftext|> a_b a|b x<y b'' on*** x### a\\b q~ z{} 12 3.5",
         "日本語 é́", LONG[:30000], "x" * 9000, None]


def test_encoder_equals_the_tokenizer():
    tokenizer, encode = Tokenizer.from_file(public_tokenizer()), encoder(public_tokenizer())
    for text in TEXTS[:-1]:
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_give_the_documents_back(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "no id"), (50, LONG)] + [(100 + i, "copy of one text") for i in range(300)]
    pieces = pack(documents(spark, rows), public_tokenizer()).collect()
    tokenizer = Tokenizer.from_file(public_tokenizer())
    want = sorted([(i is not None, i or 0, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in rows])
    by_doc = {}
    for p in pieces:
        assert p.length * 4 == len(p.ids) and zlib.crc32(p.ids) == p.ids_crc32
        by_doc.setdefault(p.doc_id, []).append(p)
    got = []
    for i, mine in by_doc.items():
        copies = sum(1 for j, _ in rows if j == i)
        mine.sort(key=lambda p: p.start)
        assert sum(p.length for p in mine) == copies * mine[0].doc_tokens
        whole = np.zeros(mine[0].doc_tokens, np.uint32)
        for p in mine:
            whole[p.start: p.start + p.length] = np.frombuffer(p.ids, "<u4")
        got += [(i is not None, i or 0, tuple(whole.tolist()))] * copies
    assert sorted(got) == want
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    used = sum(p.length for p in pieces)
    assert len(sequences) * 2048 - used < 2048 + 8 * len(sequences)


def test_empty_table(spark):
    assert pack(empty(spark), public_tokenizer()).count() == 0


class Captured:
    """In place of a DataFrame: keeps the function that workers would run."""

    def select(self, *columns):
        return self

    def mapInPandas(self, run, schema):
        self.run = run
        return self


@pytest.mark.parametrize("step", [near_duplicates.profiles, secrets.examine])
def test_workers_let_go_of_the_tokenizer_in_other_passes(step):
    docs = Captured()
    step(docs)
    held = weakref.ref(encoder(public_tokenizer()))
    assert held() is encoder(public_tokenizer())
    rows = pd.DataFrame({"doc_id": [1], "text": ["one two three four five six"]})
    (out,) = docs.run(iter([rows]))
    gc.collect()
    assert len(out) == 1 and held() is None
