import os

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C
from markbook.llm import decontamination, near_duplicates, secrets, toxicity
from markbook.llm.packing import public_tokenizer
from markbook.llm.registered import QUERIES, SQL

from .cases import documents, empty
from .test_near_duplicates import near_rows

FOLDER = "/root/testdata/sf0.001"


def test_stages_follow_their_operators(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("tables not present")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [n for n, _ in C.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    rows = docs
    for name, stage in C.STAGES:
        before = {r.doc_id: r.text for r in rows.collect()}
        out = stage(spark, rows, FOLDER)
        if name != "packing":
            assert out.columns == docs.columns
        after = out.collect()
        if name == "toxicity":
            scores = toxicity.score(rows, *toxicity.learn(rows, spark.read.parquet(f"{FOLDER}/labels.parquet"))).collect()
            assert {r.doc_id for r in after} == {r.doc_id for r in scores if r.score < 0.7}
        elif name == "near_duplicates":
            assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in near_duplicates.groups(rows).collect() if r.kept)
        elif name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
            assert {r.doc_id for r in after} == {i for i, t in before.items() if not any(x in t for x in items)}
        elif name == "secrets":
            for r in after:
                spans = secrets.base_spans(before[r.doc_id])
                assert r.n_chars == len(r.text) and (r.text == before[r.doc_id]) <= (not spans) and not secrets.base_spans(r.text)
        else:
            tokenizer = Tokenizer.from_file(public_tokenizer())
            assert sum(r.length for r in after) == sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in before.values())
        rows = C.stored(out, name)


def test_one_of_each_group_takes_awkward_rows(spark):
    rows = near_rows()
    out = C.one_of_each_group(spark, documents(spark, rows), FOLDER)
    got = [r.doc_id for r in out.collect()]
    kept = {r.doc_id for r in near_duplicates.groups(documents(spark, rows)).collect() if r.kept}
    assert len(got) == len(set(got)) and set(got) == kept
    assert C.one_of_each_group(spark, empty(spark), FOLDER).count() == 0


def test_every_operator_has_one_query():
    numbered = [n for n in QUERIES if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in numbered) == list(range(1, 14)) and "pipeline" in QUERIES and set(SQL) <= set(QUERIES)


def test_stages_take_awkward_rows_and_clashing_columns(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("tables not present")
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first().text
    rows = [(1, None), (2, ""), (None, "no id here"), (None, None), (3, "one text"), (3, "another text"), (None, item), (4, item)]
    docs = documents(spark, rows)
    for name, stage in C.STAGES:
        docs = C.stored(stage(spark, docs, FOLDER), name)
        if name == "decontamination":
            kept = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()))
            assert [k[:2] for k in kept] == [(False, 0), (False, 0), (True, 1), (True, 2), (True, 3)]
    pieces = docs.collect()
    assert sorted((r.doc_id or 0) for r in pieces) == [0, 0, 1, 2, 3] and {r.length for r in pieces if r.doc_id in (1, 2)} == {1}
    none = empty(spark)
    for name, stage in C.STAGES:
        none = C.stored(stage(spark, none, FOLDER), name)
    assert none.count() == 0 and "sequence_id" in none.columns
