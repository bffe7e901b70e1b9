import csv

import pytest

from markbook.sources import bank


def write(path, header, *rows, **options):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, **options).writerows([header, *rows])


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "bank"
    four, five = ["question", "A", "B", "C", "D", "answer"], ["row_idx", "question", "A", "B", "C", "D", "E", "answer", "explanation", "other"]
    write(root / "basic medicine" / "test.csv", four, ['q "1",\nnext', "a", "b", "c", "d", "A"], ["q2", "a", "", "c", "d", "B"])
    write(root / "basic medicine" / "train.csv", four, ["t1", "a", "b", "c", "d", "C"])
    write(root / "數學+100%" / "test.csv", five, [7, "q3", "a", "b", "c", "d", "e", "E", "why", "x"], [3, "q4", "a", "b", "c", "d", "e", "D", "", "x"])
    write(root / "law" / "test.csv", ["answer", "question", "B", "A"], ["B", "two only", "bb", "aa"])
    write(root / "empty" / "test.csv", four)
    return str(root)


def test_choices_are_those_of_each_file(spark, tree):
    got = bank.read_tree(spark, tree)
    assert got.columns == ["subject", "split", "row_idx", "question", "A", "B", "C", "D", "E", "answer", "explanation", "letters"]
    rows = {(r["subject"], r["split"], r["row_idx"]): r for r in got.collect()}
    assert set(rows) == {("basic medicine", "test", 0), ("basic medicine", "test", 1), ("basic medicine", "train", 0), ("數學+100%", "test", 7), ("數學+100%", "test", 3), ("law", "test", 0)}
    first, law, longer = rows["basic medicine", "test", 0], rows["law", "test", 0], rows["數學+100%", "test", 7]
    assert first["question"] == 'q "1",\nnext' and first["letters"] == list("ABCD") and first["E"] is None and first["explanation"] is None
    assert (law["A"], law["B"], law["C"], law["answer"], law["letters"]) == ("aa", "bb", None, "B", ["A", "B"])
    assert longer["letters"] == list("ABCDE") and longer["E"] == "e" and longer["explanation"] == "why"


def test_one_list_of_choices_is_a_bank(spark, tree):
    got = bank.by_choices(bank.read_tree(spark, tree), "ABCDE")
    assert got.columns == ["subject", "split", "row_idx", "question", "A", "B", "C", "D", "E", "answer", "explanation"]
    assert sorted(r["row_idx"] for r in got.collect()) == [3, 7]


def test_parquet_schemas_are_merged(spark, tmp_path):
    root = str(tmp_path / "bank")
    spark.createDataFrame([("q1", "a", "b", "A")], "question string, A string, B string, answer string").coalesce(1).write.parquet(f"{root}/s1/test")
    spark.createDataFrame([("q2", "a", "b", "c", "C"), ("q3", "a", "b", None, "B")], "question string, A string, B string, C string, answer string").coalesce(1).write.parquet(f"{root}/s2/test")
    rows = {(r["subject"], r["row_idx"]): (r["question"], r["letters"]) for r in bank.read_tree(spark, root, "parquet").collect()}
    assert rows == {("s1", 0): ("q1", ["A", "B"]), ("s2", 0): ("q2", ["A", "B", "C"]), ("s2", 1): ("q3", ["A", "B", "C"])}


def test_no_files(spark, tmp_path):
    assert bank.read_tree(spark, str(tmp_path)).count() == 0
