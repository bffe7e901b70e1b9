from markbook.llm import decontamination as D

from .cases import LONG, documents, empty

ITEMS = [
    (1, "A train leaves Paris at 9 and travels 120 km to Lyon in 2 hours. How many km does the train travel in 1 hour?"),
    (2, "which of these is the capital of the old kingdom"),
    (3, "two words"), (4, None), (5, ""), (None, "this item has no id so nothing can hold it at all"),
    (6, "which of these is the capital of the old kingdom"),
    (7, "name the river that flows north past the seven towers"),
]


def found(spark, rows, items=ITEMS):
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, hash string")
    return sorted(((r.doc_id, r.item_id) for r in D.leaks(documents(spark, rows), bench).collect()), key=lambda p: (p[0] is not None, p))


def test_copies_changes_and_clean_documents(spark):
    filler = "some other text that stands before and after it all the while "
    rows = [
        (10, filler + ITEMS[0][1] + " " + filler),
        (11, filler + ITEMS[0][1].upper().replace(",", "") + filler),
        (12, filler + "A train leaves Rome at 7 and travels 300 km to Oslo in 5 hours. How many km does the train travel in 1 hour? " + filler),
        (13, filler + "WHICH of these, is the capital of the old kingdom? " + filler),
        (14, filler * 3), (15, "which of these is the capital of a new republic then"), (16, None), (17, ""), (None, ITEMS[0][1]),
        (18, LONG + ITEMS[6 + 1][1]), (19, "two words"), (10, filler), (20, "the capital of the old kingdom"),
        (21, "this item has no id so nothing can hold it at all"),
    ]
    got = found(spark, rows)
    assert got == [(None, 1), (10, 1), (11, 1), (12, 1), (13, 2), (13, 6), (18, 7), (19, 3)]


def test_slots_must_agree(spark):
    item = [(1, "Take 5 apples and give 5 apples to a friend then count the apples and take 5 again and rest")]
    same = "Take 9 apples and give 9 apples to a friend then count the apples and take 9 again and rest"
    mixed = "Take 1 apples and give 2 apples to a friend then count the apples and take 3 again and rest"
    assert found(spark, [(1, same)], item) == [(1, 1)]
    pieces, where, _, _, slot = D.Reader()(same)
    assert [pieces[i] for i, s in zip(where, slot) if s] == ["9", "9", "9"]
    (full,) = [r for r in D.leaks(documents(spark, [(1, same)]), spark.createDataFrame(item, "item_id long, text string")).collect()]
    rows = D.leaks(documents(spark, [(2, mixed)]), spark.createDataFrame(item, "item_id long, text string")).collect()
    assert full.share == 1.0 and all(r.share < 1.0 for r in rows)


def test_clean_keeps_columns_and_searches_null_ids(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents(spark, [(1, ITEMS[0][1]), (2, "clean"), (2, "clean"), (None, ITEMS[0][1]), (None, "clean"), (None, None)])
    kept = D.clean(docs, bench)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 2, 2]


def test_empty_tables(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.leaks(empty(spark), bench).count() == 0
    assert D.leaks(documents(spark, [(1, "x")]), bench.limit(0)).count() == 0


def test_short_items_are_found_as_written(spark):
    item = [(3, "Is it on?"), (4, "7 km")]
    assert found(spark, [(1, "We asked: is it on? Nobody knew."), (2, "is it off"), (3, "it ran 9 km"), (4, "it ran 7 km")], item) == [(1, 3), (4, 4)]


def test_a_value_of_the_document_stands_for_one_of_the_item(spark):
    item = [(1, "what is the sum of 5 plus 6 when all apples are counted")]
    rows = [(1, "what is the sum of 7 plus 8 when all apples are counted"), (2, "what is the sum of 9 plus 9 when all apples are counted")]
    assert found(spark, rows, item) == [(1, 1)]


def test_rows_of_one_id_are_searched_apart(spark):
    words = ITEMS[0][1].split()
    half = len(words) // 2 - 4  # neither half holds enough of the item
    rows = [(1, " ".join(words[:half])), (1, " ".join(["x"] * half + words[half: half + 9])), (2, "plain"), (2, ITEMS[7][1])]
    assert found(spark, rows) == [(2, 7)]
    kept = D.clean(documents(spark, rows), spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert sorted((r.doc_id, r.text == "plain") for r in kept.collect()) == [(1, False), (1, False), (2, True)]


def test_equals_a_plain_search_for_literal_copies(spark):
    """Items without slots: a document holds an item if 13 of its tokens, or all, stand there in a row."""
    import random

    rnd = random.Random(4)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    items = [(i, " ".join(rnd.choices(words, k=rnd.randint(5, 30)))) for i in range(15)]
    rows = []
    for i in range(120):
        text = rnd.choices(words, k=rnd.randint(0, 40))
        if i % 2:
            of = rnd.choice(items)[1].split()
            a = rnd.randint(0, len(of))
            text[rnd.randint(0, len(text)):0] = of[a: a + rnd.randint(3, 20)]
        rows.append((i, " ".join(text)))
    want = []
    for i, text in rows:
        held = f" {text} "
        for n, item in items:
            tokens = item.split()
            size = min(13, len(tokens))
            if any(f" {' '.join(tokens[a: a + size])} " in held for a in range(len(tokens) - size + 1)):
                want.append((i, n))
    assert want and found(spark, rows, items) == sorted(want)
