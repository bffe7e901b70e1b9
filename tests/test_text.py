import random
import string

from pyspark.sql import functions as F

from markbook import fixed_values as fixed
from markbook.functions import text

TEXT = F.col("text")
ALPHABET = "aB C.,!\t\n\r\x0b\x1c\x1f\x85\xa0   　ÀßΣİ答案（）é-_'\"\\^`{|}~"


def random_texts(n=3000, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def normalized(s):
    return " ".join("".join(c for c in s.lower() if c not in string.punctuation).split())


def test_strip_and_normalize_equal_python(values):
    texts = random_texts()
    assert values(texts, text.strip(TEXT)) == [t.strip() for t in texts]
    assert values(texts, text.normalize(TEXT)) == [normalized(t) for t in texts]


def test_punctuation_is_ascii_punctuation():
    assert fixed.PUNCTUATION == string.punctuation


def test_exact_match(values):
    assert values(["(b)", " B. ", "b c", "", None], text.exact_match(TEXT, F.lit("B"))) == [True, True, False, False, None]


def test_fold_brackets(values):
    assert values(["⟦x⟧【y】〖z〗⦃a⦄❨b❩⟮c⟯（d）"], text.fold_brackets(TEXT)) == ["[x][y][z]{a}(b)(c)(d)"]


def test_cut_at_stop(values):
    assert values(["a</s>b</s>c", "abc"], text.cut_at_stop(TEXT, F.lit("</s>"))) == ["a", "abc"]
    assert values(["a</s>b"], text.cut_at_stop(TEXT, F.lit(""))) == ["a</s>b"]


def forward_longest(value, chars, phrases):
    """Left to right; at each place the longest phrase, else the character."""
    out, i = "", 0
    while i < len(value):
        size = max((len(p) for p in phrases if value.startswith(p, i)), default=0)
        out += phrases[value[i : i + size]] if size else chars.get(value[i], value[i])
        i += size or 1
    return out


def test_script_phrases_longest_first(values):
    chars = {"甲": "1", "乙": "2", "丙": "3", "x": "y"}
    phrases = {"甲乙": "AB", "乙丙丙": "BCC", "甲乙丙": "<ABC>", "x.": "dot"}
    rng = random.Random(3)
    texts = ["".join(rng.choice("甲乙丙丁x.\n") for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    script = text.Script(chars, phrases)
    want = [forward_longest(t, chars, phrases) for t in texts]
    assert values(texts, script.column(TEXT)) == want
    assert [script.text(t) for t in texts] == want


def test_a_large_table_equals_a_walk(spark, values):
    """50,000 phrases, many of them beginnings of others."""
    rng = random.Random(8)
    letters = [chr(0x4E00 + i) for i in range(400)] + ["\U0001F600", "a"]
    phrases = {}
    while len(phrases) < 50_000:
        phrase = "".join(rng.choice(letters) for _ in range(rng.randint(2, 5)))
        phrases[phrase] = "".join(rng.choice(letters) for _ in range(rng.randint(0, 6)))
    rows = [*phrases.items(), *((c, letters[i - 1]) for i, c in enumerate(letters)), ("", "x"), ("乙" * 3, None)]
    script = text.Script.from_table(spark.createDataFrame(rows, "source string, target string"))
    assert len(script.phrases) == 50_000 and len(script.chars) == len(letters)
    known = list(phrases)
    texts = ["".join(rng.choice([rng.choice(known), rng.choice(letters), " "]) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["", None]
    by_size = {n: {p: t for p, t in phrases.items() if len(p) == n} for n in range(2, 6)}

    def walk(value):
        out, i = "", 0
        while i < len(value):
            size = next((n for n in (5, 4, 3, 2) if value[i: i + n] in by_size[n]), 0)
            out += by_size[size][value[i: i + size]] if size else script.chars.get(value[i], value[i])
            i += size or 1
        return out

    want = [None if t is None else walk(t) for t in texts]
    assert values(texts, script.column(TEXT)) == want
    assert script.trie.convert(texts) == want


def test_script_of_messages_pairs_and_arrays(spark):
    script = text.Script({"甲": "1"}, {"甲乙": "AB"})
    rows = spark.createDataFrame([([("user", "甲乙甲"), ("x", None)], [("甲", "甲乙")], ["甲甲乙", None]), (None, [], [])], "m array<struct<role string, content string>>, p array<struct<query string, answer string>>, a array<string>")
    for s, twice in ((script, "1AB"), (text.Script({"甲": "1"}), "11乙")):
        got = rows.select(s.messages(F.col("m")), s.pairs(F.col("p")), s.texts(F.col("a"))).collect()
        assert got[0][2] == [twice, None] and got[1][0] is None and got[1][1] == [] and got[1][2] == []
        assert [tuple(r) for r in got[0][0]][0][0] == "user" and got[0][0][1]["content"] is None


def test_script_without_phrases(values):
    script = text.Script()
    assert values(["答案應為：選項A"], script.column(TEXT)) == ["答案应为：选项A"] == [script.text("答案應為：選項A")]


def test_bound_evaluates_null(values):
    assert values([None, "a"], text.bound(TEXT, lambda t: F.concat(t, t))) == [None, "aa"]


def test_a_batch_is_converted_in_bounded_slices():
    import tracemalloc

    script = text.Script({"x": "y"}, {"ab": "c", "abab": "", "qu": "long"})
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abqux ") for _ in range(400)) for _ in range(5000)] + [None, "", "ab" * 300_000]
    tracemalloc.start()
    got = script.trie.convert(texts[:5000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25 * 400 * 5000
    assert got == [script.trie.convert([t])[0] for t in texts[:5000]]
    assert script.trie.convert(texts[4990:]) == [*got[4990:], None, "", ""] and script.trie.convert([]) == []
