"""Text expressions: trimming, answer comparison, folding, script conversion."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cached_property

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markbook import fixed_values as fixed
from markbook.functions import trie as tries
from markbook.functions.trie import Trie

# Workers get these functions with the job, so they need no installed copy.
cloudpickle.register_pickle_by_value(tries)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Every character that Python counts as white space; the JVM's own classes leave
# some of them out.  Once as a regex class, once as plain characters.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0" + "".join(
    map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
_ODD_SPACES = SPACES.replace(" ", "")


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, however often it is used.

    The lambda also keeps a large expression out of the generated stage method,
    which the JVM would otherwise find too long to compile.
    """
    return F.transform(F.array(value), use)[0]


def strip(text: Column) -> Column:
    """White space of any kind removed from both ends (``trim`` knows only U+0020)."""
    return F.btrim(text, F.lit(SPACES))


def normalize(text: Column) -> Column:
    """Lower case, no ASCII punctuation, single spaces: the form answers compare in.

    One pass drops the punctuation and turns every white space into U+0020.
    """
    bare = F.translate(F.lower(text), _ODD_SPACES + fixed.PUNCTUATION, " " * len(_ODD_SPACES))
    return F.trim(F.regexp_replace(bare, "  +", " "))


def exact_match(left: Column, right: Column) -> Column:
    return normalize(left) == normalize(right)


def fold_brackets(text: Column) -> Column:
    """Exotic brackets to their ASCII forms."""
    return F.translate(text, "".join(fixed.BRACKETS), "".join(fixed.BRACKETS.values()))


def cut_at_stop(text: Column, stop: Column) -> Column:
    """Text before the first stop token; an empty stop token keeps the whole text."""
    return F.when(F.length(stop) > 0, F.call_function("substring_index", text, stop, F.lit(1))).otherwise(text)


def text_or_empty(text: Column) -> Column:
    """A missing or blocked response counts as empty text."""
    return F.coalesce(text, F.lit(""))


class Script:
    """Traditional-to-simplified mapping: single characters and optional phrases.

    Phrases win over characters, from left to right, and the longest phrase at a
    position wins, as in a dictionary segmenter.  Characters alone are one built-in
    expression.  With phrases, texts go through a trie in Arrow batches; the trie is sent to
    the workers once, and its size is that of the dictionary, whatever the texts are.
    """

    def __init__(self, chars: dict[str, str] | None = None, phrases: dict[str, str] | None = None):
        self.chars = dict(fixed.SCRIPT_CHARS if chars is None else chars)
        self.phrases = dict(phrases or {})
        self._shared = None

    @classmethod
    def from_table(cls, table: DataFrame) -> Script:
        """The mapping of a table (source, target), one character or phrase per row.  Of repeated sources the least target counts."""
        rows = table.where("source <> '' AND target IS NOT NULL").groupBy("source").agg(F.min("target").alias("target")).toArrow()
        pairs = dict(zip(rows["source"].to_pylist(), rows["target"].to_pylist()))
        single = {s: t for s, t in pairs.items() if len(s) == 1 and len(t) == 1}
        return cls(single, {s: t for s, t in pairs.items() if s not in single})

    @cached_property
    def trie(self) -> Trie:
        return Trie(self.chars, self.phrases)

    def _sent(self):
        """What the trie is made of as a broadcast of the running session."""
        context = SparkSession.active().sparkContext
        if self._shared is None or self._shared[0] is not context:
            self._shared = (context, context.broadcast(self.trie.parts))
        return self._shared[1]

    def column(self, text: Column) -> Column:
        if not self.phrases:
            return F.translate(text, "".join(self.chars), "".join(self.chars.values()))
        shared = self._sent()

        @F.pandas_udf("string")
        def converted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            trie = Trie.of(shared.value)
            for texts in parts:
                yield pd.Series(trie.convert(list(texts)), dtype=object)

        return converted(text)

    def texts(self, texts: Column) -> Column:
        """Every element of an array of texts converted."""
        if not self.phrases:
            return F.transform(texts, self.column)
        shared = self._sent()

        @F.pandas_udf("array<string>")
        def converted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            trie = Trie.of(shared.value)
            for lists in parts:
                sizes = [0 if one is None else len(one) for one in lists]
                flat = iter(trie.convert([t for one in lists if one is not None for t in one]))
                yield pd.Series([None if one is None else [next(flat) for _ in range(n)] for one, n in zip(lists, sizes)], dtype=object)

        return converted(texts)

    def text(self, value: str) -> str:
        """The same conversion of a driver-side constant, such as a pattern."""
        return self.trie.convert([value])[0]

    def messages(self, messages: Column) -> Column:
        """Each message's content converted."""
        return F.zip_with(messages, self.texts(messages.getField("content")), lambda m, t: F.struct(m["role"].alias("role"), t.alias("content")))

    def pairs(self, history: Column) -> Column:
        """Both parts of each pair (query, answer) converted."""
        queries, answers = (self.texts(history.getField(name)) for name in ("query", "answer"))
        return F.zip_with(queries, answers, lambda q, a: F.struct(q.alias("query"), a.alias("answer")))
