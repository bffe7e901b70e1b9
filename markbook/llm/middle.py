"""Fill-in-the-middle transformation with cuts found in a Fenwick tree.

A text is seen as UTF-8 bytes in blocks of fixed size.  Two Fenwick trees over the blocks hold the units and the code points
that begin in each.  A cut after k units descends the unit tree by binary lifting to the block in which unit k begins, adding
up code points on the way, and is then located among the bytes of that one block.  Units are code points, words or lines.

A null text is empty and an empty text is plain, as is a row without an id, which has nothing to draw its cuts from.  Repeated
rows are transformed alike, and all other columns are passed through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markbook.llm.common import query, table, travels

travels(__name__)

BLOCK = 4096  # bytes
PLAIN_FROM = 90  # of 100: from here on a text stays plain
SPM_BELOW = 20  # of 100: below it the suffix goes first
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"


def unit_starts(raw: np.ndarray, unit: str) -> np.ndarray:
    """True at every byte where a unit begins.  A word takes the white space after it, a line its line end; what stands before
    the first word belongs to it."""
    if unit == "code_point":
        return (raw & 0xC0) != 0x80
    starts = np.zeros(len(raw), bool)
    starts[:1] = True
    if unit == "word":
        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
        starts[1:] = space[:-1] & ~space[1:]
        first = int(np.argmin(space)) if len(raw) else 0
        starts[first: first + (first > 0)] = False
    elif unit == "line":
        starts[1:] = raw[:-1] == 10
    else:
        raise ValueError(f"unit {unit}: code_point, word or line")
    return starts


def fenwick(counts: np.ndarray) -> np.ndarray:
    """tree[i] = the sum of the lowbit(i) counts that end with the i-th."""
    total = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(len(total))
    return total - total[at - (at & -at)]


class Blocks:
    """The two trees of one text."""

    def __init__(self, raw: bytes, unit: str = "code_point", size: int = BLOCK):
        self.raw, self.size = np.frombuffer(raw, np.uint8), size
        self.points = unit_starts(self.raw, "code_point")
        self.starts = self.points if unit == "code_point" else unit_starts(self.raw, unit)
        edges = np.arange(0, len(self.raw), size)
        per_block = [np.add.reduceat(s, edges, dtype=np.int64) if len(edges) else np.zeros(0, np.int64) for s in (self.starts, self.points)]
        self.n_units, self.n_points = (int(c.sum()) for c in per_block)
        self.units, self.chars = (fenwick(c).tolist() for c in per_block)

    def cut(self, k: int) -> tuple[int, int]:
        """(bytes, code points) in front of unit ``k``; k = n_units is the end of the text."""
        if k >= self.n_units:
            return len(self.raw), self.n_points
        at, before, chars = 0, 0, 0
        step = 1 << (len(self.units) - 1).bit_length()
        while step:
            up = at + step
            if up < len(self.units) and before + self.units[up] <= k:
                at, before, chars = up, before + self.units[up], chars + self.chars[up]
            step >>= 1
        low = at * self.size
        inside = int(np.flatnonzero(self.starts[low: low + self.size])[k - before])
        return low + inside, chars + int(np.count_nonzero(self.points[low: low + inside]))


def draws(doc_id: int, seed: int = 1) -> list[int]:
    """Four unsigned 32-bit numbers that depend on the id and the seed alone."""
    hexed = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(hexed[i: i + 8], 16) for i in range(0, 32, 8)]


def transform_text(text: str | None, doc_id: int | None, seed: int = 1, unit: str = "code_point", block: int = BLOCK):
    """(units, form, code points before the middle, code points of the middle, output) of one text."""
    raw = (text or "").encode()
    blocks = Blocks(raw, unit, block)
    n = blocks.n_units
    if not raw or doc_id is None or any(mark in raw for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text or ""
    h1, h2, h3, h4 = draws(doc_id, seed)
    if h3 % 100 >= PLAIN_FROM:
        return n, "plain", None, None, text
    (b1, c1), (b2, c2) = (blocks.cut(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = raw[:b1], raw[b1:b2], raw[b2:]
    if h4 % 100 < SPM_BELOW:
        return n, "spm", c1, c2 - c1, (SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle).decode()
    return n, "psm", c1, c2 - c1, (PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle).decode()


def fill_in_middle(docs: DataFrame, seed: int = 1, unit: str = "code_point", name: str = "_middle") -> DataFrame:
    """``docs`` (doc_id, text, more) plus the struct ``name``: n, form, prefix_chars, middle_chars, output."""
    columns = ["n", "form", "prefix_chars", "middle_chars", "output"]

    @F.pandas_udf("n long, form string, prefix_chars long, middle_chars long, output string")
    def transformed(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in parts:
            rows = [transform_text(t, None if pd.isna(i) else int(i), seed, unit) for i, t in zip(ids.astype("Int64"), texts)]
            yield pd.DataFrame(rows, columns=columns).astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return docs.withColumn(name, transformed(F.col("doc_id").cast("long"), F.col("text")))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    parts = F.split(output, "<[PSM]>")  # nothing, first, second, middle
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


@query("op11_fill_in_middle", """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents
), numbers AS (
  SELECT doc_id, t, n,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS k1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS k2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS d3, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS d4
  FROM drawn
), cuts AS (
  SELECT *, least(k1, k2) AS a, greatest(k1, k2) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR d3 IS NULL OR d3 >= 90 THEN 'plain'
         WHEN d4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
), made AS (
  SELECT doc_id, n, form, a, b - a AS m, CASE form
    WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
    ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END AS output
  FROM cuts
), parts AS (
  SELECT *, strpos(output, '<P>') AS p, strpos(output, '<S>') AS s, strpos(output, '<M>') AS mid FROM made
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN m END AS middle_chars,
  sha256(output) AS output_sha256,
  sha256(CASE form
    WHEN 'plain' THEN output
    WHEN 'psm' THEN substr(output, 4, s - 4) || substr(output, mid + 3) || substr(output, s + 3, mid - s - 3)
    ELSE substr(output, p + 3, mid - p - 3) || substr(output, mid + 3) || substr(output, 4, p - 4) END) AS restored_sha256
FROM parts""")
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` cut into code points, and put together again."""
    rows = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    made = F.col("_middle")
    return rows.select(
        "doc_id", made["n"].alias("n"), made["form"].alias("form"), made["prefix_chars"].alias("prefix_chars"),
        made["middle_chars"].alias("middle_chars"), F.sha2(made["output"].cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(made["output"], made["form"]).cast("binary"), 256).alias("restored_sha256"),
    )
