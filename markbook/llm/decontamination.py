"""Benchmark decontamination on templates.

Texts are read as tokens twice over: literally (lower case), and as a template in which numbers, units after numbers and
names are typed placeholders.  Windows of both readings of the benchmark fill a bitmap of fixed size; windows of documents
that pass it are joined with the benchmark's windows by hash.  Matches of a document and an item that lie on one
diagonal are put together if their slots agree: a value of the item must stand for the same value of the document
everywhere, so a question with other numbers or names is caught, and chance agreement of templates is not.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markbook.llm.common import query, stored, table, tidy, travels
from markbook.plans.joins import salted_join

travels(__name__)

WINDOW = 8  # tokens; an item of fewer tokens is one window
SHORT_ITEM = 5  # tokens; items of fewer are found as they are written, never as a template
LITERAL = 5 / 8  # least share of a window's tokens that are no placeholders
RUN = 13  # tokens that must agree in one run, or the whole item if it is shorter
BITMAP_BITS = 1 << 28  # at most; there are 16 bits for a window of the benchmark
SALTS = 64
CACHE = 300_000

TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+(?:[.,:]\d+)*|[.!?\n]|[%$€£°]")
# Units that are a placeholder next to a number.
UNITS = frozenset(
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg t gram grams kilogram kilograms ton tons tonne tonnes lb lbs "
    "pound pounds oz ounce ounces ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour "
    "hours day days week weeks month months year years hz khz mhz ghz w kw kwh v volt volts j kj cal kcal pa kpa bar k mph kmh usd "
    "eur gbp dollar dollars euro euros cent cents percent degree degrees kb mb gb tb byte bytes bit bits".split()) | frozenset("%$€£°")
STOPS = frozenset(".!?\n")
WORD, NUMBER, UNIT, CAPITAL, STOP = range(5)
NAME = 3

_RNG = np.random.default_rng(77)
_STEPS = _RNG.integers(0, 2**63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACEHOLDER = _RNG.integers(0, 2**63, 4, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Tokens(dict):
    """token -> its hash with its kind in the last three bits"""

    def __missing__(self, token: str) -> int:
        low = token.lower()
        kind = (STOP if token in STOPS else NUMBER if token[0].isdigit() else UNIT if low in UNITS else CAPITAL if token[0].isupper() else WORD)
        self[token] = found = int.from_bytes(hashlib.blake2b(low.encode(), digest_size=8).digest(), "little") & ~7 | kind
        return found


class Reader:
    """text -> (pieces, where tokens are among them, literal hashes, template hashes, slot kinds); a kind of 0 is a literal token."""

    def __init__(self):
        self.known = _Tokens()

    def __call__(self, text: str | None):
        found = TOKEN.findall(text or "")
        if len(self.known) > CACHE:
            self.known.clear()
        values = np.fromiter(map(self.known.__getitem__, found), np.uint64, len(found))
        literal, kind = values & ~np.uint64(7), (values & np.uint64(7)).astype(np.int8)
        before = np.r_[np.int8(STOP), kind[:-1]]
        after = np.r_[kind[1:], np.int8(STOP)]
        slot = np.zeros(len(kind), np.int8)
        slot[kind == NUMBER] = NUMBER
        slot[(kind == UNIT) & ((before == NUMBER) | (after == NUMBER))] = UNIT
        slot[(kind == CAPITAL) & (before != STOP)] = NAME
        stay = kind != STOP
        literal, slot = literal[stay], slot[stay]
        return found, np.flatnonzero(stay), literal, np.where(slot > 0, _PLACEHOLDER[slot], literal), slot


def window_hashes(tokens: np.ndarray, size: int) -> np.ndarray:
    n = len(tokens) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    s = np.full(n, size, np.uint64)
    for i in range(size):
        s += tokens[i: i + n] * _STEPS[i]
    return _mix(s)


def _windows(reader: Reader, text: str | None, sizes: list[int]):
    """(size, positions, hashes, slots) of all windows, literal and, where it differs, as a template."""
    found, where, literal, template, slot = reader(text)
    filled = np.r_[0, np.cumsum(slot > 0)]
    for size in sizes:
        n = len(literal) - size + 1
        if n <= 0:
            continue
        yield size, np.arange(n), window_hashes(literal, size), None
        if size < SHORT_ITEM or not filled[-1]:
            continue
        slots = filled[size:] - filled[:-size]
        at = np.flatnonzero((slots > 0) & (size - slots >= LITERAL * size))
        if len(at):
            yield size, at, window_hashes(template, size)[at], lambda p, size=size: [found[where[i]].lower() for i in range(p, p + size) if slot[i]]


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(hash, item_id, item_at, item_slots, size, n_tokens); null ids and items without a token have none."""

    def run(batches: Iterator[pd.DataFrame]):
        reader = Reader()
        for rows in batches:
            out = []
            for item, text in zip(rows["item_id"], rows["text"]):
                n = len(reader(text)[1])
                if not n:
                    continue
                for size, at, hashes, slots in _windows(reader, text, [min(WINDOW, n)]):
                    out += [(h, item, p, slots(p) if slots else [], size, n) for p, h in zip(at.tolist(), hashes.view(np.int64).tolist())]
            yield pd.DataFrame(out, columns=["hash", "item_id", "item_at", "item_slots", "size", "n_tokens"])

    return benchmark.where("item_id IS NOT NULL").select("item_id", "text").mapInPandas(
        run, "hash long, item_id long, item_at int, item_slots array<string>, size int, n_tokens int")


ROW = ["doc_id", "text_hash", "text_length"]  # of rows that share all three, repeated ones, one is searched for all


def _rows(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"text_hash": F.xxhash64("text"), "text_length": F.length("text")})


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text_length, at, slots) of document windows joined to equal windows of ``items``."""
    spark = docs.sparkSession
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # at most WINDOW
    width = max(16, min(BITMAP_BITS.bit_length() - 1, (16 * items.count()).bit_length()))
    bucket = F.shiftrightunsigned("hash", 64 - width)
    bits = items.groupBy(F.shiftright(bucket, 3).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1, CAST(shiftrightunsigned(hash, {64 - width}) & 7 AS INT))")).alias("bits"))
    bitmap = np.zeros(1 << width - 3, np.uint8)
    found = bits.toArrow()  # at most BITMAP_BITS bits
    bitmap[found["at"].to_numpy()] = found["bits"].to_numpy().astype(np.uint8)
    shared = spark.sparkContext.broadcast(bitmap)
    shift = np.uint64(64 - width)

    def run(batches: Iterator[pd.DataFrame]):
        tidy()
        reader, held = Reader(), shared.value
        for rows in batches:
            out = []
            for *row, text in zip(rows["doc_id"].astype("Int64"), rows["text_hash"], rows["text_length"], rows["text"]):
                for _, at, hashes, slots in _windows(reader, text, sizes):
                    bit = (hashes >> shift).astype(np.int64)
                    hit = np.flatnonzero(held[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                    out += [(h, *row, p, slots(p) if slots else []) for p, h in zip(at[hit].tolist(), hashes[hit].view(np.int64).tolist())]
            yield pd.DataFrame(out, columns=["hash", *ROW, "at", "slots"]).astype({"doc_id": "Int64"})

    found = _rows(docs.where("text IS NOT NULL").select("doc_id", "text")).select(*ROW, "text").mapInPandas(
        run, "hash long, doc_id long, text_hash long, text_length int, at int, slots array<string>")
    # A window that many documents share is spread over SALTS tasks; the benchmark's windows are repeated for each.
    return salted_join(found, items, ["hash"], "inner", SALTS)


def _agreeing(windows: list) -> list:
    """Windows of one diagonal whose slots agree with the commonest reading of each slot value, the item's and the document's: one
    value of the item stands for one of the document and the other way round."""
    votes: tuple[dict[str, Counter], dict[str, Counter]] = (defaultdict(Counter), defaultdict(Counter))
    for w in windows:
        for a, b in set(zip(w["item_slots"], w["slots"])):
            votes[0][a][b] += 1
            votes[1][b][a] += 1
    meant, back = ({a: max(sorted(c), key=c.__getitem__) for a, c in side.items()} for side in votes)
    return [w for w in windows if len(w["item_slots"]) == len(w["slots"]) and all(meant[a] == b and back[b] == a for a, b in zip(w["item_slots"], w["slots"]))]


def _decide(windows: list, total: int) -> tuple[int, float]:
    """(longest run, share) of the tokens of an item that one stretch of a document covers, both read in step from one place on."""
    covered = np.zeros(total + 1, bool)
    for w in _agreeing(windows):
        covered[w["item_at"]: w["item_at"] + w["size"]] = True
    edges = np.flatnonzero(np.diff(np.r_[False, covered].astype(np.int8)))
    return int((edges[1::2] - edges[::2]).max(initial=0)), float(covered.sum()) / total


def found_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``leaks`` with the columns ROW, one row per different row of ``docs`` and item."""
    items = stored(benchmark_windows(benchmark), "benchmark-windows")
    windows = matches(docs, items)

    @F.pandas_udf("struct<longest_run: int, share: double>")
    def decided(windows: pd.Series, totals: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_decide(list(w), n) for w, n in zip(windows, totals)], columns=["longest_run", "share"])

    # Repeated rows give the same windows, so a stretch has at most those of its item.
    window = F.struct("item_at", "size", "item_slots", "slots")
    ends = F.max(F.col("item_at") + F.col("size")) - F.min("item_at")
    least = F.least(F.lit(RUN), F.col("n_tokens"))
    stretches = windows.groupBy(*ROW, "item_id", (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.max("n_tokens").alias("n_tokens"), ends.alias("reach"), F.collect_set(window).alias("windows"))
    found = stretches.where(F.col("reach") >= least).withColumn("_decided", decided("windows", "n_tokens"))
    best = found.groupBy(*ROW, "item_id").agg(
        F.max("n_tokens").alias("n_tokens"), F.max("_decided.longest_run").alias("longest_run"), F.max("_decided.share").alias("share"))
    return best.where(F.col("longest_run") >= least)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_tokens, longest_run, share): documents that hold an item, or RUN tokens of it in one run.

    Null texts hold nothing.  Rows of one doc_id with different texts, and rows without an id, are searched and reported each on
    its own; equal rows once.  Of benchmark rows that share an item_id all windows count for that item."""
    return found_rows(docs, benchmark).drop("text_hash", "text_length")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold an item; a row with a null text stays."""
    held = stored(found_rows(docs, benchmark).select(F.struct(*ROW).alias("_held")).distinct(), "leaks")
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.length("text").alias("text_length"))
    return docs.join(held, key.eqNullSafe(F.col("_held")), "left_anti").select(*docs.columns)


@query("op4_decontamination")
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of ``documents`` that hold an item of ``benchmark``, with the items."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id").agg(
        F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.count("*").alias("n_items"), F.max("longest_run").alias("longest_run"), F.max("share").alias("share"))
