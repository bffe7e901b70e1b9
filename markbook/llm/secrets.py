"""Secret scan: fixed patterns, and a randomness test battery for tokens that no pattern knows.

Each token of at least 20 key characters is tested in the smallest alphabet that holds it: chi-squared uniformity over
the alphabet, runs about its middle, and lag-one serial correlation.  Fisher's method joins the three p-values into one
figure of randomness.  How random ordinary text of that length looks is measured on the corpus itself: the letters of every
document, cut into stretches of every length class from end to end, go through the same tests.  A token's p-value is the share of ordinary stretches of its length
class that look at least as random, and Benjamini-Hochberg over all tokens of the corpus sets, class by class, how random a
token must look to be reported.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markbook.llm.common import query, stored, table, tidy, travels

travels(__name__)

# The patterns of the base scan.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")

TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+")
LENGTHS = (20, 24, 28, 32, 40, 48, 64, 96, 128)  # lower ends of the length classes
LEVELS = 1000  # steps in which randomness is counted
BLOCK = 1 << 20  # letters whose stretches are measured at once
FALSE_SHARE = 0.05

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = {
    "decimal": DIGITS, "hex": DIGITS + "abcdef", "hex_upper": DIGITS + "ABCDEF", "lower": LOWER, "upper": UPPER,
    "base32": UPPER + "234567", "base36": DIGITS + LOWER, "base36_upper": DIGITS + UPPER, "letters": UPPER + LOWER,
    "base62": DIGITS + UPPER + LOWER, "base64": UPPER + LOWER + DIGITS + "+/", "base64_url": UPPER + LOWER + DIGITS + "-_",
    "any": UPPER + LOWER + DIGITS + "+/-_",
}
ORDERED = sorted(((n, frozenset(a), {c: i for i, c in enumerate(a)}) for n, a in ENCODINGS.items()), key=lambda e: len(e[1]))


def encoding(token: str) -> str:
    """The smallest alphabet that holds all characters of the token."""
    held = set(token)
    return next(n for n, a, _ in ORDERED if held <= a)


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _uniformity(squares: int, n: int, k: int) -> float:
    """Chi-squared on the whole alphabet with the cube-root approximation; ``squares`` of how often each character is there."""
    square = k / n * squares - n
    z = ((max(square, 0.0) / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))
    return 0.5 * math.erfc(z / math.sqrt(2))


def _runs(a: int, runs: int, n: int) -> float:
    """Runs above and below the middle of the alphabet, ``a`` characters being above."""
    b = n - a
    if not (a and b):
        return 2.0 ** (1 - n)
    mean = 2 * a * b / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    return _two_sided((runs - mean) / math.sqrt(var)) if var > 0 else 1.0


def randomness(token: str) -> float:
    """Fisher's joint p-value, under uniform random characters, of the three tests (1: nothing speaks against chance)."""
    held = set(token)
    places = next(p for _, a, p in ORDERED if held <= a)
    n, k = len(token), len(places)
    x = [places[c] for c in token]
    p = [_uniformity(sum(token.count(c) ** 2 for c in held), n, k)]
    high = [2 * v >= k for v in x]
    p.append(_runs(sum(high), 1 + sum(u != v for u, v in zip(high, high[1:])), n))
    mean = sum(x) / n
    spread = sum((v - mean) ** 2 for v in x)
    serial = sum((u - mean) * (v - mean) for u, v in zip(x, x[1:])) / spread if spread else 1.0
    p.append(_two_sided((serial + 1 / n) * math.sqrt(n)))
    h = -sum(math.log(max(v, 1e-300)) for v in p)
    return math.exp(-h) * (1 + h + h * h / 2)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start, then in the order of KINDS."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, k, e in sorted(found)]


def length_class(n: int) -> int:
    return max(i for i, low in enumerate(LENGTHS) if low <= n)


def _level(r: float) -> int:
    return min(LEVELS - 1, int(r * LEVELS))


# Letters to lower case; all other bytes of UTF-8 are left out.
_LOWERED = bytes(c | 32 for c in range(256))
_OTHER = bytes(c for c in range(256) if not chr(c).isascii() or not chr(c).isalpha())
# Per letter: above the middle, hexadecimal, value, its square.
_BY_LETTER = np.array([(v >= 13, v < 6, v, v * v) for v in range(26)], float)


@lru_cache(len(LENGTHS))
def _logs(n: int) -> tuple[np.ndarray, np.ndarray]:
    """-log of the p-values of n lower-case letters: by sum of squared counts, and by letters above the middle and runs."""
    k = len(LOWER)
    even = [_uniformity(v, n, k) for v in range(n * n + 1)]
    runs = [[_runs(a, r, n) for r in range(n + 1)] for a in range(n + 1)]
    return tuple(-np.log(np.maximum(v, 1e-300)) for v in (even, runs))


def _levels(x: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The level of ``randomness`` of the n letters (0 .. 25) of ``x`` at each of the places ``at``, which ascend."""
    x, at = x[at[0]: at[-1] + n], at - at[0]
    windows = np.lib.stride_tricks.sliding_window_view(x, n)[at]
    cells = windows + np.arange(0, len(at) * 26, 26, dtype=np.int32)[:, None]
    times = np.bincount(cells.ravel(), minlength=len(at) * 26).reshape(-1, 26).astype(float)
    squares = (times * times).sum(1).astype(np.int64)
    above, few, mean, spread = np.einsum("ij,jk->ki", times, _BY_LETTER)
    mean = mean / n
    spread = spread - n * mean * mean
    value, high = x.astype(np.int32), x >= 13
    last = at + n - 1

    def total(v):
        upto = np.append(np.int32(0), np.cumsum(v, dtype=np.int32))  # a part has about BLOCK / 4 letters
        return upto[last] - upto[at]

    runs = 1 + total(high[1:] != high[:-1])
    pairs = total(value[1:] * value[:-1]) - mean * (2 * n * mean - value[at] - value[last]) + (n - 1) * mean * mean
    same = squares == n * n
    serial = np.where(same, 1.0, pairs / np.where(same, 1.0, spread))
    order = np.abs(serial + 1 / n) * math.sqrt(n) / math.sqrt(2)
    order = np.maximum(np.fromiter(map(math.erfc, order.tolist()), float, len(at)), 1e-300)
    even, by_runs = _logs(n)
    h = even[squares] + by_runs[above.astype(np.int64), runs] - np.log(order)
    out = np.minimum(LEVELS - 1, (np.exp(-h) * (1 + h + h * h / 2) * LEVELS).astype(np.int64))
    # Stretches of a to f alone are hexadecimal to ``randomness``.
    few = np.flatnonzero(few == n)
    if len(few):
        kinds, which = np.unique(windows[few], axis=0, return_inverse=True)
        out[few] = np.array([_level(randomness("".join(LOWER[v] for v in kind))) for kind in kinds])[which.ravel()]
    return out


def _stretches(letters: list[bytes]) -> np.ndarray:
    """How many stretches of these texts have each (length class, level).  A text is covered from end to end in every
    length class it is long enough for; where the last stretch would be cut short, it begins further to the left."""
    counts = np.zeros((len(LENGTHS), LEVELS), np.int64)
    x = np.frombuffer(b"".join(letters), np.uint8) - np.uint8(ord("a"))
    sizes = np.array([len(t) for t in letters], np.int64)
    begins = np.cumsum(sizes) - sizes
    for i, n in enumerate(LENGTHS):
        long = np.flatnonzero(sizes >= n)
        many = -(-sizes[long] // n)
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at = np.minimum(np.repeat(begins[long], many) + nth * n, np.repeat((begins + sizes)[long] - n, many))
        step = max(1, BLOCK // 4 // n)
        for part in (at[j: j + step] for j in range(0, len(at), step)):
            counts[i] += np.bincount(_levels(x, part, n), minlength=LEVELS)
    return counts


def ordinary_counts(texts: Iterable[str | None]) -> np.ndarray:
    """How many stretches of all texts have each (length class, level)."""
    counts, waiting, held = np.zeros((len(LENGTHS), LEVELS), np.int64), [], 0
    for text in texts:
        letters = (text or "").encode("utf-8", "ignore").translate(_LOWERED, _OTHER)
        if len(letters) >= LENGTHS[0]:
            waiting.append(letters)
            held += len(letters)
        if held >= BLOCK:
            counts += _stretches(waiting)
            waiting, held = [], 0
    return counts + _stretches(waiting) if waiting else counts


def ordinary(docs: DataFrame) -> dict[tuple[int, int], int]:
    """(length class, level) -> stretches of all texts of ``docs``."""

    def run(batches: Iterator[pd.DataFrame]):
        tidy()
        counts = ordinary_counts(text for rows in batches for text in rows["text"])
        size, level = np.nonzero(counts)
        yield pd.DataFrame({"size": size, "level": level, "n": counts[size, level]})

    # At most length classes x levels rows, of each task and in all.
    cells = docs.select("text").mapInPandas(run, "size int, level int, n long").groupBy("size", "level").agg(F.sum("n").alias("n")).collect()
    return {(r["size"], r["level"]): r["n"] for r in cells}


def examine(docs: DataFrame) -> DataFrame:
    """(doc_id, base, tokens) per row of ``docs``: base spans, and tested tokens outside them.

    A null text is an empty one; null ids and repeated rows stay as they are."""

    def run(batches: Iterator[pd.DataFrame]):
        tidy()
        for rows in batches:
            out = []
            for doc_id, text in zip(rows["doc_id"].astype("Int64"), rows["text"]):
                text = text or ""
                base = base_spans(text)
                tokens = [(m.start(), m.end(), encoding(m[0]), length_class(len(m[0])), _level(randomness(m[0])))
                          for m in TOKEN.finditer(text) if not any(s < m.end() and m.start() < e for s, e, _ in base)]
                out.append((doc_id, [dict(zip(("start", "end", "kind"), b)) for b in base],
                            [dict(zip(("start", "end", "encoding", "size", "level"), t)) for t in tokens]))
            yield pd.DataFrame(out, columns=["doc_id", "base", "tokens"])

    span = "start: int, end: int"
    return docs.select("doc_id", "text").mapInPandas(
        run, f"doc_id long, base array<struct<{span}, kind: string>>, tokens array<struct<{span}, encoding: string, size: int, level: int>>")


def _counts(examined: DataFrame) -> dict[tuple[int, int], int]:
    # At most length classes x levels rows.
    cells = examined.select(F.explode("tokens").alias("t")).groupBy("t.size", "t.level").agg(F.count("*").alias("n")).collect()
    return {(r["size"], r["level"]): r["n"] for r in cells}


def least_levels(ordinary: dict, tokens: dict, false_share: float = FALSE_SHARE) -> dict[int, int]:
    """Length class -> least level of a reported token, by Benjamini-Hochberg over all tokens."""
    cells = []
    for size in range(len(LENGTHS)):
        total = sum(n for (s, _), n in ordinary.items() if s == size)
        above = 0
        for level in reversed(range(LEVELS)):
            above += ordinary.get((size, level), 0)
            if tokens.get((size, level)):
                cells.append(((above + 1) / (total + 1), size, level, tokens[size, level]))
    cells.sort()
    m, seen, limit = sum(c[3] for c in cells), 0, -1.0
    for i, (p, _, _, n) in enumerate(cells):
        seen += n
        if (i + 1 == len(cells) or cells[i + 1][0] > p) and p <= false_share * seen / m:
            limit = p
    least: dict[int, int] = {}
    for p, size, level, _ in cells:
        if p <= limit:
            least[size] = min(level, least.get(size, LEVELS))
    return least


def scan(docs: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """(doc_id, base, found) per row of ``docs``; ``found`` adds tokens of kind ``random`` to the base spans."""
    examined = stored(examine(docs), "secrets")
    least = least_levels(ordinary(docs), _counts(examined), false_share)
    bound = F.create_map(*[F.lit(v) for pair in least.items() for v in pair]) if least else None
    passed = F.filter("tokens", lambda t: t["level"] >= F.element_at(bound, t["size"])) if least else F.filter("tokens", lambda t: F.lit(False))
    random = F.transform(passed, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.lit("random").alias("kind")))
    # By start, then by kind in the order of KINDS.
    rank = lambda k: F.array_position(F.array(*[F.lit(x) for x in (*KINDS, "random")]), k)
    keyed = F.transform(F.concat("base", random), lambda t: F.struct(t["start"], rank(t["kind"]), t["end"], t["kind"]))
    found = F.transform(F.sort_array(keyed), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["kind"].alias("kind")))
    return examined.select("doc_id", "base", found.alias("found"))


def _joined(spans):
    return F.array_join(F.transform(spans, lambda t: F.concat_ws(":", t["kind"], t["start"].cast("string"), t["end"].cast("string"))), ",")


def redacted(docs: DataFrame, mark: str = "[SECRET]", false_share: float = FALSE_SHARE) -> DataFrame:
    """``docs`` with every found span replaced by a mark; n_chars follows.  Overlapping spans become one mark; a null text
    stays null.  What is reported depends on the corpus by a few numbers only, so no text is shuffled."""
    examined = stored(examine(docs), "secrets")
    least = least_levels(ordinary(docs), _counts(examined), false_share)

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        base = base_spans(text)
        spans = [(s, e) for s, e, _ in base]
        for m in TOKEN.finditer(text):
            bound = least.get(length_class(len(m[0])), LEVELS)
            if not any(s < m.end() and m.start() < e for s, e, _ in base) and _level(randomness(m[0])) >= bound:
                spans.append(m.span())
        out, at = [], 0
        for s, e in sorted(spans):
            if s >= at:
                out += [text[at:s], mark]
            at = max(at, e)
        return "".join(out) + text[at:]

    @F.pandas_udf("string")
    def replaced(texts: pd.Series) -> pd.Series:
        return texts.map(clean)

    out = docs.withColumn("text", replaced("text"))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


@query("op7_secrets")
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of ``documents``."""
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda t: t["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))
