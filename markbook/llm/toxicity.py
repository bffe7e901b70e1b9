"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one on the words that toxic text has in more contexts than
ordinary text explains.  A window of text is compressed twice, with the ordinary dictionary behind either the toxic one or
as many blank bytes; common language therefore costs the same both times, and the saving is what only the toxic dictionary
knows.  A document is described by how many of its windows save how much, and a calibrated logistic model turns that into a
probability.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from markbook.llm.common import query, table, tidy, travels

travels(__name__)

SAMPLE = 3000  # labelled rows per class that the model is fitted on, at most
SAMPLE_CHARS = 8000  # code points taken from each of them
DICTIONARY = 32 << 10
TOXIC_BYTES = 8 << 10
WINDOW = 64  # bytes, cut at white space where there is any
LEVEL = 3
STEPS = 8  # savings of 0 .. 7 bytes and more are counted apart
THRESHOLD = 0.7
RATIO = 4.0  # a toxic word has this many times the contexts it has in ordinary text
EVIDENCE = 20.0  # and this much log-likelihood evidence

WORD = re.compile(r"[^\s.,;:!?|\"'()]+")
CUT = re.compile(rb"(?s).{1,%d}(?:\s|$)|.{1,%d}" % (WINDOW - 1, WINDOW))


def windows(text: str) -> list[bytes]:
    """The whole text in lower case, in stretches of at most WINDOW bytes."""
    return CUT.findall(text.lower().encode())


def _contexts(texts: list[str]) -> dict[str, int]:
    """In how many different (word before, word after) each word stands: copies of a text count once."""
    found = defaultdict(set)
    for text in texts:
        words = WORD.findall(text.lower())
        for before, word, after in zip(["", *words], words, [*words[1:], ""]):
            found[word].add((before, after))
    return {w: len(c) for w, c in found.items()}


def toxic_words(toxic: list[str], ordinary: list[str]) -> list[str]:
    """Words with significantly more contexts in toxic text, the clearest last."""
    bad, good = _contexts(toxic), _contexts(ordinary)
    n_bad, n_good = sum(bad.values()), sum(good.values())
    kept = []
    for w, a in bad.items():
        b = good.get(w, 0)
        if a * n_good > RATIO * (b + 1) * n_bad:
            share = (a + b) / (n_bad + n_good)
            g2 = 2 * (a * math.log(a / (n_bad * share)) + (b * math.log(b / (n_good * share)) if b else 0))
            if g2 >= EVIDENCE:
                kept.append((g2, w))
    return [w for _, w in sorted(kept)]


class Distance:
    """The two dictionaries as contents; compressors are made once per worker."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = ordinary, toxic

    @classmethod
    def train(cls, toxic: list[str], ordinary: list[str]) -> Distance:
        samples = [w for t in ordinary for w in windows(t)]
        try:
            common = zstd.train_dictionary(DICTIONARY, samples).as_bytes()
        except zstd.ZstdError:  # too little text to train on: the text itself
            common = b"".join(samples)[-DICTIONARY:]
        return cls(common, " ".join(toxic_words(toxic, ordinary)).encode()[-TOXIC_BYTES:])

    def counter(self):
        """text -> how many windows save 0, 1, .. STEPS - 1 or more bytes."""

        def compressor(front: bytes):
            held = zstd.ZstdCompressionDict(front + b" " + self.ordinary, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            return zstd.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress

        with_toxic, without = compressor(self.toxic), compressor(bytes(len(self.toxic)))

        def count(text: str) -> list[int]:
            out = [0] * STEPS
            for w in windows(text):
                out[min(max(len(without(w)) - len(with_toxic(w)), 0), STEPS - 1)] += 1
            return out

        return count


def features(counts: np.ndarray) -> np.ndarray:
    """Shares and damped numbers of windows by saving, the text's length and its mean saving."""
    counts = np.asarray(counts, np.float64).reshape(-1, STEPS)
    n = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    # A text longer than those learned from counts as one of their length with the same shares.
    longest = SAMPLE_CHARS / WINDOW
    counts, n = counts * np.minimum(1, longest / n), np.minimum(n, longest)
    above = counts[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:]
    mean = (counts * np.arange(STEPS)).sum(axis=1, keepdims=True) / n
    return np.hstack([above / n, np.log1p(above), np.log(n), mean, np.sqrt(mean)])


class Logistic:
    """Logistic regression by Newton steps with a small ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = self._z(x)
        self.w = np.zeros(z.shape[1])
        keep = np.r_[np.full(z.shape[1] - 1, ridge), 1e-6]
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            grad = z.T @ (p - y) + keep * self.w
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), grad)
            self.w -= step
            if np.abs(step).max() < 1e-6:
                break

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._z(x) @ self.w, -30, 30)))


def fit(rows: list[tuple[str, int]], prior: float):
    """(Distance, Logistic or None): dictionaries from three fifths of the texts, calibration on the others.

    ``prior`` is the share of label 1 among all labelled rows; the sample's own share is corrected to it."""
    texts = list(dict.fromkeys(rows))
    train, rest = [r for i, r in enumerate(texts) if i % 5 < 3], [r for i, r in enumerate(texts) if i % 5 >= 3]
    distance = Distance.train([t for t, y in train if y == 1], [t for t, y in train if y == 0])
    y = np.array([y for _, y in rest], float)
    if not 0 < y.sum() < len(y):
        return distance, None
    count = distance.counter()
    model = Logistic(features([count(t) for t, _ in rest]), y)
    have = y.mean()
    model.w[-1] += math.log(prior / (1 - prior)) - math.log(have / (1 - have))
    return distance, model


def held_out(doc_id, folds: int, fold: int):
    """Rows that learning never sees; a null id is not held out, and not learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """Fit on at most ``sample`` rows of each label, the least by a hash of the id."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.where(~held_out(F.col("doc_id"), 3, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0]
    if share is None or not 0 < share < 1:
        return Distance(b"", b""), None
    # A share of each label's rows by their hash comes near the sample's size, so that few rows are ranked.
    rows = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    near = F.when(F.col("toxic") == 1, sample / rows[1]).otherwise(sample / rows[0]) * 1.2 + 100 / min(rows.values())
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < near * (1 << 30)).withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample)
    # At most 2 x sample ids: a bounded broadcast.
    texts = docs.select("doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = texts.where("text IS NOT NULL").dropDuplicates(["doc_id"]).orderBy("toxic", "n").select("text", "toxic").collect()
    return fit([(r.text, r.toxic) for r in sorted(rows, key=lambda r: zlib.crc32(r.text.encode()))], share)


def score(docs: DataFrame, distance: Distance, model: Logistic | None, name: str = "score") -> DataFrame:
    """``docs`` plus column ``name`` (0 to 1) from the whole text.  A null or empty text has no windows and is scored as such;
    with nothing learned the score is 0."""
    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tidy()
        count = distance.counter()
        for texts in parts:
            if model is None:
                yield pd.Series(np.zeros(len(texts)))
            else:
                yield pd.Series(model(features([count(t or "") for t in texts])) if len(texts) else [], dtype="float64")

    return docs.withColumn(name, scored("text"))


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every row of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, *learn(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
