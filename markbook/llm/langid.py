"""Language identification by a byte convolutional network.

A window of bytes goes through filters of several widths, a maximum over all places of the window and a softmax over the
languages.  A filter over bytes is a sum of table rows, one per byte, so for scoring the tables of two neighbouring bytes
are joined into one: a filter of width four is two lookups.  Training is plain numpy with Adam; the gradient of a maximum
touches one place per filter only.  A document's probabilities are the means of the log-probabilities of its windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from markbook.llm.common import query, table, travels

travels(__name__)

WINDOW = 256  # bytes of a window; the last one is filled with zero bytes
WIDTHS = (2, 3, 4)
FILTERS = 8  # per width
SAMPLE = 400  # documents per language that the network is trained on, at most
PIECES = 8  # windows drawn from each of them, wherever they are in the text
SAMPLES = 100_000  # documents of all languages together, at most; a language has fewer if there are very many
STEPS = 500
BATCH = 96
CHUNK = 1 << 20  # bytes scored at once


def windows(raw: bytes) -> np.ndarray:
    """All bytes of a text as rows of WINDOW bytes; the text's last row ends in zeros."""
    n = max(1, -(-len(raw) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, WINDOW)


class Network:
    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.tables = {w: rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def train(self, crops: list[bytes], labels: np.ndarray, steps: int = STEPS) -> Network:
        rng = np.random.default_rng(11)
        names = [*(f"t{w}" for w in WIDTHS), "bias", "out", "out_bias"]
        values = {**{f"t{w}": self.tables[w] for w in WIDTHS}, "bias": self.bias, "out": self.out, "out_bias": self.out_bias}
        first, second = ({k: np.zeros_like(v) for k, v in values.items()} for _ in range(2))
        by_label = [np.flatnonzero(labels == i) for i in range(len(self.languages))]
        for step in range(1, steps + 1):
            y = rng.integers(0, len(self.languages), BATCH)
            x = np.zeros((BATCH, WINDOW), np.uint8)
            for i, label in enumerate(y):
                raw = crops[rng.choice(by_label[label])]
                size = int(rng.integers(12, WINDOW + 1))
                at = int(rng.integers(0, max(len(raw) - size, 0) + 1))
                piece = np.frombuffer(raw[at: at + size], np.uint8)
                x[i, : len(piece)] = piece
            pooled, places = [], []
            for w in WIDTHS:
                t = values[f"t{w}"]
                s = sum(t[j][x[:, j: WINDOW - w + 1 + j]] for j in range(w))
                at = s.argmax(axis=1)
                places.append(at)
                pooled.append(np.take_along_axis(s, at[:, None, :], axis=1)[:, 0])
            raw_h = np.hstack(pooled) + values["bias"]
            h = np.maximum(raw_h, 0)
            logits = h @ values["out"] + values["out_bias"]
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            d = p.copy()
            d[np.arange(BATCH), y] -= 1
            d /= BATCH
            dh = (d @ values["out"].T) * (raw_h > 0)
            grads = {"out": h.T @ d, "out_bias": d.sum(axis=0), "bias": dh.sum(axis=0)}
            for n, w in enumerate(WIDTHS):
                g = np.zeros_like(values[f"t{w}"])
                part = dh[:, n * FILTERS: (n + 1) * FILTERS]
                for j in range(w):
                    hit = np.take_along_axis(x, places[n] + j, axis=1)
                    np.add.at(g[j], (hit, np.arange(FILTERS)[None, :]), part)
                grads[f"t{w}"] = g
            rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.99 * second[k] + 0.01 * grads[k] ** 2
                values[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
        return self

    def scorer(self):
        """windows (n x WINDOW bytes) -> log-probabilities (n x languages)."""
        pairs = {}
        for w in WIDTHS:
            t = self.tables[w]
            pairs[w] = [(j, (t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, FILTERS)) for j in range(0, w - 1, 2)]
            if w % 2:
                pairs[w].append((w - 1, t[w - 1]))

        def score(x: np.ndarray) -> np.ndarray:
            two = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
            pooled = []
            for w in WIDTHS:
                n = WINDOW - w + 1
                s = None
                for j, t in pairs[w]:
                    part = t.take((two if len(t) > 256 else x)[:, j: j + n], axis=0)
                    s = part if s is None else np.add(s, part, out=s)
                pooled.append(s.max(axis=1))
            logits = np.maximum(np.hstack(pooled) + self.bias, 0) @ self.out + self.out_bias
            logits -= logits.max(axis=1, keepdims=True)
            return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

        return score


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, sample: int = SAMPLE) -> Network | None:
    """Train on windows of at most ``sample`` documents of each language, those least by a hash of the id; None without any.

    Windows lie at places that a hash of the id gives, over the whole text."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    rows = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}  # a row per language
    languages = sorted(rows)
    if not languages:
        return None
    sample = max(1, min(sample, SAMPLES // len(languages)))
    # A share of each language's rows by their hash comes near the sample's size, so that few rows are ranked.
    near = F.create_map(*[F.lit(x) for lang, n in rows.items() for x in (lang, min(1.0, 1.2 * (sample + 50) / n))])
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.element_at(near, F.col("lang")) * (1 << 30))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    last = F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1
    pieces = F.transform(F.sequence(F.lit(1), F.lit(PIECES)), lambda i: F.substr("text", 1 + F.pmod(F.xxhash64("doc_id", i), last), F.lit(WINDOW)))
    rows = (known.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample)
            .select("lang", "n", pieces.alias("pieces")).collect())
    rows.sort(key=lambda r: (r.lang, r.n))
    crops = [(languages.index(r.lang), piece.encode()) for r in rows for piece in r.pieces]
    return Network(languages).train([raw for _, raw in crops], np.array([label for label, _ in crops]))


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """``docs`` plus lang_pred and score (its probability).  A null text, one without a letter, or an untrained network
    gives ``und`` with score 0."""
    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def named(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = network.scorer() if network else None
        for texts in parts:
            # Windows of all texts of the batch side by side, scored CHUNK bytes at a time.
            pending, counts, sums = [], [], np.zeros((len(texts), len(network.languages) if network else 1))
            held = 0

            def flush():
                nonlocal pending, counts, held
                if pending:
                    got = score(np.vstack(pending))
                    np.add.at(sums, np.repeat([i for i, _ in counts], [n for _, n in counts]), got)
                pending, counts, held = [], [], 0

            total = np.ones(len(texts))
            for i, text in enumerate(texts):
                if text is None or network is None:
                    continue
                rows = windows(text.encode())
                total[i] = len(rows)
                for at in range(0, len(rows), CHUNK // WINDOW):
                    part = rows[at: at + CHUNK // WINDOW]
                    pending.append(part)
                    counts.append((i, len(part)))
                    held += part.size
                    if held >= CHUNK:
                        flush()
            flush()
            mean = sums / total[:, None]
            p = np.exp(mean - mean.max(axis=1, keepdims=True, initial=-np.inf))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            yield pd.DataFrame({"lang_pred": [network.languages[b] if network else None for b in best], "score": p[np.arange(len(p)), best]})

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) & F.lit(network is not None)
    out = docs.withColumn("_named", named("text"))
    return (out.withColumn("lang_pred", F.when(letters, F.col("_named.lang_pred")).otherwise("und"))
            .withColumn("score", F.when(letters, F.col("_named.score")).otherwise(0.0)).drop("_named"))


@query("op10_langid")
def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every row of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    named = predict(docs.select("doc_id", "text"), learn(docs))
    return named.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
