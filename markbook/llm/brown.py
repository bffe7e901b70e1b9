"""Scoring texts with Brown classes: class transitions and word emissions.

Words are put into classes by the exchange algorithm: a word moves to the class that raises the likelihood of a bigram model
over classes most.  Words that make up more than a fixed share of the training tokens (so few that they are broadcast) are
exchanged round by round: every task goes over its words with its own copy of the class counts, then the moves are put
together and the counts taken anew.  All other words, however many, are then placed once, by the neighbours of all their
occurrences, against the classes so far.  The model counts class transitions over the whole training text, with a Good-Turing
share for words never seen.

The texts pass through three stages.  Words are counted; pairs of frequent words are counted; then every text is written as
numbers in chunks with a list of words each, and only those lists meet other chunks: a word is one row per chunk, not one per
occurrence.  Null texts are empty and consist of the end alone.  A row without an id is scored but not learned from; repeated
rows count each time.  Without training text every token is unknown.
"""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count, islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markbook.llm.common import discard, query, stored, table, travels

travels(__name__)

CLASSES = 64
SHARE = 1 << 14  # a word of more than 1 / SHARE of all tokens is exchanged in rounds; there are at most SHARE
ROUNDS = 8
LEAST_GAIN = 1e-4  # of the likelihood, below which a round is the last
WEIGHT = 20.0  # tokens that the smoothing of a class weighs
CHUNK_TOKENS, CHUNK_WORDS = 1 << 22, 3 << 17  # a chunk ends with the text that reaches either
COUNTED_WORDS = 1 << 18  # words that a worker counts before it hands them on
READ, LISTED = 1 << 8, 1 << 16  # texts and words of a chunk that a worker takes up or hands on at once
HAPAX, UNSEEN = 128, 127  # codes of a text: its classes, the end, UNSEEN; HAPAX is added to the class of a word seen once
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words(raw: bytes | None) -> list[bytes]:
    """The words of a text in UTF-8; these bytes split at exactly the six white-space characters of ASCII."""
    return (raw or b"").translate(LOWER).split()


def _texts(batch: pa.RecordBatch) -> Iterator[bytes | None]:
    column = batch.column("text").cast(pa.binary())
    for low in range(0, len(column), READ):
        yield from column[low: low + READ].to_pylist()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts; the end of a text is the null word."""

    def counted(batches: Iterator[pa.RecordBatch]):
        found: Counter = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
            found.clear()
            return out

        for batch in batches:
            for raw in _texts(batch):
                found.update(words(raw))
                found[None] += 1
                if len(found) >= COUNTED_WORDS:
                    yield rows()
        yield rows()

    return docs.select("text").mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_pairs(docs: DataFrame, numbers, n_frequent: int) -> DataFrame:
    """(a, b, n): neighbours over all texts, as numbers of frequent words; n_frequent is any other word, + 1 the end."""

    def paired(batches: Iterator[pa.RecordBatch]):
        width, end = n_frequent + 2, n_frequent + 1
        kind = np.int32 if width * width < 1 << 31 else np.int64

        def rows(held):
            ids = np.frombuffer(held, np.int32).astype(kind)
            pairs, n = np.unique(ids[:-1] * width + ids[1:], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in ((pairs // width).astype(np.int32), (pairs % width).astype(np.int32), n.astype(np.int64))], ["a", "b", "n"])

        held = array("i", [end])
        for batch in batches:
            for raw in _texts(batch):
                held.extend(map(numbers.value.get, words(raw), repeat(n_frequent)))
                held.append(end)
                if len(held) > CHUNK_TOKENS:
                    yield rows(held)
                    held = array("i", [end])
        if len(held) > 1:
            yield rows(held)

    return docs.select("text").mapInArrow(paired, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _g(x):
    return x * np.log(np.maximum(x, 1))


def likelihood(counts: np.ndarray) -> float:
    """The part of the log-likelihood of a class bigram model that depends on the classes."""
    return float(_g(counts).sum() - _g(counts.sum(0)).sum() - _g(counts.sum(1)).sum())


def best_class(counts: np.ndarray, now: int, left: np.ndarray, right: np.ndarray, self_pairs: float, classes: int) -> int:
    """Where a word of class ``now`` raises the likelihood most; ``counts`` loses the word.

    ``left`` and ``right`` are its neighbours by class without itself.  Ties keep the present class, then the smallest.
    """
    size = left.sum() + self_pairs
    totals = counts.sum(1)[:classes]
    totals[now] -= size
    counts[now, :] -= right
    counts[:, now] -= left
    counts[now, now] -= self_pairs
    inner = counts.diagonal()[:classes]
    before = _g(counts)
    rows = (_g(counts[:classes] + right[None, :]) - before[:classes]).sum(1)
    columns = (_g(counts[:, :classes] + left[:, None]) - before[:, :classes]).sum(0)
    r, le = right[:classes], left[:classes]
    both = _g(inner + r + le + self_pairs) - _g(inner + r) - _g(inner + le) + _g(inner)
    gain = rows + columns + both - 2 * (_g(totals + size) - _g(totals))
    gain[now] += 1e-9 * max(1.0, abs(gain[now]))
    return int(gain.argmax())


def exchange(pairs: DataFrame, n_frequent: int, classes: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(class of every frequent word, class counts) after at most ``rounds`` rounds.

    Words are numbered by falling frequency.  Two more classes hold all other words and the end; they stay as they are.
    What a task holds is one row per frequent word, of at most two neighbours per frequent word.
    """
    spark = pairs.sparkSession
    sides = pairs.select(F.col("a").alias("word"), F.lit(True).alias("right"), F.col("b").alias("other"), "n").union(
        pairs.select(F.col("b").alias("word"), F.lit(False).alias("right"), F.col("a").alias("other"), "n"))
    around = stored(sides.groupBy("word").agg(F.collect_list(F.struct("right", "other", "n")).alias("near"))
                    .select("word", "near.right", "near.other", "near.n"), "contexts")

    def totals(member: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(member)

        def run(batches):
            found, size = np.zeros((classes + 2) ** 2, np.int64), classes + 2
            for rows in batches:
                for word, right, other, n in zip(rows["word"], rows["right"], rows["other"], rows["n"]):
                    at = shared.value[word] * size + shared.value[other[right]]
                    found += np.bincount(at, n[right], len(found)).astype(np.int64)
            at = np.flatnonzero(found)
            yield rows_frame(at, found[at])

        got = around.mapInPandas(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # (classes + 2)^2 rows
        counts = np.zeros((classes + 2) ** 2, np.int64)
        counts[[r["at"] for r in got]] = [r["n"] for r in got]
        return counts.reshape(classes + 2, classes + 2)

    def rows_frame(at, n):
        return pd.DataFrame({"at": at.astype(np.int32), "n": n})

    def moved(member: np.ndarray, counts: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast((member, counts.astype(np.float64)))

        def run(batches):
            mine, table = shared.value[0].copy(), shared.value[1].copy()
            for rows in batches:
                out = []
                rows = rows[rows["word"] < n_frequent].sort_values("word")
                for word, right, other, n in zip(rows["word"], rows["right"], rows["other"], rows["n"]):
                    same = other == word
                    near = [np.bincount(mine[other[s]], n[s], classes + 2) for s in (~right & ~same, right & ~same)]
                    alone = float(n[right & same].sum())
                    new = best_class(table, mine[word], *near, alone, classes)
                    table[new, :] += near[1]
                    table[:, new] += near[0]
                    table[new, new] += alone
                    mine[word] = new
                    out.append(word)
                yield rows_frame(np.array(out, np.int64), mine[out].astype(np.int64))

        got = around.mapInPandas(run, "at int, n long").collect()  # a row per frequent word
        new = member.copy()
        new[[r["at"] for r in got]] = [r["n"] for r in got]
        return new

    member = np.append(np.arange(n_frequent) % classes, [classes, classes + 1])
    counts = totals(member)
    for _ in range(rounds):
        after = moved(member, counts)
        found = totals(after)
        gain = likelihood(found) - likelihood(counts)
        if gain <= 0:
            break
        member, counts = after, found
        if gain < LEAST_GAIN * abs(likelihood(found)):
            break
    discard(around)
    return member, counts


def placing(counts: np.ndarray, classes: int) -> np.ndarray:
    """Log-weights (left neighbour's class, then right neighbour's class) x class, for placing a word by its neighbours."""
    share = (counts.sum(0) + 1.0) / (counts.sum() + len(counts))
    follow = (counts + WEIGHT * share) / (counts.sum(1, keepdims=True) + WEIGHT)
    # P(class | left) P(word | class) P(right | class); a word's own count is the same for all classes.
    return np.vstack([np.log(follow[:, :classes]) - np.log(counts.sum(1)[:classes] + 1.0), np.log(follow[:classes].T)])


def numbered(docs: DataFrame, numbers, n_frequent: int, member: np.ndarray) -> DataFrame:
    """Texts as numbers, and the other words of each chunk, as rows of one table.

    Text rows: chunk, doc_id, train, ids (four planes of bytes; frequent words, the end as n_frequent, then the words of the
    chunk).  Word rows: chunk, local, word, near: two bytes for each training occurrence, the classes on its left and right.
    """
    names = ["chunk", "doc_id", "train", "ids", "local", "word", "near"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int32(), pa.string(), pa.binary()]
    codes = np.append(member[:n_frequent], [member[n_frequent + 1], member[n_frequent]]).astype(np.uint8)  # the end, other words

    def run(batches: Iterator[pa.RecordBatch]):
        part = TaskContext.get().partitionId() << 24

        def rows(chunk, known, held, texts):
            ids, (doc_ids, trains, sizes) = np.frombuffer(held, np.int32), zip(*texts)
            # Each text ends with the end, so neighbours in this row of numbers are neighbours in the texts.
            code = codes[np.minimum(ids, n_frequent + 1)]
            left, right = np.append(codes[n_frequent], code[:-1]), np.append(code[1:], codes[n_frequent])
            at = np.flatnonzero((ids > n_frequent) & np.repeat(trains, sizes))
            which = ids[at] - n_frequent - 1
            at = at[np.argsort(which, kind="stable")]
            near = np.column_stack([left[at], right[at]]).reshape(-1)
            ends = np.concatenate([[0], np.cumsum(2 * np.bincount(which, minlength=len(known) - n_frequent - 1))])
            del code, left, right, at, which
            listed = islice(known, n_frequent + 1, None)
            for low in range(0, len(ends) - 1, LISTED):
                named, stops = list(islice(listed, LISTED)), ends[low: low + LISTED + 1]
                n, offsets = len(named), (stops - stops[0]).astype(np.int32)
                around = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(near[stops[0]: stops[-1]])])
                batch = [pa.array(np.full(n, part + chunk)), *[pa.nulls(n, k) for k in kinds[1:4]], pa.array(np.arange(low, low + n, dtype=np.int32)), pa.array(named, pa.binary()).cast(pa.string()), around]
                yield pa.RecordBatch.from_arrays(batch, names)
            ends = np.cumsum(sizes)
            for low in range(0, len(sizes), READ):
                here = slice(low, low + READ)
                first, n = ends[low] - sizes[low], len(sizes[here])
                planes = [a.view(np.uint8).reshape(-1, 4).T.tobytes() for a in np.split(ids[first: ends[here][-1]], ends[here][:-1] - first)]
                batch = [pa.array(np.full(n, part + chunk)), pa.array(doc_ids[here], pa.int64()), pa.array(trains[here]), pa.array(planes, pa.binary())]
                yield pa.RecordBatch.from_arrays(batch + [pa.nulls(n, k) for k in kinds[4:]], names)

        def begun():
            known = defaultdict(count(n_frequent + 1).__next__, numbers.value)
            known[None] = n_frequent
            return known, array("i"), []

        chunk, (known, held, texts) = 0, begun()
        for batch in batches:
            for doc_id, train, raw in zip(batch.column("doc_id").to_pylist(), batch.column("train").to_pylist(), _texts(batch)):
                before = len(held)
                held.extend(map(known.__getitem__, words(raw)))
                held.append(n_frequent)
                texts.append((doc_id, train, len(held) - before))
                if len(held) >= CHUNK_TOKENS or len(known) - n_frequent >= CHUNK_WORDS:
                    yield from rows(chunk, known, held, texts)
                    chunk, (known, held, texts) = chunk + 1, begun()
        if texts:
            yield from rows(chunk, known, held, texts)

    return docs.mapInArrow(run, "chunk long, doc_id long, train boolean, ids binary, local int, word string, near binary")


def placed(listed: DataFrame, weights: np.ndarray, names: bool = False) -> DataFrame:
    """(chunk, local, n, class) of all word rows, or (word, n, class) of all words: n training occurrences, class -1 without any.

    The rows of a word are read in order and added up as they come, so a word may be in any number of chunks.
    """
    sides, classes = len(weights) // 2, weights.shape[1]
    schema = "word string, n long, class int" if names else "chunk long, local int, n long, class int"

    def run(batches: Iterator[pa.RecordBatch]):
        def rows(word, near, places):
            n = near[:, :sides].sum(1)
            label = np.where(n > 0, (near @ weights).argmax(1), -1).astype(np.int32)
            if names:
                return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(n), pa.array(label)], ["word", "n", "class"])
            chunk, local, group = places
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (chunk, local, n[group], label[group])], ["chunk", "local", "n", "class"])

        word, near, parts = None, None, []  # the word whose rows may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("word")
            fresh = np.append(True, pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False))
            group = np.cumsum(fresh) - 1
            size = int(group[-1]) + 1
            raw = batch.column("near")
            lengths = pc.binary_length(raw).to_numpy(zero_copy_only=False)
            pairs = np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(-1, 2)
            whose = np.repeat(group, lengths // 2) * (2 * sides)
            at = np.concatenate([whose + pairs[:, 0], whose + sides + pairs[:, 1]])
            sums = np.bincount(at, minlength=size * 2 * sides).reshape(size, 2 * sides)
            place = [batch.column("chunk").to_numpy(), batch.column("local").to_numpy(), group]
            named = column.filter(pa.array(fresh)).to_pylist()
            if word is not None and word != named[0]:
                yield rows([word], near[None, :], _joined(parts))
                word = None
            if word is not None:
                sums[0] += near
            last = group == size - 1
            if size > 1:
                whole = [p[~last] for p in place]
                yield rows(named[:-1], sums[:-1], _joined([*(parts if word is not None else []), whole]))
            keeps = size == 1 and word is not None
            word, near = named[-1], sums[-1]
            parts = [*(parts if keeps else []), [place[0][last], place[1][last], np.zeros(int(last.sum()), np.int64)]]
        if word is not None:
            yield rows([word], near[None, :], _joined(parts))

    return listed.repartition("word").sortWithinPartitions("word").mapInArrow(run, schema)


def _joined(parts: list) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*parts)]


class Model:
    """The class bigram model: log10 weights of (code before, code) without the words' own counts."""

    def __init__(self, counts: np.ndarray, classes: int):
        """``counts`` over codes of training texts, which hold no UNSEEN."""
        plain = counts.reshape(2, HAPAX, 2, HAPAX)
        seen = plain.sum((0, 2))
        total = seen.sum()
        n = seen.sum(0)
        end = classes
        once = plain[:, :, 1].sum(0)  # (before, hapax)
        base = n / (total + 1.0)
        base[end] += 1.0 / (total + 1.0)
        unseen = (once.sum() + 0.5) / (total + 1.0)
        follow = seen.astype(float)
        follow[UNSEEN] = plain[1].sum(1).sum(0)  # what follows words seen once
        first = once.sum(1).astype(float)
        first[UNSEEN] = plain[1, :, 1].sum()
        size = follow.sum(1) + WEIGHT
        chance = (first + WEIGHT * unseen) / size
        spread = (follow + WEIGHT * base) / size[:, None] * (1 - chance)[:, None]
        with np.errstate(divide="ignore"):
            weights = np.log10(spread) - np.log10(np.where(np.arange(HAPAX) == end, 1, np.maximum(n, 1)))
        weights[:, UNSEEN] = np.log10(chance)
        self.classes, self.n, self.spread, self.chance = classes, n, spread, chance
        self.weights = np.tile(weights, (2, 2))


def score(docs: DataFrame, train: Column, classes: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens, n_known, train_tokens, base_score, score.

    ``train`` tells the rows to learn from.  ``base_score`` is that of single words with 0.1 added to every count.
    """
    if not 1 <= classes <= UNSEEN - 3:
        raise ValueError(f"classes from 1 to {UNSEEN - 3}")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(train, F.lit(False)).alias("train"))
    learned = rows.where("train").select("text")
    frequent, member, counts, total, distinct, ends = clusters(learned, classes, rounds)
    n_frequent = len(frequent)
    numbers = spark.sparkContext.broadcast({w: i for i, (w, _) in enumerate(frequent)})
    texts = stored(numbered(rows, numbers, n_frequent, member), "numbered")
    listed = texts.where("word IS NOT NULL").select("chunk", "local", "word", "near")
    known = placed(listed, placing(counts, classes))

    head = np.array([c for _, c in frequent] + [ends], np.int64)
    head_codes = np.append(member[:n_frequent], classes).astype(np.int64)

    def coded(texts: pa.Table, listed: pa.Table) -> pa.Table:
        found = np.zeros(len(head) + len(listed), np.int64)
        codes = np.full(len(found), UNSEEN)
        found[: len(head)], codes[: len(head)] = head, head_codes
        at = listed["local"].to_numpy() + len(head)
        found[at] = listed["n"].to_numpy()
        codes[at] = np.where(listed["class"].to_numpy() < 0, UNSEEN, listed["class"].to_numpy())
        once = (found == 1) & (np.arange(len(found)) != n_frequent)
        codes = (codes + HAPAX * once).astype(np.uint8)
        base = np.log10((found + 0.1) / (total + 0.1 * (distinct + 1)))
        own = np.log10(np.maximum(found, 1))
        own[n_frequent] = 0.0
        out = []
        for doc_id, train, planes in zip(texts["doc_id"].to_pylist(), texts["train"].to_pylist(), texts["ids"].to_pylist()):
            ids = np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view("<i4")[:, 0]
            out.append((doc_id, train, len(ids), int(np.count_nonzero(found[ids])), float(base[ids].sum()), float(own[ids].sum()), codes[ids].tobytes()))
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
        columns = zip(*out) if out else [[]] * len(kinds)
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "train", "n_tokens", "n_known", "base_score", "own", "codes"])

    whole = texts.where("ids IS NOT NULL").select("chunk", "doc_id", "train", "ids")
    sequences = stored(whole.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(
        coded, "doc_id long, train boolean, n_tokens long, n_known long, base_score double, own double, codes binary"), "sequences")
    discard(texts)

    def transitions(batches: Iterator[pa.RecordBatch]):
        found = np.zeros(1 << 16, np.int64)
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).astype(np.int64)
            if len(codes):
                found += np.bincount((np.append(classes, codes[:-1]) << 8) + codes, minlength=1 << 16)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(found[at])], ["at", "n"])

    got = sequences.where("train").select("codes").mapInArrow(transitions, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    counted = np.zeros(1 << 16, np.int64)
    counted[[r["at"] for r in got]] = [r["n"] for r in got]
    weights = Model(counted, classes).weights.ravel()

    @F.pandas_udf("double")
    def summed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            codes = [np.frombuffer(raw, np.uint8).astype(np.int64) for raw in part]
            yield pd.Series([float(weights[(np.append(classes, c[:-1]) << 8) + c].sum()) for c in codes], dtype=float)

    return sequences.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", (F.col("own") + summed("codes")).alias("score"))


def clusters(learned: DataFrame, classes: int, rounds: int):
    """(frequent words with counts by falling count, class of each, class counts, tokens, distinct tokens, texts)."""
    spark = learned.sparkSession
    counts = stored(word_counts(learned), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    top = counts.where((F.col("n") * SHARE > total) | F.col("word").isNull()).collect()  # at most SHARE and one rows
    discard(counts)
    ends = sum(r.n for r in top if r.word is None)
    frequent = sorted(((r.word.encode(), r.n) for r in top if r.word is not None), key=lambda p: (-p[1], p[0]))
    numbers = spark.sparkContext.broadcast({w: i for i, (w, _) in enumerate(frequent)})
    member, found = exchange(frequent_pairs(learned, numbers, len(frequent)), len(frequent), classes, rounds)
    return frequent, member, found, total, distinct, ends


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


@query("op12_class_ngrams")
def op12_class_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` scored by classes learned from nine tenths of them."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
