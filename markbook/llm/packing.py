"""Packing documents into sequences: shortest-pack-first over the length histogram.

Each document is cut into full sequences and one tail shorter than a sequence.  The histogram of tail lengths is all the
planner sees.  Lengths are placed longest first, always into the packs with the most room; packs of one pattern (the same
lengths in the same places) are counted, not listed, so the plan has a few thousand rows whatever the corpus.  A length
that fits no open pack is cut where the roomiest pack ends (the rest returns to the histogram as a shorter length), or opens
packs where no room is worth a cut.
Tails are then ranked within their length and meet their place in the plan by (length, rank).
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from markbook.llm.common import kept, query, stored, table, tidy, travels

travels(__name__)

SEQUENCE = 2048
END_ID = 1
LEAST_PART = 8  # no cut makes a smaller part
FLUSH_IDS = 1 << 20  # ids that a worker holds before it hands them on
CACHE_WORDS = 200_000  # stretches that a worker keeps, and as many older ones


# Latin words with marks after them: their parts and their lower case can be told without the tokenizer's own splitter.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=>?@\[-`{-~]*)")
VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that a byte-level vocabulary writes as themselves
HIDDEN = [b for b in range(256) if b not in VISIBLE]
BYTE_CHARS = {**{b: chr(b) for b in VISIBLE}, **{b: chr(256 + i) for i, b in enumerate(HIDDEN)}}


class _Known(dict):
    """stretch of text -> its ids as bytes, filled as it is asked; when full, the older half of what was asked goes."""

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> bytes:
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


def encoder(tokenizer_path: str):
    """``_encoder`` with what it knows kept in the worker from task to task."""
    return kept(tokenizer_path, lambda: _encoder(tokenizer_path))


def _encoder(tokenizer_path: str):
    """text -> ids (uint32), equal to encoding the whole text: the tokenizer never joins across a blank or a line end,
    so the stretches between them are encoded once each and kept.  A plain Latin word and the marks after it are asked of the
    vocabulary itself, everything else of the whole tokenizer."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    model = tokenizer.model

    def stretch(text: str) -> bytes:
        plain = PLAIN.fullmatch(text)
        if not plain:
            return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        word, marks = plain.groups()
        if marks or word != word.lower():
            return known[word.lower()] + known[marks] if marks else known[word.lower()]
        written = text if text.isascii() else "".join([BYTE_CHARS[b] for b in text.encode()])
        return array("I", [t.id for t in model.tokenize(written)]).tobytes()

    known = _Known(stretch)

    def encode(text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(known.__getitem__, text.replace("\n", " ").split(" "))), np.uint32)

    return encode


def plan(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, int, int, int, int, int, int]]:
    """Places for all tails: (length, first rank, count, start in the tail, part length, first sequence, offset).

    The tails of ``length`` ranked first rank .. + count - 1 put their bytes [start, start + part length) at ``offset`` of
    the sequences first sequence, + 1, + 2 ...; every id of every tail has exactly one place, and sequences are gapless.
    """
    bins: dict[int, list[tuple[int, int, int, int]]] = {}  # part length: blocks (length, first rank, count, start)
    for length, count in histogram.items():
        if count:
            bins.setdefault(length, []).append((length, 0, count, 0))
    order = [-n for n in bins]
    order.sort()
    packs: list[tuple[int, int, int]] = []  # a heap of (-room, first sequence, how many alike)
    places, sequences = [], 0
    todo = sum(length * count for length, count in histogram.items())  # ids without a place

    def put(part: int, blocks: list, first: int, count: int, offset: int) -> None:
        nonlocal todo
        todo -= part * count
        while count:
            length, rank, n, start = blocks.pop()
            if n > count:
                blocks.append((length, rank + count, n - count, start))
                n = count
            places.append((length, rank, n, start, part, first, offset))
            first, count = first + n, count - n

    while order:
        part = -heappop(order)
        blocks = bins.pop(part, None)
        while blocks:
            left = sum(b[2] for b in blocks)
            room, first, alike = (-packs[0][0], packs[0][1], packs[0][2]) if packs else (0, 0, 0)
            if room >= part:
                heappop(packs)
                n = min(left, alike)
                put(part, blocks, first, n, size - room)
                if n < alike:
                    heappush(packs, (-room, first + n, alike - n))
                if room > part:
                    heappush(packs, (part - room, first, n))
            elif room >= LEAST_PART and part - room >= LEAST_PART:
                heappop(packs)
                n = min(left, alike)
                cut: list = []
                need = n
                while need:
                    length, rank, count, start = blocks.pop()
                    if count > need:
                        blocks.append((length, rank + need, count - need, start))
                        count = need
                    cut.append((length, rank, count, start))
                    need -= count
                rest = [(length, rank, count, start + room) for length, rank, count, start in cut]
                put(room, cut, first, n, size - room)
                if n < alike:
                    heappush(packs, (-room, first + n, alike - n))
                if part - room not in bins:
                    bins[part - room] = []
                    heappush(order, room - part)
                bins[part - room].extend(rest)
            else:
                n = min(left, -(-todo // size))  # no more packs than all that is left can fill
                put(part, blocks, sequences, n, 0)
                heappush(packs, (part - size, sequences, n))
                sequences += n
    return places


def _ids(docs: DataFrame, tokenizer_path: str, size: int) -> DataFrame:
    """(chunk, doc_id, doc_tokens, tail, place, full0, ids): one row per document, chunks of one Arrow batch.

    ``place`` numbers the tails of a length and ``full0`` the full sequences within a chunk, so that later steps only
    add a start per (chunk, length).  Ids below 65,536 are kept in two bytes."""

    columns = ["chunk", "doc_id", "doc_tokens", "tail", "place", "full0", "wide", "ids"]

    def run(batches: Iterator[pd.DataFrame]):
        tidy(keep=True)
        encode = encoder(tokenizer_path)
        part = TaskContext.get().partitionId() << 16
        for number, rows in enumerate(batches):
            seen: dict[int, int] = {}
            out, fulls, held = [], 0, 0
            for doc_id, text in zip(rows["doc_id"].astype("Int64"), rows["text"]):
                ids = np.append(encode(text or ""), np.uint32(END_ID))
                tail = len(ids) % size
                place = seen.get(tail, 0)
                seen[tail] = place + 1
                wide = int(ids.max()) >= 1 << 16
                out.append((part + number, doc_id, len(ids), tail, place, fulls, wide, ids.astype("<u4" if wide else "<u2").tobytes()))
                fulls += len(ids) // size
                held += len(ids)
                if held >= FLUSH_IDS:
                    yield pd.DataFrame(out, columns=columns)
                    out, held = [], 0
            yield pd.DataFrame(out, columns=columns)

    schema = "chunk long, doc_id long, doc_tokens long, tail int, place long, full0 long, wide boolean, ids binary"
    return docs.select("doc_id", "text").mapInPandas(run, schema)


def pack(docs: DataFrame, tokenizer_path: str, size: int = SEQUENCE) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    A null or empty text is the end id alone; a repeated row is packed once per row, a null doc_id stays null.  Tails are
    ranked by counts per (chunk, length) and a running sum over chunks, so no task sorts the documents of one length, however
    many share it.  Sequences of the plan are numbered from 0; full sequences follow, numbered by chunk, with gaps.
    """
    spark = docs.sparkSession
    ids = stored(_ids(docs, tokenizer_path, size), "packing-ids")
    counts = ids.groupBy("chunk", "tail").agg(F.count("*").alias("rows"))
    # At most ``size`` rows, whatever the corpus.
    histogram = {r.tail: r.n for r in counts.groupBy("tail").agg(F.sum("rows").alias("n")).collect()}
    places = plan({k: v for k, v in histogram.items() if k}, size)
    base = max((p[5] + p[2] for p in places), default=0)
    before = Window.partitionBy("tail").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("chunk", "tail", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rank0"))
    ranked = ids.join(starts, ["chunk", "tail"])

    book: dict[int, list] = {}
    for length, rank, n, start, part, sequence, offset in places:
        book.setdefault(length, []).append((rank, n, start, part, sequence, offset))
    book = {k: np.array(v, np.int64) for k, v in book.items()}
    shared = spark.sparkContext.broadcast(book)  # a few rows per length below ``size``

    def cut(batches: Iterator[pd.DataFrame]):
        book = shared.value
        for rows in batches:
            out = []
            for r in rows.itertuples():
                ids = np.frombuffer(r.ids, "<u4" if r.wide else "<u2").astype("<u4")
                full, rank = len(ids) // size, r.rank0 + r.place
                pieces = [(i * size, size, base + (r.chunk << 22) + r.full0 + i, 0) for i in range(full)]
                if r.tail:
                    at = book[r.tail]
                    mine = at[(at[:, 0] <= rank) & (rank < at[:, 0] + at[:, 1])]
                    pieces += [(full * size + s, part, seq + rank - first, off) for first, _, s, part, seq, off in mine.tolist()]
                for s, length, seq, off in pieces:
                    raw = ids[s: s + length].tobytes()
                    out.append((None if pd.isna(r.doc_id) else int(r.doc_id), s, length, zlib.crc32(raw), len(ids), seq, off, raw))
            frame = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])
            yield frame.astype({"doc_id": "Int64"})

    return ranked.mapInPandas(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of 2048."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizer()).drop("ids")
