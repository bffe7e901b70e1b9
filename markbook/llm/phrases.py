"""Phrase collocations by Toivonen's sampling: exact counts in few passes over the texts.

A sample of the texts is mined level by level at a lowered support.  What is frequent there, and its negative border (every
phrase whose parts without the first and without the last word are frequent there, but which is not itself), is then counted
over all texts in one pass.  A border phrase that turns out frequent is a failure of the sample: it joins the known phrases, and
another pass counts the border that this opens, until no pass finds a failure.  Then every frequent phrase has been counted, and
all counts are those of the whole table, whatever the sample was.  What failures open holds a failure of the first pass, so the
later passes read only what lies near those, which one pass over all texts cuts out.

The border is never listed.  Known phrases go to the workers as a bit filter of at most FILTER_BITS bits: a filter that is
too full lets more phrases be counted, and changes no result.  Nearly all of the first border is rare, so its phrases are first
added up by their hashes alone, in ranges of hashes; only phrases whose hash reaches the support are exchanged and counted as
they are written.  Phrases that share a hash can only let more through.  Workers add up phrases chunk by chunk, so a phrase is one row per
chunk.  A null text is empty, a null language is ``und``, and repeated rows count each time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from markbook.llm.common import discard, query, stored, table, travels

travels(__name__)

LEAST = 30  # occurrences of a frequent phrase
LONGEST = 4  # words
SAMPLE = 4  # one text of SAMPLE is in the sample, by its hash
SLACK = 0.4  # of the support that the sample's share of a frequent phrase would have
FIRST = 2000  # phrases reported per language
CHUNK_TOKENS, CHUNK_WORDS = 1 << 20, 1 << 18  # a chunk ends with the text that reaches either
WAITING, WAITING_BYTES = 1 << 16, 1 << 21  # texts with as many words wait at least until they are split, unless they have as many bytes
SLICE = 1 << 19  # positions that are worked on at once
FILTER_BITS = 1 << 28
BLOCK = 1 << 13  # bytes of a filter that travel together
PROBES = 4
BATCH = 1 << 16  # rows handed on at once
READ = 1 << 8  # texts taken up at once
EXCERPT = 1 << 10  # words after which a row of excerpts ends, at the end of what lies together
RANGE_BYTES, RANGES = 1 << 23, 1 << 14  # text that a range of hashes stands for, and the most ranges there are

STOPS = b".,;:!?\n\x0b\x0c\r"
FOLD = bytes(10 if b in STOPS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def extend(hashes: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase with one more word."""
    return _mix(hashes * STEP + word)


def word_hashes(words: Sequence[bytes], seed: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(seed)), np.uint64, len(words))


def seed_of(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode())


def _bit(hashes: np.ndarray, i: int, size: int) -> np.ndarray:
    step = np.uint64(i) * (_mix(hashes) | np.uint64(1)) if i else np.uint64(0)
    return ((hashes + step) & np.uint64(size - 1)).astype(np.int64)


def _bits(hashes: np.ndarray, size: int) -> Iterator[np.ndarray]:
    return (_bit(hashes, i, size) for i in range(PROBES))


def holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """True for every phrase in the filter, and for few others."""
    left = np.arange(len(hashes))
    for i in range(PROBES):
        at = _bit(hashes[left] if i else hashes, i, len(bits) * 8)
        left = left[(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)]
    found = np.zeros(len(hashes), bool)
    found[left] = True
    return found


def phrase_filter(known: DataFrame, room: int = 12):
    """A broadcast filter of the phrases (lang, phrase) of ``known``, which is read twice, with ``room`` bits for each."""

    def hashed(batch: pa.RecordBatch):
        alike: dict[tuple[str, int], list[list[bytes]]] = {}
        for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").cast(pa.binary()).to_pylist()):
            words = phrase.split(b" ")
            alike.setdefault((lang, len(words)), []).append(words)
        for (lang, _), phrases in alike.items():
            yield reduce(extend, [word_hashes(column, seed_of(lang)) for column in zip(*phrases)])

    return _filter(known.select("lang", "phrase"), known.count(), hashed, room)


def _filter(rows: DataFrame, n: int, hashed: Callable[[pa.RecordBatch], Iterator[np.ndarray]], room: int = 12):
    """A broadcast filter of the ``n`` hashes that ``hashed`` takes from ``rows``."""
    size = 1 << max(16, min(FILTER_BITS.bit_length() - 1, (room * n).bit_length()))

    def marked(batches: Iterator[pa.RecordBatch]):
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            for hashes in hashed(batch):
                for at in _bits(hashes, size):
                    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for block in range(0, len(bits), BLOCK):
            part = bits[block: block + BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([block // BLOCK], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["block", "bits"])

    def joined(parts: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in parts["bits"].to_pylist()])
        return pa.table({"block": parts["block"][:1], "bits": pa.array([bits.tobytes()], pa.binary())})

    whole = np.zeros(size // 8, np.uint8)
    marks = rows.mapInArrow(marked, "block int, bits binary")
    for row in marks.groupBy("block").applyInArrow(joined, "block int, bits binary").collect():  # at most FILTER_BITS bits
        whole[row.block * BLOCK: row.block * BLOCK + len(row.bits)] = np.frombuffer(row.bits, np.uint8)
    return rows.sparkSession.sparkContext.broadcast(whole)


class _Chunk:
    """Texts as one row of numbers: words, -1 between pieces.  Texts wait until there are many, and are split together."""

    def __init__(self):
        self.tables: dict[str, pa.Array] = {}  # by language: what stands between words, then its words in order of their numbers
        self.parts: list[tuple[str, np.ndarray]] = []
        self.waiting: dict[str, list[bytes]] = {}
        self.tokens = self.pending = self.bytes = 0

    def add(self, lang: str, raw: bytes | None) -> None:
        raw = (raw or b"").translate(FOLD)
        self.waiting.setdefault(lang, []).append(raw)
        self.pending += raw.count(b" ") + 2 * raw.count(b"\n") + 2  # as many numbers at most
        self.bytes += len(raw)
        if self.bytes >= WAITING_BYTES or self.pending >= max(WAITING, CHUNK_WORDS - self.width()):
            self.take_up()

    def take_up(self) -> None:
        for lang, texts in self.waiting.items():
            raw = b"\n".join([*texts, b""]).replace(b"\n", b" \n ")
            found = pc.split_pattern(pa.array([raw], pa.large_binary()), " ").values
            old = self.tables.get(lang)
            if old is None:
                old = pa.array([b"", b"\n"], pa.large_binary())
            coded = pa.concat_arrays([old, found]).dictionary_encode()  # numbers go by first occurrence, so old ones stay
            ids = coded.indices.to_numpy()[len(old):] - np.int32(2)
            self.tables[lang] = coded.dictionary
            self.parts.append((lang, ids[ids != -2]))
            self.tokens += len(self.parts[-1][1])
        self.waiting, self.pending, self.bytes = {}, 0, 0

    def width(self) -> int:
        return sum(len(t) - 2 for t in self.tables.values())

    def full(self) -> bool:
        return self.tokens + self.pending >= CHUNK_TOKENS or self.width() >= CHUNK_WORDS

    def words(self) -> Iterator[tuple[str, pa.Array, int]]:
        """Each language that has words, its words, and the number of the first."""
        low = 0
        for lang, table in self.tables.items():
            if len(table) > 2:
                yield lang, table[2:], low
                low += len(table) - 2

    def ids(self) -> np.ndarray:
        first = {lang: low for lang, _, low in self.words()}
        return np.concatenate([np.where(ids < 0, ids, ids + np.int32(first.get(lang, 0))) for lang, ids in self.parts])

    def listing(self) -> tuple[pa.DictionaryArray, pa.Array]:
        """Language and word of each number."""
        names, tables, _ = zip(*self.words())
        which = np.repeat(np.arange(len(names), dtype=np.int32), [len(t) for t in tables])
        return pa.DictionaryArray.from_arrays(pa.array(which), pa.array(names, pa.string())), pa.concat_arrays(tables).cast(pa.binary())

    def hashes(self) -> np.ndarray:
        return np.concatenate([word_hashes(table.to_numpy(zero_copy_only=False), seed_of(lang)) for lang, table, _ in self.words()])


def _chunked(batches: Iterator[pa.RecordBatch], rows: Callable[[_Chunk], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """What ``rows`` makes of the texts (lang, text), chunk by chunk; texts are taken up a few at a time."""
    chunk = _Chunk()
    for batch in batches:
        langs, texts = batch.column("lang"), batch.column("text").cast(pa.binary())
        for low in range(0, len(texts), READ):
            for lang, raw in zip(langs[low: low + READ].to_pylist(), texts[low: low + READ].to_pylist()):
                chunk.add(lang, raw)
                if chunk.full():
                    yield from _rows(chunk, rows)
                    chunk = _Chunk()
    yield from _rows(chunk, rows)


def _rows(chunk: _Chunk, rows: Callable[[_Chunk], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    chunk.take_up()
    if chunk.width():
        yield from rows(chunk)


def _known(ids: np.ndarray, at: np.ndarray, length: int, hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Of the positions ``at`` those at which a phrase of ``length`` words in the filter begins."""
    out = []
    for low in range(0, len(at), SLICE):
        here = at[low: low + SLICE]
        value = reduce(extend, [hashes[ids[here + i]] for i in range(length)])
        out.append(here[holds(bits, value)])
    return np.concatenate(out) if out else at


def candidates(ids: np.ndarray, at: np.ndarray, hashes: np.ndarray, bits: np.ndarray, longest: int) -> list[np.ndarray]:
    """For 2, 3 .. ``longest`` words: those of the positions ``at`` where phrases begin whose two parts, a word shorter, are in
    the filter."""
    single = np.append(holds(bits, hashes), False)[ids]  # the last one stands for what is between pieces
    at = at[single[at]]
    here = np.zeros(len(ids) + 1, bool)
    out = []
    for length in range(2, longest + 1):
        if length == 2:
            at = at[single[np.minimum(at + 1, len(ids) - 1)] & (at + 1 < len(ids))]
        else:
            here[:] = False
            here[at] = True
            at = at[here[at + 1]]
        out.append(at)
        if length < longest:
            at = _known(ids, at, length, hashes, bits)
    return out


def distinct(ids: np.ndarray, at: np.ndarray, length: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(where it first begins, how often) of every phrase of ``length`` words that begins at ``at``, some first words at a
    time; phrases are told apart exactly."""
    parts = max(1, -(-len(at) // SLICE))
    for part in range(parts):
        mine = at if parts == 1 else at[ids[at] % parts == part]
        number = ids[mine].astype(np.int64)
        for i in range(1, length - 1):
            number = np.unique(number * width + ids[mine + i], return_inverse=True)[1]
        _, first, n = np.unique(number * width + ids[mine + length - 1], return_index=True, return_counts=True)
        yield mine[first], n


def covered(ids: np.ndarray, hashes: np.ndarray, bits: np.ndarray, longest: int) -> np.ndarray:
    """Where there is a word of a phrase of up to ``longest`` words that is in the filter."""
    out = np.append(holds(bits, hashes), False)[ids]  # the last one stands for what is between pieces
    at = np.flatnonzero(ids >= 0).astype(np.int32)
    at = at[ids[at + 1] >= 0]
    for length in range(2, longest + 1):
        begins = _known(ids, at, length, hashes, bits)
        for i in range(length):
            out[begins + i] = True
        at = at[ids[at + length] >= 0]  # a text ends with what is between pieces
    return out


def near(hit: np.ndarray, ids: np.ndarray, longest: int) -> np.ndarray:
    """Positions less than ``longest`` words away from a ``hit``, on either side, in the same piece."""
    for _ in range(1, longest):
        out = hit.copy()
        out[:-1] |= hit[1:]
        out[1:] |= hit[:-1]
        hit = out & (ids >= 0)
    return np.flatnonzero(hit).astype(np.int32)


def excerpts(docs: DataFrame, fresh, longest: int = LONGEST) -> DataFrame:
    """(lang, text): all of the texts that lies less than ``longest`` words away from a phrase of up to ``longest`` - 1 words in the
    filter ``fresh``, in order, a line end between what does not lie together."""

    def cut(batches: Iterator[pa.RecordBatch]):
        def rows(chunk: _Chunk):
            ids, width = chunk.ids(), chunk.width()
            at = near(covered(ids, chunk.hashes(), fresh.value, longest - 1), ids, longest)
            if not len(at):
                return
            lang, listed = chunk.listing()
            words, starts = pa.concat_arrays([listed, pa.array([b"\n"], pa.binary())]), np.flatnonzero(np.append(True, np.diff(at) > 1))
            which, number = lang.indices.to_numpy()[ids[at[starts]]], np.insert(ids[at], starts, width)
            starts = starts + np.arange(len(starts))  # each with the line end before it
            begins = np.append(True, (np.diff(which) != 0) | (np.diff(starts // EXCERPT) != 0))
            bounds, which = np.append(starts[begins], len(number)), which[begins]
            low = 0
            while low < len(which):
                high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + BATCH, "right")) - 1)
                here = bounds[low: high + 1]
                found = pa.ListArray.from_arrays(pa.array((here - here[0]).astype(np.int32)), words.take(pa.array(number[here[0]: here[-1]])))
                texts = pc.binary_join(found, b" ")
                yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(which[low: high])), texts], ["lang", "text"])
                low = high

        return _chunked(batches, rows)

    return docs.select("lang", "text").mapInArrow(cut, "lang string, text binary")


def screen(docs: DataFrame, known, least: int, longest: int = LONGEST):
    """A filter of the phrases that ``phrase_counts`` would count with ``known`` and whose hashes occur ``least`` times.

    A range of hashes is one group, which holds eight bytes and a count for each of its phrases and chunks.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(RANGES.bit_length() - 1, max(4, (size // RANGE_BYTES).bit_length()))
    kind = np.min_scalar_type(least)  # for a count of ``least`` and one of more are alike

    def hashed(batches: Iterator[pa.RecordBatch]):
        cuts = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)

        def rows(chunk: _Chunk):
            ids, hashes = chunk.ids(), chunk.hashes()
            at = np.flatnonzero(ids >= 0).astype(np.int32)
            for i, at in enumerate([at, *(candidates(ids, at, hashes, known.value, longest) if longest > 1 else [])]):
                for low in range(0, len(at), SLICE):
                    here = at[low: low + SLICE]
                    value, n = np.unique(reduce(extend, [hashes[ids[here + j]] for j in range(i + 1)]), return_counts=True)
                    n = np.minimum(n, least).astype(kind)
                    ends = np.concatenate([[0], np.searchsorted(value, cuts), [len(value)]])
                    blobs = [pa.Array.from_buffers(pa.binary(), 1 << bits, [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(x)]) for x in (value, n)]
                    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(1 << bits, dtype=np.int32)), *blobs], ["range", "hashes", "n"])
                    yield batch.filter(pa.array(np.diff(ends) > 0))

        return _chunked(batches, rows)

    def added(parts: pa.Table) -> pa.Table:
        value, n = (np.frombuffer(b"".join(parts[c].to_pylist()), k) for c, k in (("hashes", np.uint64), ("n", kind)))
        order = np.argsort(value)
        value = value[order]
        first = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
        value = value[first][np.add.reduceat(n[order], first, dtype=np.int64) >= least]
        return pa.table({"hashes": pa.array([value.tobytes()], pa.binary()), "n": pa.array([len(value)], pa.int64())})

    parts = docs.select("lang", "text").mapInArrow(hashed, "range int, hashes binary, n binary")
    found = stored(parts.groupBy("range").applyInArrow(added, "hashes binary, n long"), "screened")
    n = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    out = _filter(found.select("hashes"), n, lambda batch: (np.frombuffer(b, np.uint64) for b in batch.column("hashes").to_pylist()))
    discard(found)
    return out


def phrase_counts(docs: DataFrame, known=None, before=None, shortest: int = 1, longest: int = LONGEST, fresh=None, passing=None) -> DataFrame:
    """(lang, phrase, words, n) over all texts of ``docs``: phrases of ``shortest`` to ``longest`` words whose parts are in the
    filter ``known``, without those whose parts are in ``before``.  With single words comes a row per language of no words at all
    and n words.  ``fresh`` is a filter of what ``known`` has and ``before`` has not: a phrase that holds none of it is not new.
    ``passing``, from ``screen``, takes the place of ``known``, and phrases that are not in it themselves are left out."""

    def counted(batches: Iterator[pa.RecordBatch]):
        def rows(chunk: _Chunk):
            ids, width = chunk.ids(), chunk.width()
            lang, listed = chunk.listing()
            which = lang.indices.to_numpy()
            hashes = chunk.hashes() if longest > 1 or passing is not None else None
            if shortest == 1:
                n = np.bincount(ids[ids >= 0], minlength=width)
                total = np.bincount(which, n).astype(np.int64)
                yield from batches_of(lang.dictionary, pa.array([b""] * len(total), pa.binary()), 0, total)
                if passing is None:
                    yield from batches_of(lang, listed, 1, n)
                else:
                    kept = np.flatnonzero(holds(passing.value, hashes))
                    yield from batches_of(lang.take(pa.array(kept)), listed.take(pa.array(kept)), 1, n[kept])
            if longest < 2:
                return
            if fresh is None:
                at = np.flatnonzero(ids >= 0).astype(np.int32)
            else:
                hit = covered(ids, hashes, fresh.value, longest - 1)
                at = near(hit, ids, longest)
            old = candidates(ids, at, hashes, before.value, longest) if before is not None else None
            for i, at in enumerate(candidates(ids, at, hashes, (passing or known).value, longest)):
                if i + 2 < shortest:
                    continue
                if old is not None:
                    at = np.setdiff1d(at, old[i], assume_unique=True)
                if fresh is not None:  # places without such a phrase were not all looked at
                    at = at[np.logical_or.reduce([hit[at + j] for j in range(i + 2)])]
                if passing is not None:
                    at = _known(ids, at, i + 2, hashes, passing.value)
                for first, n in distinct(ids, at, i + 2, width):
                    for low in range(0, len(first), BATCH):
                        here = first[low: low + BATCH]
                        phrase = pc.binary_join_element_wise(*[listed.take(pa.array(ids[here + j])) for j in range(i + 2)], b" ")
                        yield from batches_of(lang.take(pa.array(ids[here])), phrase, i + 2, n[low: low + BATCH])

        def batches_of(lang, phrase, words, n):
            lang = lang.cast(pa.string())
            for low in range(0, len(phrase), BATCH):
                part = slice(low, low + BATCH)
                columns = [lang[part], phrase[part].cast(pa.string()), pa.array(np.full(len(n[part]), words, np.int32)), pa.array(n[part].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "words", "n"])

        return _chunked(batches, rows)

    found = docs.select("lang", "text").mapInArrow(counted, "lang string, phrase string, words int, n long")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, sample: int = SAMPLE, slack: float = SLACK) -> DataFrame:
    """(lang, phrase, words, n) of every phrase of up to ``longest`` words with n >= ``least``; words = 0 is a language's total.

    ``docs`` has (lang, text).  Sample and slack decide how many passes there are, never what is found.

    Filters let more through, and a phrase that is counted in excerpts though it holds no failure may also occur outside of them.
    So of later passes only what has a failure as a part is kept, and all else waits for the pass after its parts are known.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text", F.xxhash64(*docs.columns).alias("_hash"))
    drawn = texts.where(F.pmod("_hash", F.lit(sample)) == 0)
    support = max(1, int(least / sample * slack))
    known = None
    for length in range(1, max(longest, 2)):
        level = phrase_counts(drawn, known and phrase_filter(known), shortest=length, longest=length)
        level = stored(level.where((F.col("n") >= support) & (F.col("words") > 0)).select("lang", "phrase"), f"phrases-{length}")
        known = level if known is None else known.union(level)
    first = bits = phrase_filter(known)
    read, before, shortest, frequent, fresh, failures = texts, None, 1, None, None, None
    passing = screen(texts, bits, least, longest)
    while True:
        counts = phrase_counts(read, bits, before, shortest, longest, fresh, passing)
        counts = counts.where((F.col("n") >= least) | (F.col("words") == 0))
        counts = stored(counts if failures is None else _holding(counts, failures), "phrase-counts")
        # A phrase counted by two passes has the same count in both.
        frequent = counts if frequent is None else frequent.union(counts)
        failures = counts.where((F.col("words") > 0) & (F.col("words") < longest)).select("lang", "phrase").join(known, ["lang", "phrase"], "left_anti")
        failures = stored(failures, "failures")
        if failures.isEmpty():
            if before is not None:
                discard(read)
            return frequent.distinct()
        known = known.union(failures)
        fresh = phrase_filter(failures, 64)
        if before is None:
            read = stored(excerpts(texts, fresh, longest), "excerpts")
        # Only the first pass kept all that its filter let through; what failures open is little.
        bits, before, shortest, passing = phrase_filter(known), first, 2, None


def _part(start, length):
    return F.array_join(F.slice("_words", start, length), " ")


def _holding(phrases: DataFrame, parts: DataFrame) -> DataFrame:
    """The phrases (lang, phrase, words, n) that, without the first or without the last word, are among ``parts`` (lang, phrase)."""
    split = phrases.withColumn("_words", F.split("phrase", " "))
    part = split.withColumn("_part", F.explode(F.array(_part(F.lit(1), F.col("words") - 1), _part(F.lit(2), F.col("words") - 1))))
    found = part.join(parts.select("lang", F.col("phrase").alias("_part")), ["lang", "_part"], "left_semi")
    return found.select(*phrases.columns).distinct()


def collocations(phrases: DataFrame, longest: int = LONGEST, first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of two words and more, best first.

    ``phrases`` comes from ``mine``.  The score is that of the weakest cut.  A phrase is dropped if a longer one holds it in at
    least four of five places.
    """
    phrases = stored(phrases, "frequent")
    counts = phrases.where("words > 0").select("lang", "phrase", "n")
    totals = phrases.where("words = 0").select("lang", F.col("n").alias("total"))
    found = phrases.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("_words"))
    cuts = found.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "_k", _part(F.lit(1), F.col("_k")).alias("_left"), _part(F.col("_k") + 1, F.col("words") - F.col("_k")).alias("_right"))
    for side, name in (("_left", "l"), ("_right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    # Decimals, because the product may pass 64 bits.
    cuts = cuts.withColumn("score", F.expr("CAST(a AS DECIMAL(20, 0)) * 2000000 div (CAST(l AS DECIMAL(20, 0)) + r)"))
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "_k", "l", "r")).alias("_cut"))

    inside = found.where("words > 2").withColumn("_size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inside = inside.withColumn("_at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("_size") + 1)))
    inside = inside.select("lang", _part(F.col("_at"), F.col("_size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").where(F.col("_longer").isNull() | F.expr("CAST(_longer AS DECIMAL(20, 0)) * 100 < CAST(a AS DECIMAL(20, 0)) * 80"))
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    kept = kept.select("lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score")
    ranked = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


@query("op13_collocations", r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM worded GROUP BY lang
), grams AS (
  SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM worded, range(1, 5) AS lengths(m) WHERE len(ws) >= m)
), counts AS (
  SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY lang, m, phrase HAVING count(*) >= 30
), cuts AS (
  SELECT c.lang, c.phrase, c.m, c.a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS part1,
    array_to_string(string_split(phrase, ' ')[k + 1:m], ' ') AS part2
  FROM counts c, range(1, 4) AS places(k) WHERE k < m
), scores AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, k, x.a AS l, y.a AS r,
    CAST((CAST(2000000 AS HUGEINT) * cuts.a) // (x.a + y.a) AS BIGINT) AS score
  FROM cuts JOIN counts x ON x.lang = cuts.lang AND x.phrase = part1 JOIN counts y ON y.lang = cuts.lang AND y.phrase = part2
), weakest AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + size - 1], ' ') AS phrase, max(a) AS longer
  FROM counts, range(2, 4) AS sizes(size), range(1, 4) AS places(i) WHERE size < m AND i + size - 1 <= m GROUP BY ALL
), kept AS (
  SELECT w.* FROM weakest w LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST(80 AS HUGEINT) * w.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000""")
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first phrases of each language of ``documents``."""
    return collocations(mine(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")))
