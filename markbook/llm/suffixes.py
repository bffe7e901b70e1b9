"""Removing repeated passages with a distributed merge of sorted suffix runs.

A passage of LENGTH bytes is found through its anchor: the K-byte string of least hash in it, so equal passages have equal
anchors at equal places.  Neighbouring passages with one anchor form a record: the suffix from the anchor on, and what
stands before the anchor.  1. Blocks of whole texts are written.  2. Anchors' hashes are compared across blocks; anchors of
one document only are dropped.  3. Each block sorts its other records by suffix into a run, keeps the smallest document of
equal ones, and sends the run front-coded, cut at sampled splitters.  4. Each range merges its runs with loser trees that
compare only words beyond known common prefixes; the common prefixes it puts out then tell, for each place of the anchor
in a passage, which records hold the same passage.  5. Blocks meet the covered places of their documents.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markbook.llm.common import discard, query, shuffles_end, stored, table, travels

travels(__name__)

LENGTH = 50
K = 16
PLACES = LENGTH - K + 1  # places of an anchor in a passage
LEFT = PLACES - 1
KEY = LENGTH + 1 + LEFT + 1  # suffix, its length, reversed left context, its length
BLOCK_BYTES = 4 << 20
CHUNK = 1 << 18  # passages whose anchors are computed at once
POSITION_BITS = np.uint64(22)
RANGE_HASHES = 4_000_000  # hashes aimed at per range of step 2
RANGE_RECORDS = 250_000  # records aimed at per range of step 4
SAMPLE = 1 << 18  # anchors sampled for the splitters, in expectation
HASH_BITS = 44
DECODED = 1 << 14  # front-coded keys decoded at once
LANE = 96  # records that one loser tree puts out, about
BYTES = np.uint64(1) << np.arange(8, 64, 8, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the K bytes from every place on."""
    n = len(raw) - K + 1
    words = np.ndarray(len(raw) - 7, "<u8", raw.tobytes(), strides=(1,)).astype(np.uint64)
    return _mix(words[:n] * np.uint64(0x9E3779B97F4A7C15) ^ _mix(words[K - 8: K - 8 + n]))


def anchors(raw: np.ndarray, lengths: np.ndarray, takes_part: np.ndarray):
    """Records of a block: (document index, first passage, last passage, anchor, hash of the anchor), as arrays.

    ``raw`` is all texts after one another; places count from its start."""
    last = np.where(takes_part, np.cumsum(lengths) - LENGTH, -1)
    small = np.int32 if len(raw) < 1 << 31 else np.int64
    limit = np.repeat(last.astype(small), lengths)  # last passage of the place's document
    owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    parts = []
    for at in range(0, max(len(raw) - LENGTH + 1, 0), CHUNK):
        piece = raw[at: at + CHUNK + LENGTH - 1]
        full = _hashes(piece)
        low = (full >> POSITION_BITS << POSITION_BITS) | np.arange(len(full), dtype=np.uint64)
        width = 1
        while 2 * width <= PLACES:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < PLACES:
            low = np.minimum(low[: len(low) - (PLACES - width)], low[PLACES - width:])
        anchor = (low & np.uint64((1 << int(POSITION_BITS)) - 1)).astype(np.int64)
        # Passages that lie in one document that takes part.
        inside = np.flatnonzero(np.arange(at, at + len(anchor)) <= limit[at: at + len(anchor)])
        if not len(inside):
            continue
        place, doc, anchor = inside + at, owner[at + inside].astype(np.int64), anchor[inside]
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1] + 1) | (doc[1:] != doc[:-1])]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(place)] - 1
        parts.append((doc[first], place[first], place[last], anchor[first] + at, full[anchor[first]]))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def keys_of(raw: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Sort keys (n x KEY bytes): suffix padded with zeros, its length, left context from the anchor leftwards, its length."""
    n = len(first)
    out = np.zeros((n, KEY), np.uint8)
    if not n:
        return out
    right, left = last + LENGTH - anchor, anchor - first
    padded = np.pad(raw, (LEFT, LENGTH))
    out[:, :LENGTH] = np.lib.stride_tricks.sliding_window_view(padded, LENGTH)[anchor + LEFT]
    out[:, :LENGTH] *= np.arange(LENGTH) < right[:, None]
    out[:, LENGTH] = right
    out[:, LENGTH + 1: LENGTH + 1 + LEFT] = np.lib.stride_tricks.sliding_window_view(padded, LEFT)[anchor][:, ::-1]
    out[:, LENGTH + 1: LENGTH + 1 + LEFT] *= np.arange(LEFT) < left[:, None]
    out[:, KEY - 1] = left + 1
    return out


def common_prefixes(keys: np.ndarray) -> np.ndarray:
    """Common prefix of each sorted key with the one before it (0 for the first)."""
    if not len(keys):
        return np.zeros(0, np.int64)
    differ = keys[1:] != keys[:-1]
    return np.r_[0, np.where(differ.any(axis=1), differ.argmax(axis=1), keys.shape[1])]


def _decoded(prefix: np.ndarray, rest: np.ndarray, width: int) -> np.ndarray:
    """Keys (n x width bytes) of front-coded runs after one another."""
    keys = np.empty((len(prefix), width), np.uint8)
    rest, key, at = rest.tobytes(), b"", 0
    for done in range(0, len(prefix), DECODED):
        piece = []
        for h in prefix[done: done + DECODED].tolist():
            to = at + width - h
            key = key[:h] + rest[at:to]
            piece.append(key)
            at = to
        keys[done: done + DECODED] = np.frombuffer(b"".join(piece), np.uint8).reshape(-1, width)
    return keys


def _beats(words: np.ndarray, width: int, a: np.ndarray, b: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether rows a come before rows b, each pair agreeing on h bytes, and their common prefixes; equal ones by row."""
    n = words.shape[1]
    at = np.minimum(h >> 3, n - 1)
    flat = words.ravel()
    x, y = flat.take(a * n + at), flat.take(b * n + at)
    same = np.flatnonzero(x == y)
    if len(same):
        low = int(at[same].min())
        xs, ys = words[a[same], low:], words[b[same], low:]
        go = (xs != ys).argmax(axis=1)  # 0 where all are equal
        x[same], y[same] = np.take_along_axis(xs, go[:, None], 1)[:, 0], np.take_along_axis(ys, go[:, None], 1)[:, 0]
        at[same] = low + go
    common = 8 * at + 7 - np.searchsorted(BYTES, x ^ y, side="right")
    common[x == y] = width
    return (x < y) | (x == y) & (a < b), common


def _lanes(names: np.ndarray) -> np.ndarray:
    """Lane of each row, about LANE rows in each, in the order of the names and for equal ones of the rows."""
    n = len(names)
    every = max(1, LANE // 32)
    sample = np.arange(0, n, every)
    cuts = sample[np.argsort(names[sample], kind="stable")][LANE // every:: LANE // every]
    if not len(cuts):
        return np.zeros(n, np.int64)
    at = names[cuts]
    before = np.searchsorted(at, names)
    row = np.where(at[np.minimum(before, len(at) - 1)] == names, np.arange(n), -1)
    return np.searchsorted(np.searchsorted(at, at) * (n + 1) + cuts, before * (n + 1) + row, side="right")


def merged(prefix: np.ndarray, rest: np.ndarray, sizes: list[int], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loser-tree merge of front-coded runs: the rows in order, their common prefixes with the key before, the rows' keys.

    ``prefix`` and ``rest`` are the runs' common prefixes and remainders after one another, ``sizes`` the records of each.
    The keys are cut into lanes, each with a loser tree over its runs, and the trees take their steps together.  A node keeps
    a loser and its common prefix with the last key put out; a longer common prefix wins without a look at the keys, and
    equal ones are compared from there on only."""
    n = len(prefix)
    prefix = prefix.astype(np.int64)
    keys = _decoded(prefix, rest, width)
    if not n:
        return np.zeros(0, np.int64), prefix, keys
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = keys
    words = words.view(">u8").astype(np.uint64)
    run = np.repeat(np.arange(len(sizes)), sizes)
    lane = _lanes(keys.view(f"S{width}").ravel())
    size = np.bincount(lane)
    start = np.cumsum(size) - size
    # Longest lanes first: those still at work are always the first ones, and so are those with the highest trees.
    by_size = np.argsort(-size, kind="stable")[: np.count_nonzero(size)]
    rank = np.empty(len(size), np.int64)
    rank[by_size] = np.arange(len(by_size))
    place, size, mine = start[by_size], size[by_size], rank[lane]
    levels = np.ceil(np.log2(np.minimum(size, len(sizes)))).astype(np.int64)
    tree = np.cumsum(1 << levels) - (1 << levels)
    # A lane's leaves are the runs that have rows in it.
    head = np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | (mine[1:] != mine[:-1])])
    order = np.argsort(mine[head], kind="stable")
    ranked = mine[head][order]
    leaf = np.empty(len(head), np.int64)
    leaf[order] = np.arange(len(head)) - np.searchsorted(ranked, ranked)
    goes_on = np.ones(n, bool)
    goes_on[np.r_[head[1:], n] - 1] = False
    parent = np.repeat(leaf + (1 << levels[mine[head]]) >> 1, np.diff(np.r_[head, n]))
    total = int(tree[-1] + (1 << levels[-1]))
    rows, known = np.zeros(total, np.int64), np.full(total, -1)
    at = tree[mine[head]] + leaf
    rows[at], known[at] = head, 0
    loser, lost = np.zeros(total, np.int64), np.full(total, -1)
    a, h = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
    for level in np.unique(levels):
        of = slice(*np.searchsorted(-levels, [-level, -level + 1]))
        c = 1 << int(level)
        here = slice(tree[of.start], tree[of.start] + c * (of.stop - of.start))
        x, hx = rows[here].reshape(-1, c), known[here].reshape(-1, c)
        losers, losts = loser[here].reshape(-1, c), lost[here].reshape(-1, c)
        while c > 1:
            left, right = x[:, ::2], x[:, 1::2]
            wins, common = hx[:, ::2] >= 0, np.minimum(hx[:, ::2], hx[:, 1::2])
            both = np.nonzero(common >= 0)
            wins[both], common[both] = _beats(words, width, left[both], right[both], common[both])
            losers[:, c // 2: c], losts[:, c // 2: c] = np.where(wins, right, left), common
            x, hx = np.where(wins, left, right), np.maximum(hx[:, ::2], hx[:, 1::2])
            c //= 2
        a[of], h[of] = x[:, 0], hx[:, 0]
    order, between = np.empty(n, np.int64), np.empty(n, np.int64)
    for step in range(int(size[0])):
        c = int(np.searchsorted(-size, -step))  # lanes of more than ``step`` rows
        a, h = a[:c], h[:c]
        order[place[:c] + step], between[place[:c] + step] = a, h
        node = parent[a]
        more = goes_on[a]
        a = a + more
        h = np.where(more, prefix[a], -1)
        for level in range(int(levels[0])):
            t = int(np.searchsorted(-levels[:c], -level))  # lanes with a node on this level
            at = tree[:t] + node[:t]
            mine, ours, other, theirs = a[:t], h[:t], loser[at], lost[at]
            beaten, low = ours < theirs, np.minimum(ours, theirs)
            tie = np.flatnonzero((ours == theirs) & (ours >= 0))
            if len(tie):
                wins, low[tie] = _beats(words, width, mine[tie], other[tie], ours[tie])
                beaten[tie] = ~wins
            loser[at], lost[at] = np.where(beaten, mine, other), low
            a[:t], h[:t] = np.where(beaten, other, mine), np.maximum(ours, theirs)
            node >>= 1
    first = np.sort(place)[1:]
    between[first] = _beats(words, width, order[first - 1], order[first], np.zeros(len(first), np.int64))[1]
    return order, between, keys


def merge(runs: list[tuple[list[int], list[bytes]]]):
    """``merged`` record by record: (run, place in the run, common prefix with the key before, key).

    A run is (common prefixes, remainders); all keys are of one length."""
    sizes = [len(rests) for _, rests in runs]
    width = next((len(rests[0]) for _, rests in runs if rests), 0)
    prefix = np.array([h for prefixes, _ in runs for h in prefixes], np.int64)
    rest = np.frombuffer(b"".join(r for _, rests in runs for r in rests), np.uint8)
    starts = np.r_[0, np.cumsum(sizes)]
    order, between, keys = merged(prefix, rest, sizes, width)
    for row, h in zip(order.tolist(), between.tolist()):
        run = int(np.searchsorted(starts, row, side="right")) - 1
        yield run, row - int(starts[run]), h, keys[row].tobytes()


def same_passages(keys: np.ndarray, prefix: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """(record x place): whether the passage with the anchor at that place also starts in a document of smaller id.

    ``keys`` are different and sorted, ``prefix`` their common prefixes, ``docs`` the smallest document of each."""
    n = len(keys)
    hit = np.zeros((n, PLACES), bool)
    group = np.cumsum(prefix < K)
    busy = np.flatnonzero(np.bincount(group, minlength=group[-1] + 1 if n else 1)[group] > 1) if n else np.zeros(0, np.int64)
    if not len(busy):
        return hit
    # Records whose anchor no other record has are left out; a prefix with the last one kept is the least between them.
    edges = np.minimum.reduceat(prefix[: busy[-1] + 1], np.r_[0, busy[:-1] + 1])
    sub, docs = keys[busy], docs[busy]
    right, left = sub[:, LENGTH].astype(np.int64), sub[:, KEY - 1].astype(np.int64) - 1
    contexts = np.ascontiguousarray(sub[:, LENGTH + 1:])
    by_left = np.argsort(contexts.view(f"S{LEFT + 1}").ravel(), kind="stable")
    left_prefix = common_prefixes(contexts[by_left][:, :LEFT])
    for d in range(PLACES):
        on = np.flatnonzero((right >= LENGTH - d) & (left >= d))
        if len(on) < 2:
            continue
        left_id = np.empty(len(sub), np.int64)
        left_id[by_left] = np.cumsum(left_prefix < d) if d else 0
        name = (np.cumsum(edges < LENGTH - d) * (len(sub) + 1) + left_id)[on]
        order = np.argsort(name, kind="stable")
        name, mine = name[order], docs[on][order]
        begin = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
        least = np.repeat(np.minimum.reduceat(mine, begin), np.diff(np.r_[begin, len(name)]))
        hit[busy[on[order[mine > least]]], d] = True
    return hit


def _packed(**arrays: np.ndarray) -> bytes:
    head = ",".join(f"{k}:{v.dtype.str}:{v.size}" for k, v in arrays.items()).encode()
    return zstd.ZstdCompressor(level=3).compress(len(head).to_bytes(4, "little") + head + b"".join(v.tobytes() for v in arrays.values()))


def _unpacked(blob: bytes) -> dict[str, np.ndarray]:
    raw = zstd.ZstdDecompressor().decompress(blob)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = {}
    for part in raw[4:at].decode().split(","):
        name, kind, size = part.split(":")
        out[name] = np.frombuffer(raw, kind, int(size), at)
        at += out[name].nbytes
    return out


def _joined_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Touching spans of a document made one; sorted by document and start."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    # Far enough apart, so that one running maximum serves all documents.
    far = int(end.max()) + 2
    s, e = doc * far + start, doc * far + end
    reach = np.maximum.accumulate(e)
    new = np.r_[True, s[1:] > reach[:-1]]
    begin = np.flatnonzero(new)
    return doc[begin], start[begin], reach[np.r_[begin[1:], len(s)] - 1] - doc[begin] * far


def blocks_of(docs: DataFrame) -> DataFrame:
    """(block, n_bytes, data): whole texts packed to about BLOCK_BYTES; data holds ids, lengths and texts."""

    def block(number: int, ids: list, texts: list[bytes]) -> pd.DataFrame:
        known = np.array([i is not None for i in ids], bool)
        data = _packed(ids=np.array([0 if i is None else i for i in ids], np.int64), known=known, lengths=np.array([len(t) for t in texts], np.int64),
                       raw=np.frombuffer(b"".join(texts), np.uint8))
        return pd.DataFrame({"block": [number], "n_bytes": [sum(map(len, texts))], "data": [data]})

    def run(batches: Iterator[pd.DataFrame]):
        number = TaskContext.get().partitionId() << 24
        ids, texts, held = [], [], 0
        for rows in batches:
            for i, t in zip(rows["doc_id"].astype("Int64"), rows["text"]):
                ids.append(None if pd.isna(i) else int(i))
                texts.append((t or "").encode())
                held += len(texts[-1]) + 16
                if held >= BLOCK_BYTES:
                    yield block(number, ids, texts)
                    number, ids, texts, held = number + 1, [], [], 0
        if ids:
            yield block(number, ids, texts)

    return docs.select("doc_id", "text").mapInPandas(run, "block long, n_bytes long, data binary")


def _read(data: bytes):
    b = _unpacked(data)
    return b["ids"], b["known"].astype(bool), b["lengths"], b["raw"]


def _short(hashes: np.ndarray) -> np.ndarray:
    """Hashes for exchange and sample, mixed again: those of anchors are the least of many, so most of them are small."""
    return _mix(hashes) >> np.uint64(64 - HASH_BITS)


def _hash_range(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return (hashes >> np.uint64(16)) * np.uint64(ranges) >> np.uint64(HASH_BITS - 16)


def _anchor_lists(ranges: int, sampled_below: int):
    """Step 2, map side: per range the block's distinct anchor hashes and which of them two documents have; in range -1
    the anchors (K bytes) of the sample."""

    def run(batches: Iterator[pd.DataFrame]):
        for rows in batches:
            for r in rows.itertuples():
                ids, known, lengths, raw = _read(r.data)
                doc, _, _, anchor, full = anchors(raw, lengths, known)
                if not len(doc):
                    continue
                h = _short(full)
                order = np.argsort(h, kind="stable")
                names = ids[doc[order]]
                begin = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
                several = np.minimum.reduceat(names, begin) != np.maximum.reduceat(names, begin)
                one = h[order][begin]
                cut = np.searchsorted(_hash_range(one, ranges), np.arange(ranges + 1))
                out = []
                for i in range(ranges):
                    part = one[cut[i]: cut[i + 1]]
                    if len(part):
                        gap = np.diff(part, prepend=np.uint64(0))
                        out.append((i, r.block, _packed(low=gap.astype(np.uint32), high=(gap >> np.uint64(32)).astype(np.uint16), several=np.packbits(several[cut[i]: cut[i + 1]]))))
                pick = np.flatnonzero(one < np.uint64(sampled_below))
                if len(pick):
                    at = anchor[order][begin][pick]
                    out.append((-1, r.block, _packed(anchors=raw[at[:, None] + np.arange(K)].ravel(), several=several[pick])))
                yield pd.DataFrame(out, columns=["range", "block", "data"])

    return run


def _shared_anchors(rows: pd.DataFrame) -> pd.DataFrame:
    """Step 2, per range: for every block, which of its hashes another document has."""
    every, flag = [], []
    for data in rows["data"]:
        b = _unpacked(data)
        h = np.cumsum(b["low"].astype(np.uint64) | b["high"].astype(np.uint64) << np.uint64(32))
        every.append(h)
        flag.append(np.unpackbits(b["several"], count=len(h)).astype(bool))
    sizes = np.cumsum([len(h) for h in every])[:-1]
    every, twice = np.concatenate(every), np.concatenate(flag)
    order = np.argsort(every, kind="stable")
    every = every[order]
    same = every[1:] == every[:-1]
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return pd.DataFrame({"block": rows["block"], "range": rows["range"], "bits": [np.packbits(x).tobytes() for x in np.split(twice, sizes)]})


def _run_of_block(splitters: list[bytes], ranges: int):
    """Step 3: the block's run of sorted records, cut at the splitters, and the spans already decided within the block."""

    def run(blocks: pd.DataFrame, bits: pd.DataFrame) -> pd.DataFrame:
        columns = ["range", "block", "kind", "data"]
        if not len(blocks):
            return pd.DataFrame([], columns=columns)
        number = int(blocks["block"].iloc[0])
        ids, known, lengths, raw = _read(blocks["data"].iloc[0])
        doc, first, last, anchor, full = anchors(raw, lengths, known)
        h = _short(full)
        order = np.argsort(h)
        new = np.r_[True, h[order][1:] != h[order][:-1]][: len(h)]
        one = h[order][new]
        cut = np.searchsorted(_hash_range(one, ranges), np.arange(ranges + 1))
        shared = np.zeros(len(one), bool)
        for i, data in zip(bits["range"], bits["bits"]):
            size = cut[i + 1] - cut[i]
            shared[cut[i]: cut[i + 1]] = np.unpackbits(np.frombuffer(data, np.uint8), count=size).astype(bool)
        keep = np.sort(order[shared[np.cumsum(new) - 1]])
        if not len(keep):
            return pd.DataFrame([], columns=columns)
        doc, first, last, anchor = doc[keep], first[keep], last[keep], anchor[keep]
        keys = keys_of(raw, first, last, anchor)
        begins = np.cumsum(lengths) - lengths
        names = ids[doc]
        # By key, then by document: the first of equal records is of the block's smallest document.
        order = np.argsort(names, kind="stable")
        order = order[np.argsort(keys[order].view(f"S{KEY}").ravel(), kind="stable")]
        keys, doc, names = keys[order], doc[order], names[order]
        first, last, anchor = first[order] - begins[doc], last[order] - begins[doc], anchor[order] - begins[doc]
        prefix = common_prefixes(keys)
        begin = np.flatnonzero(prefix < KEY)
        least = np.repeat(names[begin], np.diff(np.r_[begin, len(keys)]))
        beaten = names > least
        spans = _joined_spans(doc[beaten], first[beaten], last[beaten] + LENGTH)
        out = [(number % (len(splitters) + 1), number, 1, _packed(doc=spans[0], start=spans[1], end=spans[2]))]
        # What stays: equal records of the smallest document, the run's record at the first of them.
        group = np.cumsum(prefix < KEY) - 1
        mine = np.flatnonzero(~beaten)
        held = np.bincount(group[mine], minlength=len(begin))
        begin_of = np.r_[0, np.cumsum(held)]
        # Records with one anchor stay together.
        heads = np.ascontiguousarray(keys[begin, :K]).view(f"S{K}").ravel()
        edges = [0, *np.searchsorted(heads, np.array(splitters, f"S{K}")).tolist(), len(begin)]
        run_prefix = common_prefixes(keys[begin])
        for i in range(len(splitters) + 1):
            a, b = edges[i], edges[i + 1]
            if a == b:
                continue
            p = run_prefix[a:b].copy()
            p[0] = 0
            rest = np.arange(KEY) >= p[:, None]
            at = mine[begin_of[a]: begin_of[b]]
            out.append((i, number, 0, _packed(prefix=p.astype(np.uint8), rest=keys[begin[a:b]][rest], name=names[begin[a:b]],
                                              held=held[a:b].astype(np.int32), doc=doc[at].astype(np.int32), anchor=anchor[at].astype(np.int32))))
        return pd.DataFrame(out, columns=columns)

    return run


def _merged_range(rows: pd.DataFrame) -> pd.DataFrame:
    """Step 4: (block, data) with the covered spans of the block's documents that this range decides."""
    through = rows.loc[rows["kind"] == 1, ["block", "data"]]
    rows = rows[rows["kind"] == 0].sort_values("block", ignore_index=True)
    if not len(rows):
        return through
    parts = [_unpacked(d) for d in rows["data"]]
    sizes = [len(b["name"]) for b in parts]
    at, prefix, keys = merged(np.concatenate([b["prefix"] for b in parts]), np.concatenate([b["rest"] for b in parts]), sizes, KEY)
    which, keys = np.repeat(np.arange(len(sizes)), sizes)[at], keys[at]
    names = np.concatenate([b["name"] for b in parts])[at]
    begin = np.flatnonzero(prefix < KEY)
    record = np.cumsum(prefix < KEY) - 1
    least = np.minimum.reduceat(names, begin)
    hit = same_passages(keys[begin], prefix[begin], least)
    # Records of a later document are covered wholly; those of the smallest one where other records say so.
    right, left = keys[begin, LENGTH].astype(np.int64), keys[begin, KEY - 1].astype(np.int64) - 1
    held = np.concatenate([b["held"] for b in parts])
    starts = np.r_[0, np.cumsum(held)]
    docs, places = (np.concatenate([b[c] for b in parts]).astype(np.int64) for c in ("doc", "anchor"))
    spans = []
    whole = names > least[record]
    spans.append((np.flatnonzero(whole), -left[record[whole]], right[record[whole]]))
    rest = np.flatnonzero(~whole & hit.any(axis=1)[record])
    if len(rest):
        padded = np.pad(hit[record[rest]], ((0, 0), (1, 1))).astype(np.int8)
        change = np.diff(padded, axis=1)
        r, low = np.nonzero(change == 1)
        _, high = np.nonzero(change == -1)  # one after the last place of the stretch
        spans.append((rest[r], -(high - 1), LENGTH - low))
    item = np.concatenate([s[0] for s in spans])
    begin_at, end_at = np.concatenate([s[1] for s in spans]), np.concatenate([s[2] for s in spans])
    # Each occurrence of the record in its document.
    times = held[at[item]]
    where = np.repeat(starts[at[item]], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    block = np.repeat(which[item], times)
    doc, start, end = docs[where], places[where] + np.repeat(begin_at, times), places[where] + np.repeat(end_at, times)
    # One pass joins the spans of all blocks: their documents get numbers after one another.
    most = int(docs.max()) + 1
    doc, start, end = _joined_spans(block * most + doc, start, end)
    edge = np.searchsorted(doc, np.arange(len(sizes) + 1) * most)
    out = []
    for i in np.flatnonzero(np.diff(edge)):
        of = slice(edge[i], edge[i + 1])
        out.append((int(rows["block"].iloc[i]), _packed(doc=doc[of] - i * most, start=start[of], end=end[of])))
    return pd.concat([through, pd.DataFrame(out, columns=["block", "data"])], ignore_index=True)


def _remaining(blocks: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
    """Step 5: one row per document of the block."""
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    if not len(blocks):
        return pd.DataFrame([], columns=columns)
    ids, known, lengths, raw = _read(blocks["data"].iloc[0])
    found = [_unpacked(d) for d in spans["data"]]
    none = [np.zeros(0, np.int64)]
    doc, start, end = _joined_spans(*(np.concatenate(none + [b[c] for b in found]) for c in ("doc", "start", "end")))
    edge = np.searchsorted(doc, np.arange(len(ids) + 1))
    begins = np.cumsum(lengths) - lengths
    out = []
    for i in range(len(ids)):
        text = raw[begins[i]: begins[i] + lengths[i]].tobytes()
        s, e = start[edge[i]: edge[i + 1]].tolist(), end[edge[i]: edge[i + 1]].tolist()
        kept = b"".join(text[a:b] for a, b in zip([0, *e], [*s, len(text)])) if s else text
        out.append((int(ids[i]) if known[i] else None, len(text), len(text) - len(kept), len(s), hashlib.sha256(kept).hexdigest(), kept))
    return pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64"})


def splitters_of(sample: list[tuple[bytes, bool]], share: float) -> list[bytes]:
    """Anchors that cut the shared records into ranges of about RANGE_RECORDS; ``share`` is the sampled part of all."""
    seen, within = Counter(a for a, _ in sample), {a for a, several in sample if several}
    weights = sorted((a, n) for a, n in seen.items() if n > 1 or a in within)
    total = sum(n for _, n in weights)
    ranges = max(1, round(total / share / RANGE_RECORDS))
    out, held = [], 0
    for a, n in weights:
        if held + n > total * (len(out) + 1) / ranges and held and len(out) + 1 < ranges:
            out.append(a)
        held += n
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) per row of ``docs``; ``kept`` is the remaining bytes.

    A null text is empty.  A row with a null id neither loses bytes nor makes others lose any; rows of one id do not
    make each other lose bytes.  Texts under LENGTH bytes stay whole."""
    spark = docs.sparkSession
    blocks = stored(blocks_of(docs), "suffix-blocks")
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    expected = 2 * total / (PLACES + 1) + 1  # anchors, by the density of random hashes
    ranges = max(1, round(expected / RANGE_HASHES))
    share = min(1.0, SAMPLE / expected)
    lists = blocks.select("block", "data").mapInPandas(_anchor_lists(ranges, int(share * (1 << HASH_BITS))), "range int, block long, data binary")
    lists = stored(lists, "suffix-anchors")
    sample = []
    # SAMPLE anchors in expectation, however large the corpus.
    for r in lists.where("range = -1").select("data").collect():
        b = _unpacked(r.data)
        sample += zip((x.tobytes() for x in b["anchors"].reshape(-1, K)), b["several"].tolist())
    splitters = splitters_of(sample, share)
    bits = lists.where("range >= 0").groupBy("range").applyInPandas(_shared_anchors, "block long, range int, bits binary")
    # Hashes are gone, stored and exchanged ones, before records are exchanged, and those before the last step.
    with shuffles_end(spark):
        bits = stored(bits, "suffix-bits")
    discard(lists)
    runs = blocks.select("block", "data").groupBy("block").cogroup(bits.groupBy("block")).applyInPandas(
        _run_of_block(splitters, ranges), "range int, block long, kind int, data binary")
    spans = runs.groupBy("range").applyInPandas(_merged_range, "block long, data binary")
    with shuffles_end(spark):
        spans = stored(spans, "suffix-spans")
    discard(bits)
    return blocks.select("block", "data").groupBy("block").cogroup(spans.groupBy("block")).applyInPandas(
        _remaining, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


OP3_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, o, n, substr(h, 2 * o + 1, 610) AS piece FROM (
  SELECT doc_id, h, length(h) // 2 AS n, unnest(range(0, greatest(length(h) // 2 - 49, 0), 256)) AS o FROM d)),
w AS (SELECT doc_id, o + q AS p, substr(piece, 2 * q + 1, 100) AS s FROM (SELECT *, unnest(range(0, least(256, n - 49 - o))) AS q FROM c)),
f AS (SELECT s, min(doc_id) AS first_id FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT w.doc_id, w.p FROM w JOIN f ON w.s = f.s WHERE f.first_id < w.doc_id),
g AS (SELECT doc_id, p, sum(CASE WHEN p <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS k
  FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM r)),
spans AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM g GROUP BY doc_id, k),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS c FROM spans),
kept AS (SELECT d.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
  string_agg(substr(h, CAST(2 * c + 1 AS BIGINT), CAST(2 * (a - c) AS BIGINT)), '' ORDER BY a) || substr(any_value(h), CAST(2 * max(b) + 1 AS BIGINT)) AS rest
  FROM gaps JOIN d ON gaps.doc_id = d.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


@query("op3_suffixes", OP3_SQL)
def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of 50 bytes removed from all ``documents``."""
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
