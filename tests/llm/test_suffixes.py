import hashlib
import random
import time

import numpy as np
import pandas as pd
import pytest

from markbook.llm import suffixes as S

from .cases import LONG, documents, empty


@pytest.mark.parametrize("seed", range(20))
def test_merge_puts_out_keys_in_order_with_their_common_prefixes(seed):
    rnd = random.Random(seed)
    runs, every = [], []
    for i in range(rnd.choice([1, 2, 3, 5, 8])):
        keys = sorted({bytes(rnd.choice(b"ab") for _ in range(6)) for _ in range(rnd.randint(0, 20))})
        prefix = S.common_prefixes(np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 6)).tolist()
        runs.append((prefix, [k[h:] for k, h in zip(keys, prefix)]))
        every += [(k, i, j) for j, k in enumerate(keys)]
    out = list(S.merge(runs))
    assert [(k, r, i) for r, i, _, k in out] == sorted(every)
    for (_, _, _, a), (_, _, h, b) in zip(out, out[1:]):
        assert a[:h] == b[:h] and a[h: h + 1] != b[h: h + 1] or a == b and h == 6


@pytest.mark.parametrize("n_runs", [1, 3, 400])
def test_merge_in_lanes_of_many_runs(n_runs):
    rnd = random.Random(n_runs)
    width = S.KEY
    every = [bytes(rnd.choice(b"a\xff") for _ in range(rnd.randint(0, 12))).ljust(width - 1, b"\0") + b"\1" for _ in range(300)] + [b"a" * width]
    runs = [sorted({every[-1], *rnd.choices(every, k=40)}) for _ in range(n_runs)]
    runs[n_runs // 2] = []
    packed = [np.frombuffer(b"".join(keys), np.uint8).reshape(-1, width) for keys in runs]
    prefix = [S.common_prefixes(keys) for keys in packed]
    rest = [keys[np.arange(width) >= h[:, None]] for keys, h in zip(packed, prefix)]
    order, between, keys = S.merged(np.concatenate(prefix), np.concatenate(rest), [len(keys) for keys in runs], width)
    rows = [key for keys in runs for key in keys]
    assert [x.tobytes() for x in keys] == rows
    assert order.tolist() == sorted(range(len(rows)), key=lambda i: (rows[i], i))
    assert between.tolist() == S.common_prefixes(keys[order]).tolist()


def test_ranges_hold_what_they_aim_at(monkeypatch):
    monkeypatch.setattr(S, "RANGE_RECORDS", 2000)
    raw = np.frombuffer(random.Random(7).randbytes(400_000), np.uint8)
    lengths = np.full(400, 1000)
    data = [S._packed(ids=np.arange(i, i + 400), known=np.ones(400, bool), lengths=lengths, raw=raw) for i in (0, 400)]
    share = 0.2
    out = pd.concat(S._anchor_lists(16, int(share * (1 << S.HASH_BITS)))(iter([pd.DataFrame({"block": [0, 1], "data": data})])))
    held = [sum(len(S._unpacked(d)["low"]) for d in out.loc[out["range"] == i, "data"]) for i in range(16)]
    assert max(held) < 1.3 * sum(held) / 16
    sample = [x for d in out.loc[out["range"] == -1, "data"] for x in S._unpacked(d)["anchors"].reshape(-1, S.K)]
    assert 0.8 * share < len(sample) / sum(held) < 1.2 * share
    ranges = len(S.splitters_of([(x.tobytes(), False) for x in sample], share)) + 1
    assert 0.7 * sum(held) / 2000 < ranges < 1.3 * sum(held) / 2000


def brute(rows):
    least = {}
    for i, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - 49 if i is not None else 0):
            least[raw[p: p + 50]] = min(i, least.get(raw[p: p + 50], i))
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49 if i is not None else 0):
            if least[raw[p: p + 50]] < i:
                gone[p: p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(1 for p in range(len(raw)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r)[:5] for r in S.remove_repeats(df).collect()), key=str)


def rows_with_repeats():
    rnd = random.Random(5)
    base = ["".join(rnd.choice("ab ") for _ in range(300)) for _ in range(4)]
    rows = []
    for i in range(120):
        b, c = rnd.choice(base), rnd.choice(base)
        rows.append((i, b[rnd.randint(0, 100): rnd.randint(150, 300)] + "".join(rnd.choice("abcé") for _ in range(rnd.randint(0, 60))) + c[50:200]))
    odd = [(200, "a" * 500), (201, "a" * 120), (202, "a" * 49), (203, ""), (204, None), (None, base[0]), (5, rows[5][1]), (5, rows[9][1]),
           (300, "\0" * 200), (301, "\0" * 90 + "x"), (302, LONG[:9000]), (303, "x" + LONG[:9000])]
    return rows + odd


def test_equals_brute_force(spark):
    rows = rows_with_repeats()
    assert got(documents(spark, rows).repartition(3)) == brute(rows)


def test_equals_brute_force_over_many_blocks_and_ranges(spark, monkeypatch):
    # The module travels with the job, so the workers see the small limits.
    for name, value in (("BLOCK_BYTES", 4000), ("CHUNK", 700), ("RANGE_HASHES", 300), ("RANGE_RECORDS", 100)):
        monkeypatch.setattr(S, name, value)
    rows = rows_with_repeats()
    assert got(documents(spark, rows).repartition(2)) == brute(rows)


def test_empty_table(spark):
    assert S.remove_repeats(empty(spark)).count() == 0


def test_what_it_exchanged_is_gone_before_the_last_step(spark):
    def left():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        names = [files.apply(i).getName() for i in range(files.size())]
        return {name.split("_")[1] for name in names if name.startswith("shuffle_")}

    before = left()
    S.remove_repeats(documents(spark, rows_with_repeats()))
    until = time.time() + 20  # files go in the background
    while len(left() - before) > 1 and time.time() < until:
        time.sleep(0.2)
    assert len(left() - before) <= 1  # the sum of the blocks' bytes
