"""Near duplicates on five-word shingles: MinHash bands, odd sketches, and a check on full sets.

One pass over the texts makes, per document, the size and digest of its shingle set, its band keys and its odd sketch: each
MinHash sample flips one bit of a bitmap, so the exclusive or of two bitmaps counts the samples that differ.  A second bitmap
takes all shingles: its exclusive or never counts more than the shingles that differ, so it rules pairs out for certain.
Equal sets are one class from then on.  Every member of a band bucket is a candidate with the bucket's first member; the sketches drop the
unlike, whole texts decide.  Buckets whose members then still lie in several components are searched again, block by
block, for pairs across components; pairs within one component are never made, however large the group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markbook.llm.common import discard, lookup_join, query, stored, table, tidy, travels
from markbook.llm.graph import components

travels(__name__)

WORDS = 5
PERCENT = 75  # least similarity
BANDS, ROWS = 40, 5  # a pair at the least similarity meets in a band with probability 1 - 2e-5
SAMPLES = BANDS * ROWS
SKETCH_BITS = 1024
PARITY_BITS = 2048
SKETCH_LEAST = 0.62  # estimate below which a candidate is dropped: four standard errors under 0.75, a chance of 3e-5
BLOCK = 1024  # members of a bucket in one block
SALT_ROWS = 128  # pairs of one centre in one group
FIRST_BEST = 8  # pairs tried for two components of a block in the first search; eight times as many in each further one

_RNG = np.random.default_rng(20240501)
_MULTIPLY = (_RNG.integers(0, 2**32, SAMPLES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _RNG.integers(0, 2**32, SAMPLES, dtype=np.uint64).astype(np.uint32)
_WORD_STEPS = _RNG.integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_STEPS = _RNG.integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BIT_STEPS = _RNG.integers(0, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
CACHE_WORDS = 300_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingler():
    """text -> its distinct shingles as sorted 64-bit hashes; words are split at ASCII white space, A-Z in lower case."""
    known: dict[bytes, int] = {}

    def shingles(text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        h = np.fromiter((known[w] for w in words), np.uint64, len(words))
        size = min(WORDS, len(words))
        n = len(words) - size + 1
        s = np.full(n, size, np.uint64)
        for i in range(size):
            s += _mix(h[i: i + n] * _WORD_STEPS[i])
        return np.unique(_mix(s))

    return shingles


def minhash(shingles: np.ndarray) -> np.ndarray:
    """SAMPLES least values (uint32) of the shingles under as many multiply-add permutations."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.empty(SAMPLES, np.uint32)
    for at in range(0, SAMPLES, 25):
        out[at: at + 25] = (x[None, :] * _MULTIPLY[at: at + 25, None] + _ADD[at: at + 25, None]).min(axis=1)
    return out


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """A bitmap (uint64 words) in which every sample has flipped one bit."""
    bits = _mix(samples.astype(np.uint64) * _BIT_STEPS) % np.uint64(SKETCH_BITS)
    flips = np.bincount(bits.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.uint64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity estimated from the exclusive or of sketches (last axis: words of a sketch)."""
    z = np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)
    return 1 + SKETCH_BITS / (4 * SAMPLES) * np.log(np.maximum(1 - 2 * z / SKETCH_BITS, 1e-9))


def parity(shingles: np.ndarray) -> np.ndarray:
    """A bitmap (uint64 words) in which every shingle of the set has flipped one bit."""
    flips = np.bincount((shingles & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.uint64)


def possible(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """False where the bitmaps of all shingles show more differences than the least similarity allows; ``sizes`` is that of both sets."""
    differ = np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)
    return (100 + PERCENT) * differ <= (100 - PERCENT) * sizes


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = samples.reshape(BANDS, ROWS).astype(np.uint64)
    key = _mix((rows + np.uint64(1)) * _BAND_STEPS).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return _mix(key).view(np.int64)


def profiles(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands, sketch, parity); documents without words have null for the last four."""

    def run(batches: Iterator[pd.DataFrame]):
        tidy()
        shingles = shingler()
        for rows in batches:
            out = []
            for doc_id, text in zip(rows["doc_id"].astype("Int64"), rows["text"]):
                s = shingles(text)
                if len(s):
                    m = minhash(s)
                    out.append((doc_id, len(s), hashlib.sha256(s.tobytes()).digest()[:16], band_keys(m), odd_sketch(m).tobytes(), parity(s).tobytes()))
                else:
                    out.append((doc_id, 0, None, None, None, None))
            yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "set_key", "bands", "sketch", "parity"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch binary, parity binary")


def _words(values: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint64).reshape(len(values), -1)


def _with_sketch(pairs: DataFrame, reps: DataFrame, side: str, total: int) -> DataFrame:
    asked = pairs.groupBy(side).agg(F.count("*").alias("asked"))
    small = asked.join(reps.select(F.col("doc_id").alias(side), F.col("sketch").alias(f"sketch_{side}"), F.col("parity").alias(f"parity_{side}"), F.col("n_shingles").alias(f"size_{side}")), side)
    return lookup_join(pairs, small, side, "asked", total, F.concat_ws("-", "a", "b"))


def _alike(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs whose sizes and bitmaps do not rule them out."""
    total = pairs.count()

    @F.pandas_udf("boolean")
    def like(x: pd.Series, y: pd.Series, p: pd.Series, q: pd.Series, sizes: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=bool)
        return pd.Series((estimate(_words(x), _words(y)) >= SKETCH_LEAST) & possible(_words(p), _words(q), sizes.to_numpy()))

    both = _with_sketch(_with_sketch(pairs, reps, "a", total), reps, "b", total)
    both = both.where(100 * F.least("size_a", "size_b") >= PERCENT * F.greatest("size_a", "size_b"))
    return both.where(like("sketch_a", "sketch_b", "parity_a", "parity_b", F.col("size_a") + F.col("size_b"))).select("a", "b")


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are similar enough.  A document asked for often has its text repeated per
    SALT_ROWS pairs, so no task holds all pairs of a centre."""
    asked = stored(pairs.groupBy("b").agg(F.count("*").alias("asked")), "asked")
    salts = F.ceil(F.col("asked") / SALT_ROWS).cast("int")
    total = pairs.count()
    salted = lookup_join(pairs, asked.withColumn("salts", salts), "b", "asked", total, F.concat_ws("-", "a", "b"))
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int"))
    texts = docs.select("doc_id", "text")
    left = salted.select("a", "b", "salt").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")).join(asked.select("b", salts.alias("salts")), "b")
    right = right.select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "text_b")
    both = left.join(right, ["b", "salt"])

    def check(batches: Iterator[pd.DataFrame]):
        tidy()
        shingles = shingler()
        last, held = None, None
        for rows in batches:
            keep = []
            for a, b, x, y in zip(rows["a"], rows["b"], rows["text_a"], rows["text_b"]):
                if y != last:
                    last, held = y, shingles(y)
                s = shingles(x)
                same = len(np.intersect1d(s, held, assume_unique=True))
                if 100 * same >= percent * (len(s) + len(held) - same):
                    keep.append((a, b))
            yield pd.DataFrame(keep, columns=["a", "b"]).astype("int64")

    return both.select("a", "b", "text_a", "text_b").mapInPandas(check, "a long, b long")


def _across(mixed: DataFrame, best: int) -> DataFrame:
    """(a, b, more) from the rows (band, doc_id, component, main, members, n_shingles, sketch, parity) of buckets with several components.

    A bucket is cut into blocks of about BLOCK members; the members outside its main component meet every block.  For two
    components of a unit the ``best`` likeliest pairs come out, ``more`` tells that others were left."""
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    rows = mixed.withColumn("block", F.pmod(F.xxhash64("doc_id"), blocks).cast("int")).withColumn("other", F.sequence(F.lit(0), blocks - 1))
    held = rows.select("band", "block", F.explode("other").alias("other"), F.lit(0).alias("role"), "doc_id", "component", "n_shingles", "sketch", "parity")
    minor = rows.where("component <> main").select("band", F.explode("other").alias("block"), F.col("block").alias("other"), F.lit(1).alias("role"), "doc_id", "component", "n_shingles", "sketch", "parity")

    def search(batches: Iterator[pd.DataFrame]):
        tidy()
        rest = None
        for rows in batches:
            rows = rows if rest is None else pd.concat([rest, rows], ignore_index=True)
            unit = rows[["band", "block", "other"]].to_numpy()
            edges = np.r_[0, np.flatnonzero((unit[1:] != unit[:-1]).any(axis=1)) + 1]
            rest = rows.iloc[edges[-1]:]  # the last unit may go on in the next batch
            yield _likely(rows.iloc[: edges[-1]], edges, best)
        if rest is not None:
            yield _likely(rest, np.r_[0, len(rest)], best)

    units = held.union(minor).repartition("band", "block", "other").sortWithinPartitions("band", "block", "other", "role", "doc_id")
    return units.mapInPandas(search, "a long, b long, more boolean")


def _likely(rows: pd.DataFrame, edges: np.ndarray, best: int) -> pd.DataFrame:
    """The likeliest pairs (a, b) across components in each unit, members before minors; ``edges`` are where units begin."""
    none = pd.DataFrame({"a": [], "b": [], "more": []}).astype({"a": "int64", "b": "int64", "more": bool})
    if not len(rows):
        return none
    sketch, every = _words(rows["sketch"]), _words(rows["parity"])
    role, component, ids, size = (rows[c].to_numpy(np.int64) for c in ("role", "component", "doc_id", "n_shingles"))
    found = []
    for begin, end in zip(edges[:-1], edges[1:]):
        cut = begin + int(np.searchsorted(role[begin:end], 1))
        for i in range(cut, end):
            y = np.flatnonzero(component[begin:cut] != component[i]) + begin
            y = y[100 * np.minimum(size[y], size[i]) >= PERCENT * np.maximum(size[y], size[i])]
            y = y[possible(every[i], every[y], size[i] + size[y])]
            if len(y):
                e = estimate(sketch[i], sketch[y])
                hit = e >= SKETCH_LEAST
                if hit.any():
                    y = y[hit]
                    found.append((np.full(len(y), begin), np.full(len(y), i), y, (e[hit] * 1e6).astype(np.int64)))
    if not found:
        return none
    unit, x, y, e = (np.concatenate(c) for c in zip(*found))
    p, q = component[x], component[y]
    out = pd.DataFrame({"u": unit, "a": np.maximum(ids[x], ids[y]), "b": np.minimum(ids[x], ids[y]), "p": np.minimum(p, q), "q": np.maximum(p, q), "e": e})
    out = out.drop_duplicates(["u", "a", "b"]).sort_values(["e", "a", "b"], ascending=[False, True, True])
    out["n"] = out.groupby(["u", "p", "q"]).cumcount()
    out["more"] = out["n"] == best - 1
    return out.loc[out["n"] < best, ["a", "b", "more"]].drop_duplicates()


def link(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profiles, classes, components of the classes' representatives).

    classes: set_key, copies, rep.  Rows with a null id or without words take no part."""
    known = stored(profiles(docs), "profiles")
    part = known.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    first = F.min(F.struct("doc_id", "bands", "sketch", "parity", "n_shingles"))
    reps = stored(part.groupBy("set_key").agg(F.count("*").alias("copies"), first.alias("first")).select("set_key", "copies", "first.*"), "classes")
    band_rows = reps.select(F.explode("bands").alias("band"), "doc_id")
    total = reps.count() * BANDS
    buckets = stored(band_rows.groupBy("band").agg(F.count("*").alias("members"), F.min("doc_id").alias("centre")).where("members > 1"), "buckets")
    placed = lookup_join(band_rows, buckets.withColumn("size", F.col("members")), "band", "members", total, F.col("doc_id").cast("string"))
    placed = stored(placed.where("centre IS NOT NULL"), "bucket-rows")
    texts = docs.where("doc_id IS NOT NULL")

    star = stored(placed.where("doc_id <> centre").select(F.col("doc_id").alias("a"), F.col("centre").alias("b")).distinct(), "pairs")
    tried = stored(_alike(star, reps), "pairs")
    links = stored(confirmed(tried, texts), "links")
    discard(star)
    best = FIRST_BEST
    while True:
        parts = components(links)
        members = placed.select("band", "doc_id", "size").join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        members = stored(members.withColumn("component", F.coalesce("component", "doc_id")), "bucket-components")
        # All members of a bucket were tried with its first one, so two members leave nothing to try.
        several = members.groupBy("band").agg(F.min("component").alias("main"), F.max("component").alias("last"), F.count("*").alias("rows")).where("main <> last AND rows > 2").drop("last")
        several = stored(several, "mixed-buckets")
        mixed = lookup_join(members, several, "band", "rows", members.count(), F.col("doc_id").cast("string")).where("main IS NOT NULL")
        mixed = mixed.withColumnRenamed("size", "members").join(reps.select("doc_id", "n_shingles", "sketch", "parity"), "doc_id")
        across = stored(_across(mixed, best), "across")
        new = stored(across.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        more = across.where("more").limit(1).count()
        if new.limit(1).count():
            links = stored(links.union(confirmed(new, texts)), "links")
            tried = tried.union(new)
        elif not more:
            discard(members, several, across)
            return known, reps.select("set_key", "copies", F.col("doc_id").alias("rep")), parts
        discard(members, several, across)
        best *= 8


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``.

    A document without words, or with a null id, is linked with nothing and kept; repeated rows of one id share its answer."""
    known, classes, parts = link(docs)
    named = stored(classes.join(parts, F.col("rep") == F.col("node"), "left").select("set_key", "copies", F.coalesce("component", "rep").alias("component")), "named")
    rows = known.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key"))
    found = lookup_join(rows, named, "set_key", "copies", known.count(), F.col("doc_id").cast("string"))
    component = F.coalesce("component", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


OP8_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
shingles AS (SELECT doc_id, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b WHERE 100 * n >= 75 * (len(p.s) + len(q.s) - n)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS c FROM sets UNION SELECT ways.b, reach.c FROM reach JOIN ways ON ways.a = reach.doc_id)
SELECT sets.doc_id, CAST(any_value(len(s)) AS BIGINT) AS n_shingles, min(c) AS component_id, sets.doc_id = min(c) AS kept
FROM sets JOIN reach ON sets.doc_id = reach.doc_id GROUP BY sets.doc_id
"""


@query("op8_near_duplicates", OP8_SQL)
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all ``documents``."""
    return groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
