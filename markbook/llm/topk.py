"""Exact top-k search by columnar branch and bound.

Vectors are stored dimension by dimension (one row of a matrix per dimension).  Partial scores grow by blocks of
dimensions; after each block a candidate survives only if its score plus the most its remaining dimensions can add
(Cauchy-Schwarz on the remaining norms) reaches the k-th best score that is already certain.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from markbook.llm.common import query, table, travels

travels(__name__)

SLAB_ROWS = 8192  # candidates in one block
LANE_ROWS = 512  # queries in one block
DIMS = 16  # dimensions added between two compactions
EXACT = float(2**53)


def quantised(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, v, dims): floor(scale * x) per component.

    Null ids, null vectors and vectors with a null, NaN or infinite component take no part; an empty vector scores 0."""
    x = F.col("embedding")
    fine = F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))), F.lit(False)))
    v = F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("double"))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & fine).select(
        "vec_id", v.alias("v"), F.size(x).alias("dims"))


def _packed(kind: str):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", kind="stable")
        matrix = np.ascontiguousarray(np.array(rows["v"].tolist(), dtype=np.float64).reshape(len(rows), -1).T)
        ids = rows["vec_id"].to_numpy(np.int64)
        return pd.DataFrame({"dims": [int(rows["dims"].iloc[0])], kind: [int(rows[kind].iloc[0])],
                             f"{kind}_ids": [ids.tobytes()], f"{kind}_v": [matrix.tobytes()]})

    return pack


def _remaining(matrix: np.ndarray, cuts: list[int]) -> list[np.ndarray]:
    return [np.sqrt((matrix[c:] ** 2).sum(axis=0)) for c in cuts]


def search_block(qids, q, cids, c, k: int):
    """(query id, candidate id, score) of the k best of one block of candidates for every query; q, c are dims x rows."""
    dims = q.shape[0]
    if dims and np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * dims >= EXACT:
        yield from _search_wide(qids, q, cids, c, k)
        return
    cuts = list(range(DIMS, dims, DIMS)) + [dims]
    left_q, left_c = _remaining(q, cuts), _remaining(c, cuts)
    first = q[: cuts[0]].T @ c[: cuts[0]]
    for j, qid in enumerate(qids):
        alive = np.flatnonzero(cids != qid)
        score = first[j, alive]
        for b, cut in enumerate(cuts):
            if b:
                score = score + q[cuts[b - 1]: cut, j] @ c[cuts[b - 1]: cut][:, alive]
            if len(alive) > k and cut < dims:
                mass = left_q[b][j] * left_c[b][alive] * (1 + 1e-9) + 1e-6
                sure = np.partition(score - mass, len(alive) - k)[len(alive) - k]
                stay = score + mass >= sure
                alive, score = alive[stay], score[stay]
        best = np.lexsort((cids[alive], -score))[:k]
        for i in best:
            yield qid, cids[alive[i]], int(score[i])


def _search_wide(qids, q, cids, c, k):
    """Components too large for exact doubles: plain integers; a score beyond a long is held at its end."""
    low, high = -(2**63), 2**63 - 1
    columns = [[int(x) for x in c[:, i]] for i in range(c.shape[1])]
    for j, qid in enumerate(qids):
        mine = [int(x) for x in q[:, j]]
        scored = sorted((-sum(a * b for a, b in zip(mine, col)), cid) for col, cid in zip(columns, cids) if cid != qid)
        for s, cid in scored[:k]:
            yield qid, cid, min(max(-s, low), high)


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query, ties to the smaller vec_id.

    Both inputs have (vec_id, v, dims) of ``quantised``.  A query meets every candidate of its length but those with its
    own id; a candidate row that is repeated counts as often as it stands there.  Both sides are cut into blocks by a
    hash of the row, and each pair of blocks is one unit of work, so no key, vector or query can load one task."""
    n_slabs = max(1, -(-candidates.count() // SLAB_ROWS))
    n_lanes = max(1, -(-queries.count() // LANE_ROWS))
    blob = lambda kind: f"dims int, {kind} int, {kind}_ids binary, {kind}_v binary"
    place = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    slabs = candidates.withColumn("slab", place(n_slabs)).groupBy("dims", "slab").applyInPandas(_packed("slab"), blob("slab"))
    lanes = queries.withColumn("lane", place(n_lanes)).groupBy("dims", "lane").applyInPandas(_packed("lane"), blob("lane"))
    slabs = slabs.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(n_lanes - 1))))
    lanes = lanes.withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(n_slabs - 1))))

    def score(batches):
        for rows in batches:
            for r in rows.itertuples():
                qids, cids = np.frombuffer(r.lane_ids, np.int64), np.frombuffer(r.slab_ids, np.int64)
                q = np.frombuffer(r.lane_v, np.float64).reshape(r.dims, len(qids))
                c = np.frombuffer(r.slab_v, np.float64).reshape(r.dims, len(cids))
                found = list(search_block(qids, q, cids, c, k))
                yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    units = lanes.hint("shuffle_hash").join(slabs, ["dims", "slab", "lane"])
    found = units.mapInPandas(score, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


@query("op6_topk", OP6_SQL)
def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose vec_id is divisible by 50 against all rows of ``embeddings``."""
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    queries = vectors.where(F.col("vec_id") % 50 == 0).dropDuplicates(["vec_id"])
    return top_k(vectors, queries, k=5)
