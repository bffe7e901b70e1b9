"""Joins whose small side is broadcast only after its size is known."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markbook.session import written

# Well under what every executor can hold next to its own work.
BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 32


def constant_bytes(df: DataFrame) -> int | None:
    """Size of a table that the optimizer has folded to constant rows, else None.

    Only there is the estimate a size: files count as they lie compressed on disk, and
    exploded or collected rows are hardly counted at all.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    if plan.getClass().getSimpleName() not in ("LocalRelation", "OneRowRelation"):
        return None
    return int(str(plan.stats().sizeInBytes()))


def measured_bytes(df: DataFrame) -> int:
    """The width of all rows as text: one map-side-combined aggregate over the small side."""
    row = F.length(F.to_json(F.struct("*"))).cast("long")
    return df.select(F.sum(row).alias("bytes")).first()["bytes"] or 0


# Steps of a plan that make reading a table twice costly.
_STEPS = re.compile(r"^[\s:+|*-]*\w*(?:Aggregate|Join|Window|Generate|Sort|Python|InPandas|InArrow|Repartition|Union|Rebalance)\w*\b", re.M)


def is_computed(df: DataFrame) -> bool:
    """False for a table that is no more than read and filtered."""
    return bool(_STEPS.search(df._jdf.queryExecution().optimizedPlan().toString()))


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """True if the rows of ``df`` fit, by their size and not by an estimate."""
    size = constant_bytes(df)
    return (measured_bytes(df) if size is None else size) <= limit


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", limit: int = BROADCAST_BYTES) -> DataFrame:
    """``big`` joined to a dimension with one row per key.

    A dimension of proven size is broadcast, so ``big`` is not shuffled and a hot
    key costs nothing.  A larger one is joined on (key, salt): its rows are
    repeated per salt and the rows of a hot key spread over that many tasks.
    A dimension that has to be computed is written first, and measured and joined as it was written.
    """
    if constant_bytes(small) is None and is_computed(small):
        small = written(small, "dimension")
    if fits_broadcast(small, limit):
        return big.join(F.broadcast(small), on, how)
    return salted_join(big, small, on, how)


def salted_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", salts: int = SALTS) -> DataFrame:
    """Equi-join with the keys of ``big`` spread over ``salts`` tasks each.

    The salt is a hash of the whole row, so a recomputed task gives the same rows.
    """
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(salts)).cast("int"))
    if how in ("left_semi", "left_anti"):
        small = small.select(*on).distinct()
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
