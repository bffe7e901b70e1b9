"""Running totals and row caps that never put a whole group into one task.

Rows are dealt by range over (group, order), so a task gets a stretch of that order
whatever the order values are: dense, sparse, repeated or null.  Each task sorts its stretch and adds
up as the rows come; the sorted rows are written with their totals so far and the number of their range.  A range begins
inside at most one group, so what the earlier ranges add is one row per range, joined by broadcast.  Rows are exchanged once.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markbook.plans.joins import is_computed
from markbook.session import written

# Workers get these functions with the job, so they need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Up to this many rows per group it is cheaper to drop the surplus before any shuffle.
WINDOW_LIMIT = 1000
SALTS = 32


def _columns(df: DataFrame) -> list[Column]:
    """All columns, whose names may hold dots and spaces."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def _fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores in front as none of the table's own columns has."""
    front = "_"
    while any(c.lower().startswith(front) for c in df.columns):
        front += "_"
    return [front + n for n in names]


def _changes(keys: list[pa.Array], last: list | None) -> np.ndarray:
    """True where a row's key differs from that of the row before; ``last`` is the key before the first row."""
    out = np.zeros(len(keys[0]) if keys else 0, bool)
    for i, column in enumerate(keys):
        codes = pc.fill_null(pc.dictionary_encode(column).indices, -1).to_numpy(zero_copy_only=False)
        out[1:] |= codes[1:] != codes[:-1]
        out[0] |= last is None or column[0].as_py() != last[i]
    return out


def _sums(values: pa.Array, starts: np.ndarray, before):
    """Running sums that begin anew at ``starts``; rows in front of the first one go on from ``before``.  Nulls add nothing."""
    if pa.types.is_decimal(values.type):
        fresh, out, at = set(starts.tolist()), [], before
        for i, v in enumerate(values.to_pylist()):
            at = (0 if i in fresh else at) + (v or 0)
            out.append(at)
        return pa.array(out, values.type), at
    plain = pc.fill_null(values, 0).to_numpy(zero_copy_only=False)
    whole = np.cumsum(plain)
    edges = np.concatenate([[0], starts, [len(plain)]]).astype(np.int64)
    if pa.types.is_integer(values.type):
        less = np.concatenate([[-before], np.append(0, whole)[starts]])
        out = whole - np.repeat(less, np.diff(edges))
    else:  # a difference of sums would lose digits
        parts = [plain[a:b].copy() for a, b in zip(edges[:-1], edges[1:])]
        if len(parts[0]):
            parts[0][0] += before
        out = np.concatenate([np.fromiter(accumulate(p), float, len(p)) for p in parts])
    return pa.array(out, values.type), out[-1]


def _added(n_keys: int, n_values: int):
    """Sorted rows, whose first columns are the keys and the values, with running sums in place of these columns, the
    partition's number, and whether the row is the last of the partition's first or last group."""

    def run(batches: Iterator[pa.RecordBatch]):
        part = TaskContext.get().partitionId()
        last, sums, in_first, held = None, [0] * n_values, True, None

        def rows(columns, names, edge):
            return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(edge), part, np.int32)), pa.array(edge)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(i) for i in range(n_keys)]
            change = _changes(keys, last) if keys else np.arange(batch.num_rows) < (last is None)
            starts = np.flatnonzero(change)
            edge = np.zeros(batch.num_rows, bool)
            # The first change of all is the beginning of the first group.
            ends = starts[1:] if last is None else starts
            if in_first and len(ends):
                if ends[0]:
                    edge[ends[0] - 1] = True
                else:
                    held[2][-1] = True
                in_first = False
            columns = []
            for i in range(n_values):
                out, sums[i] = _sums(batch.column(n_keys + i), starts, sums[i])
                columns.append(out)
            if held:
                yield rows(*held)
            names = [f"c{i}" for i in range(batch.num_columns - n_keys + 2)]
            held = ([*columns, *[batch.column(i) for i in range(n_keys + n_values, batch.num_columns)]], names, edge)
            last = [k[-1].as_py() for k in keys]
        if held:
            held[2][-1] = True
            yield rows(*held)

    return run


def running_totals(
    df: DataFrame, keys: list[str], order: str | list[Column], values: dict[str, Column], parts: int | None = None
) -> DataFrame:
    """``df`` plus one running sum per entry of ``values`` within each group, rows in the given order.

    Without ``keys`` the whole table is one group.  ``parts`` is the number of ranges,
    by default that of a shuffle.  Equal order values are told apart by a hash of the row.
    """
    order = [F.col(order)] if isinstance(order, str) else list(order)
    tie, range_, edge, start = _fresh(df, "tie", "range", "edge", "start")
    columns, group = _columns(df), [F.col(f"`{k}`") for k in keys]
    key_names, order_names, value_names = ([f"{tie}_{kind}{i}" for i in range(n)] for kind, n in (("k", len(keys)), ("o", len(order)), ("v", len(values))))
    rows = df.select(
        *[c.alias(n) for c, n in zip(group, key_names)], *[v.alias(n) for v, n in zip(values.values(), value_names)], *columns,
        F.xxhash64(*columns).alias(tie))
    for field in rows.select(*value_names).schema:
        if isinstance(field.dataType, T.IntegralType):
            rows = rows.withColumn(field.name, F.col(field.name).cast("long"))
        elif isinstance(field.dataType, T.DecimalType):
            rows = rows.withColumn(field.name, F.col(field.name).cast("decimal(38,%d)" % field.dataType.scale))
    # Dealing by range looks at its input twice; what is costly to compute is written first.
    if is_computed(df):
        rows = written(rows, "running")
    by = [*key_names, *order, tie]
    ranged = (rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)).sortWithinPartitions(*by).drop(tie)
    fields = [*[T.StructField(n, rows.schema[v].dataType) for n, v in zip(values, value_names)], *df.schema.fields,
              T.StructField(range_, T.IntegerType()), T.StructField(edge, T.BooleanType())]
    plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)])
    names = [f.name for f in fields]
    ranged = ranged.toDF(*[f"c{i}" for i in range(len(ranged.columns))])
    added = ranged.mapInArrow(_added(len(keys), len(values)), plain).toDF(*[f"{tie}_{i}" for i in range(len(fields))])
    added = written(added, "ranges")
    inner = {n: F.col(f"{tie}_{i}") for i, n in enumerate(names)}
    at = {n: F.col(f"{tie}_{i}") for i, n in enumerate(names[: len(values)])}
    own = [F.col(f"{tie}_{len(values) + i}") for i in range(len(df.columns))]
    whose = F.struct(*[own[df.columns.index(k)].alias(f"k{i}") for i, k in enumerate(keys)]) if keys else F.struct(F.lit(0))
    # At most two rows per range: the totals of its first and its last group.
    totals = added.where(inner[edge]).select(inner[range_].alias(range_), whose.alias(start), *[c.alias(f"{start}_{i}") for i, c in enumerate(at.values())])
    before = Window.partitionBy(start).orderBy(range_).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(range_, start, *[F.sum(f"{start}_{i}").over(before).alias(f"{start}_{i}") for i in range(len(values))])
    starts = starts.where(F.col(f"{start}_0").isNotNull())
    joined = added.join(F.broadcast(starts), (inner[range_] == F.col(range_)) & whose.eqNullSafe(F.col(start)), "left")
    return joined.select(
        *[c.alias(n) for c, n in zip(own, df.columns)],
        *[(c + F.coalesce(F.col(f"{start}_{i}"), F.lit(0))).alias(n) for i, (n, c) in enumerate(at.items())])


def first_rows(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The first ``n`` rows of every group by ``order``, with their rank as ``rank``.

    A small ``n`` is cut twice, first within each of SALTS parts of a group, so that the
    last sort of a group sees at most SALTS * n rows however many tasks hold some.
    """
    if n > WINDOW_LIMIT:
        ranked = running_totals(df, keys, order, {"rank": F.lit(1)})
        return ranked.where(F.col("rank") <= n).withColumn("rank", F.col("rank").cast("int"))
    tie, salt = _fresh(df, "tie", "salt")
    salted = df.withColumn(tie, F.xxhash64(*_columns(df))).withColumn(salt, F.pmod(tie, F.lit(SALTS)))
    part = Window.partitionBy(*keys, salt).orderBy(order, tie)
    few = salted.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= n)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order, tie))).where(F.col("rank") <= n).drop(tie, salt)
