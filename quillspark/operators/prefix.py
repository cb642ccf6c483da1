"""Running sums and places over any number of rows, without one window that holds them all.

Rows are dealt by ranges of their order, sorted in each range and summed within it; the totals of the ranges
before are then added. Only a key that goes on from the range before needs that, so what is added is at most
one row for each range, and is broadcast.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Up to so many rows in all, plain windows are used.
WINDOW_ROWS = 1 << 20


def checkpoint_folder(spark: SparkSession) -> None:
    """See that checkpoints have a folder: what ``spark.checkpoint.dir`` names, or, for a local session without it, a temporary one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(root or tempfile.mkdtemp(prefix="quillspark-"))


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the checkpoint folder, with its number of rows as ``known_rows``."""
    if hasattr(df, "known_rows"):
        return df
    checkpoint_folder(df.sparkSession)
    done = df.checkpoint()
    done.known_rows = done.count()
    return done


def same(left: DataFrame, keys: Sequence[str], prefix: str = "__k_") -> Column:
    """Equality of keys with those of a table whose columns carry ``prefix``, null being equal to null."""
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(F.col(f"{prefix}{k}"))
    return on


def matched(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on ``keys``, null being equal to null; the keys come once. Without keys, ``right`` is one row."""
    right = right.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    return left.join(right if keys else F.broadcast(right), same(left, keys), how).drop(*(f"__k_{k}" for k in keys))


def _changes(table: pa.Table, by: Sequence[str]) -> np.ndarray:
    """For each row but the first, whether a key differs from the row before."""
    out = np.zeros(max(table.num_rows - 1, 0), bool)
    for c in by:
        a, b = table.column(c).slice(0, table.num_rows - 1), table.column(c).slice(1)
        apart = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        out |= apart.to_numpy()
    return out


def _within_ranges(dealt: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """cum_<column> within each range, and range: its number."""
    names = dealt.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields), *(f"`cum_{c}` bigint" for c in columns), "range int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        before, carried = None, np.zeros(len(columns), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b] if before is None else [before, b])
            starts = np.flatnonzero(_changes(t, by)) + (before is None)
            sums = []
            for k, c in enumerate(columns):
                run_ = np.cumsum(b.column(c).to_numpy(zero_copy_only=False).astype(np.int64)) + carried[k]
                base = np.zeros(b.num_rows, np.int64)
                if len(starts):
                    ends = run_[np.maximum(starts - 1, 0)]
                    ends[starts == 0] = carried[k]
                    base[starts] = np.diff(ends, prepend=0)
                sums.append(run_ - np.cumsum(base))
                carried[k] = sums[-1][-1]
            before = b.slice(b.num_rows - 1)
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, sums), pa.array(np.full(b.num_rows, part, np.int32))], names=[*names, *(f"cum_{c}" for c in columns), "range"])

    return dealt.mapInArrow(run, schema)


def prefix_sums(df: DataFrame, columns: Sequence[str], by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with cum_<column>: sums of whole-number columns over the rows up to this one in ``order``, within ``by``.

    Rows equal in ``order`` follow each other in any order. Few rows are summed in windows, more in ranges.
    """
    given = settled(df)
    if given.known_rows <= WINDOW_ROWS:
        upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return given.withColumns({f"cum_{c}": F.sum(F.col(c).cast("bigint")).over(upto) for c in columns})
    names = [*by, *order]
    local = settled(_within_ranges(given.repartitionByRange(*names).sortWithinPartitions(*names), columns, by))
    totals = local.groupBy("range", *by).agg(*(F.sum(c).cast("bigint").alias(f"__t_{c}") for c in columns))
    below = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("range", *by, *(F.sum(f"__t_{c}").over(below).alias(f"__b_{c}") for c in columns)).filter(f"`__b_{columns[0]}` is not null")
    keys = ["range", *by]
    carried = carried.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    joined = local.join(F.broadcast(carried), same(local, keys), "left")
    return joined.select(*given.columns, *((F.col(f"cum_{c}") + F.coalesce(F.col(f"__b_{c}"), F.lit(0))).alias(f"cum_{c}") for c in columns))
