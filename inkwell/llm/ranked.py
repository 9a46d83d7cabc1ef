"""Exact positions in a global sort: the first N of every group (problem 7) and percentiles of groups (problem 6).

Both sort the whole table once into range partitions by (group, score, identifier), number rows inside each partition while
streaming over it, and turn counts per (group, partition) into offsets by a prefix sum. A group of any size is spread over
as many partitions as its rows need. The pass that percentiles share with the core is ``operators.global_sort``."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.operators.global_sort import quantiles, runs, sorted_ranges


def _numbered(group: list[str], keep: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Streams over one sorted partition: adds ``__part`` and ``__local`` (rows of the row's group before it in this partition); rows
    whose local place can't be among the first ``keep`` are dropped on the spot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last: tuple | None = None
        before = 0
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(b.schema.get_field_index(g)) for g in group]
            starts = runs(cols)
            lens = np.diff(np.append(starts, b.num_rows))
            local = np.arange(b.num_rows) - np.repeat(starts, lens)
            head = tuple(c[0].as_py() for c in cols)
            if head == last:
                local[: lens[0]] += before
            last = tuple(c[-1].as_py() for c in cols)
            before = int(local[-1]) + 1
            out = pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(local)], names=[*b.schema.names, "__part", "__local"])
            yield out.filter(pa.array(local < keep))

    return run


def numbered_sort(df: DataFrame, group: list[str], order: list[Column], keep: int) -> DataFrame:
    """``df`` sorted globally by group and order in range partitions, with ``__part`` and ``__local``, up to ``keep`` rows of each."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return sorted_ranges(df, group, order).mapInArrow(_numbered(group, keep), f"{schema}, __part int, __local bigint")


def first_of_groups(df: DataFrame, group: list[str], order: list[Column], n: int, place: str = "place") -> DataFrame:
    """The first ``n`` rows of every group by ``order`` (which has to end in a unique identifier) with their place (int,
    from 1). Groups of fewer rows give fewer; null keys are groups of their own; n below 1 or an empty table give no row; a
    column named like ``place`` is replaced.

    A row whose number within its group and partition exceeds n can't be among the first n of the group, so partitions hand
    on at most n rows per group; that number plus the rows of the group in earlier partitions is the exact place. Earlier
    partitions that hold any of the group hold rows that come first, so their rows handed on suffice as counts up to n."""
    kept = numbered_sort(df.drop(place), group, order, keep=max(0, n))
    w = Window.partitionBy(*group).orderBy("__part").rangeBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.count(F.lit(1)).over(w), F.lit(0))
    return kept.withColumn(place, (offset + F.col("__local") + 1).cast("int")).where(F.col(place) <= n).drop("__part", "__local")


def value_counts(long: DataFrame, group: list[str], value: str = "value", count: str = "cnt") -> DataFrame:
    """The mergeable state of percentiles: rows per (group, value). Null, NaN and infinite values are missing. With a column
    ``count`` in the input, its sums: states of separate days or files are combined by their union."""
    v = F.col(value)
    rows = F.sum(count) if count in long.columns else F.count(F.lit(1))
    return long.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))).groupBy(*group, value).agg(rows.cast("bigint").alias(count))


def percentiles(state: DataFrame, group: list[str], at: Iterable[float], value: str = "value", count: str = "cnt", ties: str | None = None) -> DataFrame:
    """Exact percentiles (linear between neighbouring order statistics) per group of a state of ``value_counts``: group,
    n (rows), and one double per entry of ``at``: p50 for 0.5, p99_9 for 0.999. The error is 0 but for the rounding of the
    interpolation, however the rows were split into states. Groups without a value give no row; one value is every
    percentile of its group; null, NaN and infinite values are missing.

    Without the column ``count`` the rows are single values. They are counted by value first, or, where ``ties`` names a column that
    differs among equal values, sorted as they are. The sort's counts per partition give offsets for the groups at the
    partitions' ends; the groups within a partition have their targets located and interpolated while streaming over it."""
    at = [float(p) for p in at]
    if any(not 0 <= p <= 1 for p in at):
        raise ValueError("percentiles lie between 0 and 1")
    finite = state.where(F.abs(F.col(value).cast("double")) < float("inf"))
    found = quantiles(finite, group, value, at, total="n", out="__at", weight=count if count in state.columns else None, ties=ties)
    return found.select(*group, "n", *[F.col("__at")[i].alias("p" + f"{p * 100:g}".replace(".", "_")) for i, p in enumerate(at)])
