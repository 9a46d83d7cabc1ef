"""Positions and quantiles within groups of any size, from one global sort.

The table is sorted once into range partitions by (group, order), so that a group takes as many partitions as its rows need. A
stream over each sorted partition numbers the rows of a group within the partition; what a partition has to know of those before
it is one number for the group that it begins with, and those numbers follow from one row per partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.runtime import materialise

#: Rows of one group that wait for the rest of their group; a longer run is passed on and placed by offsets.
HELD_ROWS = 200_000


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def runs(cols: list[pa.Array]) -> np.ndarray:
    """Starts of the runs of equal rows over the columns; nulls are equal."""
    n = len(cols[0])
    change = np.zeros(n, dtype=bool)
    change[:1] = True
    for c in cols:
        if n > 1:
            differs = pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, n - 1)), False).to_numpy(zero_copy_only=False)
            nulls = pc.is_null(c).to_numpy(zero_copy_only=False)
            change[1:] |= differs | (nulls[1:] != nulls[:-1])
    return np.flatnonzero(change)


def sorted_ranges(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """``df`` in range partitions by group and order, each sorted."""
    by = [*[F.col(f"`{g}`").asc_nulls_first() for g in group], *order]
    return df.repartitionByRange(partitions(df), *by).sortWithinPartitions(*by)


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _numberer(group: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds ``__local`` (rows of the row's group before it in this partition), ``__head`` (its group is the partition's first) and
    ``__part``. Two more rows tell of the partition, by ``__of``: its first row (head), and its last with the rows of its group so far
    (tail)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last: tuple | None = None
        before, head = 0, True
        tail: pa.RecordBatch | None = None

        def told(b: pa.RecordBatch, local: np.ndarray, heads: np.ndarray, of: str | None) -> pa.RecordBatch:
            n = b.num_rows
            more = [pa.array(local.astype(np.int64)), pa.array(heads), pa.array(np.full(n, part, np.int32)), pa.array([of] * n, pa.string())]
            return pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "__local", "__head", "__part", "__of"])

        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(b.schema.get_field_index(g)) for g in group]
            starts = runs(cols)
            lens = np.diff(np.append(starts, b.num_rows))
            local = np.arange(b.num_rows) - np.repeat(starts, lens)
            goes_on = tuple(c[0].as_py() for c in cols) == last
            if goes_on:
                local[: lens[0]] += before
            heads = np.zeros(b.num_rows, bool)
            if last is None:
                yield told(b.slice(0, 1), local[:1], np.ones(1, bool), "head")
            if head and (last is None or goes_on):
                heads[: lens[0]] = True
            head = head and len(starts) == 1 and (last is None or goes_on)
            last, before = tuple(c[-1].as_py() for c in cols), int(local[-1]) + 1
            tail = b.slice(b.num_rows - 1)
            yield told(b, local, heads, None)
        if tail is not None:
            yield told(tail, np.array([before]), np.zeros(1, bool), "tail")

    return run


def numbered(df: DataFrame, group: list[str], order: list[Column], out: str) -> DataFrame:
    """``df`` with the place (bigint, from 1) of each row in its group by ``order``, which should end in a unique column. Null keys are
    a group; a column named ``out`` is replaced; an empty table gives no row. A group of any size is spread over tasks."""
    df = df.drop(out)
    table = materialise(sorted_ranges(df, group, order).mapInArrow(_numberer(group), f"{_schema(df)}, __local bigint, __head boolean, __part int, __of string"))
    # two rows per partition: the rows of a group before a partition are the tails before its head
    ends = table.where("__of is not null").select(*[F.col(f"`{g}`") for g in group], "__part", F.when(F.col("__of") == "tail", F.col("__local")).otherwise(F.lit(0)).alias("__n"), (F.col("__of") == "tail").alias("__tail"))
    before = Window.partitionBy(*[F.col(f"`{g}`") for g in group]).orderBy("__part", "__tail").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).where("not __tail").select(F.col("__part").alias("__p"), "__before")
    rows = table.where("__of is null").join(F.broadcast(offsets), F.col("__part") == F.col("__p"), "left")  # one row per partition
    place = F.col("__local") + 1 + F.when(F.col("__head"), F.col("__before")).otherwise(F.lit(0))
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], place.alias(out))


def _spots(n: np.ndarray | Column, at: Sequence[float], nearest: bool) -> list:
    """Places (from 0, perhaps between two) of the quantiles among n values."""
    if isinstance(n, Column):
        return [F.greatest(F.lit(0), F.ceil(F.lit(float(p)) * n) - 1) if nearest else F.lit(float(p)) * (n - 1) for p in at]
    return [np.maximum(0, np.ceil(p * n) - 1) if nearest else p * (n - 1) for p in at]


def _placer(group: list[str], at: Sequence[float], nearest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Streams over rows (group, __v, __c) sorted by group and value: a row with ``__q`` per group that lies wholly within the
    partition, and the rows of the groups at its ends, and of very long ones, with ``__part`` and ``__local``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: pa.RecordBatch | None = None
        going = True  # rows of the group at hand have been passed on, or may lie in the partition before
        passed = 0  # values of that group passed on so far
        last: tuple | None = None  # that group
        k = len(group)

        def table(keys: list[pa.Array], n: int, **given: pa.Array) -> pa.RecordBatch:
            kinds = {"__n": pa.int64(), "__q": pa.list_(pa.float64()), "__v": pa.float64(), "__c": pa.int64(), "__part": pa.int32(), "__local": pa.int64()}
            return pa.RecordBatch.from_arrays([*keys, *[given.get(c, pa.nulls(n, t)) for c, t in kinds.items()]], names=[*group, *kinds])

        def emit(b: pa.RecordBatch, open_end: bool) -> Iterator[pa.RecordBatch]:
            nonlocal going, passed, last
            n = b.num_rows
            if not n:
                return
            keys = [b.column(i) for i in range(k)]
            if last is not None and last != tuple(x[0].as_py() for x in keys):
                going, passed = False, 0
            v, c = (b.column(i).to_numpy(zero_copy_only=False) for i in (k, k + 1))
            starts = runs(keys)
            ends = np.append(starts[1:], n)
            whole = np.ones(len(starts), bool)
            whole[0] &= not going
            whole[-1] &= not open_end
            upto = np.cumsum(c)
            base = (upto - c)[starts]
            size = upto[ends - 1] - base
            if whole.any():
                s, size_, base_ = starts[whole], size[whole], base[whole]
                quantiles = []
                for h in _spots(size_, at, nearest):
                    lo, hi = (v[np.searchsorted(upto, base_ + f(h).astype(np.int64), side="right")] for f in (np.floor, np.ceil))
                    quantiles.append(lo + (hi - lo) * (h - np.floor(h)))
                flat = np.stack(quantiles, 1).ravel() if quantiles else np.zeros(0)
                lists = pa.ListArray.from_arrays(pa.array((np.arange(len(s) + 1) * len(at)).astype(np.int32)), pa.array(flat))
                yield table([x.take(pa.array(s)) for x in keys], len(s), __n=pa.array(size_), __q=lists)
            rest = np.flatnonzero(np.repeat(~whole, ends - starts))
            if len(rest):
                local = upto - c - np.repeat(base, ends - starts)
                if going:
                    local[: ends[0]] += passed
                yield table([x.take(pa.array(rest)) for x in keys], len(rest), __v=pa.array(v[rest]), __c=pa.array(c[rest]), __part=pa.array(np.full(len(rest), part, np.int32)), __local=pa.array(local[rest]))
            passed = int(size[-1]) + (passed if going and len(starts) == 1 else 0) if open_end else 0
            going, last = open_end, tuple(x[-1].as_py() for x in keys)

        for b in batches:
            if not b.num_rows:
                continue
            if held is not None and held.num_rows:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            cut = int(runs([b.column(i) for i in range(k)])[-1])
            if cut:
                yield from emit(b.slice(0, cut), False)
            held = b.slice(cut)
            if held.num_rows > HELD_ROWS:
                yield from emit(held, True)
                held = None
        if held is not None:
            yield from emit(held, True)

    return run


def quantiles(df: DataFrame, group: list[str], value: str, at: Sequence[float], nearest: bool = False, total: str = "n", out: str = "q", weight: str | None = None, ties: str | None = None) -> DataFrame:
    """group, ``total`` (values) and ``out``, an array with one quantile per entry of ``at``: interpolated linearly, or with ``nearest`` the
    value of rank ceil(p n). Exact, for groups of any size. Null and NaN values are left out; groups without values give no row;
    null keys are a group. ``weight`` names a column that says how often a value counts. Rows are counted per (group, value) before
    they are sorted, so that many equal values are one row; with ``ties``, a column that differs among equal values, they are
    sorted as they are."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    v, c = F.col(value).cast("double"), F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")
    keys = [F.col(f"`{g}`") for g in group]
    if ties is None:
        rows = rows.groupBy(*keys, v.alias("__v")).agg(F.sum(c).alias("__c"))
    else:
        rows = rows.select(*keys, v.alias("__v"), F.col(ties).alias("__t"), *([] if weight is None else [c.alias("__c")]))
    ordered = sorted_ranges(rows, group, [F.col("__v").asc(), *([F.col("__t").asc()] if ties else [])])
    ordered = ordered.select(*keys, "__v", F.col("__c") if "__c" in rows.columns else c.alias("__c"))
    kinds = ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in group)
    table = materialise(ordered.mapInArrow(_placer(group, at, nearest), f"{kinds}, __n bigint, __q array<double>, __v double, __c bigint, __part int, __local bigint"))
    inner = table.where("__q is not null").select(*keys, F.col("__n").alias(total), F.col("__q").alias(out))
    # the groups at the ends of partitions: at most two per partition, whose counts give offsets
    edge = table.where("__q is null")
    counts = edge.groupBy(*keys, "__part").agg(F.sum("__c").alias("__rows"))
    run = Window.partitionBy(*keys)
    counts = counts.select(*[F.col(f"`{g}`").alias(f"__g{i}") for i, g in enumerate(group)], F.col("__part").alias("__p"), (F.sum("__rows").over(run.orderBy("__part")) - F.col("__rows")).alias("__before"), F.sum("__rows").over(run).alias("__n_"))
    same = [F.col(f"`{g}`").eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)]
    joined = edge.join(F.broadcast(counts), [F.col("__part") == F.col("__p"), *same])
    placed = joined.select(*keys, "__v", "__c", F.col("__n_").alias("__n"), (F.col("__before") + F.col("__local")).alias("__from"))
    spots = _spots(F.col("__n"), at, nearest)
    covers = lambda k: (F.col("__from") <= k) & (k < F.col("__from") + F.col("__c"))
    sides = [(F.floor(h), F.ceil(h)) for h in spots]
    wanted = F.array(*[covers(k) for pair in sides for k in pair])
    found = placed.where(F.array_contains(wanted, True)).groupBy(*keys, "__n").agg(*[F.max(F.when(covers(k), F.col("__v"))).alias(f"__{i}{s}") for i, pair in enumerate(sides) for s, k in zip("lh", pair, strict=True)])
    between = [F.col(f"__{i}l") + (F.col(f"__{i}h") - F.col(f"__{i}l")) * (h - F.floor(h)) for i, h in enumerate(spots)]
    return inner.unionAll(found.select(*keys, F.col("__n").alias(total), F.array(*between).alias(out)))
