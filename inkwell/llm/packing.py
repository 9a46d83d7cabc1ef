"""Filling fixed-capacity containers with items (problem 9): best-two-fit over blocks of items.

A text above the capacity is cut into full containers and a rest; nothing else is split. Items fall into blocks by a hash of
their id, as many blocks as the number of items asks for; a block is packed by one task: a container is filled greedily with the
largest item that still fits, and then its smallest item is replaced by the two unpacked items that fill its expanded gap best.
Containers that stay loose are opened again, and the items of all blocks' loose containers are packed together in the same way,
level by level, until they are one block or packing them anew gains nothing. Blocks, containers and their ids hang on the
items alone, not on the number of tasks, so that any cluster gives the same result."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.runtime import materialise

#: Items of a block, on average.
BLOCK_ITEMS = 20_000
#: A container is loose if more than this share of its capacity is free.
LOOSE = 0.0005
#: Copies of an item that are written out by one row.
COPIES = 10_000


def best_two_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers of item numbers. Every size lies between 0 and ``capacity``. Equal sizes are taken in order of number."""
    stock: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        stock.setdefault(sizes[i], []).append(i)
    avail = sorted(stock)

    def take(k: int) -> int:
        s = avail[k]
        i = stock[s].pop()
        if not stock[s]:
            del avail[k]
        return i

    bins: list[list[int]] = []
    while avail:
        held = [take(len(avail) - 1)]
        gap = capacity - sizes[held[0]]
        while avail and (k := bisect_right(avail, gap) - 1) >= 0:
            i = take(k)
            held.append(i)
            gap -= sizes[i]
        if gap and len(avail) > 0 and len(held) > 0:
            small = min(range(len(held)), key=lambda j: (sizes[held[j]], j))
            room, best, pair = gap + sizes[held[small]], sizes[held[small]], None
            k = bisect_right(avail, room) - 1
            while k >= 0 and 2 * avail[k] > best:
                a = avail[k]
                j = bisect_right(avail, min(a, room - a)) - 1
                if j == k and len(stock[a]) < 2:
                    j -= 1
                if j >= 0 and a + avail[j] > best:
                    best, pair = a + avail[j], (a, avail[j])
                    if best == room:
                        break
                k -= 1
            if pair:
                out = held.pop(small)
                for s in pair:
                    held.append(take(bisect_right(avail, s) - 1))
                s = sizes[out]
                if s not in stock or not stock[s]:
                    avail.insert(bisect_right(avail, s), s)
                stock.setdefault(s, []).append(out)
        bins.append(held)
    return bins


SCHEMA = "container_id bigint, slot int, id {kind}, piece int, token_from bigint, n_tokens bigint, loose boolean"


def _packer(capacity: int, level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packs rows (block, id, piece, token_from, n_tokens) sorted by block, block by block. A container is named by the level, the
    block and its number there."""

    def pack_block(block: pa.Table) -> Iterator[pa.RecordBatch]:
        sizes = block.column("n_tokens").to_numpy()
        bins = best_two_fit(sizes.tolist(), capacity)
        order = np.array([i for b in bins for i in b], np.int64)
        held = np.array([len(b) for b in bins])
        name = (level << 56) + (block.column("block")[0].as_py() << 24) + np.arange(len(bins))
        slot = np.arange(len(order)) - np.repeat(np.cumsum(held) - held, held) + 1
        free = capacity - np.add.reduceat(sizes[order], np.cumsum(held) - held)
        out = block.drop_columns(["block"]).take(pa.array(order))
        out = out.add_column(0, "container_id", pa.array(np.repeat(name, held))).add_column(1, "slot", pa.array(slot.astype(np.int32)))
        out = out.append_column("loose", pa.array(np.repeat(free > capacity * LOOSE, held)))
        yield from out.combine_chunks().to_batches(max_chunksize=50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            blocks = b.column(0).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if i == j:
                    continue
                if held and held[0].column(0)[0].as_py() != blocks[i]:
                    yield from pack_block(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(i, j - i))
        if held:
            yield from pack_block(pa.Table.from_batches(held))

    return run


def _items(sizes: DataFrame, capacity: int, id_col: str, size: str) -> DataFrame:
    """(id, piece, copy, token_from, n_tokens) of every piece. Equal rows are counted before they are shuffled and written out
    again with their number, so that they differ by it, and a repeated id is no hot key."""
    known = sizes.where(F.col(size).isNotNull()).select(F.col(id_col).alias("id"), F.greatest(F.col(size), F.lit(0)).cast("bigint").alias("n"))
    counted = known.groupBy("id", "n").agg(F.count(F.lit(1)).alias("c"))
    some = counted.select("id", "n", "c", F.explode(F.sequence(F.lit(0), F.floor((F.col("c") - 1) / COPIES))).alias("k"))
    each = some.select("id", "n", F.explode(F.sequence(F.col("k") * COPIES, F.least(F.col("c"), (F.col("k") + 1) * COPIES) - 1)).alias("copy"))
    pieces = each.select("id", "n", "copy", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / float(capacity)), F.lit(1)) - 1)).alias("k"))
    return pieces.select("id", (F.col("k") + 1).cast("int").alias("piece"), "copy", (F.col("k") * capacity).cast("bigint").alias("token_from"), F.least(F.lit(capacity), F.col("n") - F.col("k") * capacity).cast("bigint").alias("n_tokens"))


def pack(sizes: DataFrame, capacity: int, id_col: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(container_id, slot, id, piece, token_from, n_tokens) for each piece of ``sizes`` (id, size). A size up to ``capacity``
    is one piece (piece 1 from token 0); a larger one gives full pieces of ``capacity`` and a rest. Size 0 takes no space but
    a slot; a null size has no container: its row has null in all columns but the id. Repeated ids are items of their own; an
    empty table gives no row; other columns are ignored."""
    if capacity < 1:
        raise ValueError("the capacity has to be at least 1")
    kind = sizes.schema[id_col].dataType.simpleString()
    sizes = materialise(sizes.select(id_col, size))  # counted once, though read for items and for nulls
    items = _items(sizes, capacity, id_col, size)
    levels: list[DataFrame] = []
    count = sizes.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.col(size) / float(capacity))))).head()[0] or 0  # one row
    tasks = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while count:
        blocks = max(1, -(-count // BLOCK_ITEMS))
        key = ["id", "piece", "copy"] if not levels else ["id", "piece", "was", "place"]
        # rows are sorted by all that tells them apart, so that a block is packed alike wherever it lies
        spread = items.withColumn("block", F.pmod(F.xxhash64(*key), F.lit(blocks))).repartition(min(blocks, tasks), "block").sortWithinPartitions("block", *key)
        packed = materialise(spread.select("block", "id", "piece", "token_from", "n_tokens").mapInArrow(_packer(capacity, len(levels)), SCHEMA.format(kind=kind)))
        loose = packed.where("loose")
        left = loose.count() if blocks > 1 else 0
        if blocks == 1 or 2 * left > count:
            levels.append(packed.drop("loose"))
            break
        levels.append(packed.where("not loose").drop("loose"))
        items = loose.select("id", "piece", F.col("container_id").alias("was"), F.col("slot").alias("place"), "token_from", "n_tokens")
        count = left
    none = sizes.where(F.col(size).isNull()).selectExpr("cast(null as bigint) container_id", "cast(null as int) slot", f"`{id_col}` id", "cast(null as int) piece", "cast(null as bigint) token_from", "cast(null as bigint) n_tokens")
    return reduce(DataFrame.unionAll, levels, none).withColumnRenamed("id", id_col)
