"""Consolidating pairwise matches into groups (problem 2): near-overlapping boxes and connected components.

One global sort by key, box and id puts identical boxes together without expanding them into pairs; while streaming over a
sorted partition, the few boxes of a key are compared on the spot, and only keys of many boxes, or that reach over the
partition's ends, go to a join on the key plus a grid cell, so that no key is one task. Components come from union-find within
edge partitions: blocks of bounded size keep a spanning forest each, and forests are merged level by level over the roots alone,
until no node has two roots."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.operators.boxes import OVERLAP, RATIO, overlap_pairs, page_boxes
from inkwell.runtime import materialise

#: Edges that one union-find holds at once; a larger partition is worked off in blocks of this size.
BLOCK_EDGES = 1_000_000
#: Distinct boxes of a key up to which all are compared on the spot.
FEW_BOXES = 32
#: Rows of one key that wait for the rest of their key; a longer run goes to the join.
HELD_ROWS = 100_000


def _forest(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over one block: every node with the smallest node of its tree."""
    nodes, code = np.unique(np.concatenate([src, dst]), return_inverse=True)
    parent = list(range(len(nodes)))
    n = len(src)
    for a, b in zip(code[:n].tolist(), code[n:].tolist(), strict=True):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a < b:
            parent[b] = a
        elif b < a:
            parent[a] = b
    root = np.array(parent, dtype=np.int64)
    while True:
        up = root[root]
        if np.array_equal(up, root):
            return nodes, nodes[root]
        root = up


def _forest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    src: list[np.ndarray] = []
    dst: list[np.ndarray] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if src:
            nodes, roots = _forest(np.concatenate(src), np.concatenate(dst))
            src.clear()
            dst.clear()
            for i in range(0, len(nodes), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 100_000]), pa.array(roots[i : i + 100_000])], names=["node", "root"])

    held = 0
    for b in batches:
        src.append(b.column(0).to_numpy(zero_copy_only=False))
        dst.append(b.column(1).to_numpy(zero_copy_only=False))
        held += b.num_rows
        if held >= BLOCK_EDGES:
            yield from flush()
            held = 0
    yield from flush()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): every node of an edge with the smallest node id that it is linked to directly or indirectly.

    Edges with a null end are left out; a loop makes a component of one node; repeated edges change nothing; no edge gives
    no row; other columns are ignored. Each level keeps, for every node, one of its roots (by a hash that changes from level
    to level, so that a chain of any order shrinks by a constant factor) and hands on only the pairs of roots that met in
    some node."""
    links = edges.select(F.col(src).cast("bigint").alias("src"), F.col(dst).cast("bigint").alias("dst")).where("src is not null and dst is not null")
    levels: list[DataFrame] = []
    lows: list[DataFrame] = []
    while True:
        forest = materialise(links.mapInArrow(_forest_batches, "node bigint, root bigint"))
        pick = F.min_by("root", F.xxhash64("root", F.lit(len(levels))))
        label = materialise(forest.groupBy("node").agg(pick.alias("up"), F.min("root").alias("low"), F.max("root").alias("high")))
        if label.where("low <> high").isEmpty():
            levels.append(label.select("node", F.col("low").alias("up")))
            break
        levels.append(label.select("node", "up"))
        lows.append(forest.select("root").distinct())
        # pairs of roots, spread by both: many trees meet in few roots
        links = forest.join(label.where("low <> high").select("node", "up"), "node").where("root <> up").select(F.col("root").alias("src"), F.col("up").alias("dst")).distinct()
    found = levels[-1]
    for below in reversed(levels[:-1]):
        above = found.select(F.col("node").alias("up"), F.col("up").alias("__top"))
        found = below.join(above, "up", "left").select("node", F.coalesce("__top", "up").alias("up"))
    if len(levels) > 1:  # the names of the trees are roots by hash: name each by its smallest root instead
        named = found.join(lows[0].withColumnRenamed("root", "node"), "node", "left_semi").groupBy("up").agg(F.min("node").alias("component"))
        return found.join(named, "up").select("node", "component")
    return found.select("node", F.col("up").alias("component"))


BY = ["k1", "k2", "x", "y", "w", "h", "id"]


def _near(a: list[np.ndarray], b: list[np.ndarray], overlap: int, ratio: int) -> np.ndarray:
    """Do the boxes (x, y, w, h) nearly coincide? Limits in whole thousandths."""
    ok = np.ones(len(a[0]), bool)
    for p, w in ((0, 2), (1, 3)):
        common = np.minimum(a[p] + a[w], b[p] + b[w]) - np.maximum(a[p], b[p])
        small, large = np.minimum(a[w], b[w]), np.maximum(a[w], b[w])
        ok &= (common * 1000 >= small * overlap) & (large * 1000 <= small * ratio)
    return ok


def _linker(overlap: int, ratio: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Streams over a partition sorted by key, box and id. Rows (src, dst): a copy with the first row of its box, and the first rows
    of two boxes that nearly coincide. Rows with a box (src alone): boxes still to be compared, since their key has many or may
    have more in another partition. Rows alone with their key give none: nothing can match them."""

    def links(src: np.ndarray, dst: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(src), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), *[none] * 6], names=["src", "dst", *BY[:6]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 7
        first = True  # the key at hand may have begun in the partition before
        last_box: tuple | None = None
        rep = 0

        def emit(c: list[np.ndarray], open_end: bool) -> Iterator[pa.RecordBatch]:
            """Whole keys, but for the first key while ``first`` and the last with ``open_end``."""
            nonlocal first, last_box, rep
            n = len(c[0])
            if not n:
                return
            new_key = np.ones(n, bool)
            new_key[1:] = (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1])
            new_box = new_key.copy()
            for v in c[2:6]:
                new_box[1:] |= v[1:] != v[:-1]
            if last_box is not None and last_box == tuple(int(v[0]) for v in c[:6]):
                new_box[0] = False  # the box of a long key goes on
            key = np.cumsum(new_key) - 1
            starts = np.flatnonzero(new_box)
            reps = np.concatenate([[rep], c[6][starts]])[np.cumsum(new_box)]
            copy = ~new_box & (reps != c[6])
            yield links(reps[copy], c[6][copy])
            boxes = [v[starts] for v in c]
            of = key[starts]
            many = np.bincount(of, minlength=key[-1] + 1)
            to_join = many > FEW_BOXES
            to_join[0] |= first
            to_join[-1] |= open_end
            at = np.flatnonzero(~to_join[of]) if len(of) else of
            for d in range(1, FEW_BOXES):
                at = at[at + d < len(of)]
                at = at[of[at] == of[at + d]]
                if not len(at):
                    break
                near = at[_near([v[at] for v in boxes[2:6]], [v[at + d] for v in boxes[2:6]], overlap, ratio)]
                yield links(boxes[6][near], boxes[6][near + d])
            j = np.flatnonzero(to_join[of])
            yield pa.RecordBatch.from_arrays([pa.array(boxes[6][j]), pa.nulls(len(j), pa.int64()), *[pa.array(v[j]) for v in boxes[:6]]], names=["src", "dst", *BY[:6]])
            last_box, rep = tuple(int(v[-1]) for v in c[:6]), int(reps[-1])
            first = open_end

        for b in batches:
            if not b.num_rows:
                continue
            c = [np.concatenate([h, b.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held)]
            change = np.flatnonzero((c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1]))
            cut = int(change[-1]) + 1 if len(change) else 0
            if cut:
                yield from emit([v[:cut] for v in c], False)
            held = [v[cut:] for v in c]
            if len(held[0]) > HELD_ROWS:
                yield from emit(held, True)
                held = [v[:0] for v in held]
        yield from emit(held, True)

    return run


def duplicate_groups(matched: DataFrame, id_col: str = "record_id", overlap: float = OVERLAP, ratio: float = RATIO) -> DataFrame:
    """(record_id, group_id) of every row that nearly coincides, directly or through others, with another row on the same
    page image; group_id is the smallest record_id of the group. Ids have to be unique. See ``page_boxes`` for the rows that
    match nothing; an empty table gives no row, further columns are ignored."""
    rows = materialise(page_boxes(matched, id_col).select(*BY))  # a table, since the sort reads its rows twice
    parts = int(matched.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, *BY).sortWithinPartitions(*BY)
    found = materialise(ordered.mapInArrow(_linker(round(overlap * 1000), round(ratio * 1000)), "src bigint, dst bigint, " + ", ".join(f"{c} bigint" for c in BY[:6])))
    pairs = overlap_pairs(found.where("dst is null").withColumnRenamed("src", "rep"), overlap, ratio)
    edges = found.where("dst is not null").select("src", "dst").unionAll(pairs)
    return connected_components(edges).select(F.col("node").alias(id_col), F.col("component").alias("group_id"))
