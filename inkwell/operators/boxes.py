"""Boxes on page images: the near-overlap join and groups of linked rows.

The join has an equi key (k1, k2: a 128-bit fingerprint) plus a grid cell, so that no page is one task; identical boxes
are put together by the caller and never expanded into pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.paths import page_image_key
from inkwell.runtime import materialise

#: Side of a grid cell for boxes of more than an eighth and up to a quarter of it; others use cells doubled or halved as often as
#: they need, so that a cell is four to eight times as large as the boxes in it.
CELL = 256
#: The limits of a near overlap: share of the smaller side on each axis, and how often the smaller side goes into the larger.
OVERLAP, RATIO = 0.8, 1.6


def near_overlap(a: str, b: str, overlap: float = OVERLAP, ratio: float = RATIO) -> Column:
    """Do the boxes ``a.(x, y, w, h)`` and ``b....`` overlap by ``overlap`` of the smaller side on both axes, with sides
    that differ by ``ratio`` at most? In whole thousandths, so that the limits themselves are exact."""

    def axis(p: str, w: str) -> Column:
        x1, x2, w1, w2 = (F.col(f"{t}.{c}") for c in (p, w) for t in (a, b))
        common = F.least(x1 + w1, x2 + w2) - F.greatest(x1, x2)
        small, large = F.least(w1, w2), F.greatest(w1, w2)
        return (common * 1000 >= small * round(overlap * 1000)) & (large * 1000 <= small * round(ratio * 1000))

    return axis("x", "w") & axis("y", "h")


def _size_class(side: Column) -> Column:
    return F.ceil(F.log2(side / F.lit(CELL / 4))).cast("int")


def overlap_pairs(boxes: DataFrame, overlap: float = OVERLAP, ratio: float = RATIO) -> DataFrame:
    """(src, dst) for the pairs of ``boxes`` (k1, k2, x, y, w, h, rep: distinct boxes per key, whole numbers) that nearly
    coincide, src < dst. Each box has one home cell by its centre and asks the cells that the centre of a near-coinciding box
    can lie in, in the grids of its own and, near the border, of the next size class; the cells are part of the join key, so
    that a hot page spreads over many tasks."""
    if overlap < 0.5:
        raise ValueError("the grid needs an overlap of at least 0.5")
    cx, cy, long_side = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2, F.greatest("w", "h")
    cell = lambda v, c: F.floor(v / (F.lit(float(CELL)) * F.pow(F.lit(2.0), c))).cast("int")
    own = _size_class(long_side)
    cell_key = lambda c: F.xxhash64("k1", c, "gx", "gy").alias("cell")
    rest = ["k2", "x", "y", "w", "h", "rep"]
    home = boxes.withColumns({"gx": cell(cx, own), "gy": cell(cy, own)}).select(cell_key(own), *rest)
    lowest, highest = _size_class(long_side / ratio), _size_class(long_side * ratio)
    reach = ratio / 2 + 0.5 - overlap  # centres of near-coinciding boxes, in sides of the smaller
    span = lambda v, side, c: F.explode(F.sequence(cell(v - F.col(side) * reach, c), cell(v + F.col(side) * reach, c)))
    asks = boxes.withColumn("cls", F.explode(F.sequence(lowest, highest))).withColumn("gx", span(cx, "w", F.col("cls"))).withColumn("gy", span(cy, "h", F.col("cls")))
    met = home.alias("a").join(asks.select(cell_key(F.col("cls")), *rest).alias("b"), (F.col("a.cell") == F.col("b.cell")) & (F.col("a.k2") == F.col("b.k2")))
    near = met.where((F.col("a.rep") < F.col("b.rep")) & near_overlap("a", "b", overlap, ratio))
    return near.select(F.col("a.rep").alias("src"), F.col("b.rep").alias("dst"))


def page_boxes(matched: DataFrame, id_col: str = "record_id") -> DataFrame:
    """The rows of a matched table that can match at all: id, a 128-bit fingerprint (k1, k2) of book, character, volume,
    page and page image, and the box. Rows without source_image, volume, page, book, character or box, or with a side not
    above 0, are left out."""
    b = F.col("bbox")
    key = [F.col("book"), F.col("std_char"), F.col("volume"), F.col("page"), F.col("__image")]
    usable = "book is not null and std_char is not null and volume is not null and page is not null and x is not null and y is not null and w > 0 and h > 0"
    return (
        matched.select(F.col(id_col).alias("id"), "book", "std_char", "volume", "page", *[b[n].cast("int").alias(c) for n, c in (("x", "x"), ("y", "y"), ("width", "w"), ("height", "h"))], page_image_key("source_image").alias("__image"))
        .where(usable + " and __image is not null and id is not null")
        .select("id", F.xxhash64(*key).alias("k1"), F.xxhash64(F.lit("inkwell"), *reversed(key)).alias("k2"), *[F.col(c).cast("bigint").alias(c) for c in "xywh"])
    )


def linked_groups(links: DataFrame) -> DataFrame:
    """(node, first): every node of a link with the smallest node it is linked to, directly or indirectly. Null ends and loops are
    left out; no link gives no row.

    Each round every node goes over to the neighbour (or itself) that comes first by a hash of the round, links are named by where
    their ends went, and those that became loops are gone: only what isn't put together yet goes on, a constant factor less
    each time. Rounds are tables in the shared folder; the moves are joined back from the last one to the first."""
    some = links.where("src is not null and dst is not null and src <> dst")
    edges = materialise(some.select("src", "dst").unionAll(some.select("dst", "src")).distinct())
    moves: list[DataFrame] = []
    while True:
        order = lambda c: F.struct(F.xxhash64(c, F.lit(len(moves))), F.col(c))  # noqa: E731, B023
        near = edges.groupBy("src").agg(F.min_by("dst", order("dst")).alias("dst"))
        move = materialise(near.select(F.col("src").alias("node"), F.when(order("dst") < order("src"), F.col("dst")).otherwise(F.col("src")).alias("up")))
        moves.append(move)
        to = move.select(F.col("node").alias("dst"), F.col("up").alias("__to"))
        left = edges.join(move.withColumnRenamed("node", "src"), "src").join(to, "dst").where(F.col("up") != F.col("__to"))
        edges = materialise(left.select(F.col("up").alias("src"), F.col("__to").alias("dst")).distinct())
        if edges.isEmpty():
            break
    found = moves[-1]
    for below in reversed(moves[:-1]):
        above = found.select(F.col("node").alias("up"), F.col("up").alias("__top"))
        found = below.join(above, "up", "left").select("node", F.coalesce("__top", "up").alias("up"))
    return found.join(found.groupBy("up").agg(F.min("node").alias("first")), "up").select("node", "first")
