"""Raster operators over pixel rows (id, x, y, gray): histograms, projections, connected components and trims as joins,
aggregates and windows. A raster of any size is many rows; none is collected into one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.operators.boxes import linked_groups
from inkwell.operators.global_sort import quantiles
from inkwell.runtime import checkpoint, materialise


def otsu(pixels: DataFrame) -> DataFrame:
    """(id, threshold): the gray level that separates dark from light best: the first level with the largest variance between
    the classes at or below and above it. A raster of one gray level has the level itself."""
    hist = pixels.groupBy("id", "gray").agg(F.count(F.lit(1)).alias("c"))
    by, run = Window.partitionBy("id"), Window.partitionBy("id").orderBy("gray")
    s = hist.select("id", "gray", F.sum("c").over(run).alias("n0"), F.sum(F.col("c") * F.col("gray")).over(run).alias("s0"), F.sum("c").over(by).alias("n"), F.sum(F.col("c") * F.col("gray")).over(by).alias("s"))
    n1 = F.col("n") - F.col("n0")
    gap = F.try_divide(F.col("s0").cast("double"), F.col("n0")) - F.try_divide((F.col("s") - F.col("s0")).cast("double"), n1)
    between = F.when(n1 > 0, F.round(F.col("n0") * n1 * gap * gap, 6)).otherwise(F.lit(-1.0))
    return s.groupBy("id").agg(F.max_by("gray", F.struct(between, -F.col("gray"))).alias("threshold"))


def projection(pixels: DataFrame, axis: str, dark: Column) -> DataFrame:
    """(id, axis, coverage): share of dark pixels in each column (axis x) or row (y)."""
    return pixels.groupBy("id", axis).agg((F.count_if(dark) / F.count(F.lit(1))).alias("coverage"))


def dark_runs(coverage: DataFrame, axis: str, above: float | Column) -> DataFrame:
    """(id, start, stop, mass): maximal runs of neighbouring places with a coverage above ``above``; stop is exclusive."""
    over = coverage.where(F.col("coverage") > above)
    r = over.withColumn("__g", F.col(axis) - F.row_number().over(Window.partitionBy("id").orderBy(axis)))
    return r.groupBy("id", "__g").agg(F.min(axis).alias("start"), (F.max(axis) + 1).alias("stop"), F.sum("coverage").alias("mass")).drop("__g")


def projection_trim(coverage: DataFrame, axis: str, length: int, reach: float = 0.3, most: float = 0.2, above: float = 0.005) -> DataFrame:
    """(id, lo, hi): bounds after runs that lie wholly within ``reach`` of an edge and are at most ``most`` of the length wide have been
    cut off, edge by edge, until a run stays. If all are cut from a side, that bound is the far end of the last one. Rasters
    without any run keep their length."""
    runs = dark_runs(coverage, axis, above)
    near, far = round(length * reach), length - round(length * reach)
    thin = (F.col("stop") - F.col("start")) <= length * most
    cut_lo, cut_hi = (F.col("stop") <= near) & thin, (F.col("start") >= far) & thin
    b = runs.groupBy("id").agg(F.min(F.when(~cut_lo, F.col("start"))).alias("lo"), F.max(F.when(~cut_hi, F.col("stop"))).alias("hi"), F.max("stop").alias("end"), F.min("start").alias("begin"))
    lo = F.least(F.coalesce("lo", "end"), F.lit(length - 1)).cast("int")
    bounds = b.select("id", lo.alias("lo"), F.coalesce("hi", "begin").cast("int").alias("hi")).withColumn("hi", F.greatest(F.col("lo") + 1, F.least("hi", F.lit(length))))
    ids = coverage.select("id").distinct()
    return ids.join(bounds, "id", "left").select("id", F.coalesce("lo", F.lit(0)).alias("lo"), F.coalesce("hi", F.lit(length)).alias("hi"))


def tightened(bounds: DataFrame, coverage: DataFrame, axis: str, length: int, above: Column) -> DataFrame:
    """(id, lo, hi): bounds moved inwards to the next place with a coverage above ``above``, at least one apart."""
    inked = bounds.join(coverage.where(above).select("id", F.col(axis).alias("at")), "id", "left").groupBy("id", "lo", "hi")
    t = inked.agg(F.min(F.when(F.col("at") >= F.col("lo"), F.col("at"))).alias("a"), F.max(F.when(F.col("at") < F.col("hi"), F.col("at") + 1)).alias("b"))
    lo = F.least(F.coalesce("a", F.lit(length)), F.lit(length - 1)).cast("int")
    return t.select("id", lo.alias("lo"), F.greatest(lo + 1, F.coalesce("b", F.lit(0))).cast("int").alias("hi"))


def axis_bounds(coverage: DataFrame, axis: str, length: int, reach: tuple[float, float], most: tuple[float, float], least: tuple[float, float] = (0.005, 0.01), tight: float = 0.01) -> DataFrame:
    """(id, lo, hi): like ``projection_trim`` with limits per edge, runs above ``least`` (as it is, and as a share of the largest
    coverage), and edges tightened to a coverage above ``tight``. A blank raster keeps its length; one with ink but without
    any run is cut to the limit ``most`` on both sides."""
    top = coverage.groupBy("id").agg(F.max("coverage").alias("top"))
    c = coverage.join(top, "id")
    runs = dark_runs(c, axis, F.greatest(F.lit(least[0]), least[1] * F.col("top")))
    near, far = round(length * min(reach[0], 1.0)), length - round(length * min(reach[1], 1.0))
    cut = [length if m <= 0 else round(length * min(m, 1.0)) for m in most]
    size = F.col("stop") - F.col("start")
    cut_lo, cut_hi = (F.col("stop") <= near) & (size <= length * most[0]), (F.col("start") >= far) & (size <= length * most[1])
    b = runs.groupBy("id").agg(F.coalesce(F.min(F.when(~cut_lo, F.col("start"))), F.max("stop")).alias("lo"), F.coalesce(F.max(F.when(~cut_hi, F.col("stop"))), F.min("start")).alias("hi"))
    ends = tightened(b, c, axis, length, F.col("coverage") > tight)
    lo = min(length - 1, cut[0])
    bare = [F.when(F.col("top") > 0, F.lit(v)).otherwise(F.lit(w)) for v, w in ((lo, 0), (max(lo + 1, length - cut[1]), length))]
    return top.join(ends, "id", "left").select("id", F.coalesce("lo", bare[0]).alias("lo"), F.coalesce("hi", bare[1]).alias("hi"))


def projection_bounds(pixels: DataFrame, dark: Column, width: int, height: int, least: tuple[float, float] = (0.005, 0.01), tight: float = 0.01) -> DataFrame:
    """(id, x0, x1, y0, y1): ``axis_bounds`` of the columns, then of the rows of what they leave."""
    px = pixels.select("id", "x", "y", dark.alias("ink"))
    cols = checkpoint(axis_bounds(projection(px, "x", F.col("ink")), "x", width, (0.3, 0.3), (0.25, 0.25), least, tight).withColumnsRenamed({"lo": "x0", "hi": "x1"}))
    inside = px.join(cols, "id").where("x >= x0 and x < x1")
    rows = axis_bounds(projection(inside, "y", F.col("ink")), "y", height, (0.3, 0.5), (0.25, 0.3), least, tight)
    return cols.join(rows.withColumnsRenamed({"lo": "y0", "hi": "y1"}), "id")


def components(pixels: DataFrame, dark: Column, width: int) -> DataFrame:
    """(id, label, x, y, w, h, area): 8-connected components of the dark pixels with their boxes."""
    box = [F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"), F.count(F.lit(1)).alias("area")]
    return labelled(pixels, dark, width).groupBy("id", "label").agg(*box)


def labelled(pixels: DataFrame, dark: Column, width: int) -> DataFrame:
    """The dark pixels with the label of their 8-connected component, the smallest pixel number. Pixels are joined with the
    neighbours behind them, and groups are found over all rasters at once."""
    ink = pixels.where(dark).select("id", "x", "y", (F.col("id") * (width * width) + F.col("y") * width + F.col("x")).cast("bigint").alias("n"))
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 1), (0, 1), (1, 1))])
    ask = ink.select("id", "n", "x", "y", F.explode(steps).alias("s")).select("id", F.col("n").alias("src"), (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"))
    links = ask.join(ink, ["id", "x", "y"]).select("src", F.col("n").alias("dst"))
    return ink.join(linked_groups(links), ink["n"] == F.col("node"), "left").withColumn("label", F.coalesce("first", "n"))


def classified(parts: DataFrame, width: int, height: int, edge: int = 1, shares: tuple[float, float, float] = (0.05, 0.04, 0.02), max_aspect: float = 10.0, min_dim: int = 0) -> DataFrame:
    """Components with their tier (border_touch, edge_zone, interior) and the reason they are removed for: area below the tier's
    share of the raster, else (not in the interior) a box as long as ``max_aspect`` times its width, else a thin box; null where
    they stay."""
    reach = lambda m: (F.col("x") <= m) | (F.col("y") <= m) | (F.col("x") + F.col("w") >= width - m) | (F.col("y") + F.col("h") >= height - m)
    tier = F.when(reach(0), "border_touch").when(reach(edge), "edge_zone").otherwise("interior")
    least = F.when(F.col("tier") == "border_touch", shares[0]).when(F.col("tier") == "edge_zone", shares[1]).otherwise(shares[2])
    thin, long = F.least("w", "h"), F.greatest("w", "h")
    reason = F.when(F.col("area") < F.greatest(F.lit(1), F.floor(least * width * height)), "area").when((F.col("tier") != "interior") & (long >= max_aspect * thin), "aspect").when(thin <= min_dim, "thin")
    return parts.withColumn("tier", tier).withColumn("reason", reason)


def ink_counts(pixels: DataFrame, level: int, inclusive: bool) -> DataFrame:
    """(id, black, total): pixels darker than ``level`` (or as dark)."""
    return pixels.groupBy("id").agg(F.count_if(F.col("gray") <= level if inclusive else F.col("gray") < level).alias("black"), F.count(F.lit(1)).alias("total"))


def ink_box(pixels: DataFrame, level: int, pad: int, width: int, height: int) -> DataFrame:
    """(id, x, y, w, h): the tight box of pixels of at most ``level`` with a margin, clamped; rasters without ink give no row."""
    b = pixels.where(F.col("gray") <= level).groupBy("id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    x, y = F.greatest(F.lit(0), F.col("x0") - pad), F.greatest(F.lit(0), F.col("y0") - pad)
    return b.select("id", x.alias("x"), y.alias("y"), (F.least(F.lit(width - 1), F.col("x1") + pad) - x + 1).alias("w"), (F.least(F.lit(height - 1), F.col("y1") + pad) - y + 1).alias("h"))


def centre_crop(pixels: DataFrame, width: int, height: int, side: int) -> DataFrame:
    """The pixels within a box of ``side`` around the middle (w // 2, h // 2), moved to its origin; what the box has beyond the raster
    is white and has no row."""
    x0, y0 = width // 2 - side // 2, height // 2 - side // 2
    inside = (F.col("x") >= x0) & (F.col("x") < x0 + side) & (F.col("y") >= y0) & (F.col("y") < y0 + side)
    return pixels.where(inside).select("id", (F.col("x") - x0).alias("x"), (F.col("y") - y0).alias("y"), "gray")


def border_cuts(pixels: DataFrame, dark: Column, width: int, reach: float = 0.4, share: float = 0.35, least: int = 1, most: int = 2, drop: float = 0.4) -> DataFrame:
    """(id, left, right): columns to cut off on either side: a run of ``least`` to ``most`` columns within ``reach`` of the edge whose
    coverage is at least ``share`` of the largest, if the column behind it is lower by ``drop`` of the largest. The run
    nearest to the edge counts; its cut ends behind it. 0 where there is none."""
    cov = projection(pixels, "x", dark)
    top = cov.groupBy("id").agg(F.max("coverage").alias("top"))
    c = cov.join(top, "id")
    high = c.where((F.col("coverage") >= share * F.col("top")) & (F.col("top") > 0))
    runs = high.withColumn("g", F.col("x") - F.row_number().over(Window.partitionBy("id").orderBy("x"))).groupBy("id", "g", "top").agg(F.min("x").alias("start"), F.max("x").alias("stop"), F.max("coverage").alias("peak"))
    runs = runs.where((F.col("stop") - F.col("start") + 1).between(least, most))
    limit = int(width * reach)
    sides = {}
    for side, near, behind in (("left", F.col("stop") < limit, F.col("stop") + 1), ("right", F.col("start") >= width - limit, F.col("start") - 1)):
        next_to = runs.where(near).withColumn("at", behind).join(cov.select("id", F.col("x").alias("at"), F.col("coverage").alias("after")), ["id", "at"], "left")
        sharp = next_to.where(F.col("peak") - F.coalesce("after", F.lit(0.0)) >= drop * F.col("top"))
        cut = F.min(F.col("stop") + 1) if side == "left" else F.min(width - F.col("start"))
        sides[side] = sharp.groupBy("id").agg(cut.cast("int").alias(side))
    both = top.select("id").join(sides["left"], "id", "left").join(sides["right"], "id", "left")
    return both.select("id", F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("right", F.lit(0)).alias("right"))


def border_pass(coverage: DataFrame, state: DataFrame, reach: float, share: float, least: float, most: float, drop: float, stands_out: float, edge: int) -> DataFrame:
    """(id, left, right): one pass over the columns within ``state`` (id, lo, hi), of rasters where a cut is found. Places count from
    the edge; a run that starts within ``edge`` of it and ends before ``reach`` of the width is a border if its mean is above that of as
    many places behind it (within the reach) by ``drop`` of the largest coverage and ``stands_out`` of itself. The longest run
    counts, the first of equals: on the left its cut ends behind it, on the right behind its outermost column, as the
    reference has it; there a reach of no whole column stands for all."""
    w = F.col("hi") - F.col("lo")
    c = coverage.join(state, "id").where("x >= lo and x < hi").withColumn("top", F.max("coverage").over(Window.partitionBy("id"))).where("top > 0")
    limit = F.floor(w * F.lit(reach))
    sides = F.array(F.struct(F.lit(0).alias("side"), (F.col("x") - F.col("lo")).alias("p"), limit.alias("n")), F.struct(F.lit(1).alias("side"), (F.col("hi") - 1 - F.col("x")).alias("p"), F.when(limit > 0, limit).otherwise(w).alias("n")))
    seen = c.select("id", "coverage", "top", w.alias("w"), F.explode(sides).alias("s")).select("id", "coverage", "top", "w", "s.*").where("p < n")
    high = seen.where(F.col("coverage") >= share * F.col("top")).withColumn("g", F.col("p") - F.row_number().over(Window.partitionBy("id", "side").orderBy("p")))
    runs = high.groupBy("id", "side", "g", "top", "w", "n").agg(F.min("p").alias("start"), (F.max("p") + 1).alias("stop"), F.avg("coverage").alias("mean"))
    size = F.col("stop") - F.col("start")
    shortest = F.greatest(F.lit(1), F.floor(F.col("w") * F.lit(least)))
    runs = runs.where((F.col("stop") < F.col("n")) & (F.col("start") <= edge) & size.between(shortest, F.greatest(shortest, F.floor(F.col("w") * F.lit(most)))))
    behind = runs.join(seen.select("id", "side", "p", "coverage"), ["id", "side"]).where((F.col("p") >= F.col("stop")) & (F.col("p") < F.col("stop") + size))
    fall = F.col("mean") - F.col("after")
    sharp = behind.groupBy("id", "side", "start", "stop", "mean", "top").agg(F.avg("coverage").alias("after")).where((F.round(fall - drop * F.col("top"), 9) >= 0) & (F.round(fall - stands_out * F.col("mean"), 9) >= 0))
    cut = F.max_by(F.when(F.col("side") == 0, F.col("stop")).otherwise(F.col("start") + 1), F.struct(size, -F.col("start")))
    return sharp.groupBy("id", "side").agg(cut.alias("cut")).groupBy("id").agg(*[F.coalesce(F.max(F.when(F.col("side") == k, F.col("cut"))), F.lit(0)).alias(v) for k, v in enumerate(("left", "right"))])


def border_bounds(pixels: DataFrame, dark: Column, width: int, height: int, reach: float = 0.15, share: float = 0.35, least: float = 0.02, most: float = 0.1, drop: float = 0.4, stands_out: float = 0.5, edge: int = 2, passes: int = 5) -> DataFrame:
    """(id, x0, x1, y0, y1): what stays after up to ``passes`` of ``border_pass``, each on what the last one left, and of the height
    of rasters that were cut: runs of rows wholly within 0.3 of an edge go, but no more than 0.2 of the inked height per
    edge, and the edges are tightened. Columns keep their coverage while others are cut, so all passes read one small table."""
    px = pixels.select("id", "x", "y", dark.alias("ink"))
    cov = materialise(projection(px, "x", F.col("ink")))
    state = cov.select("id").distinct().select("id", F.lit(0).alias("lo"), F.lit(width).alias("hi"), F.lit(True).alias("more"))
    for _ in range(passes):
        cuts = border_pass(cov, state.where("more").drop("more"), reach, share, least, most, drop, stands_out, edge)
        w = F.col("hi") - F.col("lo")
        xl, right = F.least(w - 1, F.coalesce("left", F.lit(0))), F.coalesce("right", F.lit(0))
        moved = state.join(cuts, "id", "left").select("id", (F.col("lo") + xl).cast("int").alias("lo"), (F.col("lo") + F.greatest(xl + 1, w - right)).cast("int").alias("hi"), F.col("left").isNotNull().alias("more"))
        state = checkpoint(moved)
        if not state.where("more").limit(1).count():
            break
    cut = state.where((F.col("lo") > 0) | (F.col("hi") < width)).select("id", "lo", "hi")
    rows = projection(px.join(cut, "id").where("x >= lo and x < hi"), "y", F.col("ink"))
    rows = rows.join(rows.groupBy("id").agg(F.max("coverage").alias("top")), "id")
    near, far = int(height * 0.3), height - int(height * 0.3)
    b = dark_runs(rows, "y", F.greatest(F.lit(0.001), 0.01 * F.col("top"))).groupBy("id").agg(
        F.min("start").alias("begin"), F.max("stop").alias("end"), F.coalesce(F.min(F.when(F.col("stop") > near, F.col("start"))), F.max("start")).alias("a"), F.coalesce(F.max(F.when(F.col("start") < far, F.col("stop"))), F.max("stop")).alias("b")
    )
    free = F.floor((F.col("end") - F.col("begin")) * F.lit(0.2))
    b = b.select("id", (F.col("begin") + F.least(free, F.col("a") - F.col("begin"))).alias("lo"), (F.col("end") - F.least(free, F.col("end") - F.col("b"))).alias("hi"))
    tight = tightened(b, rows, "y", height, F.col("coverage") > F.greatest(F.lit(0.005), 0.005 * F.col("top"))).withColumnsRenamed({"lo": "y0", "hi": "y1"})
    return state.join(tight, "id", "left").select("id", F.col("lo").alias("x0"), F.col("hi").alias("x1"), F.coalesce("y0", F.lit(0)).alias("y0"), F.coalesce("y1", F.lit(height)).alias("y1"))


def frame_pixels(pixels: DataFrame, dark: Column, width: int, height: int, length: float = 0.7, margin: int = 1, most: float = 0.5) -> DataFrame:
    """(id, x, y) of the pixels of frames: rows and columns near an edge with a dark run of ``length`` of the raster, where such a row
    and such a column cross. A raster of whose ink more than ``most`` would go keeps all."""
    ink = pixels.where(dark).select("id", "x", "y")

    def lines(along: str, across: str, size: int, extent: int) -> DataFrame:
        r = ink.withColumn("g", F.col(along) - F.row_number().over(Window.partitionBy("id", across).orderBy(along))).groupBy("id", across, "g").agg(F.min(along).alias("a"), F.max(along).alias("b"))
        long = r.where((F.col("b") - F.col("a") + 1 >= size * length) & ((F.col(across) <= margin) | (F.col(across) >= extent - 1 - margin)))
        return long.select("id", across, F.col("a").alias(f"{along}0"), F.col("b").alias(f"{along}1"))

    rows, cols = lines("x", "y", width, height), lines("y", "x", height, width)
    cross = rows.join(cols, "id").where((F.col("x").between(F.col("x0"), F.col("x1"))) & (F.col("y").between(F.col("y0"), F.col("y1"))))
    across = cross.select("id", "y", F.explode(F.sequence("x0", "x1")).alias("x")).select("id", "x", "y")
    down = cross.select("id", "x", F.explode(F.sequence("y0", "y1")).alias("y"))
    frame = across.unionByName(down).distinct()
    share = ink.groupBy("id").agg(F.count(F.lit(1)).alias("n")).join(frame.groupBy("id").agg(F.count(F.lit(1)).alias("f")), "id").where(F.col("f") <= most * F.col("n"))
    return frame.join(share.select("id"), "id", "left_semi")


def stroke_distance(pixels: DataFrame, strokes: DataFrame) -> DataFrame:
    """``pixels`` with ``d2``: the squared distance to the nearest of ``strokes`` (id, x, y) in the same raster, null without any. Within
    columns the nearest stroke above and below comes from running maxima and minima; along a row each pixel then meets one
    candidate per column, so that no raster is collected."""
    cells = pixels.select("id", "x", "y").distinct().join(strokes.select("id", "x", "y").distinct().withColumn("__s", F.lit(True)), ["id", "x", "y"], "left")
    col = Window.partitionBy("id", "x").orderBy("y")
    at = F.when(F.col("__s"), F.col("y"))
    above = F.max(at).over(col.rowsBetween(Window.unboundedPreceding, 0))
    below = F.min(at).over(col.rowsBetween(0, Window.unboundedFollowing))
    near = F.least(F.col("y") - above, below - F.col("y"))  # least leaves nulls out
    columns = cells.select("id", "y", F.col("x").alias("__x"), near.alias("__dy")).where("__dy is not null")
    along = F.col("x") - F.col("__x")
    best = pixels.select("id", "x", "y").distinct().join(columns, ["id", "y"]).groupBy("id", "x", "y").agg(F.min(along * along + F.col("__dy") * F.col("__dy")).alias("d2"))
    return pixels.join(best, ["id", "x", "y"], "left")


def noise_scores(pixels: DataFrame, width: int, dark: int, light: int, areas: tuple[int, int] = (2, 200_000), stroke: int = 6) -> tuple[DataFrame, DataFrame]:
    """Components of mid-gray pixels (above ``dark``, below ``light``) and what speaks for noise, and their pixels.

    The first table has (id, label, area, aspect, near, spread, score, noise): the box's aspect, the mean distance of the pixels to
    the nearest dark stroke and that distance's variation by its mean. Dark components of fewer than ``stroke`` pixels are no strokes.
    The score is 0.4 of how compact it is (aspect from 5 down to 2) and 0.6 of how far and how unevenly it lies (1.5 to 2 pixels,
    variation 0.2 to 0.25, half each, all of it without any stroke); from 0.4 on it is noise. Components with an area outside
    ``areas`` are kept whatever their score. The second has (id, label, x, y, gray, d) of their pixels."""
    mid = (F.col("gray") > dark) & (F.col("gray") < light)
    ink = labelled(pixels, F.col("gray") <= dark, width).select("id", "label", "x", "y")
    strokes = ink.join(ink.groupBy("id", "label").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= stroke), ["id", "label"])
    found = labelled(pixels, mid, width).select("id", "label", "x", "y")
    far_ = stroke_distance(pixels, strokes).select("id", "x", "y", "gray", F.sqrt("d2").alias("d"))
    named = materialise(found.join(far_, ["id", "x", "y"]).select("id", "label", "x", "y", "gray", "d"))
    w, h = F.max("x") - F.min("x") + 1, F.max("y") - F.min("y") + 1
    parts = named.groupBy("id", "label").agg(F.count(F.lit(1)).alias("area"), (F.greatest(w, h) / F.least(w, h)).alias("aspect"), F.avg("d").alias("near"), (F.stddev_pop("d") / (F.avg("d") + 1)).alias("spread"))
    ramp = lambda v, lo, hi: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.round(v, 9) - lo) / (hi - lo)))
    far = F.when(F.col("near").isNull(), 1.0).otherwise(0.5 * ramp(F.col("near"), 1.5, 2.0) + 0.5 * ramp(F.col("spread"), 0.2, 0.25))
    score = F.round(0.4 * (1 - ramp(F.col("aspect"), 2.0, 5.0)) + 0.6 * far, 6)
    return parts.withColumn("score", score).withColumn("noise", (F.col("score") >= 0.4) & F.col("area").between(*areas)), named


def background(pixels: DataFrame, parts: DataFrame, radius: int = 8, light: int = 150, default: int = 245) -> DataFrame:
    """(id, label, background): the median gray, rounded down, of the light pixels within ``radius`` of a component (id, label, x, y) and
    not of it; of all such pixels where none is light, and ``default`` where there are none."""
    disc = [(dx, dy) for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1) if dx * dx + dy * dy <= radius * radius]
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in disc])
    own = parts.select("id", "label", "x", "y").distinct()
    around = own.select("id", "label", (F.col("x")).alias("__x"), F.col("y").alias("__y"), F.explode(steps).alias("s")).select("id", "label", (F.col("__x") + F.col("s.dx")).alias("x"), (F.col("__y") + F.col("s.dy")).alias("y")).distinct()
    ring = materialise(around.join(own, ["id", "label", "x", "y"], "left_anti").join(pixels.select("id", "x", "y", "gray"), ["id", "x", "y"]).select("id", "label", "gray"))
    middle = lambda rows, out: quantiles(rows, ["id", "label"], "gray", (0.5,)).select("id", "label", F.floor(F.col("q")[0]).cast("int").alias(out))
    all_ = own.select("id", "label").distinct().join(middle(ring.where(F.col("gray") >= light), "__light"), ["id", "label"], "left").join(middle(ring, "__any"), ["id", "label"], "left")
    return all_.select("id", "label", F.coalesce("__light", "__any", F.lit(default)).alias("background"))


def without_noise(pixels: DataFrame, width: int, dark: int, light: int, keep: float = 3.0, radius: int = 8, bright: int = 150, areas: tuple[int, int] = (2, 200_000), stroke: int = 6) -> DataFrame:
    """(id, x, y, gray, new): the pixels of noise that are ``keep`` or farther from the nearest stroke (all of them without one), and the
    background that takes their place."""
    scores, named = noise_scores(pixels, width, dark, light, areas, stroke)
    noise = materialise(named.join(scores.where("noise").select("id", "label"), ["id", "label"], "left_semi"))
    gone = noise.where(F.col("d").isNull() | (F.col("d") >= keep))
    return gone.join(background(pixels, noise, radius, bright), ["id", "label"]).select("id", "x", "y", "gray", F.col("background").alias("new"))


def local_ink(pixels: DataFrame, radius: int = 1, less: int = 2) -> DataFrame:
    """(id, x, y, ink): is a pixel darker than the mean of the pixels within ``radius`` of it, itself included, by more than ``less``? Beyond
    the raster there is nothing. Each pixel hands its gray to its neighbours, so that sums are aggregates."""
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1)])
    given = pixels.select("id", F.col("x").alias("__x"), F.col("y").alias("__y"), "gray", F.explode(steps).alias("s")).select("id", (F.col("__x") + F.col("s.dx")).alias("x"), (F.col("__y") + F.col("s.dy")).alias("y"), F.col("gray").alias("__g"))
    mean = given.groupBy("id", "x", "y").agg(F.sum("__g").alias("__s"), F.count(F.lit(1)).alias("__n"))
    return pixels.join(mean, ["id", "x", "y"]).select("id", "x", "y", ((F.col("gray") + less) * F.col("__n") < F.col("__s")).alias("ink"))
