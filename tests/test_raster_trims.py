"""Whole trims and noise scores of rasters against loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.operators import raster

EPS = 1e-9


def rows_of(spark, grids):
    return spark.createDataFrame([(i, x, y, int(v)) for i, g in enumerate(grids) for (y, x), v in np.ndenumerate(g)], "id bigint, x int, y int, gray int")


def cut(p, w, top, reach_all, edge):
    """Length of the cut from the edge at p[0], with the run's start and stop; p is the window seen from that edge."""
    best, found, start = 0, 0, -1
    short = max(1, int(w * 0.02))
    longest = max(short, int(w * 0.1))
    for i, v in enumerate(p):
        if v >= 0.35 * top:
            start = i if start < 0 else start
        elif start >= 0:
            n, mean, after = i - start, p[start:i].mean(), p[i : i + i - start].mean()
            if start <= edge and short <= n <= longest and mean - after >= 0.4 * top - EPS and mean - after >= mean * 0.5 - EPS and n > best:
                best, found = n, (i if reach_all == "left" else start + 1)
            start = -1
    return found


def border(ink):
    h, w = ink.shape
    lo, hi = 0, w
    for _ in range(5):
        p = ink[:, lo:hi].mean(axis=0)
        n, limit = hi - lo, int((hi - lo) * 0.15)
        if p.max() <= 0:
            break
        left, right = cut(p[:limit], n, p.max(), "left", 2), cut(p[::-1][: limit or n], n, p.max(), "right", 2)
        if not left and not right:
            break
        xl = min(n - 1, left)
        lo, hi = lo + xl, lo + max(xl + 1, n - right)
    if (lo, hi) == (0, w):
        return 0, w, 0, h
    c = ink[:, lo:hi].mean(axis=1)
    runs = runs_of(c, max(0.001, 0.01 * c.max()))
    if not runs:
        return lo, hi, 0, h
    near = int(h * 0.3)
    a = next((r[0] for r in runs if r[1] > near), runs[-1][0])
    b = next((r[1] for r in reversed(runs) if r[0] < h - near), runs[-1][1])
    begin, end = runs[0][0], runs[-1][1]
    free = int((end - begin) * 0.2)
    return lo, hi, *tight(c, begin + min(free, a - begin), end - min(free, end - b), max(0.005, 0.005 * c.max()))


def runs_of(c, above):
    runs, start = [], -1
    for i, v in enumerate([*c, -1]):
        if v > above:
            start = i if start < 0 else start
        elif start >= 0:
            runs.append((start, i))
            start = -1
    return runs


def tight(c, lo, hi, above):
    while lo < len(c) and c[lo] <= above:
        lo += 1
    while hi > 0 and c[hi - 1] <= above:
        hi -= 1
    lo = min(len(c) - 1, lo)
    return lo, max(lo + 1, min(len(c), hi))


def axis(c, reach, most, least=(0.005, 0.01), above=0.01):
    n = len(c)
    if c.max() <= 0:
        return 0, n
    runs = runs_of(c, max(least[0], least[1] * c.max()))
    if not runs:
        lo = min(n - 1, round(n * most[0]))
        return lo, max(lo + 1, n - round(n * most[1]))
    lo = next((s for s, e in runs if not (e <= round(n * reach[0]) and e - s <= n * most[0])), runs[-1][1])
    hi = next((e for s, e in reversed(runs) if not (s >= n - round(n * reach[1]) and e - s <= n * most[1])), runs[0][0])
    return tight(c, lo, hi, above)


def trim(ink, *levels):
    x0, x1 = axis(ink.mean(axis=0), (0.3, 0.3), (0.25, 0.25), *levels)
    return x0, x1, *axis(ink[:, x0:x1].mean(axis=1), (0.3, 0.5), (0.25, 0.3), *levels)


def drawn(n=60, h=30, w=40, seed=3):
    """Glyphs in the middle, lines and blots at the sides and ends; 0 is ink."""
    rng = np.random.default_rng(seed)
    out = [np.full((h, w), 9)]
    for _ in range(n):
        g = np.full((h, w), 9)
        g[8:22, 12:28] = np.where(rng.random((14, 16)) < 0.4, 0, 9)
        for _ in range(rng.integers(0, 4)):
            x = rng.choice([*range(0, 5), *range(w - 5, w)])
            g[rng.integers(0, 6) : h - rng.integers(0, 6), x : x + rng.integers(1, 3)] = 0
        for _ in range(rng.integers(0, 3)):
            y, x = rng.integers(0, h), rng.integers(0, w - 8)
            g[y, x : x + 8] = 0
        out.append(g)
    return out


def bounds(df):
    return {r.id: (r.x0, r.x1, r.y0, r.y1) for r in df.collect()}


def test_border_bounds(spark):
    grids = drawn()
    want = {i: border(g == 0) for i, g in enumerate(grids)}
    assert bounds(raster.border_bounds(rows_of(spark, grids), F.col("gray") < 5, 40, 30)) == want
    assert len(set(want.values())) > 10


def test_second_border_goes(spark):
    g = np.full((30, 40), 9)
    g[:, 0] = g[:, 3] = 0  # two lines of the same length
    g[10:20, 15:25] = 0
    g[0:2, 15:25] = 0
    x0, x1, y0, _ = bounds(raster.border_bounds(rows_of(spark, [g]), F.col("gray") < 5, 40, 30))[0]
    assert (x0, x1) == (4, 40)
    assert y0 > 0


def test_projection_bounds(spark):
    faint = np.full((300, 40), 9)
    faint[150, 20] = 0  # ink below every limit: cut to the limits
    assert bounds(raster.projection_bounds(rows_of(spark, [faint]), F.col("gray") < 5, 40, 300)) == {0: trim(faint == 0)}
    assert trim(faint == 0)[:2] == (10, 30)
    grids = drawn(seed=4)
    for levels in ((), ((0.1, 0.01), 0.2)):
        assert bounds(raster.projection_bounds(rows_of(spark, grids), F.col("gray") < 5, 40, 30, *levels)) == {i: trim(g == 0, *levels) for i, g in enumerate(grids)}


@pytest.mark.parametrize(("areas", "noise"), [((2, 10), [False, True]), ((1, 10), [True, True]), ((2, 3), [False, False])])
def test_noise_areas(spark, areas, noise):
    g = np.full((12, 12), 9)
    g[0, 0] = 5
    g[9:11, 9:11] = 5
    got = raster.noise_scores(rows_of(spark, [g]), 12, 2, 8, areas)[0].orderBy("area").collect()
    assert [(r.area, r.score) for r in got] == [(1, 1.0), (4, 1.0)]  # without strokes the distance counts in full
    assert [r.noise for r in got] == noise


def test_specks_are_no_strokes(spark):
    g = np.full((12, 12), 9)
    g[0, 0:6] = 0
    g[8, 8] = 0  # a speck beside the patch
    g[9:11, 9:11] = 5
    assert raster.noise_scores(rows_of(spark, [g]), 12, 2, 8)[0].head().near > 8
    assert raster.noise_scores(rows_of(spark, [g]), 12, 2, 8, stroke=0)[0].head().near == pytest.approx((2**0.5 + 2 * 5**0.5 + 8**0.5) / 4)


def test_distance_and_background_against_loops(spark):
    rng = np.random.default_rng(11)
    grids = [rng.integers(0, 256, (14, 17)) for _ in range(5)] + [np.full((14, 17), 200)]
    px = rows_of(spark, grids)
    strokes = px.where("gray < 20").select("id", "x", "y")
    got = {(r.id, r.x, r.y): r.d2 for r in raster.stroke_distance(px, strokes).collect()}
    for i, g in enumerate(grids):
        ink = np.argwhere(g < 20)
        for y in range(14):
            for x in range(17):
                want = min(((ink - (y, x)) ** 2).sum(1)) if len(ink) else None
                assert got[i, x, y] == want
    parts = px.where("gray between 60 and 90").selectExpr("id", "x div 6 as label", "x", "y")
    ground = {(r.id, r.label): r.background for r in raster.background(px, parts, 2, 150).collect()}
    assert set(ground) == {(i, x // 6) for i, g in enumerate(grids) for y, x in np.argwhere((g >= 60) & (g <= 90))}
    for (i, label), level in ground.items():
        g = grids[i]
        own = {(y, x) for y, x in np.argwhere((g >= 60) & (g <= 90)) if x // 6 == label}
        ring = [int(g[y, x]) for y in range(14) for x in range(17) if (y, x) not in own and any((y - a) ** 2 + (x - b) ** 2 <= 4 for a, b in own)]
        light = [v for v in ring if v >= 150]
        assert level == int(np.median(light or ring or [245]))
