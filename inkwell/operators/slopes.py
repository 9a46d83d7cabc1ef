"""The median of the slopes of all pairs of a series' points (Theil and Sen), without making all pairs.

How many slopes lie below t is the number of pairs that change places between the order of x and that of y - t x, which a merge
counts in n log n. Values of t are brought near the median from both sides until few pairs lie between; those, the pairs that
change places between the two orders, are made, and the median is taken from their own slopes. A series is one task's, a
row per point."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs that are made at a time, and drawn to begin with.
MADE, DRAWN = 1 << 21, 1 << 16


def _levels(ranks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The levels of a merge sort of a permutation: places of the left halves in the order of (part, rank), the same of the right
    ones, and for each right one where its left ones of a larger rank begin and end. Each pair of places meets at one level."""
    n = len(ranks)
    places, of = np.arange(n), np.argsort(ranks)
    size = 1
    while size < n:
        half = places // size
        key = np.sort(half * n + ranks)  # every half by rank
        h, p = key // n, of[key % n]
        left, right = (h & 1) == 0, (h & 1) == 1
        part = h >> 1
        lk = part[left] * n + key[left] % n
        begin = np.searchsorted(lk, part[right] * n + key[right] % n)
        end = np.searchsorted(lk, (part[right] + 1) * n)
        yield p[left], p[right], begin, end
        size *= 2


def _below(ranks: np.ndarray, weight: np.ndarray) -> int:
    """Weighted pairs of places whose ranks are the other way round."""
    total = 0
    for left, right, begin, end in _levels(ranks):
        upto = np.append(0, np.cumsum(weight[left]))
        total += int(weight[right] @ (upto[end] - upto[begin]))
    return total


def _swapped(ranks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Those pairs of places, some at a time."""
    for left, right, begin, end in _levels(ranks):
        many = end - begin
        keep = many > 0
        right, begin, many = right[keep], begin[keep], many[keep]
        upto = np.cumsum(many)
        at = 0
        while at < len(right):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + MADE, side="right")))
            m = many[at:to]
            first = np.repeat(begin[at:to] - (np.cumsum(m) - m), m)
            yield left[first + np.arange(len(first))], np.repeat(right[at:to], m)
            at = to


def _gathered(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different values in order, with their weights."""
    values, weights = np.zeros(0), np.zeros(0, np.int64)

    def merged(v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v, place = np.unique(v, return_inverse=True)
        out = np.zeros(len(v), np.int64)
        np.add.at(out, place, w)
        return v, out

    for v, w in parts:
        values, weights = merged(np.append(values, v), np.append(weights, w))
    return values, weights


def median_slope(x: np.ndarray, y: np.ndarray) -> float | None:
    """The median (the mean of the middle two) of the slopes of all pairs of different x; None if there are none."""
    points, weight = np.unique(np.stack([x, y], 1), axis=0, return_counts=True)
    x, y, weight = points[:, 0], points[:, 1], weight.astype(np.int64)  # by x, then y
    n, number = len(x), int(weight.sum())
    same = np.add.reduceat(weight, np.flatnonzero(np.append(True, x[1:] != x[:-1])))
    total = number * (number - 1) // 2 - int((same * (same - 1) // 2).sum())
    if not total:
        return None
    middle = ((total - 1) // 2, total // 2)
    gap = np.diff(np.unique(x))
    x0 = x - x[n // 2]

    def order(t: float) -> np.ndarray:
        """The points in the order of y - t x."""
        if np.isinf(t):
            return np.lexsort((y, -x if t > 0 else x))
        return np.lexsort((y, y - t * x0))

    def ranks(of: np.ndarray) -> np.ndarray:
        out = np.empty(n, np.int64)
        out[of] = np.arange(n)
        return out

    def count(t: float) -> int:
        """Pairs of a slope below t; slopes that can't be told from t are counted either way."""
        return 0 if t == -np.inf else total if t == np.inf else _below(ranks(order(t)), weight)

    def error(t: float) -> float:
        """How far a slope may lie from t and be counted on the wrong side."""
        return 0.0 if np.isinf(t) else 16 * np.finfo(float).eps * (np.abs(y).max() + abs(t) * np.abs(x0).max()) / gap.min()

    lo, hi, below, upto = -np.inf, np.inf, 0, total

    def narrow(t: float) -> None:
        nonlocal lo, hi, below, upto
        if not lo < t < hi:
            return
        c = count(t)
        if c <= middle[0]:
            lo, below = t, c
        elif c > middle[1]:
            hi, upto = t, c

    if n * (n - 1) // 2 > MADE:
        rng = np.random.default_rng(0)
        drawn = rng.choice(n, (2, DRAWN), p=weight / number)
        dx = x[drawn[1]] - x[drawn[0]]
        sample = np.sort((y[drawn[1]] - y[drawn[0]])[dx != 0] / dx[dx != 0])
        width = max(1, int(2 * np.sqrt(len(sample))))
        while len(sample) and (np.isinf(lo) or np.isinf(hi)) and width < len(sample):
            centre = len(sample) // 2
            narrow(sample[max(0, centre - width)])
            narrow(sample[min(len(sample) - 1, centre + width)])
            width *= 4
        for _ in range(200):
            floor = 64 * max(error(lo), error(hi))
            if upto - below <= MADE or np.isinf(lo) or np.isinf(hi) or hi - lo <= floor:
                break
            # by what is known of the counts, a little to either side of where the median should be; at times the middle
            share, before, was = min(0.98, max(0.02, (sum(middle) / 2 - below) / (upto - below))), (lo, hi), hi - lo
            for t in (lo + was * max(0.01, share - 0.05), before[0] + was * min(0.99, share + 0.05)):
                narrow(t)
            if hi - lo > 0.5 * was:
                t = (lo + hi) / 2
                old = (lo, hi)
                narrow(t)
                if (lo, hi) == old:  # the middle two lie on both sides of t, or are it
                    break

    def slopes_between() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        first = order(lo)
        place = ranks(order(hi))[first]
        for i, j in _swapped(place):
            i, j = first[i], first[j]
            dx = x[j] - x[i]
            keep = dx != 0
            yield (y[j] - y[i])[keep] / dx[keep], (weight[i] * weight[j])[keep]

    widened = 0
    while True:
        values, weights = _gathered(slopes_between())
        ends = np.cumsum(weights) + below
        # at the ends of what was made a slope may have been counted on the wrong side: then more is made
        if len(ends) and below <= middle[0] and ends[-1] > middle[1]:
            a, b = (float(values[np.searchsorted(ends, k, side="right")]) for k in middle)
            if a - lo > error(lo) and hi - b > error(hi):
                return a + (b - a) * 0.5
        width = max(hi - lo, error(lo), error(hi)) * 4 if widened < 6 and not (np.isinf(lo) or np.isinf(hi)) else np.inf
        widened += 1
        lo, hi = lo - width, hi + width
        below = count(lo)


def median_slopes(df: DataFrame, group: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """group, slope: ``median_slope`` of each series; series without two different x give no row. Points that aren't finite are left
    out."""
    keys = [F.col(f"`{g}`") for g in group]
    points = df.select(*keys, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    points = points.where((F.abs("__x") < float("inf")) & (F.abs("__y") < float("inf")))

    def run(t: pa.Table) -> pa.Table:
        slope = median_slope(*(t.column(c).to_numpy() for c in ("__x", "__y")))
        one = t.slice(0, 0 if slope is None else 1).select(group)
        return one.append_column("slope", pa.array([] if slope is None else [slope], pa.float64()))

    kinds = ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in group)
    return points.groupBy(*keys).applyInArrow(run, f"{kinds}, slope double")
