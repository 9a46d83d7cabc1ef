"""Trend statistics of series: rank correlation, slopes, influence and resampling.

A series is one row per point (group, x, y), one point per book or other entity, never one per raw row: callers aggregate first.
Pairs of points are counted, not built: how many points lie above and to the right of each follows from running counts, one
window per bit of the rank, so that a series costs n log n rows. Leave-one-out correlations follow from those counts and rank
sums. Resamples are drawn by a hash, so that any engine can draw the same; as rows of their own they are ``replicates``, their
statistics come from ``resampling``, where they are counted and never become rows. The draws of a seeded generator, one series per task, are there too (``seeded_trends``)."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.operators.global_sort import numbered, partitions, quantiles
from inkwell.operators.resampling import resampled
from inkwell.operators.slopes import median_slopes
from inkwell.runtime import materialise, small

RESAMPLES = 400


def with_rank(df: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """The mean rank of ``value`` in its group as ``out``; ties share their mean."""
    w = Window.partitionBy(*group).orderBy(value)  # the same sort for both
    return df.withColumn(out, F.rank().over(w) + (F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2.0)


def with_sorted_rank(df: DataFrame, group: list[str], value: str, unique: list[str], out: str) -> DataFrame:
    """The same from one global sort, for groups of any size; ``unique`` are columns that tell rows of a group apart."""
    places = numbered(df, group, [F.col(value).asc(), *[F.col(u).asc() for u in unique]], "__place")
    mean = places.groupBy(*group, F.col(value).alias("__value")).agg(F.avg("__place").alias(out))
    return places.join(mean.withColumnsRenamed({g: f"__{g}" for g in group}), [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group] + [F.col(value).eqNullSafe(F.col("__value"))]).select(*df.columns, out)


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r from sums as an aggregate; null for fewer than two rows or a constant side."""
    n, sx, sy = F.count(F.lit(1)), F.sum(x), F.sum(y)
    cov = n * F.sum(x * y) - sx * sy
    var = (n * F.sum(x * x) - sx * sx) * (n * F.sum(y * y) - sy * sy)
    return F.when((n >= 2) & (var > 1e-9), cov / F.sqrt(F.when(var > 1e-9, var)))


def spearman(df: DataFrame, group: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """group, n, rho: the rank correlation of each series; null for fewer than two points or a constant side."""
    ranked = with_rank(with_rank(df, group, x, "__rx"), group, y, "__ry")
    return ranked.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), correlation(F.col("__rx"), F.col("__ry")).alias("rho"))


def above_right(df: DataFrame, group: list[str], x: str = "x", y: str = "y", out: str = "__more") -> DataFrame:
    """``df`` with the number of points of the series that have a larger x and a larger y. Two ranks differ first in one bit: with the
    points in order of x (and falling y), those with a 0 there count the later ones that have a 1, among the points that agree
    in all higher bits."""
    w = Window.partitionBy(*group)
    ranked = df.withColumns({"__r": F.dense_rank().over(w.orderBy(y)) - 1, "__pos": F.row_number().over(w.orderBy(F.col(x).asc(), F.col(y).desc()))})
    ranked = ranked.withColumn("__top", F.max("__r").over(w))
    bits = F.when(F.col("__top") > 0, F.sequence(F.lit(0), F.floor(F.log2(F.col("__top").cast("double"))).cast("int"))).otherwise(F.array().cast("array<int>"))
    each = ranked.select(*[F.col(f"`{g}`") for g in group], "__r", "__pos", F.explode(bits).alias("__b"))
    each = each.select(*[F.col(f"`{g}`") for g in group], "__pos", "__b", F.expr("shiftright(__r, __b + 1)").alias("__high"), F.expr("shiftright(__r, __b) & 1").alias("__bit"))
    later = Window.partitionBy(*group, "__b", "__high").orderBy(F.col("__pos").desc()).rowsBetween(Window.unboundedPreceding, -1)
    counted = each.withColumn("__n", F.when(F.col("__bit") == 0, F.coalesce(F.sum("__bit").over(later), F.lit(0))).otherwise(F.lit(0)))
    sums = counted.groupBy(*group, "__pos").agg(F.sum("__n").alias(out))
    return ranked.join(sums, [*group, "__pos"], "left").withColumn(out, F.coalesce(out, F.lit(0))).drop("__r", "__pos", "__top")


def pair_counts(df: DataFrame, group: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """group, n, and over all pairs of points: concordant, discordant, tied_x (on x alone), tied_y and tied_both."""
    more = above_right(df.select(*group, x, y), group, x, y).groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sum("__more").alias("concordant"))
    two = F.sum(F.expr("__c * (__c - 1) div 2"))

    def ties(by: list[str], name: str) -> DataFrame:
        return df.groupBy(*group, *by).agg(F.count(F.lit(1)).alias("__c")).groupBy(*group).agg(two.alias(name))

    for by, name in (([x], "__tx"), ([y], "__ty"), ([x, y], "tied_both")):
        more = more.join(ties(by, name), group)
    all_ = F.expr("n * (n - 1) div 2")
    d = all_ - F.col("__tx") - F.col("__ty") + F.col("tied_both") - F.col("concordant")
    return more.select(*group, "n", "concordant", d.alias("discordant"), (F.col("__tx") - F.col("tied_both")).alias("tied_x"), (F.col("__ty") - F.col("tied_both")).alias("tied_y"), "tied_both")


def tau_of_counts(joint: bool) -> Column:
    """Kendall's tau from the counts of ``pair_counts``; with ``joint``, pairs tied on both sides count as ties of either side."""
    both = F.col("tied_both") if joint else F.lit(0)
    c, d = F.col("concordant"), F.col("discordant")
    denominator = F.sqrt((c + d + F.col("tied_x") + both).cast("double") * (c + d + F.col("tied_y") + both))
    return F.when(denominator > 0, F.try_divide((c - d).cast("double"), denominator))


#: Points of a block: two blocks of a series are compared by one key of the join.
BLOCK = 256


def slopes(df: DataFrame, group: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """group, slope: of every pair of points with different x, made block by block, so that no task has a whole series, and never kept
    together. There are n squared: their median is ``theil_sen``, which doesn't make them."""
    w = Window.partitionBy(*group)
    p = df.select(*group, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"), F.row_number().over(w.orderBy(x, y)).alias("__i"), F.count(F.lit(1)).over(w).alias("__n"))
    block, last = F.floor((F.col("__i") - 1) / BLOCK), F.floor((F.col("__n") - 1) / BLOCK)
    mine = [F.col(f"`{g}`") for g in group]
    a = p.select(*mine, block.alias("__a"), F.explode(F.sequence(block, last)).alias("__b"), "__x", "__y", "__i").alias("a")
    b = p.select(*mine, F.explode(F.sequence(F.lit(0).cast("bigint"), block)).alias("__a"), block.alias("__b"), "__x", "__y", "__i").alias("b")
    on = [F.col(f"a.`{g}`").eqNullSafe(F.col(f"b.`{g}`")) for g in group] + [F.col("a.__a") == F.col("b.__a"), F.col("a.__b") == F.col("b.__b"), F.col("a.__i") < F.col("b.__i"), F.col("a.__x") != F.col("b.__x")]
    return a.join(b, on).select(*[F.col(f"a.`{g}`") for g in group], F.try_divide(F.col("b.__y") - F.col("a.__y"), F.col("b.__x") - F.col("a.__x")).alias("slope"))


def theil_sen(df: DataFrame, group: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """group, slope: the median of the slopes of all pairs, which are counted and not made; series without two different x give no row."""
    return median_slopes(df, group, x, y)


def leave_one_out(df: DataFrame, group: list[str], point: str, x: str = "x", y: str = "y") -> DataFrame:
    """group, point, rho without the point less rho of all. Without a point, every rank above it falls by one and every tied
    rank by a half, so that the sums of the n leave-one-out series follow from rank sums above and beside each point and from
    ``above_right``. Series of fewer than three points give no row."""
    w = Window.partitionBy(*group)
    p = df.withColumn("__n", F.count(F.lit(1)).over(w)).where("__n >= 3")
    p = above_right(with_rank(with_rank(p, group, x, "__rx"), group, y, "__ry"), group, x, y)
    upto = lambda v: w.orderBy(v).rangeBetween(Window.unboundedPreceding, 0)
    tied = lambda *v: Window.partitionBy(*group, *v)
    p = p.withColumns(
        {
            "__cx": F.count(F.lit(1)).over(tied(x)), "__cy": F.count(F.lit(1)).over(tied(y)), "__cb": F.count(F.lit(1)).over(tied(x, y)),
            "__y_above": F.rank().over(tied(x).orderBy(F.col(y).desc())) - 1, "__x_above": F.rank().over(tied(y).orderBy(F.col(x).desc())) - 1,
            "__ry_right": F.sum("__ry").over(w) - F.sum("__ry").over(upto(x)), "__rx_above": F.sum("__rx").over(w) - F.sum("__rx").over(upto(y)),
            "__ry_beside": F.sum("__ry").over(tied(x)) - F.col("__ry"), "__rx_beside": F.sum("__rx").over(tied(y)) - F.col("__rx"),
            "__sxx": F.sum(F.col("__rx") * F.col("__rx")).over(w), "__syy": F.sum(F.col("__ry") * F.col("__ry")).over(w), "__sxy": F.sum(F.col("__rx") * F.col("__ry")).over(w),
        }
    )
    n, rx, ry = F.col("__n"), F.col("__rx"), F.col("__ry")

    def square(r: Column, ties: Column, total: Column) -> Column:
        upper = r + (ties - 1) / 2.0  # places up to the point's ties; what is above has the places behind them
        above = (n * (n + 1) - upper * (upper + 1)) / 2.0
        return total - r * r - 2 * (above + 0.5 * (ties - 1) * r) + (n - upper) + 0.25 * (ties - 1)

    both = F.col("__more") + 0.5 * (F.col("__y_above") + F.col("__x_above")) + 0.25 * (F.col("__cb") - 1)
    xy = F.col("__sxy") - rx * ry - (F.col("__rx_above") + 0.5 * F.col("__rx_beside")) - (F.col("__ry_right") + 0.5 * F.col("__ry_beside")) + both
    m = n - 1
    s = m * (m + 1) / 2.0
    vx, vy = m * square(rx, F.col("__cx"), F.col("__sxx")) - s * s, m * square(ry, F.col("__cy"), F.col("__syy")) - s * s
    left = F.when((vx > 1e-9) & (vy > 1e-9), (m * xy - s * s) / F.sqrt(F.when((vx > 1e-9) & (vy > 1e-9), vx * vy)))
    whole = n * (n + 1) / 2.0
    wx, wy = n * F.col("__sxx") - whole * whole, n * F.col("__syy") - whole * whole
    rho = F.when((wx > 1e-9) & (wy > 1e-9), (n * F.col("__sxy") - whole * whole) / F.sqrt(F.when((wx > 1e-9) & (wy > 1e-9), wx * wy)))
    return p.select(*group, point, (left - rho).alias("delta"), rho.alias("rho"))


def rho_p(rho: Column, n: Column) -> Column:
    """Two-sided p of a rank correlation by the normal tail of its t statistic; null for n < 3 or a missing rho. The tail is 1 less a
    series of positive terms, to about 15 digits."""
    z = F.abs(rho) * F.sqrt((n - 2) / F.greatest(F.lit(1e-12), 1 - rho * rho)) / math.sqrt(2)
    start = F.struct(z.alias("t"), z.alias("s"))

    def step(a: Column, k: Column) -> Column:
        t = a["t"] * 2 * z * z / (2 * k + 1)
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    erf = F.aggregate(F.sequence(F.lit(1), F.lit(150)), start, step, lambda a: a["s"]) * F.exp(-z * z) * (2 / math.sqrt(math.pi))
    return F.when((n >= 3) & rho.isNotNull(), F.when((F.abs(rho) >= 1) | (z > 6), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - erf))))


# ---- resampling, drawn by a hash ----


def drawn(tag: str, *parts: Column) -> Column:
    """A whole number below 2 to the 48 from a tag and the parts, by MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(tag), *[p.cast("string") for p in parts])), 1, 12), 16, 10).cast("bigint")


def replicates(df: DataFrame, group: str, tag: str, times: int = RESAMPLES, shuffled: bool = False, x: str = "x", y: str = "y") -> DataFrame:
    """(group, r, x, y): ``times`` resamples of each series, each of as many points. Place k of replicate r has the point number
    ``drawn(tag, group, r, k)`` modulo n, with points numbered by x and y; with ``shuffled`` the xs stay and the ys take the order of
    ``drawn(tag, group, r, number)``."""
    w = Window.partitionBy(group)
    p = df.select(F.col(group), F.col(x).alias("x"), F.col(y).alias("y"), (F.row_number().over(w.orderBy(x, y)) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n")).where("n >= 3")
    # the points are few and lie in a task per series: they are spread before they become many
    each = p.repartition(partitions(df), "i").withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(times))))
    if shuffled:
        order = Window.partitionBy(group, "r").orderBy(drawn(tag, F.col(group), F.col("r"), F.col("i")), "i")
        to = each.select(group, "r", "y", (F.row_number().over(order) - 1).alias("i"))
        return to.join(small(p.select(group, "i", "x")), [group, "i"]).select(group, "r", "x", "y")
    draws = each.select(group, "r", (drawn(tag, F.col(group), F.col("r"), F.col("i")) % F.col("n")).alias("i"))
    return draws.join(small(p.select(group, "i", "x", "y")), [group, "i"]).select(group, "r", "x", "y")


def interval(stats: DataFrame, group: str, value: str, low: str, high: str) -> DataFrame:
    """group, low, high: the 2.5 and 97.5 percentiles of the replicates' statistics that are defined, null for fewer than ten."""
    q = quantiles(stats, [group], value, (0.025, 0.975))
    enough = lambda k: F.when(F.col("n") >= 10, F.col("q")[k])
    return q.select(group, enough(0).alias(low), enough(1).alias(high))


def rho_trends(df: DataFrame, group: str, tag: str = "rho", times: int = RESAMPLES) -> DataFrame:
    """group, n, rho, tau, rho_ci_lo, rho_ci_hi: both correlations of each series, and the interval of rho by ``times`` resamples."""
    stats = materialise(resampled(df, group, tag, times, rho=True))
    own = stats.where("r = 0").select(group, "n", "rho", tau_of_counts(True).alias("tau"))
    return own.join(interval(stats.where("r > 0"), group, "rho", "rho_ci_lo", "rho_ci_hi"), group, "left")


def rho_interval(df: DataFrame, group: str, times: int = RESAMPLES) -> DataFrame:
    """group, rho_ci_lo, rho_ci_hi by ``times`` resamples of the series."""
    return interval(resampled(df, group, "rho", times, rho=True).where("r > 0"), group, "rho", "rho_ci_lo", "rho_ci_hi")


def tau_interval(df: DataFrame, group: str, times: int = RESAMPLES) -> DataFrame:
    """group, tau_ci_lo, tau_ci_hi by ``times`` resamples of the series."""
    taus = resampled(df, group, "tau_ci", times, pairs=True).where("r > 0").withColumn("tau", tau_of_counts(True))
    return interval(taus, group, "tau", "tau_ci_lo", "tau_ci_hi")


def tau_permutation_p(df: DataFrame, group: str, times: int = RESAMPLES) -> DataFrame:
    """group, p_tau: the share of ``times`` shuffled series, and the series itself, whose tau is at least as far from 0; null where tau
    is undefined or for fewer than three points."""
    stats = materialise(resampled(df, group, "tau_p", times, shuffled=True)).withColumn("__tau", F.round(F.abs(tau_of_counts(True)), 12))
    own = stats.where("r = 0").select(group, "n", F.col("__tau").alias("__own"))
    taus = stats.where("r > 0").select(group, "__tau")
    hits = taus.join(own, group).groupBy(group).agg(F.count_if(F.col("__tau") >= F.col("__own")).alias("__hits"))
    defined = (F.col("n") >= 3) & F.col("__own").isNotNull()
    return own.join(hits, group, "left").select(group, F.when(defined, (1 + F.coalesce("__hits", F.lit(0))) / F.lit(float(times + 1))).alias("p_tau"))


# ---- resampling by a seeded generator, within one series ----


def ranks(v: np.ndarray) -> np.ndarray:
    """Mean ranks along the last axis, by sorting."""
    order = np.argsort(v, axis=-1, kind="stable")
    ordered = np.take_along_axis(v, order, -1)
    fresh = np.ones(v.shape, bool)
    fresh[..., 1:] = ordered[..., 1:] != ordered[..., :-1]
    places = np.broadcast_to(np.arange(1, v.shape[-1] + 1), v.shape)
    first = np.maximum.accumulate(np.where(fresh, places, 0), -1)
    ends = np.concatenate([fresh[..., 1:], np.ones((*v.shape[:-1], 1), bool)], -1)
    last = np.minimum.accumulate(np.where(ends, places, v.shape[-1])[..., ::-1], -1)[..., ::-1]
    out = np.empty(v.shape)
    np.put_along_axis(out, order, (first + last) / 2.0, -1)
    return out


def _rho(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    a, b = ranks(x), ranks(y)
    a, b = a - a.mean(-1, keepdims=True), b - b.mean(-1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return (a * b).sum(-1) / np.sqrt((a * a).sum(-1) * (b * b).sum(-1))


def _tau(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    i, j = np.triu_indices(x.shape[-1], 1)
    dx, dy = np.sign(x[..., i] - x[..., j]), np.sign(y[..., i] - y[..., j])
    agree = (dx * dy).sum(-1)
    moved = (dx * dy != 0).sum(-1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return agree / np.sqrt((moved + (dx == 0).sum(-1)) * (moved + (dy == 0).sum(-1)))


def stable_seed(tag: str, x: np.ndarray, y: np.ndarray) -> int:
    """A seed from a tag and the values: 64 bits of a hash over tag, x and y with zero bytes between, its low half."""
    parts = b"\0".join([tag.encode(), np.asarray(x, float).tobytes(), np.asarray(y, float).tobytes()])
    return int.from_bytes(hashlib.blake2b(parts, digest_size=8).digest(), "little") & 0xFFFFFFFF


def rho_p_value(rho: float, n: int) -> float:
    """Two-sided p of a rank correlation by the normal tail of its t statistic; NaN for n < 3 or an undefined rho."""
    if not math.isfinite(rho) or n < 3:
        return math.nan
    if abs(rho) >= 1:
        return 0.0
    t = abs(rho) * math.sqrt((n - 2) / max(1e-12, 1 - rho * rho))
    return min(1.0, max(0.0, math.erfc(t / math.sqrt(2))))


def _interval(stat, x: np.ndarray, y: np.ndarray, seed: int) -> tuple[float, float]:
    n = len(x)
    if n < 3:
        return math.nan, math.nan
    rng = np.random.default_rng(seed)
    draws = np.stack([rng.integers(0, n, size=n) for _ in range(RESAMPLES)])
    got = np.concatenate([stat(x[d], y[d]) for d in np.array_split(draws, 8)])
    got = got[np.isfinite(got)]
    return (float(np.quantile(got, 0.025)), float(np.quantile(got, 0.975))) if len(got) >= 10 else (math.nan, math.nan)


def _permutation_p(x: np.ndarray, y: np.ndarray, tau: float, seed: int) -> float:
    n = len(x)
    if n < 3 or not math.isfinite(tau):
        return math.nan
    rng = np.random.default_rng(seed)
    orders = np.stack([rng.permutation(n) for _ in range(RESAMPLES)])
    got = np.concatenate([_tau(np.broadcast_to(x, o.shape), y[o]) for o in np.array_split(orders, 8)])
    return (1 + int((np.isfinite(got) & (np.abs(got) >= abs(tau))).sum())) / (RESAMPLES + 1)


def trend(x: np.ndarray, y: np.ndarray) -> dict[str, float]:
    """n, rho, its p and interval, tau, its p and interval of one series."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    many = len(x) >= 2
    rho, tau = (float(_rho(x, y)), float(_tau(x, y))) if many else (math.nan, math.nan)
    lo, hi = _interval(_rho, x, y, stable_seed("rho", x, y))
    tlo, thi = _interval(_tau, x, y, stable_seed("tau_ci", x, y))
    p_tau = _permutation_p(x, y, tau, stable_seed("tau_p", x, y))
    return {"n": float(len(x)), "rho": rho, "p_rho": rho_p_value(rho, len(x)), "rho_ci_lo": lo, "rho_ci_hi": hi, "tau": tau, "p_tau": p_tau, "tau_ci_lo": tlo, "tau_ci_hi": thi}


def robust_slope(x: np.ndarray, y: np.ndarray, method: str = "huber", rounds: int = 20) -> float:
    """Slope by iteratively reweighted least squares with Huber's or Tukey's weights; NaN for fewer than two points."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    if len(x) < 2:
        return math.nan
    weight, slope = np.ones(len(x)), math.nan
    for _ in range(rounds):
        if not weight.sum():
            return math.nan
        mx, my = np.average(x, weights=weight), np.average(y, weights=weight)
        spread = float((weight * (x - mx) ** 2).sum())
        slope = float((weight * (x - mx) * (y - my)).sum()) / spread if spread else 0.0
        off = y - my - slope * (x - mx)
        scale = 1.4826 * float(np.median(np.abs(off - np.median(off))))
        if scale <= 1e-12:
            scale = float(off.std()) or 1.0
        u = np.abs(off) / scale
        weight = np.minimum(1.0, 1.345 / np.maximum(u, 1e-300)) if method == "huber" else np.where(u < 4.685, (1 - (u / 4.685) ** 2) ** 2, 0.0)
    return slope


TREND_SCHEMA = "n double, rho double, p_rho double, rho_ci_lo double, rho_ci_hi double, tau double, p_tau double, tau_ci_lo double, tau_ci_hi double, huber double, bisquare double"


def seeded_trends(df: DataFrame, group: str, x: str = "x", y: str = "y") -> DataFrame:
    """One row per series: the statistics of ``trend`` and both robust slopes; undefined ones are null. Points are taken in the
    order of x, then y, since the seeds depend on it. A series is one task's."""
    kind = df.schema[group].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y"])
        a, b = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
        row = trend(a, b) | {"huber": robust_slope(a, b), "bisquare": robust_slope(a, b, "bisquare")}
        return pd.DataFrame([{group: pdf[group].iloc[0]} | {k: v if math.isfinite(v) else None for k, v in row.items()}])

    points = df.select(group, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return points.groupBy(group).applyInPandas(run, f"`{group}` {kind}, {TREND_SCHEMA}")


def robust_slopes(df: DataFrame, group: str, x: str = "x", y: str = "y") -> DataFrame:
    """group, huber, bisquare: robust slopes of each series, null for fewer than two points. Each round reads the series anew, so
    that one task keeps it; its size is that of the points alone."""
    kind = df.schema[group].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y"])
        a, b = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
        found = {m: robust_slope(a, b, m) for m in ("huber", "bisquare")}
        return pd.DataFrame([{group: pdf[group].iloc[0]} | {k: v if math.isfinite(v) else None for k, v in found.items()}])

    points = df.select(group, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return points.groupBy(group).applyInPandas(run, f"`{group}` {kind}, huber double, bisquare double")
