"""Core operators on small cases worked by hand or by brute force."""

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.functions import scalars as S
from inkwell.operators import boxes, raster, resampling, trends
from inkwell.operators import slopes as S_
from inkwell.operators import review_state as RS
from inkwell.plans import trends as plans
from inkwell.plans.relational import common, trimmed

from .oracle import SF


def one(spark, expr, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(v for v, _ in values.values())], ", ".join(f"{n} {values[n][1]}" for n in names))
    return df.select(expr).head()[0]


@pytest.mark.parametrize(("path", "volume"), [("册01_pages/page_001.png", 1), ("册12/image.jpg", 12), ("book_vol03.png", 3), ("第5册/x", 5), ("b/V7/x", 7), ("none", None), (None, None)])
def test_volume_number(spark, path, volume):
    assert one(spark, S.volume_number(F.col("p")), p=(path, "string")) == volume


def test_instance_ids(spark):
    made = S.make_instance_id(F.col("v"), F.col("p"), F.col("i"))
    assert one(spark, made, v=(2, "int"), p=("page_0017", "string"), i=(156, "int")) == "册02_page0017_idx156"
    assert one(spark, made, v=(None, "int"), p=("page_0017", "string"), i=(156, "int")) is None
    back = one(spark, S.parse_instance_id(F.col("t")), t=("册02_page0017_idx156", "string"))
    assert (back.volume, back.page, back.idx) == (2, "0017", 156)
    assert one(spark, S.parse_instance_id(F.col("t")), t=("x", "string")) is None


def test_small_scalars(spark):
    assert one(spark, S.preprocessed_path(F.col("t")), t=("/v/data/raw/书/册01_pages/page_0001.png", "string")) == "data/results/preprocessed/书/册01_pages/page_0001_preprocessed.png"
    assert one(spark, S.min_confidence(F.col("t")), t=(75.0, "double")) == 0.75
    assert one(spark, S.min_confidence(F.col("t")), t=(float("nan"), "double")) == 0.75
    assert one(spark, S.min_confidence(F.col("t")), t=(-1.0, "double")) == 0.0
    assert one(spark, S.lenient_int(F.col("t")), t=(" 12 ", "string")) == 12
    assert one(spark, S.lenient_int(F.col("t")), t=("x", "string")) == 0
    assert one(spark, S.strip_all_space(F.col("t")), t=(" a　b\x1c\n", "string")) == "ab"
    assert one(spark, S.style_tags(F.col("t")), t=("近欧型、 扁方/；", "string")) == ["近欧型", "扁方"]
    assert one(spark, S.style_tags(F.col("t")), t=(None, "string")) == ["（空）"]
    p = one(spark, S.book_prefix(F.col("t")), t=("04_1131_x_y", "string"))
    assert (p.ord, p.year, p.rest) == (4, 1131, "x_y")
    assert one(spark, S.styles_by_region(F.col("t")), t=("a:x|y;b:z", "string")) == {"a": ["x", "y"], "b": ["z"]}
    rgb = one(spark, S.hex_rgb(F.col("t")), t=("#0a10ff", "string"))
    assert (rgb.r, rgb.g, rgb.b) == (10, 16, 255)
    assert one(spark, S.hex_rgb(F.col("t")), t=("#12", "string")) is None
    assert one(spark, S.axis_overlap(F.lit(0), F.lit(10), F.lit(5), F.lit(5)), t=(1, "int")) == 1.0
    assert one(spark, S.axis_overlap(F.lit(0), F.lit(0), F.lit(5), F.lit(5)), t=(1, "int")) == 0.0
    assert one(spark, S.size_ratio(F.lit(0), F.lit(5)), t=(1, "int")) == float("inf")


def test_states(spark):
    rows = [(1, None, "confirmed", ""), (2, "odd", None, "drop"), (3, "accepted", "dropped", None), (4, "rejected", "pending", "need")]
    n = {r.i: r for r in RS.normalised(spark.createDataFrame(rows, "i int, filter_status string, review_status string, decision string")).collect()}
    assert [(n[i].filter_status, n[i].review_status, n[i].decision) for i in (1, 2, 3, 4)] == [("accepted", "confirmed", "need"), ("pending", "dropped", "drop"), ("accepted", "dropped", "drop"), ("rejected", "pending", "need")]


def test_overlap_pairs_and_groups(spark):
    rng = random.Random(1)
    rows = [(i % 3, 0, rng.randint(0, 900), rng.randint(0, 900), rng.choice([40, 50, 500, 800, 3000]), rng.choice([40, 50, 300]), i) for i in range(300)]
    rows += [(0, 0, 10, 10, 50, 50, 1000), (0, 0, 20, 10, 50, 50, 1001), (0, 0, 30, 10, 50, 50, 1002), (0, 0, 10, 10, 80, 80, 1003), (0, 0, 10, 10, 81, 50, 1004)]
    df = spark.createDataFrame(rows, "k1 bigint, k2 bigint, x bigint, y bigint, w bigint, h bigint, rep bigint")
    want = set()
    for a in rows:
        for b in rows:
            if a[6] < b[6] and a[0] == b[0]:
                good = True
                for p, s in ((2, 4), (3, 5)):
                    small, large = sorted((a[s], b[s]))
                    good &= min(a[p] + a[s], b[p] + b[s]) - max(a[p], b[p]) >= 0.8 * small and large <= 1.6 * small
                if good:
                    want.add((a[6], b[6]))
    got = [tuple(r) for r in boxes.overlap_pairs(df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want
    assert (1000, 1002) not in want
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in want:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    groups = {r.node: r.first for r in boxes.linked_groups(boxes.overlap_pairs(df)).collect()}
    assert groups == {k: find(k) for k in parent}
    assert boxes.linked_groups(boxes.overlap_pairs(df.limit(0))).count() == 0


def test_common_and_trim(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 1), ("c", 1), ("c", 3)], "g string, k int")
    assert [r.k for r in common(df, "g", "k").collect()] == [1]
    v = spark.createDataFrame([("a", float(i)) for i in range(20)] + [("b", 1.0), ("b", 100.0)], "g string, v double")
    kept = trimmed(v, ["g"], "v", 0.05).collect()
    assert sorted(r.v for r in kept if r.g == "a") == [float(i) for i in range(1, 19)]
    assert sum(r.g == "b" for r in kept) == 2


def test_trends_against_loops(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(g, i, float(rng.integers(0, 3 * g + 4) if g % 2 else i), float(rng.integers(0, 6))) for g in range(6) for i in range(g * 6)]
    rows += [(9, i, float(i), float(i % 2)) for i in range(2)]
    df = spark.createDataFrame(rows, "g int, p int, x double, y double")
    monkeypatch.setattr(trends, "BLOCK", 4)
    counts = trends.pair_counts(df, ["g"])
    got = {r.g: r for r in counts.withColumn("t", trends.tau_of_counts(True)).withColumn("b", trends.tau_of_counts(False)).collect()}
    slope = {r.g: r.slope for r in trends.theil_sen(df, ["g"]).collect()}
    rho = {r.g: (r.rho, r.p) for r in trends.spearman(df, ["g"]).withColumn("p", trends.rho_p(F.col("rho"), F.col("n"))).collect()}
    loo = {(r.g, r.p): r.delta for r in trends.leave_one_out(df, ["g"], "p").collect()}
    assert not any(g == 9 for g, _ in loo)
    for g in range(1, 6):
        x, y = (np.array([r[k] for r in rows if r[0] == g]) for k in (2, 3))
        i, j = np.triu_indices(len(x), 1)
        dx, dy = x[j] - x[i], y[j] - y[i]
        assert (got[g].concordant, got[g].discordant, got[g].tied_both) == ((dx * dy > 0).sum(), (dx * dy < 0).sum(), ((dx == 0) & (dy == 0)).sum())
        assert (got[g].tied_x, got[g].tied_y) == (((dx == 0) & (dy != 0)).sum(), ((dx != 0) & (dy == 0)).sum())
        assert got[g].t == pytest.approx(float(trends._tau(x, y)))
        assert slope[g] == pytest.approx(float(np.median(dy[dx != 0] / dx[dx != 0])))
        r = np.corrcoef(trends.ranks(x), trends.ranks(y))[0, 1]
        assert rho[g] == (pytest.approx(r), pytest.approx(trends.rho_p_value(r, len(x)), abs=1e-12))
        for k in range(len(x)):
            keep = np.arange(len(x)) != k
            assert loo[g, k] == pytest.approx(np.corrcoef(trends.ranks(x[keep]), trends.ranks(y[keep]))[0, 1] - r)


def test_ranks_by_sorting():
    rng = np.random.default_rng(8)
    v = rng.integers(0, 5, (4, 30)).astype(float)
    below, same = (v[:, None, :] < v[:, :, None]).sum(-1), (v[:, None, :] == v[:, :, None]).sum(-1)
    assert np.array_equal(trends.ranks(v), below + (same + 1) / 2.0)


def test_resampling_by_hash(spark):
    rng = np.random.default_rng(3)
    rows = [("up", float(i), i + float(rng.normal())) for i in range(25)] + [("noise", float(i), float(rng.normal())) for i in range(25)] + [("short", 1.0, 1.0), ("short", 2.0, 2.0)] + [("flat", float(i), 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    drawn = trends.replicates(df, "g", "t", 20).groupBy("g", "r").count().collect()
    assert {(r.g, r["count"]) for r in drawn} == {("up", 25), ("noise", 25), ("flat", 5)}
    mixed = trends.replicates(df, "g", "t", 5, shuffled=True).where("g = 'up'").groupBy("r").agg(F.sort_array(F.collect_list("y")).alias("y"), F.sort_array(F.collect_list("x")).alias("x")).collect()
    assert all(r.y == sorted(y for g, _, y in rows if g == "up") and r.x == [float(i) for i in range(25)] for r in mixed)
    ci = {r.g: (r.rho_ci_lo, r.rho_ci_hi) for r in trends.rho_interval(df, "g", 200).collect()}
    assert 0.9 < ci["up"][0] <= ci["up"][1] <= 1
    assert ci["noise"][0] < 0.3 and ci["noise"][1] > -0.3
    tau = {r.g: (r.tau_ci_lo, r.tau_ci_hi) for r in trends.tau_interval(df, "g", 100).collect()}
    assert tau["up"][0] > 0.7
    p = {r.g: r.p_tau for r in trends.tau_permutation_p(df, "g", 200).collect()}
    assert p["up"] == pytest.approx(1 / 201)
    assert p["noise"] > 0.02
    assert p["short"] is None and p["flat"] is None


def test_trend_bundle(spark):
    x = np.arange(30.0)
    up, down = trends.trend(x, x * 2), trends.trend(x, -x)
    assert (up["rho"], up["p_rho"], up["tau"], up["p_tau"]) == (pytest.approx(1), 0.0, pytest.approx(1), pytest.approx(1 / 401))
    assert down["rho"] == pytest.approx(-1)
    assert trends.robust_slope(x, np.where(x == 7, 500, 3 * x)) == pytest.approx(3, abs=1e-2)
    assert trends.robust_slope(x, np.where(x == 7, 500, 3 * x), "bisquare") == pytest.approx(3, abs=1e-6)
    rng = np.random.default_rng(1)
    y = rng.normal(size=30)
    a, b = trends.trend(x, y), trends.trend(x, y)
    assert a == b
    assert a["rho_ci_lo"] <= a["rho"] <= a["rho_ci_hi"]
    assert 1 / 401 <= a["p_tau"] <= 1
    df = spark.createDataFrame([("s", float(i), float(v)) for i, v in zip(x, y, strict=True)] + [("short", 1.0, 2.0), ("flat", 1.0, 1.0), ("flat", 2.0, 1.0), ("flat", 3.0, 1.0)], "g string, x double, y double")
    got = {r.g: r for r in trends.seeded_trends(df, "g").collect()}
    assert got["s"].rho == pytest.approx(a["rho"])
    assert got["short"].rho is None
    assert got["flat"].rho is None
    assert got["flat"].tau is None


def image(spark, grid, i=1):
    return spark.createDataFrame([(i, x, y, v) for y, line in enumerate(grid) for x, v in enumerate(line)], "id bigint, x int, y int, gray int")


def test_components_and_tiers(spark):
    grid = [[0, 9, 9, 9, 9, 9], [9, 0, 9, 9, 9, 9], [9, 9, 9, 0, 0, 9], [9, 9, 9, 0, 0, 9], [9, 9, 9, 9, 9, 9], [9, 9, 9, 9, 9, 9]]
    parts = raster.components(image(spark, grid), F.col("gray") < 5, 6)
    assert sorted((r.label % 36, r.x, r.y, r.w, r.h, r.area) for r in parts.collect()) == [(0, 0, 0, 2, 2, 2), (15, 3, 2, 2, 2, 4)]
    tiers = {r.area: (r.tier, r.reason) for r in raster.classified(parts, 6, 6, shares=(0.1, 0.01, 0.01)).collect()}
    assert tiers == {2: ("border_touch", "area"), 4: ("edge_zone", None)}


def test_trim_and_otsu(spark):
    grid = [[0, 9, 9, 0, 0, 0, 0, 9, 9, 0]] * 4
    px = image(spark, grid)
    cov = raster.projection(px, "x", F.col("gray") < 5)
    assert [(r.lo, r.hi) for r in raster.projection_trim(cov, "x", 10).collect()] == [(3, 7)]
    blank = raster.projection(image(spark, [[9] * 10]), "x", F.col("gray") < 5)
    assert [(r.lo, r.hi) for r in raster.projection_trim(blank, "x", 10).collect()] == [(0, 10)]
    assert raster.otsu(px).head().threshold == 0
    assert raster.otsu(image(spark, [[7, 7]])).head().threshold == 7


def test_quantiles(spark):
    from inkwell.operators.global_sort import quantiles

    rng = np.random.default_rng(5)
    rows = [(str(rng.integers(0, 3)), float(v)) for v in np.round(rng.normal(size=500), 1)] + [("one", 2.0), ("none", None), (None, 1.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    at = (0.0, 0.1, 0.5, 0.9, 1.0)
    linear = {r.g: r for r in quantiles(df, ["g"], "v", at).collect()}
    nearest = {r.g: r for r in quantiles(df, ["g"], "v", at, nearest=True).collect()}
    assert set(linear) == {"0", "1", "2", "one", None}
    for g, r in linear.items():
        v = sorted(x for k, x in rows if k == g and x is not None)
        assert r.n == len(v)
        assert np.allclose(r.q, np.quantile(v, at))
        assert nearest[g].q == [v[max(0, int(np.ceil(p * len(v) - 1e-12)) - 1)] for p in at]


def test_resampled_statistics_are_those_of_the_resamples(spark, monkeypatch):
    """Counted, not built: the rows of ``replicates`` must give the same statistics, whatever the blocks; a key of two blocks of MD5."""
    monkeypatch.setattr(resampling, "BLOCK_DRAWS", 100)
    rng = np.random.default_rng(5)
    long = "长" * 40
    rows = [(g, float(rng.integers(0, kx)), float(rng.integers(0, ky))) for g, n, kx, ky in (("a", 120, 40, 50), (long, 13, 3, 200), ("b", 11, 200, 2), ("flat", 4, 1, 9)) for _ in range(n)] + [("two", 1.0, 1.0), ("two", 2.0, 3.0), (None, 1.0, 2.0), (None, 2.0, 1.0), (None, 3.0, 5.0), (None, 4.0, 4.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    for shuffled in (False, True):
        got = {(r.g, r.r): r for r in resampling.resampled(df, "g", "t", 12, rho=not shuffled, pairs=True, shuffled=shuffled).collect()}
        assert len(got) == 6 + 4 * 12 + 12
        made = trends.replicates(df.where("g is not null"), "g", "t", 12, shuffled=shuffled)
        want = trends.pair_counts(made, ["g", "r"]).join(trends.spearman(made, ["g", "r"]).drop("n"), ["g", "r"]).collect()
        own = trends.pair_counts(df.where("g is not null"), ["g"]).join(trends.spearman(df, ["g"]).drop("n"), ["g"]).withColumn("r", F.lit(0)).collect()
        assert len(want) == 48
        for r in want + own:
            s = got[r.g, r.r]
            assert [s[c] for c in ("n", *resampling.PAIRS)] == [r[c] for c in ("n", *resampling.PAIRS)]
            if not shuffled or r.r == 0:
                assert s.rho == (None if r.rho is None else pytest.approx(r.rho))
    assert resampling.draws("t|" + long, (1, 2), 3)[0, 2] == int(hashlib.md5(f"t|{long}|1|2".encode()).hexdigest()[:12], 16)


def test_intervals_make_no_rows_of_resamples(spark, monkeypatch):
    def never(*a, **k):
        raise AssertionError("resamples as rows")

    monkeypatch.setattr(trends, "replicates", never)
    df = spark.createDataFrame([("a", float(i), float(i * i % 7)) for i in range(20)], "g string, x double, y double")
    r = trends.rho_trends(df, "g", times=30).head()
    assert r.n == 20
    assert r.rho_ci_lo <= r.rho <= r.rho_ci_hi
    tau = trends.tau_interval(df, "g", 30).head()
    assert -1 <= tau.tau_ci_lo <= tau.tau_ci_hi <= 1
    assert 1 / 31 <= trends.tau_permutation_p(df, "g", 30).head().p_tau <= 1
    if os.path.isdir(SF):
        assert plans.group_index_trend(spark, SF).count() > 0


@pytest.mark.parametrize("made", [1 << 21, 50, 3])
def test_median_slope_is_that_of_all_pairs(monkeypatch, made):
    monkeypatch.setattr(S_, "MADE", made)
    monkeypatch.setattr(S_, "DRAWN", 64)
    rng = np.random.default_rng(1)
    for k in range(150):
        n = int(rng.integers(1, 80))
        x = rng.normal(size=n) if k % 5 == 0 else rng.integers(0, (2, 10, 300)[k % 3], n).astype(float)
        y = 2 * x if k % 7 == 0 else np.round(rng.normal(0, (1, 0.001, 0)[k // 3 % 3], n), (6, 1)[k % 2])
        order = np.lexsort((y, x))
        i, j = np.triu_indices(n, 1)
        dx, dy = (v[order][j] - v[order][i] for v in (x, y))
        want = float(np.quantile(dy[dx != 0] / dx[dx != 0], 0.5)) if (dx != 0).any() else None
        assert S_.median_slope(x, y) == (want if want is None else pytest.approx(want, rel=1e-15, abs=1e-15))


def test_theil_sen_of_a_long_series(spark):
    """Half a billion pairs: not to be made."""
    n = 32_000
    df = spark.range(n).selectExpr("1 as g", "cast(id % 320 as double) as x", "id % 320 * 0.25 + pmod(hash(id), 1000) / 1000 as y")
    assert trends.theil_sen(df, ["g"]).head().slope == pytest.approx(0.25, abs=1e-4)
