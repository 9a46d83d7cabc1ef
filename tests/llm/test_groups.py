"""Pairs, components, survivors, top n and percentiles against brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import components as C
from inkwell.llm.queries import GROUP, measurements
from inkwell.llm.ranked import first_of_groups, percentiles, value_counts
from inkwell.llm.survivors import OUTWEIGHS, best_of_groups

BOX = "struct<x:int,y:int,width:int,height:int>"
NB = "struct<x:double,y:double,width:double,height:double>"
SCHEMA = f"record_id bigint, book string, std_char string, volume int, page string, char_index int, source_image string, bbox {BOX}, normalized_bbox {NB}, confidence double, loaded_at timestamp_ntz"


def matched(n=700, seed=1, hot=0.35):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rng.random() < hot:
            b, c, v, p = "h", "字", 1, "page_0001"  # one hot page, with many copies of one box
            box = (100, 100, 50, 50) if rng.random() < 0.5 else (rng.randint(0, 1500), rng.randint(0, 1500), rng.randint(1, 400), rng.randint(1, 400))
        else:
            b, c, v, p = rng.choice("ab"), rng.choice("字体"), rng.choice([1, 2, None]), rng.choice(["page_0001", "page_0002", None])
            box = (rng.randint(0, 60), rng.randint(0, 60), rng.choice([0, -3, *range(30, 60)]), rng.randint(30, 60))
        src = rng.choice([f"data/raw/{b}/册01_pages/{p}.png", f"/v/data/results/preprocessed/{b}/册01_pages/{p}_preprocessed.png", f"data/external/{b}/册01_pages/{p}.png", None])
        conf = rng.choice([None, float("nan"), 0.5, 0.9, 90.0, rng.random()])
        nb = rng.choice([None, (0.1, 0.2, 0.3, 0.4)])
        rows.append((i + 1, b, c, v, p, rng.choice([None, 0, 1, 5]), src, rng.choice([None, box, box, box]), nb, conf, rng.choice([None, dt.datetime(2021, 5, rng.randint(1, 28))])))
    return rows


def kind(src):
    return None if src is None else ("ext" if "external" in src else "page")


def brute_groups(rows):
    parent = {r[0]: r[0] for r in rows}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ok = [r for r in rows if r[3] is not None and r[4] is not None and r[6] and r[7] and r[7][2] > 0 and r[7][3] > 0]
    linked = set()
    for i, a in enumerate(ok):
        for b in ok[:i]:
            if a[1:5] != b[1:5] or kind(a[6]) != kind(b[6]):
                continue
            good = True
            for p, s in ((0, 2), (1, 3)):
                common = min(a[7][p] + a[7][s], b[7][p] + b[7][s]) - max(a[7][p], b[7][p])
                small, large = sorted((a[7][s], b[7][s]))
                good &= common >= 0.8 * small and large <= 1.6 * small
            if good:
                linked |= {a[0], b[0]}
                x, y = sorted((find(a[0]), find(b[0])))
                parent[y] = x
    return {i: find(i) for i in linked}


@pytest.mark.parametrize(("seed", "few", "held"), [(1, 32, 100_000), (2, 32, 100_000), (1, 2, 5), (2, 1, 40)])
def test_groups_and_survivors(spark, monkeypatch, seed, few, held):
    monkeypatch.setattr(C, "FEW_BOXES", few)
    monkeypatch.setattr(C, "HELD_ROWS", held)
    rows = matched(seed=seed)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute_groups(rows)
    groups = C.duplicate_groups(df)
    got = groups.collect()
    assert {r.record_id: r.group_id for r in got} == want
    assert len(got) == len(want)

    def conf(c):
        return 0 if c is None or c != c else (c / 100 if c > 1 else c)

    by = {}
    for r in rows:
        if r[0] in want:
            by.setdefault(want[r[0]], []).append(r)
    best = {g: min(m, key=lambda r: ("preprocessed" not in r[6], r[8] is None, -conf(r[9]), r[5] is None, r[5] or 0, r[0]))[0] for g, m in by.items()}
    fused = best_of_groups(df, groups).collect()
    assert {r.group_id: r.best_record_id for r in fused} == best
    for r in fused:
        members = by[r.group_id]
        assert (r.source_image == "preprocessed") or not any("preprocessed" in m[6] for m in members) or r.source_image == "other scan"
        assert (r.normalized_bbox is None) == all(m[8] is None for m in members)
        assert (r.char_index is None) == all(m[5] is None for m in members)


    voted = best_of_groups(df, groups, dealt=False).collect()
    assert {r.group_id: r.best_record_id for r in voted} == best


def test_the_survivor_follows_from_the_votes_on_its_fields(spark):
    """Each record votes with its source's trust, halved every 180 days; sums are those of the values, the survivor holds the winners."""
    raw, pre = "data/raw/b/v/page_1.png", "data/results/preprocessed/b/v/page_1_preprocessed.png"
    box, day = (0.1, 0.1, 0.1, 0.1), dt.datetime(2022, 1, 1)
    rows = [(1, raw, box, 0.9, 3, day), (2, raw, box, 0.99, 3, day), (3, pre, None, 0.5, 4, dt.datetime(2021, 7, 5)), (4, pre, None, 0.6, 5, day), (5, raw, None, 0.1, 1, day), (6, raw, None, 0.1, None, None), (7, None, None, 0.1, 0, None)]
    df = spark.createDataFrame(rows, f"record_id bigint, source_image string, normalized_bbox {NB}, confidence double, char_index int, loaded_at timestamp_ntz")
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 5), (7, 7)], "record_id bigint, group_id bigint")
    got = {r.group_id: r for r in best_of_groups(df, groups, dealt=False).collect()}
    assert (got[1].best_record_id, got[1].source_image, got[1].normalized_bbox) == (4, "preprocessed", "boxed")
    assert got[1].source_image_votes == pytest.approx(1.5 * OUTWEIGHS)
    assert got[1].normalized_bbox_votes == pytest.approx(2)
    assert (got[5].best_record_id, got[5].source_image, got[5].normalized_bbox) == (5, "other scan", None)
    assert got[5].source_image_votes == pytest.approx(1 + 0.5 ** (3650 / 180))
    assert got[7].best_record_id == 7


def test_groups_of_an_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert C.duplicate_groups(df).count() == 0
    assert best_of_groups(df, C.duplicate_groups(df)).count() == 0


def test_votes_prefer_trust_and_recency(spark):
    raw, pre = "data/raw/b/v/page_1.png", "data/results/preprocessed/b/v/page_1_preprocessed.png"
    day = lambda m: dt.datetime(2021, m, 1)
    rows = [(1, raw, None, 0.5, 3, day(1)), (2, raw, None, 0.5, 3, day(1)), (3, pre, (0.1, 0.1, 0.1, 0.1), 0.5, 4, day(1)), (4, raw, None, None, 5, day(12))]
    df = spark.createDataFrame(rows, f"record_id bigint, source_image string, normalized_bbox {NB}, confidence double, char_index int, loaded_at timestamp_ntz")
    r = best_of_groups(df, spark.createDataFrame([(i, 1) for i in (1, 2, 3, 4)], "record_id bigint, group_id bigint")).head()
    assert (r.best_record_id, r.source_image, r.char_index, r.normalized_bbox) == (3, "other scan", "5", "100 100 100 100")


def test_old_groups_keep_their_trust(spark):
    raw, pre = "data/raw/b/v/page_1.png", "data/results/preprocessed/b/v/page_1_preprocessed.png"
    old = dt.datetime(1980, 1, 1)
    rows = [(1, raw, None, 0.5, 3, old), (2, pre, None, 0.5, 4, old), (3, raw, None, 0.5, 5, dt.datetime(1, 1, 1)), (4, pre, None, 0.5, 5, dt.datetime(9999, 1, 1))]
    df = spark.createDataFrame(rows, f"record_id bigint, source_image string, normalized_bbox {NB}, confidence double, char_index int, loaded_at timestamp_ntz")
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 2)], "record_id bigint, group_id bigint")
    got = {r.group_id: r for r in best_of_groups(df, groups).collect()}
    assert (got[1].char_index, got[1].source_image, got[1].best_record_id) == ("4", "preprocessed", 2)
    assert (got[2].source_image, got[2].best_record_id) == ("preprocessed", 4)
    assert got[2].source_image_votes < float("inf")


def test_missing_sides_keep_boxes_apart(spark):
    raw = "data/raw/b/v/page_1.png"
    rows = [(1, raw, (None, 0.2, 0.1, 0.3), 0.5, 3, None), (2, raw, (0.2, None, 0.1, 0.3), 0.9, 3, None), (3, raw, (None, 0.2, 0.1, 0.3), 0.4, 3, None)]
    df = spark.createDataFrame(rows, f"record_id bigint, source_image string, normalized_bbox {NB}, confidence double, char_index int, loaded_at timestamp_ntz")
    r = best_of_groups(df, spark.createDataFrame([(i, 1) for i in (1, 2, 3)], "record_id bigint, group_id bigint")).head()
    assert (r.normalized_bbox, r.best_record_id) == ("- 200 100 300", 2)
    assert tuple(r.normalized_bbox_raw) == (None, 0.2, 0.1, 0.3)

def test_components_over_levels(spark, monkeypatch):
    rng = random.Random(4)
    n = 4000
    edges = [(i, i + 1) for i in range(0, 1500)] + [(5000 + i, 5000) for i in range(1, 900)] + [(rng.randint(10_000, 12_000), rng.randint(10_000, 12_000)) for _ in range(900)] + [(7, 7), (None, 3), (20_000, 20_000)]
    rng.shuffle(edges)
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    want = {k: find(k) for k in parent}
    monkeypatch.setattr(C, "BLOCK_EDGES", 50)  # many blocks: many levels
    df = spark.createDataFrame(edges, "src bigint, dst bigint").repartition(7)
    got = {r.node: r.component for r in C.connected_components(df).collect()}
    assert got == want
    assert len(got) < n
    assert C.connected_components(df.limit(0)).count() == 0


def test_first_of_groups(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]), rng.randint(0, 5), i, "keep") for i in range(2000)] + [("one", 1, 9999, "keep")]
    df = spark.createDataFrame(rows, "g string, w int, id bigint, place string")
    order = [F.col("w").desc(), F.col("id").asc()]
    got = first_of_groups(df, ["g"], order, 3)
    want = set()
    for g in {r[0] for r in rows}:
        for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))[:3]):
            want.add((g, r[2], k + 1))
    assert {(r.g, r.id, r.place) for r in got.collect()} == want
    assert first_of_groups(df, ["g"], order, 0).count() == 0
    assert first_of_groups(df.limit(0), ["g"], order, 3).count() == 0


def test_percentiles_exact_and_combined(spark):
    rng = np.random.default_rng(3)
    rows = [("hot" if rng.random() < 0.4 else str(rng.integers(0, 4)), float(v), int(d)) for v, d in zip(np.round(rng.normal(size=3000), 2), rng.integers(0, 3, 3000), strict=True)]
    rows += [("a", float("nan"), 0), ("a", float("inf"), 0), ("a", None, 0), ("single", 2.5, 1), (None, 1.0, 0), (None, 2.0, 0)]
    df = spark.createDataFrame(rows, "g string, value double, day int")
    at = (0.0, 0.05, 0.5, 0.999, 1.0)
    once = {r.g: r for r in percentiles(value_counts(df, ["g"]), ["g"], at).collect()}
    assert once == {r.g: r for r in percentiles(df, ["g"], at).collect()} == {r.g: r for r in percentiles(df, ["g"], at, ties="day").collect()}
    days = value_counts(df, ["day", "g"])
    combined = {r.g: r for r in percentiles(value_counts(days.drop("day"), ["g"]), ["g"], at).collect()}
    assert once == combined
    groups = {g for g, v, _ in rows if v is not None and np.isfinite(v)}
    assert set(once) == groups
    for g in groups:
        v = [x for k, x, _ in rows if k == g and x is not None and np.isfinite(x)]
        assert once[g].n == len(v)
        assert np.allclose([once[g][c] for c in ("p0", "p5", "p50", "p99_9", "p100")], np.quantile(v, at), atol=1e-12)
    assert percentiles(value_counts(df.limit(0), ["g"]), ["g"], at).count() == 0
    with pytest.raises(ValueError):
        percentiles(days, ["g"], [1.5])


def test_measurements_are_whole(spark):
    df = spark.createDataFrame([(1, "b", "c", dt.datetime(2021, 1, 1), 1.0, None, float("nan"))], "entry_id bigint, book string, std_char string, measured_at timestamp_ntz, aspect_ratio double, face_ratio double, ink_coverage double")
    assert measurements(df).count() == 6
    assert value_counts(measurements(df), GROUP).count() == 2  # one value for the book, one for the character
