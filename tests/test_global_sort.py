"""Places and quantiles within groups, from one global sort, against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.operators import global_sort as G


def rows(n=3000, seed=1):
    rng = random.Random(seed)
    return [(rng.choice(["hot", "hot", "hot", None, *map(str, range(60))]), rng.choice([None, float("nan"), *map(float, range(40)), *[rng.random() for _ in range(60)]]), i) for i in range(n)]


@pytest.mark.parametrize("parts", [1, 3, 11])
def test_numbered(spark, parts):
    data = rows()
    df = spark.createDataFrame(data, "g string, v double, id bigint").withColumn("k", F.lit("x"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {(r.g, r.id): r.k for r in G.numbered(df, ["g"], [F.col("id").desc()], "k").collect()}
        none = G.numbered(df.limit(0), ["g"], [F.col("id").desc()], "k").count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {}
    for g in {r[0] for r in data}:
        for k, i in enumerate(sorted((r[2] for r in data if r[0] == g), reverse=True)):
            want[(g, i)] = k + 1
    assert got == want
    assert none == 0


@pytest.mark.parametrize(("parts", "held", "ties"), [(1, 10**6, None), (3, 10**6, "id"), (11, 4, None), (11, 1, "id"), (2, 20, "id")])
@pytest.mark.parametrize("nearest", [False, True])
def test_quantiles(spark, monkeypatch, parts, held, ties, nearest):
    monkeypatch.setattr(G, "HELD_ROWS", held)
    data = rows(seed=parts)
    df = spark.createDataFrame(data, "g string, v double, id bigint").repartition(4)
    at = (0.0, 0.05, 0.5, 0.9, 1.0)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.g: (r.n, r.q) for r in G.quantiles(df, ["g"], "v", at, nearest, ties=ties).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len({r[0] for r in data})
    for g, (n, q) in got.items():
        v = sorted(r[1] for r in data if r[0] == g and r[1] is not None and r[1] == r[1])
        assert n == len(v)
        want = [v[max(0, int(np.ceil(p * n)) - 1)] for p in at] if nearest else np.quantile(v, at)
        assert np.allclose(q, want, atol=1e-12)
    assert G.quantiles(df.limit(0), ["g"], "v", at).count() == 0


def test_weights_and_small_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.createDataFrame([("a", 1, 3), ("a", 2, 1), ("b", 5, 2)], "g string, v int, w int")
        got = {r.g: (r.n, r.q) for r in G.quantiles(df, ["g"], "v", (0.5, 1.0), weight="w").collect()}
        many = spark.range(200).select((F.col("id") % 9).alias("g"), F.col("id").alias("v"))
        places = {(r.g, r.v): r.k for r in G.numbered(many, ["g"], [F.col("v").asc()], "k").collect()}
        medians = {r.g: r.q[0] for r in G.quantiles(many, ["g"], "v", (0.5,)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {"a": (4, [1.0, 2.0]), "b": (2, [5.0, 5.0])}
    assert all(k == v // 9 + 1 for (g, v), k in places.items())
    assert medians == {g: float(np.median(np.arange(g, 200, 9))) for g in range(9)}
