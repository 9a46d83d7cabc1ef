"""Consolidating small files (problem 5)."""

import datetime as dt
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkwell.operators.compaction import consolidate, consolidate_files, deal, kept_images, read_consolidated, same_image_members, same_image_pairs

SCHEMA = "item_id bigint, segmented_path string, confirmed_path string, shard_file string, item_bytes int, written_at timestamp_ntz"


def items(n=400, hot=0.4, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a = f"data/results/manual/segmented/b/{rng.randint(0, n // 2)}.png" if rng.random() < 0.7 else rng.choice([None, ""])
        c = f"./data/results/manual/confirmed/b/{rng.randint(0, n // 2)}.PNG" if rng.random() < 0.5 else None
        shard = "hot" if rng.random() < hot else rng.choice([None, f"s{rng.randint(0, 90)}"])
        out.append((i, a, c, shard, rng.randint(0, 900), dt.datetime(2021, 1, 1) + dt.timedelta(minutes=rng.randint(0, 50))))
    return out


def images(row):
    keys = [os.path.basename(p).lower() for p in (row[1], row[2]) if p]
    return list(dict.fromkeys(keys))


def test_deal_is_balanced_and_longest_first():
    groups = deal([9, 8, 7, 6, 5, 4, 3, 2, 1], 15)
    loads = Counter()
    for s, g in zip([9, 8, 7, 6, 5, 4, 3, 2, 1], groups, strict=True):
        loads[g] += s
    assert len(loads) == 3
    assert max(loads.values()) - min(loads.values()) <= 2
    assert deal([], 10) == []
    assert deal([0, 0], 10) == [0, 0]


def test_a_large_file_is_split_and_loads_are_even(spark):
    rows = [(i, None, None, "big", 1000, dt.datetime(2021, 1, 1)) for i in range(600)] + [(1000 + i, None, None, f"s{i}", 100 + i % 7, dt.datetime(2021, 1, 1)) for i in range(3000)]
    folder, manifest = consolidate(spark.createDataFrame(rows, SCHEMA), "shard_file", F.col("item_bytes"), ["item_id"], 20_000)
    m = manifest.collect()
    total = sum(r[4] for r in rows)
    assert sum(r.load for r in m) == total
    assert total // 20_000 <= len(m) <= -(-total // 20_000) * 1.5
    assert max(r.load for r in m) <= 40_000
    assert sum(r.rows for r in m) == len(rows) == read_consolidated(spark, folder, SCHEMA).count()


def test_other_rows_are_not_published(spark, monkeypatch):
    from inkwell.operators import compaction

    seen = compaction._marks
    monkeypatch.setattr(compaction, "_marks", lambda rows: seen(rows.withColumn("confirmed_path", F.upper("confirmed_path"))))
    with pytest.raises(RuntimeError, match="nothing is published"):
        consolidate(spark.createDataFrame(items(50), SCHEMA), "shard_file", F.col("item_bytes"), ["item_id"])


def test_files_are_consolidated_without_moving_rows(spark, tmp_path):
    rows = items()
    df = spark.createDataFrame(rows, SCHEMA)
    df.repartition(40).write.parquet(f"{tmp_path}/in")
    listed = spark.read.format("binaryFile").load(f"{tmp_path}/in").select(F.col("path").alias("file"), F.col("length").alias("bytes"))
    before = listed.count()
    folder, manifest = consolidate_files(listed, SCHEMA, 20_000)
    assert Counter(tuple(r) for r in read_consolidated(spark, folder, SCHEMA).collect()) == Counter(rows)
    assert manifest.count() < before / 2
    assert consolidate_files(listed.limit(0), SCHEMA)[1].count() == 0


def test_consolidate_keeps_every_row_once(spark):
    rows = items()
    df = spark.createDataFrame(rows, SCHEMA)
    folder, manifest = consolidate(df, "shard_file", F.col("item_bytes"), ["item_id"], 20_000)
    back = read_consolidated(spark, folder, SCHEMA)
    assert Counter(tuple(r) for r in back.collect()) == Counter(rows)
    m = manifest.collect()
    assert sum(r.rows for r in m) == len(rows)
    assert len(m) < 40
    assert len({r.file for r in m}) == len(m)
    # an orphan of another attempt isn't in the manifest and is not read
    path = folder.replace("file:", "").replace("//", "/")
    os.link(f"{path}/{m[0].file}", f"{path}/part-9999999-orphan.parquet")
    assert read_consolidated(spark, folder, SCHEMA).count() == len(rows)


def test_consolidate_empty_and_twice(spark):
    df = spark.createDataFrame([], SCHEMA)
    folder, manifest = consolidate(df, "shard_file", F.col("item_bytes"), ["item_id"])
    assert manifest.count() == 0
    with pytest.raises(Exception, match="manifest already|exists"):
        consolidate(spark.createDataFrame(items(10), SCHEMA), "shard_file", F.col("item_bytes"), ["item_id"], folder=folder)


def test_pairs_and_kept_images(spark):
    rows = items()
    df = spark.createDataFrame(rows, SCHEMA)
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and set(images(a)) & set(images(b))}
    got = [(r[0], r[1]) for r in same_image_pairs(df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want
    first = {}
    for r in rows:
        for k in images(r):
            first[k] = min(first.get(k, r[0]), r[0])
    assert sorted(tuple(r) for r in same_image_members(df).collect()) == sorted({(r[0], first[k]) for r in rows for k in images(r)})
    kept = kept_images(df.withColumn("image", F.lit("clash"))).collect()
    named = Counter(os.path.basename(r.image) for r in kept if r.image is not None)
    assert named == Counter({k for r in rows for k in images(r)})
    assert {r.item_id for r in kept if r.image is None} == {r[0] for r in rows if not images(r)}
    for r in kept:
        if r.image is not None:
            assert (r.written_at, r.item_id) == max((x[5], x[0]) for x in rows if os.path.basename(r.image) in images(x))
    assert same_image_pairs(df.limit(0)).count() == 0
    assert kept_images(df.limit(0)).count() == 0
