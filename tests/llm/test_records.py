"""The dealt values of fused records against brute force."""

import datetime as dt
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from inkwell.llm.components import duplicate_groups
from inkwell.llm.queries import p1_records
from inkwell.llm.survivors import best_of_groups
from inkwell.runtime import table

from ..oracle import SF

NB = "struct<x:double,y:double,width:double,height:double>"
SCHEMA = f"record_id bigint, source_image string, normalized_bbox {NB}, confidence double, char_index int, loaded_at timestamp_ntz"
PRE = "data/results/preprocessed/b/v/page_1_preprocessed.png"


def share(c):
    return 0.0 if c is None or c != c else (c / 100 if c > 1 else c)


def brute(members):
    """The winners of one group; ``members`` are rows of SCHEMA."""
    place = lambda r: (share(r[3]), -(2**62) if r[4] is None else -r[4], -r[0])
    keys = {
        "source_image": (1, lambda r: None if r[1] is None else ("preprocessed" if "preprocessed" in r[1] else "other scan")),
        "normalized_bbox": (2, lambda r: r[2] and " ".join(str(math.floor(v * 1000 + 0.5)) for v in r[2])),
        "confidence": (3, lambda r: str(math.floor(share(r[3]) * 100 + 0.5)) if share(r[3]) > 0 else None),
        "char_index": (4, lambda r: None if r[4] is None else str(r[4])),
    }
    out = {}
    for name, (at, key) in keys.items():
        votes, best = {}, {}
        for r in members:
            if (k := key(r)) is not None:
                age = 3650 if r[5] is None else (dt.datetime(2022, 1, 1) - r[5]).days
                votes[k] = votes.get(k, 0) + (2 if r[1] is not None and "preprocessed" in r[1] else 1) * 0.5 ** (age / 180)
                best[k] = max(best.get(k, r), r, key=place)
        won = max(votes, key=lambda k: (round(math.log2(votes[k]), 9), place(best[k]) if name == "confidence" else (), k), default=None)
        out[name] = None if won is None else best[won][at]
    return out


def test_records_hold_dealt_values(spark):
    rng = random.Random(8)
    rows, groups = [], []
    for i in range(1, 400):
        src = rng.choice(["data/raw/b/v/page_1.png", "/mnt/x/data/raw/b/v/page_1.png", PRE, "/v/" + PRE, None])
        nb = rng.choice([None, (0.1, 0.2, 0.3, 0.4), (0.1001, 0.2002, 0.3, 0.4), (0.15, 0.2, 0.3, 0.4)])
        rows.append((i, src, nb, rng.choice([None, float("nan"), 0.0, 0.5, 0.901, 90.2, 0.904]), rng.choice([None, 0, 3, 10]), rng.choice([None, dt.datetime(2021, rng.randint(1, 12), 1)])))
        groups.append((i, rng.choice([1, 1, *range(2, 60)])))
    df = spark.createDataFrame(rows, SCHEMA)
    got = best_of_groups(df, spark.createDataFrame(groups, "record_id bigint, group_id bigint")).collect()
    of = dict(groups)
    assert {r.group_id for r in got} == set(of.values())
    for r in got:
        want = brute([m for m in rows if of[m[0]] == r.group_id])
        box = r.normalized_bbox_raw
        assert {"source_image": r.source_image_raw, "normalized_bbox": box and tuple(box), "confidence": r.confidence_raw, "char_index": r.char_index_raw} == want, r.group_id


def test_age_of_a_far_date(spark):
    rows = [(1, PRE, None, 0.5, 1, dt.datetime(1900, 1, 1)), (2, PRE, None, 0.5, 2, dt.datetime(2021, 1, 1))]
    r = best_of_groups(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(1, 1), (2, 1)], "record_id bigint, group_id bigint")).head()
    assert (r.best_record_id, r.char_index) == (1, "2")  # more than 32,767 days: the old vote counts for nothing, but not for the survivor


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_returns_values_of_members(spark):
    matched = table(spark, SF, "matched_books")
    fused = p1_records(spark, SF).withColumn("normalized_bbox", F.when(F.col("nb_x").isNotNull(), F.struct(*[F.col(f"nb_{c}").alias(c) for c in ("x", "y", "width", "height")]))).cache()
    dealt = {f.name: f.dataType for f in matched.schema}
    assert all(fused.schema[c].dataType == dealt[c] for c in ("source_image", "confidence", "char_index"))
    members = duplicate_groups(matched).join(matched, "record_id").groupBy("group_id").agg(*[F.collect_set(c).alias(f"all_{c}") for c in ("source_image", "normalized_bbox", "confidence", "char_index")])
    both = fused.join(members, "group_id", "left")
    wrong = " or ".join(f"({c} is not null and not coalesce(array_contains(all_{c}, {c}), false))" for c in ("source_image", "normalized_bbox", "confidence", "char_index"))
    assert fused.where("source_image is not null").count() == fused.count() > 0
    assert both.where(wrong).count() == 0
    fused.unpersist()
