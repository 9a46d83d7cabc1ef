"""Pages, clusters and stores on small cases."""

import os

import pytest
from pyspark.sql import functions as F

from inkwell.plans.matched import clustered, page_of
from inkwell.sources import shards

BOX = "struct<x:int,y:int,width:int,height:int>"
SCHEMA = f"record_id bigint, book string, std_char string, volume int, page string, source_image string, bbox {BOX}"


def test_pages(spark):
    df = spark.createDataFrame([("a", i) for i in range(250)] + [("b", 1), (None, 5), (None, 6)], "g string, v int")
    order = [F.col("v").asc()]
    first = page_of(df, ["g"], order, page=0, size=10).collect()  # no page before the first
    assert sorted((r.g or "", r.v, r.place, r.total, r.total_pages, r.has_more) for r in first if r.g != "a") == [("", 5, 1, 2, 1, False), ("", 6, 2, 2, 1, False), ("b", 1, 1, 1, 1, False)]
    assert [(r.v, r.place, r.total_pages, r.has_more) for r in sorted(first, key=lambda r: r.place) if r.g == "a"] == [(i, i + 1, 25, True) for i in range(10)]
    last = page_of(df, ["g"], order, page=25, size=10).collect()
    assert sorted((r.v, r.place, r.has_more) for r in last) == [(240 + i, 241 + i, False) for i in range(10)]
    assert page_of(df, ["g"], order, page=1, size=5000, most=200).where("g = 'a'").count() == 200
    assert page_of(df, ["g"], order, page=1, size=-3).where("g = 'a'").count() == 1
    every = page_of(df, ["g"], order, size=None).collect()
    assert len(every) == 253
    assert {(r.place, r.has_more) for r in every if r.g == "a"} == {(i + 1, False) for i in range(250)}


def test_clusters_of_a_page(spark):
    raw, pre, ext = "data/raw/b/册01/page_0001.png", "/x/data/results/preprocessed/b/册01/page_0001_preprocessed.png", "data/external/b/册01/page_0001.png"
    at = lambda i, src, x, w=50, page="page_0001", ch="字": (i, "b", ch, 1, page, src, (x, 10, w, 50))
    rows = [at(5, raw, 0), at(6, pre, 5), at(7, raw, 10), at(8, ext, 0), at(9, raw, 500), at(10, raw, 0, 0), at(11, raw, 0, page=None), at(12, raw, 0, ch="体"), at(13, pre, 0), (14, "b", "字", 1, "page_0001", raw, None)]
    got = {r.id: r.cluster for r in clustered(spark.createDataFrame(rows, SCHEMA), "record_id").collect()}
    assert got == {5: 5, 6: 5, 7: 5, 8: 8, 9: 9, 10: 10, 11: 11, 12: 12, 13: 5, 14: 14}
    assert clustered(spark.createDataFrame([], SCHEMA), "record_id").count() == 0


def test_documents_appear_whole(spark, tmp_path):
    df = spark.createDataFrame([("a/b.json", "一", "x"), ("c.json", None, "x"), ("d.json", "", "y/z")], "name string, content string, below string")
    index = {(r.name, r.bytes) for r in shards.write_documents(df, str(tmp_path / "out"), folder="below").collect()}
    assert index == {("x/a_b.json", 3), ("y_z/d.json", 0)}
    found = sorted(os.path.relpath(os.path.join(d, f), tmp_path / "out") for d, _, fs in os.walk(tmp_path / "out") for f in fs)
    assert found == ["x/a_b.json", "y_z/d.json"]
    shards.write_documents(df, str(tmp_path / "out"), folder="below")  # again: the same files
    assert len(os.listdir(tmp_path / "out")) == 2


def test_stores_fall_back(spark, tmp_path):
    def put(path, text):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)

    put(f"{tmp_path}/shards/a.json", '{"data": {"字": [{"page": "shard"}]}}')
    put(f"{tmp_path}/shards/b.json", "{ broken")
    put(f"{tmp_path}/cache/a.json", '{"data": {"字": [{"page": "stale"}]}}')
    put(f"{tmp_path}/cache/b.json", '{"data": {"字": [{"page": "cache"}]}}')
    put(f"{tmp_path}/all/all.json", '{"books": {"a": {"chars": {"体": [{"page": "old"}]}}, "c": {"chars": {"体": [{"page": "all"}, {"page": "all"}]}}}}')
    got = sorted((r.book, r.char, r.ord, r.page) for r in shards.matched_with_fallback(spark, *[f"{tmp_path}/{s}" for s in ("shards", "cache", "all")]).collect())
    assert got == [("a", "字", 0, "shard"), ("b", "字", 0, "cache"), ("c", "体", 0, "all"), ("c", "体", 1, "all")]


@pytest.mark.parametrize("hot", [0.0, 1.0])
def test_links_of_any_shape(spark, hot):
    import random

    from inkwell.operators.boxes import linked_groups

    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randint(2000, 2300), rng.randint(2000, 2300)) for _ in range(120)] + [(None, 4), (7, 7), (9000, 9000)]
    if hot:
        edges += [(5000, 5000 + i) for i in range(1, 400)] + [(5000 + i, 5000 + i + 1) for i in range(1, 399)]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    assert {r.node: r.first for r in linked_groups(df).collect()} == {k: find(k) for k in parent}
    assert linked_groups(df.limit(0)).count() == 0
