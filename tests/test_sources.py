"""Shards in their layouts, reports, streams and state."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from inkwell.operators import review_state as RS
from inkwell.sources import shards
from inkwell.streaming import decisions


def put(path, payload):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(payload if isinstance(payload, str) else json.dumps(payload, ensure_ascii=False))


def test_ocr_pages(spark, tmp_path):
    char = lambda i, t: {"index": i, "text": t, "confidence": 0.9, "bbox": {"x": i, "y": 2, "width": 3, "height": 4}}
    put(f"{tmp_path}/b/册01/page_1_ocr.json", {"success": True, "image_path": "x", "characters": [char(0, "字"), char(1, "体")]})
    put(f"{tmp_path}/b/册01/page_2_ocr.json", {"success": False, "error": "e"})
    put(f"{tmp_path}/b/册01/page_3_ocr.json", "{ broken")
    put(f"{tmp_path}/b/册01/other.json", {"success": True, "characters": [char(0, "no")]})
    rows = shards.ocr_characters(spark, str(tmp_path)).collect()
    assert sorted((r["index"], r.text, r.bbox.x) for r in rows) == [(0, "字", 0), (1, "体", 1)]


def test_matched_layouts(spark, tmp_path):
    inst = lambda p: {"volume": 1, "page": p, "char_index": 3}
    put(f"{tmp_path}/甲.json", {"data": {"字": [inst("p1"), inst("p2")]}})
    put(f"{tmp_path}/b.json", {"chars": {"字": [inst("p3")]}})
    put(f"{tmp_path}/all.json", {"books": {"c": {"chars": {"体": [inst("p4")]}}, "d": {"chars": {}}}})
    put(f"{tmp_path}/bad.json", "[1, ")
    got = sorted((r.book, r.char, r.ord, r.page) for r in shards.matched_instances(spark, str(tmp_path)).collect())
    assert got == [("b", "字", 0, "p3"), ("c", "体", 0, "p4"), ("甲", "字", 0, "p1"), ("甲", "字", 1, "p2")]


def test_review_with_backups(spark, tmp_path):
    item = lambda s: {"chars": {"字": {"items": {"i1": {"filter": {"status": s}, "review": {"status": "pending"}}, "i2": None}}}}
    put(f"{tmp_path}/main/a.json", item("accepted"))
    put(f"{tmp_path}/main/b.json", "{ broken")
    put(f"{tmp_path}/saved/b/20200101.json", item("old"))
    put(f"{tmp_path}/saved/b/20210101.json", item("new"))
    put(f"{tmp_path}/saved/b/20220101.json", "broken too")
    put(f"{tmp_path}/saved/a/20220101.json", item("unused"))
    got = sorted((r.book, r.instance_id, r.filter.status) for r in shards.review_items(spark, f"{tmp_path}/main", f"{tmp_path}/saved").collect())
    assert got == [("a", "i1", "accepted"), ("b", "i1", "new")]


def test_catalogue_and_dictionary(spark, tmp_path):
    put(f"{tmp_path}/c.csv", 'Number,BookID,年份,刻体倾向\n1,a , 1150,"x, y"\n2,a,bad,z\n3, ,1,q\n')
    rows = shards.catalogue(spark, f"{tmp_path}/c.csv").collect()
    assert [(r.BookID, r["年份"], r["刻体倾向"]) for r in rows] == [("a", None, "z")]
    put(f"{tmp_path}/d.json", {"title": "t", "methods": [{"id": 1, "name": "m", "chars": ["一", "二"]}, {"id": 2, "name": "n", "chars": ["一"]}]})
    got = sorted((r.ord, r.method_name, r.char) for r in shards.dictionary(spark, f"{tmp_path}/d.json").collect())
    assert got == [(0, "m", "一"), (1, "m", "二"), (1000, "n", "一")]


def test_images(spark, tmp_path):
    for n in ("a.PNG", "b.jpg", "c.txt", "sub/d.tif"):
        put(f"{tmp_path}/{n}", "x")
    assert sorted(os.path.basename(r.path) for r in shards.image_files(spark, str(tmp_path)).collect()) == ["a.PNG", "b.jpg", "d.tif"]


def test_write_by_book_replaces_only_its_books(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = lambda *r: spark.createDataFrame(r, "book string, v int")
    shards.write_by_book(rows(("a", 1), ("b", 2)), path)
    shards.write_by_book(rows(("b", 3)), path, per_book=2)
    assert sorted((r.book, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3)]


def test_book_files(spark, tmp_path, monkeypatch):
    """Few files for books of few rows, several for a large one, each name back as it was, and the layout that Spark reads."""
    path = str(tmp_path / "out")
    names = ["", "a/b", "100%", "%41", "x=y:'z", "书 [1]", *[f"b{i}" for i in range(60)]]
    rows = [(b, i, f"c{i % 3}") for b in names for i in range(8)] + [("large", i, None) for i in range(30_000)]
    df = spark.createDataFrame(rows, "book string, k int, c string").repartition(7)
    index = shards.write_book_files(df, path, ["k"])
    files = [r.name for r in index.collect()]
    assert sorted(files) == sorted(os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs)
    large = sum(f.startswith("book=large/") for f in files)
    assert large > 1
    assert len(files) - large <= len(names) + 4
    back = shards.read_book_files(index, path, "k int, c string")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    read = spark.read.schema("k int, c string, book string").parquet(path).where("book not in ('%', 'large')")
    assert sorted((r.book, r.k) for r in read.collect()) == sorted((b, k) for b, k, _ in rows if b not in ("", "large"))
    os.remove(f"{path}/{files[0]}")
    with pytest.raises(Exception, match="(?i)no such file"):
        back.count()


@pytest.mark.parametrize("form", ["csv", "json", "text"])
def test_reports(spark, tmp_path, form):
    df = spark.createDataFrame([('a,"b', 1.5), ("c", float("nan")), (None, float("inf"))], "k string, v double")
    shards.write_report(df, str(tmp_path / form), form)
    if form == "text":
        assert {r.value for r in spark.read.text(str(tmp_path / form)).collect()} == {'a,"b\t1.5', "c\tNA", "NA\tNA"}
    else:
        back = spark.read.schema("k string, v double").format(form).option("header", True).option("escape", "\\").load(str(tmp_path / form))
        assert {(r.k, r.v) for r in back.collect()} == {('a,"b', 1.5), ("c", None), (None, None)}


LOG = "event_id bigint, user_id bigint, event_type string, ts timestamp, value double"


def log(n, start=0):
    return [(start + i, i % 5, "ab"[i % 2], dt.datetime(2024, 1, 1) + dt.timedelta(minutes=(i * 37) % 600), 1.0) for i in range(n)]


def test_stream_keeps_the_latest(spark, tmp_path):
    src, state = str(tmp_path / "src"), str(tmp_path / "state")
    for k in range(3):
        spark.createDataFrame(log(40, 100 * k), LOG).coalesce(1).write.mode("append").parquet(src)
    stream = decisions.decision_stream(spark, src, LOG, files_per_batch=1)
    decisions.keep_latest(stream, state, str(tmp_path / "ck"), ["user_id"], ["ts", "event_id"]).awaitTermination()
    got = {tuple(r) for r in decisions.latest_version(spark, state).collect()}
    want = {tuple(r) for r in RS.latest(spark.read.parquet(src), ["user_id"], [F.col("ts"), F.col("event_id")]).collect()}
    assert got == want
    assert len(got) == 5


def test_half_written_versions_are_not_read(spark, tmp_path):
    src, state = str(tmp_path / "src"), str(tmp_path / "state")
    run = lambda: decisions.keep_latest(decisions.decision_stream(spark, src, LOG), state, str(tmp_path / "ck"), ["user_id"], ["ts", "event_id"], buckets=3).awaitTermination()
    for k in range(4):
        spark.createDataFrame(log(40, 100 * k), LOG).coalesce(1).write.mode("append").parquet(src)
        run()
    want = sorted(map(tuple, decisions.latest_version(spark, state).collect()))
    assert want == sorted(map(tuple, RS.latest(spark.read.parquet(src), ["user_id"], [F.col("ts"), F.col("event_id")]).collect()))
    assert all(len(os.listdir(f"{state}/{b}")) <= 2 for b in os.listdir(state))
    bucket = sorted(os.listdir(state))[0]
    spark.createDataFrame(log(3, 10**6), LOG).write.parquet(f"{state}/{bucket}/v99")
    os.remove(f"{state}/{bucket}/v99/_SUCCESS")
    assert sorted(map(tuple, decisions.latest_version(spark, state).collect())) == want
    with pytest.raises(ValueError, match="no complete version"):
        decisions.latest_version(spark, str(tmp_path / "nothing"))
    assert decisions.latest_version(spark, str(tmp_path / "nothing"), LOG).count() == 0


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from inkwell import runtime

    class Nothing:
        isDefined = staticmethod(lambda: False)

    sc = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: Nothing)))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, v=None: v)))
    assert [runtime.is_local(m) for m in ("local", "local[4]", "local[*]", "local-cluster[2,1,512]", "yarn")] == [True, True, True, False, False]


def test_periods():
    from inkwell.functions.scalars import periods

    assert periods("1127-1162，1162 - 1208,1208-1273, 1300-1300") == [("早期", 1127, 1162, False), ("中期", 1162, 1208, False), ("后期", 1208, 1273, False), ("P4", 1300, 1300, True)]
    for bad in ("", "1127", "a-b", "1200-1100"):
        with pytest.raises(ValueError):
            periods(bad)


def test_stream_windows_equal_the_batch(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame(log(200), LOG).coalesce(1).write.parquet(src)
    q = decisions.windowed_counts(decisions.decision_stream(spark, src, LOG), late="30 days").writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    want = decisions.windowed_counts(spark.read.parquet(src)).collect()
    assert {tuple(r) for r in spark.table("windows").collect()} == {tuple(r) for r in want}


def test_recognise(spark):
    from inkwell.sources.ocr_service import recognise

    def client():
        def send(images):
            if b"bad" in images:
                raise RuntimeError("down")
            return [(i.decode().upper(), 0.5) for i in images[:-1]]  # the last answer is missing

        return send

    df = spark.createDataFrame([(i, f"i{i}".encode()) for i in range(6)] + [(6, b"bad"), (7, b"y"), (8, None)], "id bigint, image binary").coalesce(1)
    got = {r.id: (r.text, r.confidence, r.state, r.error) for r in recognise(df, client, batch=3, tasks=1).collect()}
    assert [got[i] for i in range(6)] == [("I0", 0.5, "ready", None), ("I1", 0.5, "ready", None), ("", 0.0, "ready", None)] + [("I3", 0.5, "ready", None), ("I4", 0.5, "ready", None), ("", 0.0, "ready", None)]
    assert got[6] == got[7] == ("", 0.0, "error", "down")
    assert got[8] == ("", 0.0, "error", "no image")
