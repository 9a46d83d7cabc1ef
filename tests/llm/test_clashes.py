"""Tables with further columns, named like the ones an operator makes itself, and repeated rows."""

from pyspark.sql import functions as F

from inkwell.llm.bpe import encode_texts
from inkwell.llm.components import connected_components, duplicate_groups
from inkwell.llm.lookalikes import lookalike_terms, metadata_values
from inkwell.llm.ranked import first_of_groups, percentiles, value_counts
from inkwell.llm.splitting import split_texts
from inkwell.llm.survivors import best_of_groups

from .test_groups import SCHEMA, brute_groups, matched

NAMES = ["id", "rep", "pair", "k1", "k2", "x", "y", "w", "h", "node", "src", "dst", "root", "up", "low", "high", "component", "group_id", "cell", "cls", "gx", "gy", "__image", "__kind", "__box", "__age", "field", "value", "votes", "ties", "g", "r"]


def crowded(df, names=NAMES):
    return df.withColumns({n: F.lit("clash") for n in names if n not in df.columns})


def test_groups_with_clashing_columns_and_repeated_rows(spark):
    rows = matched(200)
    df = spark.createDataFrame(rows + rows[:20], SCHEMA)
    full = crowded(df)
    got = {r.record_id: r.group_id for r in duplicate_groups(full).collect()}
    assert got == brute_groups(rows)
    fused = best_of_groups(full, crowded(duplicate_groups(df), ["best_record_id", "confidence", "source_image"]))
    assert {r.group_id for r in fused.collect()} == set(got.values())


def test_components_ignore_other_columns(spark):
    e = crowded(spark.createDataFrame([(1, 2), (2, 3), (1, 2)], "src bigint, dst bigint"))
    assert {(r.node, r.component) for r in connected_components(e).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_rankings_with_clashing_columns(spark):
    df = crowded(spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 2), ("b", 2.0, 3)], "key string, value double, n bigint"), ["place", "cnt_", "__v", "__c", "__from"])
    top = first_of_groups(df, ["key"], [F.col("value").desc(), F.col("n").asc()], 1)
    assert {(r.key, r.n, r.place) for r in top.collect()} == {("a", 2, 1), ("b", 3, 1)}
    p = percentiles(value_counts(df.drop("n"), ["key"]), ["key"], [0.5]).collect()
    assert {(r.key, r.n, r.p50) for r in p} == {("a", 2, 2.0), ("b", 1, 2.0)}


def test_texts_with_clashing_columns(spark):
    df = crowded(spark.createDataFrame([(1, "hello world"), (2, None)], "doc_id bigint, text string"), ["ids", "id", "out", "piece", "n_tokens", "char_from"])
    assert {r.doc_id: r.ids for r in encode_texts(df).collect()} == {1: [31373, 995], 2: None}
    assert [(r.doc_id, r.text) for r in split_texts(df, 64, 8).collect()] == [(1, "hello world")]


def test_lookalikes_with_clashing_columns(spark):
    books = crowded(spark.createDataFrame([(1, "⼆溪", "方笔体"), (1, "⼆溪", "方笔体")], "book_no bigint, `区域划分` string, `刻体倾向` string"), ["value", "look", "tag", "pos", "field_name", "term"])
    terms = crowded(spark.createDataFrame([(1, "region", "二溪")], "term_id int, field_name string, term string"), ["look", "value", "book_no"])
    assert [(r.book_no, r.field_name, r.term_id) for r in lookalike_terms(metadata_values(books), terms).collect()] == [(1, "region", 1)]
