"""Paths in one spelling (problem 5's keys) and packed values (problem 3)."""

import random

import pytest
from pyspark.sql import functions as F

from inkwell.functions.paths import clean_path, glyph_image_key, is_preprocessed, page_image_key
from inkwell.operators.packed_values import explode_values, packed_values

IMAGE = "results/manual/glyph/0000000_1187_霁/戬_1.png"


@pytest.mark.parametrize(
    ("path", "key"),
    [
        ("data/results/manual/segmented/0000000_1187_霁/戬_1.png", IMAGE),
        ("file:///vol/work7/data/results/manual/segmented/0000000_1187_%E9%9C%81/%E6%88%AC_1.PNG", IMAGE),
        ("data\\results\\manual\\confirmed\\0000000_1187_霁\\戬_1.png", IMAGE),
        ("./data//results/manual/tmp/../confirmed/0000000_1187_霁/./戬_1.pNg", IMAGE),
        ("D:\\x\\data\\results\\manual\\a\\b\\..\\..\\confirmed\\0000000_1187_霁\\戬_1.png", IMAGE),
        ("data/results/paddle/segmented/0000000_1187_霁/戬_1.png", "results/paddle/segmented/0000000_1187_霁/戬_1.png"),
        ("data/results/manual/segmented/0000000_1187_霁/戬_2.png", IMAGE.replace("_1.", "_2.")),
        ("data/results/manual/other/x.png", "results/manual/other/x.png"),
        ("data/results/manual/segmented/a%zz+b.png", "results/manual/glyph/a%zz+b.png"),
        ("", None),
        ("  ", None),
        (None, None),
    ],
)
def test_glyph_image_key(spark, path, key):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(glyph_image_key("p")).head()[0] == key


@pytest.mark.parametrize(
    ("path", "key", "pre"),
    [
        ("data/raw/b/册01_pages/page_0001.png", "page|b|册01_pages|1", False),
        ("/vol/x/data/results/preprocessed/b/册01_pages/page_0001_preprocessed.png", "page|b|册01_pages|1", True),
        ("data/results/preprocessed/b/册01_pages/page_0010_preprocessed.png", "page|b|册01_pages|10", True),
        ("data/raw/b/../b/册01_pages/page_0001.PNG", "page|b|册01_pages|1", False),
        ("data/raw/%62/册01_pages/page_0001.png", "page|b|册01_pages|1", False),
        ("data/raw//b/册01_pages/page_1.png", "page|b|册01_pages|1", False),
        ("data/external/b/册01_pages/page_0001.png", "external|b|册01_pages|1", False),
        ("elsewhere/x.PNG", "elsewhere/x.png", False),
        (None, None, False),
    ],
)
def test_page_image_key(spark, path, key, pre):
    row = spark.createDataFrame([(path,)], "p string").select(page_image_key("p"), is_preprocessed("p")).head()
    assert (row[0], row[1]) == (key, pre)


def test_dots_beyond_the_root(spark):
    df = spark.createDataFrame([("../../a/../b",), ("a/../../../c",)], "p string")
    assert sorted(r[0] for r in df.select(clean_path("p")).collect()) == ["b", "c"]


@pytest.mark.parametrize(
    ("text", "values"),
    [
        ('"方""折""体"、“疏，x”; a b\u3000, ,  立骨型', ['方"折"体', "疏，x", "a b", "立骨型"]),
        ("「a/b」\t|c", ["a/b", "c"]),
        ('a"b"c,d', ['a"b"c', "d"]),
        ('"unclosed, x', ['"unclosed', "x"]),
        ("“a“b”", ["a“b"]),
        ('“a"b”,c', ['a"b', "c"]),
        ('""', []),
        ('""""', ['"']),
        ('"x" y,z', ["x y", "z"]),
        ("only", ["only"]),
        ("\ufeffa", ["\ufeffa"]),
        (" , ;、", []),
        ("", []),
        (None, None),
    ],
)
def test_packed_values(spark, text, values):
    assert spark.createDataFrame([(text,)], "t string").select(packed_values(F.col("t"))).head()[0] == values


def test_explode_values_round_trip_and_clashes(spark):
    rng = random.Random(5)
    marks = [('"', '"'), ("“", "”"), ("「", "」")]
    rows, want = [], []
    for i in range(300):
        values = ["".join(rng.choice('ab 、,;/"体') for _ in range(rng.randint(1, 6))).strip() for _ in range(rng.randint(0, 5))]
        values = [v for v in values if v]
        texts = []
        for v in values:
            o, c = rng.choice(marks)
            quoted = o + (v.replace(c, c * 2) if c in v else v) + c
            plain = not set(v) & set('、,;/"')
            texts.append(v if plain and rng.random() < 0.5 else quoted)
        rows.append((i, "x", rng.choice(["、", " ; ", "\u3000/ ", ",,"]).join(texts), 7))
        want += [(i, k + 1, v) for k, v in enumerate(values)] if len(values) > 1 else []
    df = spark.createDataFrame(rows, "id int, tag string, t string, pos int")
    got = explode_values(df, "t", at_least=2)
    assert got.columns == ["id", "t", "pos", "tag"]
    assert sorted((r.id, r.pos, r.tag) for r in got.collect()) == want
    assert explode_values(df.limit(0), "t").count() == 0
