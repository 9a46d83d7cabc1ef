"""Text of one look (problem 4)."""

import unicodedata as ud

import pytest

from inkwell.llm.lookalikes import lookalike_terms, metadata_values, same_look


def looks(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return {r.t: r.same_look for r in same_look(df, "t").collect()}


def test_one_form(spark):
    same = {
        "方笔体": ["⽅笔体", "方​笔﻿体⁠", "方笔体︎"],
        "Fāngbǐ Tǐ": ["Ｆāｎｇｂǐ Ｔǐ", "Fāngbі̌ Тǐ", "Fāngbǐ\xa0Tǐ", "Fāngbı̌ Tǐ"],
        "KT-3体": ["KТ−3体", "Ｋ­T－3体", "KT‑3体"],
        "力田口": ["カ田ロ", "⼒田⼝", "力田口"],
        "圆笔(晚)": ["圆笔（晚）"],
        "龙见西门": ["⻰⻅⻄⻔"],
        "ộ": ["ộ", "ộ", "ộ"],
    }
    got = looks(spark, [*same, *[v for vs in same.values() for v in vs]])
    for term, variants in same.items():
        for v in variants:
            assert got[v] == got[term], (term, v)


def test_visible_differences_stay(spark):
    got = looks(spark, ["Fāngbǐ", "Fangbi", "fāngbǐ", "FĀNGBǏ", "方笔", "曲笔", "2", "②", "²", "ă", "ǎ", "i", "ı"])
    assert len(set(got.values())) == len(got)


def test_recomposition_is_normal(spark):
    texts = ["é", "é", "가각", "ạ̇x", "q̣̇", "́a", "日本語", "x́́"]
    got = looks(spark, texts)
    for t in texts:
        assert got[t] == ud.normalize("NFC", t), t


def test_hangul_is_put_together(spark):
    whole = ["한글", "각", "가", "값이 한국어 x가ㅏ", "가̣", "ᄀ각ᆨ", "ᅡᆨ", "가ᅡ", "각ᆨ"]
    texts = [*whole, *[ud.normalize("NFD", t) for t in whole], "각", "한글"]
    got = looks(spark, texts)
    for t in texts:
        if "ㅏ" not in t:  # a compatibility letter takes the form of the letter
            assert got[t] == ud.normalize("NFC", t), t
    assert got["한글"] == got[ud.normalize("NFD", "한글")] == got["한글"]


def test_more_lookalikes_from_a_file(spark, tmp_path):
    from inkwell.llm.lookalikes import read_confusables

    (tmp_path / "confusables.txt").write_text("\ufeff# a comment\n0417 ;\t0033 ;\tMA\t# ( З → 3 )\n20A8 ; 0052 0073 ; MA # two\n\n", encoding="utf-8")
    more = read_confusables(str(tmp_path / "confusables.txt"))
    assert more == (("З", "3"), ("₨", "Rs"))
    df = spark.createDataFrame([("З₨",), ("3Rs",)], "t string")
    got = {r.t: r.same_look for r in same_look(df, "t", more=more).collect()}
    assert got["З₨"] == got["3Rs"] == "3Rs"
    assert looks(spark, ["З"])["З"] == "З"


def test_a_long_text(spark):
    text = "Ｆé " * 25_000
    assert looks(spark, [text])[text] == ud.normalize("NFC", "Fé ") * 25_000


@pytest.mark.parametrize("text", ["", "​", "a" * 3000 + "́" * 50])
def test_edges(spark, text):
    got = looks(spark, [text, None, text])
    assert set(got) == {text}
    assert got[text] == ("" if text in ("", "​") else ud.normalize("NFC", text))


def test_cases(spark):
    books = spark.createDataFrame(
        [(1, "⼆溪八里", "方笔体、⽅笔体"), (2, " /二溪八里　", '"方""折""体"'), (3, "二​溪八里", '"⽅""折""体"'), (4, None, None), (5, "", " "), (6, "Hé-Àn", "he"), (7, "He-An", "Hé-Àn"), (8, "“Hé－Àn”", "二溪八里")],
        "book_no bigint, `区域划分` string, `刻体倾向` string",
    )
    terms = spark.createDataFrame([(1, "region", "二溪八里"), (24, "region", "Hé-Àn"), (101, "style", "方笔体"), (142, "style", '方"折"体'), (9, "style", None)], "term_id int, field_name string, term string")
    got = {(r.book_no, r.field_name, r.term_id) for r in lookalike_terms(metadata_values(books), terms).collect()}
    assert got == {(1, "region", 1), (1, "style", 101), (3, "region", 1), (3, "style", 142), (8, "region", 24)}
    assert lookalike_terms(metadata_values(books.limit(0)), terms).count() == 0
