"""Scalar functions of glyph records as Column expressions. Null in gives null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that a Unicode-aware strip removes, as members of a regular expression class.
ANY_SPACE = "\\s\\x0B\\x1C-\\x1F\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
#: Separators of style tags and the bucket of blank ones.
TAG_SEPARATORS, BLANK_BUCKET = "[,，、/;；]", "（空）"


def lenient_int(c: Column, default: int = 0) -> Column:
    """Whole number of a text or number, ``default`` where it is none."""
    return F.coalesce(F.trim(c.cast("string")).try_cast("int"), F.lit(default))


def finite(c: Column) -> Column:
    """NaN and infinite become null, so that aggregates skip them."""
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), c)


def preprocessed_path(c: Column) -> Column:
    """A raw page path as the path of its preprocessed image; any other path stays."""
    return F.regexp_replace(c, "^.*?raw/([^/]+)/([^/]+)/(page_[0-9]+)\\.[A-Za-z]+$", "data/results/preprocessed/$1/$2/$3_preprocessed.png")


def make_instance_id(volume: Column, page: Column, index: Column) -> Column:
    """``册02_page0017_idx156``; null where any part is null."""
    return F.when(volume.isNotNull() & page.isNotNull() & index.isNotNull(), F.format_string("册%02d_page%s_idx%d", volume, F.element_at(F.split(page, "_"), -1), index))


_INSTANCE = "^册([0-9]+)_page([0-9]+)_idx([0-9]+)$"


def parse_instance_id(c: Column) -> Column:
    """struct<volume, page, idx>; null where the text is no instance id."""
    part = lambda i: F.regexp_extract(c, _INSTANCE, i)
    return F.when(c.rlike(_INSTANCE), F.struct(part(1).cast("int").alias("volume"), part(2).alias("page"), part(3).cast("int").alias("idx")))


def volume_number(path: Column) -> Column:
    """First of the patterns 册NN, volNN, 第N册 and vNN that fits, case ignored; null where none does."""
    forms = ["册([0-9]+)", "(?i)vol(?:ume)?[_-]?([0-9]+)", "第([0-9]+)册", "(?i)(?:^|[/_-])v([0-9]+)"]
    return F.coalesce(*[F.nullif(F.regexp_extract(path, p, 1), F.lit("")) for p in forms]).cast("int")


def book_of_path(path: Column) -> Column:
    """The first folder, unless it looks like a volume (then the empty text)."""
    first = F.element_at(F.split(path, "/"), 1)
    return F.when((F.size(F.split(path, "/")) > 1) & volume_number(first).isNull(), first).otherwise(F.lit(""))


def style_tags(c: Column) -> Column:
    """Tags by the catalogue's five separators, trimmed; blank texts are the bucket of the blank."""
    tags = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), TAG_SEPARATORS), lambda t: F.regexp_replace(t, f"^[{ANY_SPACE}]+|[{ANY_SPACE}]+$", "")), lambda t: t != "")
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit(BLANK_BUCKET)))


def book_prefix(c: Column) -> Column:
    """struct<ord, year, rest> of ``order_year_rest``; parts that are no numbers are null."""
    p = F.split(c, "_", 3)
    return F.struct(F.get(p, 0).try_cast("int").alias("ord"), F.get(p, 1).try_cast("int").alias("year"), F.coalesce(F.get(p, 2), F.lit("")).alias("rest"))


def styles_by_region(text: Column) -> Column:
    """map<region, styles> of ``region:a|b;region2:c``."""
    return F.transform_values(F.str_to_map(text, F.lit(";"), F.lit(":")), lambda _, v: F.split(v, "\\|"))


def strip_all_space(c: Column) -> Column:
    return F.regexp_replace(c, f"[{ANY_SPACE}]+", "")


def pixel_box(box: Column, width: Column, height: Column) -> Column:
    """A normalised box (origin bottom left) as pixels (origin top left), rounded half to even and clamped to the image."""
    x = F.bround(box["x"] * width).cast("int")
    y = F.bround((1 - box["y"] - box["height"]) * height).cast("int")
    w, h = F.bround(box["width"] * width).cast("int"), F.bround(box["height"] * height).cast("int")
    x, y = F.greatest(F.lit(0), F.least(x, width - 1)), F.greatest(F.lit(0), F.least(y, height - 1))
    return F.struct(x.alias("x"), y.alias("y"), F.greatest(F.lit(1), F.least(w, width - x)).alias("width"), F.greatest(F.lit(1), F.least(h, height - y)).alias("height"))


def min_confidence(c: Column, default: float = 0.75) -> Column:
    """A threshold as a share: above 1 it is a percentage; clamped to 0..1; null and NaN are the default."""
    v = F.coalesce(F.when(~F.isnan(c), c), F.lit(default))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(v > 1, v / 100).otherwise(v)))


def axis_overlap(p1: Column, s1: Column, p2: Column, s2: Column) -> Column:
    """Overlap of two intervals by the smaller length; 0 where a length is not above 0."""
    common = F.greatest(F.lit(0), F.least(p1 + s1, p2 + s2) - F.greatest(p1, p2))
    return F.when((s1 > 0) & (s2 > 0), common / F.least(s1, s2)).otherwise(F.lit(0.0))


def size_ratio(s1: Column, s2: Column) -> Column:
    """Larger by smaller length; infinite where a length is not above 0."""
    return F.when((s1 > 0) & (s2 > 0), F.greatest(s1, s2) / F.least(s1, s2)).otherwise(F.lit(float("inf")))


def short_label(book: Column) -> Column:
    return F.substring_index(book, "_", 2)


def safe_name(c: Column) -> Column:
    return F.translate(c, "/", "_")


def formatted(c: Column, digits: int = 4) -> Column:
    """A number with fixed digits, ``NA`` where it is not finite."""
    return F.when(finite(c).isNotNull(), F.format_string(f"%.{digits}f", c)).otherwise(F.lit("NA"))


def source_kind(path: Column) -> Column:
    """preprocessed, raw or other, by the folder in the path."""
    p = F.translate(F.coalesce(path, F.lit("")), "\\", "/")
    return F.when(p.contains("results/preprocessed/") | p.contains("_preprocessed"), F.lit("preprocessed")).when(p.contains("data/raw/"), F.lit("raw")).otherwise(F.lit("other"))


def hex_rgb(c: Column) -> Column:
    """struct<r, g, b> of ``#rrggbb``; null where the text is none."""
    part = lambda i: F.conv(F.substring(c, i, 2), 16, 10).cast("int")
    return F.when(c.rlike("^#[0-9A-Fa-f]{6}$"), F.struct(part(2).alias("r"), part(4).alias("g"), part(6).alias("b")))


def periods(text: str) -> list[tuple[str, int, int, bool]]:
    """(label, start, end, end included) of periods written ``1127-1162,1162-1208``: half open but for the last. Raises for an empty
    text and for parts that are no period."""
    names = {0: "早期", 1: "中期", 2: "后期"}
    parts = [p.strip() for p in (text or "").replace("，", ",").split(",") if p.strip()]
    out = []
    for i, part in enumerate(parts):
        start, dash, end = part.partition("-")
        if not dash or not start.strip().isdecimal() or not end.strip().isdecimal() or int(end) < int(start):
            raise ValueError(f"no period: {part}")
        out.append((names.get(i, f"P{i + 1}"), int(start), int(end), i == len(parts) - 1))
    if not out:
        raise ValueError("no periods")
    return out
