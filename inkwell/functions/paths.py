"""Paths in one spelling, as Column expressions (no Python UDF).

Null and blank paths give null. Percent escapes, back slashes, doubled slashes, ``.`` and ``..`` segments, a scheme and
whatever stands before the ``data`` folder are levelled; the case of a file extension does not matter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _resolve_dots(path: Column) -> Column:
    """Fold the segments: ``.`` and empty ones vanish, ``..`` takes back the one before."""
    empty = F.array().cast("array<string>")
    step = lambda acc, s: (
        F.when(s.isin("", "."), acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, s))
    )
    return F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")


def clean_path(col: Column | str) -> Column:
    """The path with one spelling of its separators, escapes and dots; null where null or blank."""
    raw = F.nullif(F.trim(F.col(col) if isinstance(col, str) else col), F.lit(""))
    decode = lambda v: F.when(v.contains("%"), F.coalesce(F.try_url_decode(F.replace(v, F.lit("+"), F.lit("%2B"))), v)).otherwise(v)
    slashed = F.translate(let(raw, decode), "\\", "/")
    single = F.regexp_replace(F.regexp_replace(slashed, "^[A-Za-z][A-Za-z0-9+.-]*:/*", "/"), "/(?:\\.?/)+", "/")
    resolved = let(single, lambda v: F.when(v.contains("/..") | v.startswith(".."), _resolve_dots(v)).otherwise(v))
    return F.regexp_replace(resolved, "^(?:\\./)+", "")


def below_data(path: Column) -> Column:
    """What stands below the last ``data`` folder that holds raw, external or results; the whole path where there is none."""
    return F.regexp_replace(path, "^(?:.*/)?data/((?:raw|external|results)/.*)$", "$1")


def lower_extension(path: Column) -> Column:
    ext = "\\.[A-Za-z0-9]+$"
    return let(path, lambda v: F.when(v.rlike("\\.[A-Za-z0-9]*[A-Z][A-Za-z0-9]*$"), F.concat(F.regexp_replace(v, ext, ""), F.lower(F.regexp_extract(v, ext, 0)))).otherwise(v))


def page_image_key(col: Column | str) -> Column:
    """The page image a path names: ``page|book folder|volume folder|number`` for the raw and preprocessed scan (one image),
    ``external|...`` for the external one; any other path stands for itself."""
    rest = "([^/]+)/([^/]+)/page_0*([0-9]+)(?:_preprocessed)?\\.[A-Za-z0-9]+$"
    usual = f"^data/(?:raw|results/preprocessed)/{rest}"
    plain = F.col(col) if isinstance(col, str) else col
    key = F.regexp_replace(below_data(clean_path(col)), f"^(raw|results/preprocessed|external)/{rest}", "$1|$2|$3|$4")
    slow = lower_extension(F.regexp_replace(key, "^(?:raw|results/preprocessed)\\|", "page|"))
    return F.when(_plain(plain) & plain.rlike(usual), F.regexp_replace(plain, usual, "page|$1|$2|$3")).otherwise(slow)


def _plain(path: Column) -> Column:
    """True for a path below ``data`` that is in its one spelling already but for the case of its extension."""
    odd = path.contains("%") | path.contains("\\") | path.contains("/.") | path.contains("//")
    return path.startswith("data/") & ~odd


def is_preprocessed(col: Column | str) -> Column:
    """True where the path lies in the preprocessed folder; false for null."""
    c = F.col(col) if isinstance(col, str) else col
    folder = "results/preprocessed/"
    return F.coalesce(F.when(_plain(c), c.startswith("data/" + folder)).otherwise(below_data(clean_path(c)).startswith(folder)), F.lit(False))


def glyph_image_key(col: Column | str) -> Column:
    """The glyph image a review path names; ``segmented`` and ``confirmed`` below results/manual count as one folder."""
    c = F.col(col) if isinstance(col, str) else col
    rest = lower_extension(below_data(clean_path(c)))
    slow = F.regexp_replace(rest, "^results/manual/(?:segmented|confirmed)/", "results/manual/glyph/")
    usual = "^data/results/manual/(?:segmented|confirmed)/(.*\\.[a-z0-9]+)$"
    return F.when(_plain(c) & c.rlike(usual) & ~c.contains("/data/"), F.regexp_replace(c, usual, "results/manual/glyph/$1")).otherwise(slow)
