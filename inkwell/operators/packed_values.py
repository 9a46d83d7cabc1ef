"""Several values packed in one field (problem 3).

The text is split on quotation marks; pieces outside of quotes are split on delimiters, pieces inside are literals, and an
array fold puts values together again and numbers them. Everything is a Column expression, so the operator is one narrow
stage without a shuffle, whatever the size of the table or the number of rows per key.

Defined results: null, empty and blank texts and texts of delimiters only give no value. A quotation mark opens only at
the start of a value; elsewhere outside of quotes it is an ordinary character, and so is the opening mark of a quotation
that is never closed. Within quotes a doubled closing mark stands for one, marks of another kind for themselves. Text
behind a closing mark and before the next delimiter belongs to the value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.paths import let

#: The quotation marks, opening and closing in the same place, and what separates two values.
QUOTES_OPEN = '"“「『«＂'
QUOTES_CLOSE = '"”」』»＂'
DELIMITERS = "、，,﹑､﹐;；﹔/／|｜+＋\t\n\r\x0b\x0c\x85\u2028\u2029"
#: Unicode white space, as a class of Java's regular expressions.
SPACE = "\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"



def strip_space(text: Column) -> Column:
    """The text without white space of any kind around it."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def _class(chars: str) -> str:
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in chars) + "]"


def packed_values(text: Column) -> Column:
    """array<string>: the values of the text in order, trimmed, without their quotation marks, empty ones left out."""
    any_quote = _class("".join(dict.fromkeys(QUOTES_OPEN + QUOTES_CLOSE)))
    parts = F.struct(F.split(text, any_quote, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(f"({any_quote})"), F.lit(1)).alias("marks"))
    return let(parts, lambda t: let(_last_places(t["marks"]), lambda last: _folded(t["pieces"], t["marks"], last)))


def _last_places(marks: Column) -> Column:
    """Where each closing mark stands last (from 0, -1 for nowhere), so that an opening one knows whether it is ever closed."""
    behind = lambda c: F.coalesce(F.nullif(F.array_position(F.reverse(marks), c), F.lit(0)), F.size(marks) + 1)
    return F.array(*[F.size(marks) - behind(c).cast("int") for c in QUOTES_CLOSE])


def _folded(pieces: Column, marks: Column, last: Column) -> Column:
    # piece i stands between mark i-1 and mark i (the last piece has no mark behind it)
    steps = F.transform(
        pieces,
        lambda p, i: F.struct(
            p.alias("piece"),
            F.coalesce(F.get(marks, i), F.lit("")).alias("mark"),
            F.coalesce(F.get(pieces, i + 1), F.lit("")).alias("next"),
            F.coalesce(F.get(marks, i + 1), F.lit("")).alias("mark2"),
            i.alias("at"),
        ),
    )
    # state: done values, the value being put together, whether it was quoted, the mark that closes, a doubled mark to skip
    start = F.struct(
        F.array().cast("array<string>").alias("done"),
        F.lit("").alias("cur"),
        F.lit(False).alias("quoted"),
        F.lit("").alias("close"),
        F.lit(False).alias("skip"),
    )

    def step(acc: Column, s: Column) -> Column:
        inside = acc["close"] != ""
        # outside: the piece is split on delimiters; all parts but the last are complete values
        parts = F.split(s["piece"], _class(DELIMITERS), -1)
        first = F.concat(acc["cur"], F.element_at(parts, 1))
        many = F.size(parts) > 1
        done_out = F.when(many, F.concat(acc["done"], F.array(first), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))))).otherwise(acc["done"])
        cur_out = F.when(many, F.element_at(parts, -1)).otherwise(first)
        quoted_out = acc["quoted"] & ~many
        closing = F.translate(s["mark"], QUOTES_OPEN, QUOTES_CLOSE)
        is_open = F.instr(F.lit(QUOTES_OPEN), s["mark"]) > 0
        opens = (s["mark"] != "") & is_open & (strip_space(cur_out) == "") & ~quoted_out & (F.element_at(last, F.greatest(F.lit(1), F.instr(F.lit(QUOTES_CLOSE), closing))) > s["at"])
        outside = F.struct(
            done_out.alias("done"),
            F.when(opens, F.lit("")).otherwise(F.concat(cur_out, s["mark"])).alias("cur"),
            (quoted_out | opens).alias("quoted"),
            F.when(opens, closing).otherwise(F.lit("")).alias("close"),
            F.lit(False).alias("skip"),
        )
        # inside: the piece is literal; its mark closes, stands doubled for one, or is of another kind and stands for itself
        literal = F.concat(acc["cur"], s["piece"])
        closes = (s["mark"] == acc["close"]) & ~acc["skip"]
        doubled = closes & (s["next"] == "") & (s["mark2"] == acc["close"])
        within = F.struct(
            acc["done"].alias("done"),
            F.when(closes, literal).otherwise(F.concat(literal, s["mark"])).alias("cur"),
            F.lit(True).alias("quoted"),
            F.when(closes & ~doubled, F.lit("")).otherwise(acc["close"]).alias("close"),
            doubled.alias("skip"),
        )
        return F.when(inside, within).otherwise(outside)

    folded = F.aggregate(steps, start, step, lambda acc: F.array_append(acc["done"], acc["cur"]))
    return F.filter(F.transform(folded, strip_space), lambda v: v != "")


def explode_values(df: DataFrame, field: str, pos: str = "pos", value: str = "tag", at_least: int = 1) -> DataFrame:
    """One row per value of ``field`` with its place (int, from 1); other columns are kept, ``pos`` and ``value`` take the
    place of columns of that name. Rows with fewer than ``at_least`` values give none."""
    keep = [c for c in df.columns if c not in (pos, value)]
    plain = "^[^" + "".join(f"\\x{{{ord(c):x}}}" for c in dict.fromkeys(QUOTES_OPEN + QUOTES_CLOSE + DELIMITERS)) + "]*$"
    one = strip_space(F.col(field))
    packed = F.when(F.col(field).rlike(plain), F.filter(F.array(one), lambda v: v != "")).otherwise(packed_values(F.col(field)))
    enough = let(packed, lambda v: F.when(F.size(v) >= at_least, v))
    # outer, so that the values are not computed again to test that there are any
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.posexplode_outer(enough).alias("__at", value)).where(F.col(value).isNotNull())
    return rows.select(*[F.col(f"`{c}`") for c in keep], (F.col("__at") + 1).cast("int").alias(pos), F.col(value))
