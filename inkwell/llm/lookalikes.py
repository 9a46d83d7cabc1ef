"""Visually identical text with different characters (problem 4).

Texts are exploded into positioned code points, joined with a broadcast table of decompositions and look-alikes (bounded by
Unicode itself), combining marks are ordered by their class, base and marks are recomposed, Hangul letters by Unicode's
arithmetic, and the text is rebuilt. A code point carries a 128-bit key of its text, not the text.

The look-alikes of other scripts are those of the lists below (capitals of eight scripts, small letters of three, dashes, dots,
slashes, kana, radicals), not all that Unicode's confusables name: a caller may give more, for instance from that file
(``read_confusables``)."""

from __future__ import annotations

import json
import unicodedata as ud
from functools import cache

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from inkwell.operators.packed_values import DELIMITERS, QUOTES_CLOSE, QUOTES_OPEN, SPACE, explode_values, strip_space
from inkwell.runtime import materialise, small

#: Letters of other scripts and signs that look like the second string, character by character.
LOOKALIKES = [
    ("АВЕЅІЈКМНОРСТУХҮԌԚԜӀ", "ABESIJKMHOPCTYXYGQWI"),  # Cyrillic capitals
    ("аеѕіјорсухһԁԛԝӏү", "aesijopcyxhdqwly"),  # Cyrillic small letters
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABEZHIKMNOPTYXCJ"),  # Greek capitals
    ("ονϲϳι", "ovcjı"),  # Greek small letters; iota has no dot
    ("օոսհցզԼՏՍ", "onuhgqLSU"),  # Armenian
    ("ⲀⲂⲈⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬ", "ABEHIKMNOPCTYX"),  # Coptic
    ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"),  # Cherokee
    ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),  # Lisu
    ("ɑɡ", "ag"),
    ("‐‑‒–⁃−˗", "-------"),
    ("・•‧∙⋅ᐧ᛫", "·······"),
    ("∕⁄", "//"),
    ("ニハロエカトタヘー囗", "二八口工力卜夕へ一口"),  # kana and ideographs
]
#: Radicals of the CJK Radicals Supplement and the ideograph each looks like.
RADICALS = (
    "⺁厂⺄乙⺅亻⺆冂⺉刂⺊卜⺍⺌⺎兀⺒巳⺓幺⺖忄⺘扌⺙攵⺛旡⺝月⺞歺⺟母⺠民⺡氵⺣灬⺤爫⺦丬⺨犭⺩王⺪疋⺬示⺭礻⺮竹⺯糹⺰纟⺱罓⺲罒⺳㓁⺶羊⺹耂⺺肀⺼月⺽臼⺾艹⺿艹⻀艹⻁虎⻂衤⻃覀⻄西⻅见⻆角"
    "⻈讠⻉贝⻋车⻌辶⻍辶⻎辶⻏阝⻐钅⻑長⻒镸⻓长⻔门⻖阝⻗雨⻘青⻙韦⻚页⻛风⻜飞⻝食⻟飠⻠饣⻢马⻣骨⻤鬼⻥鱼⻦鸟⻧卤⻨麦⻩黄⻪黾⻫斉⻬齐⻭歯⻮齿⻯竜⻰龙⻱龜⻲亀"
)
#: Kinds of compatibility decomposition that leave the look as it is; bold, raised, circled and stacked forms do not.
SAME_LOOK = ("<wide>", "<narrow>", "<small>", "<compat>", "<noBreak>")


def _ignorable(cp: int) -> bool:
    """Default-ignorable code points by rule: format characters, variation selectors and fillers that show nothing."""
    return ud.category(chr(cp)) == "Cf" and cp not in range(0x600, 0x606) or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or 0x180B <= cp <= 0x180F or cp in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0)


Pairs = tuple[tuple[str, str], ...]


def read_confusables(path: str) -> Pairs:
    """(character, what it looks like) of a file in the format of Unicode's confusables: code points in hex, separated by ``;``."""
    with open(path, encoding="utf-8-sig") as f:
        fields = [line.split("#")[0].split(";") for line in f]
    text = lambda x: "".join(chr(int(c, 16)) for c in x.split())
    return tuple((text(x[0]), text(x[1])) for x in fields if len(x) > 1)


@cache
def _replacements(more: Pairs = ()) -> dict[str, str]:
    """What every code point is replaced by before recomposition; code points that stay are not listed. ``more`` look-alikes (from
    one character to a text) come before those listed above."""
    direct = {a: b for src, dst in LOOKALIKES for a, b in zip(src, dst, strict=True)} | dict(zip(RADICALS[::2], RADICALS[1::2], strict=True)) | {a: b for a, b in more if len(a) == 1 and a != b}

    def full(ch: str, depth: int = 0) -> str:
        if depth > 20:
            return ch
        if ch in direct:
            return "".join(full(c, depth + 1) for c in direct[ch])
        kind, _, rest = ud.decomposition(ch).rpartition("> ")
        if not rest or kind and kind + ">" not in SAME_LOOK:
            return ch
        return "".join(full(chr(int(x, 16)), depth + 1) for x in rest.split())

    table = {}
    for cp in range(0x110000):
        if 0xD800 <= cp < 0xE000 or 0xAC00 <= cp <= 0xD7A3:
            continue
        ch = chr(cp)
        if _ignorable(cp):
            table[ch] = ""
        elif ud.category(ch) == "Zs":
            table[ch] = " "
        elif (new := full(ch)) != ch:
            table[ch] = new
    return table


@cache
def _compositions() -> dict[str, str]:
    """Base plus mark to the composed character, by Unicode's own rule (exclusions are those that do not compose)."""
    out = {}
    for cp in range(0xC0, 0x30000):
        ch = chr(cp)
        parts = ud.decomposition(ch).split()
        if len(parts) == 2 and "<" not in parts[0] and ud.normalize("NFC", ch) == ch:
            out["".join(chr(int(x, 16)) for x in parts)] = ch
    out |= {"ı" + m: ud.normalize("NFC", "i" + m) for m in map(chr, range(0x300, 0x315)) if len(ud.normalize("NFC", "i" + m)) == 1}  # a dot under an accent can't be seen
    return out


def _hangul(s: Column, in_text: WindowSpec) -> Column:
    """A rebuilt character with the Hangul letters that follow it in its syllable; of those letters only their marks stay. L, V and T
    by Unicode's arithmetic, over a window in the order of the text; a letter with marks ends its syllable."""
    at = lambda k: F.lag(s, -k).over(in_text) if k < 0 else F.lead(s, k).over(in_text) if k else s
    first = lambda k: F.ascii(at(k))
    bare = lambda k: F.when(F.length(at(k)) == 1, F.ascii(at(k)))
    lead_ = lambda c: c.between(0x1100, 0x1112)
    vowel = lambda c: c.between(0x1161, 0x1175)
    trail = lambda c: c.between(0x11A8, 0x11C2)
    open_ = lambda c: c.between(0xAC00, 0xD7A3) & ((c - 0xAC00) % 28 == 0)
    tail = F.when(vowel(bare(1)) & trail(first(2)), first(2) - 0x11A7).otherwise(F.lit(0))
    syllable = F.when(lead_(bare(0)) & vowel(first(1)), 0xAC00 + ((bare(0) - 0x1100) * 21 + first(1) - 0x1161) * 28 + tail).when(open_(bare(0)) & trail(first(1)), bare(0) + first(1) - 0x11A7)
    taken = vowel(first(0)) & lead_(bare(-1)) | trail(first(0)) & (open_(bare(-1)) | vowel(bare(-1)) & lead_(bare(-2)))
    return F.when(F.coalesce(taken, F.lit(False)), F.substring(s, 2, 2**31 - 1)).when(syllable.isNotNull(), F.decode(F.unhex(F.hex(syllable)), "UTF-16BE")).otherwise(s)


def same_look(df: DataFrame, text: str, out: str = "same_look", more: Pairs = ()) -> DataFrame:
    """(text, out): for every distinct non-null text the one form that all texts of the same look share. Full-width and
    other compatibility forms, letters of other scripts, radicals and dashes take one form, as do the look-alikes ``more``
    (character, text); invisible characters vanish, every white space is a blank, combining marks are ordered by class and
    recomposed, Hangul letters are put together. Case, accents and letters that look different stay. The empty text stays empty, as
    does a text of invisible characters only."""
    spark = df.sparkSession
    known = _replacements(more)
    rows = [(a, [(c, ud.combining(c)) for c in b]) for a, b in known.items()] + [(chr(c), [(chr(c), ud.combining(chr(c)))]) for c in range(0x300, 0x1F000) if ud.combining(chr(c)) and chr(c) not in known]
    table = spark.createDataFrame(rows, "ch string, seq array<struct<c: string, ccc: int>>")
    keys = ["k1", "k2"]
    keyed = lambda t: [F.xxhash64(t).alias("k1"), F.xxhash64(F.lit("inkwell"), t).alias("k2")]
    distinct = df.select(F.col(text).alias("t")).where("t is not null").distinct()
    points = distinct.select(*keyed("t"), F.posexplode(F.split("t", "")).alias("pos", "ch"))
    seq = F.coalesce("seq", F.array(F.struct(F.col("ch").alias("c"), F.lit(0).alias("ccc"))))
    units = points.join(F.broadcast(table), "ch", "left").select(*keys, "pos", F.posexplode(seq).alias("sub", "u")).select(*keys, "pos", "sub", "u.c", "u.ccc")
    bases = units.withColumn("base", F.sum((F.col("ccc") == 0).cast("int")).over(Window.partitionBy(*keys).orderBy("pos", "sub")))
    # one row per base with its marks in canonical order; all that follows keeps the partitions by text
    marked = F.array_sort(F.collect_list(F.struct(F.col("ccc"), F.col("pos"), F.col("sub"), F.col("c"))))
    runs = bases.groupBy(*keys, "base").agg(marked.alias("run"))
    pairs = F.from_json(F.lit(json.dumps(_compositions())), "map<string,string>")
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("base"), F.lit(0).alias("blocked"))

    def step(acc, u):
        joined = F.try_element_at(pairs, F.concat(acc["base"], u["c"]))
        first = acc["base"] == ""
        free = joined.isNotNull() & (u["ccc"] > acc["blocked"])
        return F.struct(
            F.when(first | free, acc["done"]).otherwise(F.concat(acc["done"], u["c"])).alias("done"),
            F.when(first, u["c"]).when(free, joined).otherwise(acc["base"]).alias("base"),
            F.when(first | free, acc["blocked"]).otherwise(u["ccc"]).alias("blocked"),
        )

    folded = F.aggregate("run", start, step, lambda a: F.concat(a["base"], a["done"]))
    composed = runs.select(*keys, "base", F.when(F.size("run") == 1, F.col("run")[0]["c"]).otherwise(folded).alias("s"))
    composed = composed.select(*keys, "base", _hangul(F.col("s"), Window.partitionBy(*keys).orderBy("base")).alias("s"))
    rebuilt = composed.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("base", "s"))), lambda x: x["s"]), "").alias(out))
    return distinct.select("t", *keyed("t")).join(rebuilt, keys, "left").select(F.col("t").alias(text), F.coalesce(out, F.lit("")).alias(out))


def lookalike_terms(values: DataFrame, terms: DataFrame, id_col: str = "book_no", field: str = "field_name", value: str = "value", more: Pairs = ()) -> DataFrame:
    """(id, field_name, term_id): the values that look the same as a term of their field but are another string. ``values``
    has (id, field_name, value), ``terms`` (term_id, field_name, term). A value that equals the term, or any other term of the
    field, is no case; each (id, field, term) comes once. Null values and terms are left out. Distinct values are compared, and the
    cases alone are joined with the ids, so that a value that a third of all rows hold is compared once."""
    listed = terms.select("term_id", F.col(field).alias("__field"), "term")
    looked = listed.join(same_look(listed, "term", "look", more), "term").select("term_id", "__field", "term", "look")
    values = values.select(id_col, F.col(field).alias("__of"), F.col(value).alias("__value")).where("__value is not null")
    distinct = values.select("__of", "__value").distinct()
    # invisible characters and spaces around the rebuilt text do not make it another look
    edge = f"^[{SPACE}]+|[{SPACE}]+$"
    found = distinct.join(same_look(distinct, "__value", "look", more), "__value").withColumn("look", F.regexp_replace("look", edge, ""))
    cases = found.join(small(looked, listed), (found["look"] == looked["look"]) & (found["__of"] == looked["__field"]) & (found["__value"] != looked["term"])).select(F.col("__of").alias("__f"), F.col("__value").alias("__v"), "term_id")
    cases = materialise(cases)
    hits = values.join(small(cases), (F.col("__of") == F.col("__f")) & (F.col("__value") == F.col("__v")))
    return hits.select(id_col, F.col("__of").alias(field), "term_id").distinct()


def metadata_values(books: DataFrame) -> DataFrame:
    """(book_no, field_name, value): the region and each single style of the catalogue, without white space, separators and
    quotation marks around them."""
    around = f"[{SPACE}" + "".join(f"\\x{{{ord(c):x}}}" for c in dict.fromkeys(DELIMITERS + QUOTES_OPEN + QUOTES_CLOSE)) + "]+"
    region = books.select("book_no", F.lit("region").alias("field_name"), F.regexp_replace("区域划分", f"^{around}|{around}$", "").alias("value"))
    style = explode_values(books.select("book_no", "刻体倾向"), "刻体倾向", value="value").select("book_no", F.lit("style").alias("field_name"), strip_space(F.col("value")).alias("value"))
    return region.unionAll(style).where("value <> ''")


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def terms_sql(cleaned: str) -> str:
    """The SQL of ``lookalike_terms`` over the catalogue, with the replacements as a map; ``cleaned`` are the CTEs of the style values
    (the last one named clean: book_no, vals)."""
    table = _replacements()
    shown = f"map([{', '.join(map(_sql_text, table))}], [{', '.join(map(_sql_text, table.values()))}])"
    around = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
    both = around + "".join(f"\\x{{{ord(c):x}}}" for c in dict.fromkeys(DELIMITERS + QUOTES_OPEN + QUOTES_CLOSE)) + "]+"
    around += "]+"
    look = "regexp_replace(nfc_normalize(regexp_replace(array_to_string(list_transform(range(1, length({v}) + 1), lambda i: coalesce(m[substring({v}, i, 1)], substring({v}, i, 1))), ''), 'ı([\\x{{300}}-\\x{{314}}])', 'i\\1', 'g')), '^" + around.replace("{", "{{").replace("}", "}}") + "|" + around.replace("{", "{{").replace("}", "}}") + "$', '', 'g')"
    return f"""{cleaned}, m as (select {shown} as m), vals as (select book_no, 'style' as field_name, unnest(vals) as value from clean union all select book_no, 'region', regexp_replace(区域划分, '^{both}|{both}$', '', 'g') from books_metadata),
  looks as (select value, {look.format(v="value")} as look from (select distinct value from vals where value <> '') cross join m), known as (select term_id, field_name, term, {look.format(v="term")} as look from script_terms cross join m where term is not null)
  select distinct v.book_no, v.field_name, k.term_id from vals v join looks l using (value) join known k on k.look = l.look and k.field_name = v.field_name and k.term <> v.value"""
