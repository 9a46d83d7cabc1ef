"""Views of the given tables in the shapes that the operators work on, each with the SQL of the same view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.scalars import BLANK_BUCKET, book_prefix, finite, style_tags
from inkwell.operators.review_state import latest
from inkwell.runtime import table

METRICS = ("aspect_ratio", "face_ratio", "ink_coverage")


def glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyph boxes (book, ch, instance_id, w, h) that line items stand for, all whole numbers."""
    li = table(spark, sf_dir, "lineitem")
    book, ch = F.col("l_suppkey") % 38, F.col("l_partkey") % 60
    return li.select(
        book.alias("book"),
        ch.alias("ch"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("instance_id"),
        F.col("l_quantity").cast("int").alias("w"),
        (1 + (F.col("l_partkey") * 7 + F.col("l_linenumber") * 13) % 50).cast("int").alias("h"),
    )


GLYPHS = """glyphs as (select l_suppkey % 38 as book, l_partkey % 60 as ch, l_orderkey * 10 + l_linenumber as instance_id, cast(l_quantity as int) as w,
  cast(1 + (l_partkey * 7 + l_linenumber * 13) % 50 as int) as h from lineitem)"""


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue with one row per book id (trimmed, not blank; the last entry wins): book, title, year (else that of the
    id), region and tags (blank ones in their bucket), province, place."""
    raw = table(spark, sf_dir, "books_metadata").withColumn("book", F.trim("bookid")).where("book <> ''")
    last = latest(raw.select("book_no", "book", F.col("宋刻本").alias("title"), "年份", "区域划分", "省份", "地点", "刻体倾向"), ["book"], [F.col("book_no")])
    place = lambda c: F.nullif(F.trim(c), F.lit("/"))
    return last.select(
        "book",
        "title",
        F.coalesce("年份", book_prefix(F.col("book"))["year"]).alias("year"),
        F.coalesce(F.nullif(F.trim("区域划分"), F.lit("")), F.lit(BLANK_BUCKET)).alias("region"),
        style_tags(F.col("刻体倾向")).alias("tags"),
        place("省份").alias("province"),
        place("地点").alias("place"),
    )


_EDGE = r"^[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$"
#: SQL of ``style_tags``: the tags of the catalogue's style column.
TAGS = f"""list_filter(list_transform(regexp_split_to_array(coalesce(刻体倾向, ''), '[,，、/;；]'), lambda t: regexp_replace(t, '{_EDGE}', '', 'g')), lambda t: t <> '')"""
BOOKS = f"""books as (select trim(bookid) as book, 宋刻本 as title, coalesce(年份, try_cast(split_part(trim(bookid), '_', 2) as int)) as year,
  coalesce(nullif(trim(区域划分), ''), '（空）') as region, case when len({TAGS}) > 0 then {TAGS} else ['（空）'] end as tags,
  nullif(trim(省份), '/') as province, nullif(trim(地点), '/') as place
  from (select *, row_number() over (partition by trim(bookid) order by book_no desc) as k from books_metadata where trim(bookid) <> '') where k = 1)"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured glyphs (entry_id, book, ch, instance_id, three metrics); NaN and infinite values are null."""
    a = table(spark, sf_dir, "analysis_bundle")
    return a.select("entry_id", "book", F.col("std_char").alias("ch"), "instance_id", "measured_at", "lookup_missing", *[finite(F.col(m)).alias(m) for m in METRICS])


ENTRIES = "entries as (select entry_id, book, std_char as ch, instance_id, measured_at, lookup_missing, " + ", ".join(f"case when isfinite({m}) then {m} end as {m}" for m in METRICS) + " from analysis_bundle)"


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched instances with a flat box: record_id, book, ch, volume, page, idx, source_image, x, y, w, h, conf (share; missing
    is 0), method_name, ocr_file."""
    m = table(spark, sf_dir, "matched_books")
    b = F.col("bbox")
    c = F.when(~F.isnan("confidence"), F.col("confidence"))
    return m.select(
        "record_id", "book", F.col("std_char").alias("ch"), "volume", "page", F.col("char_index").alias("idx"), "source_image",
        *[b[n].alias(a) for n, a in (("x", "x"), ("y", "y"), ("width", "w"), ("height", "h"))],
        F.coalesce(F.when(c > 1, c / 100).otherwise(c), F.lit(0.0)).alias("conf"), "normalized_bbox", "method_name", "ocr_file",
    )


INSTANCES = """instances as (select record_id, book, std_char as ch, volume, page, char_index as idx, source_image, bbox.x as x, bbox.y as y, bbox.width as w, bbox.height as h,
  case when confidence is null or isnan(confidence) then 0 when confidence > 1 then confidence / 100 else confidence end as conf, normalized_bbox, method_name, ocr_file from matched_books)"""


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review items with states as stored."""
    return table(spark, sf_dir, "review_books").withColumnRenamed("std_char", "ch")


REVIEWS = "reviews as (select item_id, book, std_char as ch, instance_id, filter_status, review_status, review_at, review_method, decision, segmented_path, confirmed_path, shard_file, item_bytes, written_at from review_books)"


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary's entries in order: ord (from 1 over methods and places), method_id, method_name, ch."""
    d = table(spark, sf_dir, "standard_chars")
    return d.select((F.col("method_id") * 1000 + F.col("ord_in_method")).alias("ord"), "method_id", "method_name", F.col("std_char").alias("ch"))


DICTIONARY = "dictionary as (select method_id * 1000 + ord_in_method as ord, method_id, method_name, std_char as ch from standard_chars)"


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision log that events stand for: event_id, key, ts, status."""
    e = table(spark, sf_dir, "events")
    status = F.create_map(*[F.lit(x) for pair in STATUS_OF.items() for x in pair])
    return e.select("event_id", F.col("user_id").alias("key"), "ts", status[F.col("event_type")].alias("status"), "value", "props")


STATUS_OF = {"click": "accepted", "error": "dropped", "purchase": "confirmed", "signup": "pending", "view": "rejected"}
DECISIONS = "decisions as (select event_id, user_id as key, ts, case event_type " + " ".join(f"when '{a}' then '{b}'" for a, b in STATUS_OF.items()) + " end as status, value, props from events)"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters of 8 by 8 gray values that embeddings stand for: id, x, y, gray (0..255)."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("i", "v"))
    gray = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("v").cast("double") + 1) * 127.5).cast("int")))
    return e.select("id", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), gray.alias("gray"))


PIXELS = """pixels as (select vec_id as id, cast((i - 1) % 8 as int) as x, cast((i - 1) // 8 as int) as y,
  least(255, greatest(0, cast(floor((cast(embedding[i] as double) + 1) * 127.5) as int))) as gray from (select vec_id, embedding, unnest(range(1, 65)) as i from embeddings))"""


def with_views(*views: str) -> str:
    return "with recursive " + ", ".join(views) + " "



