"""The project's files: written from the given tables in their formats, with the faults that readers have to bear, and read back."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.plans.registry import Registry
from inkwell.runtime import scratch_path, table
from inkwell.sources import shards
from inkwell.sources import views as V
from inkwell.sources.ocr_service import recognise
from inkwell.sources.views import with_views

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle
query = R.query


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def _by_key(df: DataFrame, keys: list[str], key: str, item: Column, name: str) -> DataFrame:
    """``item`` of all rows as a map by ``key`` per ``keys``."""
    return df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col(key).alias("k"), item.alias("v")))).alias(name))


# ---- recognised pages ----


@query("select ocr_file || '.' || std_char as page, char_index as idx, std_char as text, case when isfinite(confidence) then confidence end as conf, bbox.x as x, bbox.width as w from matched_books where ocr_file is not null and std_char is not null and book is not null")
def read_ocr_pages(spark, d):
    """The characters of recognised pages, one document of pages per book; failed pages and documents that can't be parsed give
    none."""
    m = table(spark, d, "matched_books").where("ocr_file is not null and std_char is not null and book is not null")
    clean = F.when(~F.isnan("confidence"), F.col("confidence"))
    char = F.struct(F.col("char_index").alias("index"), F.col("std_char").alias("text"), clean.alias("confidence"), F.col("bbox"))
    pages = m.groupBy("book", F.concat_ws(".", "ocr_file", "std_char").alias("page")).agg(F.collect_list(char).alias("characters"))
    good = F.struct(F.lit(True).alias("success"), F.col("page").alias("image_path"), F.size("characters").alias("character_count"), "characters")
    failed = F.struct(F.lit(False).alias("success"), F.lit("failed").alias("image_path"), F.lit(0).alias("character_count"), F.col("characters"))
    books = pages.groupBy("book").agg(F.to_json(F.flatten(F.collect_list(F.array(good, failed)))).alias("content"))
    path = scratch_path(spark, "ocr")
    shards.write_documents(books.select(F.concat("book", F.lit("_ocr.json")).alias("name"), "content"), path)
    shards.write_documents(books.limit(1).select(F.lit("broken_ocr.json").alias("name"), F.lit("{ broken").alias("content")), path)
    back = shards.ocr_characters(spark, path)
    return back.select(F.col("image_path").alias("page"), F.col("index").alias("idx"), "text", F.col("confidence").alias("conf"), "bbox.x", F.col("bbox.width").alias("w"))


# ---- matched books ----

_MATCHED = "select book, std_char as char, volume, page, char_index as idx, source_image, bbox.x as x, bbox.height as h, method_name as method from matched_books where book is not null and std_char is not null"


def _matched_documents(spark, d: str) -> DataFrame:
    """(book, kind, chars): the instances of every book by character, and a number from 0 to 5 by which books differ in layout."""
    m = table(spark, d, "matched_books").where("book is not null and std_char is not null")
    clean = F.when(~F.isnan("confidence"), F.col("confidence"))
    instance = F.struct("volume", "page", "char_index", "source_image", "bbox", "normalized_bbox", clean.alias("confidence"), F.col("method_name").alias("method"), "ocr_file")
    lists = m.groupBy("book", "std_char").agg(F.collect_list(instance).alias("l"))
    chars = _by_key(lists, ["book"], "std_char", F.col("l"), "chars")
    return chars.withColumn("kind", F.pmod(F.hash("book"), F.lit(6)))


@query(_MATCHED)
def read_matched(spark, d):
    """Every book from the first store that has it: shards (as data or as chars), else cached shards, else the file of all books. Some
    shards are broken, some stand in several stores with other contents."""
    docs = _matched_documents(spark, d)
    root = scratch_path(spark, "matched")
    named = lambda rows, content: rows.select(F.concat("book", F.lit(".json")).alias("name"), content.alias("content"))
    empty = F.from_json(F.lit("{}"), "map<string,array<struct<page:string>>>")
    shards.write_documents(named(docs.where("kind = 0"), _json(data=F.col("chars"))), f"{root}/shards")
    shards.write_documents(named(docs.where("kind in (1, 5)"), _json(chars=F.col("chars"))), f"{root}/shards")
    shards.write_documents(named(docs.where("kind = 2"), F.lit("[1, ")), f"{root}/shards")
    shards.write_documents(named(docs.where("kind in (2, 3)"), _json(data=F.col("chars"))), f"{root}/cache")
    shards.write_documents(named(docs.where("kind = 5"), _json(data=empty)), f"{root}/cache")
    monolith = docs.where("kind = 4").select(F.concat(F.lit("part_"), "book", F.lit(".json")).alias("name"), _json(books=F.create_map("book", F.struct("chars"))).alias("content"))
    shards.write_documents(monolith, f"{root}/all")
    back = shards.matched_with_fallback(spark, f"{root}/shards", f"{root}/cache", f"{root}/all")
    return back.select("book", "char", "volume", "page", F.col("char_index").alias("idx"), "source_image", "bbox.x", F.col("bbox.height").alias("h"), "method")


@query("select book, count(distinct std_char) as chars, count(*) as instances from matched_books where book is not null and std_char is not null group by book")
def matched_index(spark, d):
    """The index beside per-book shards: characters and instances of every book, from the shards as they are read back."""
    docs = _matched_documents(spark, d)
    path = scratch_path(spark, "shards")
    index = shards.write_documents(docs.select(F.concat("book", F.lit(".json")).alias("name"), _json(chars=F.col("chars")).alias("content")), path)
    back = shards.matched_instances(spark, path)
    counts = back.groupBy("book").agg(F.count_distinct("char").alias("chars"), F.count(F.lit(1)).alias("instances"))
    listed = index.where("bytes > 0").select(F.regexp_replace("name", "\\.json$", "").alias("book"))
    return counts.join(listed, "book", "left_semi")


# ---- review books ----

_LAST_ITEMS = "last as (select * from (select *, row_number() over (partition by book, std_char, instance_id order by item_id desc) as k from review_books where book is not null and std_char is not null and instance_id is not null) where k = 1)"


@query(with_views(_LAST_ITEMS) + "select book, std_char as char, instance_id, filter_status, review_status, decision, segmented_path from last")
def read_reviews(spark, d):
    """The last item of every key, from one review shard per book in either layout; books whose shard is broken come from the newest
    backup that can be read."""
    from inkwell.operators.review_state import latest

    r = table(spark, d, "review_books").where("book is not null and std_char is not null and instance_id is not null")
    last = latest(r.select("book", "std_char", "instance_id", "item_id", "filter_status", "review_status", "decision", "segmented_path"), ["book", "std_char", "instance_id"], [F.col("item_id")])
    item = F.struct(F.struct(F.col("filter_status").alias("status")).alias("filter"), F.struct(F.col("review_status").alias("status"), F.col("decision"), F.col("segmented_path")).alias("review"))
    chars = _by_key(_by_key(last, ["book", "std_char"], "instance_id", item, "items"), ["book"], "std_char", F.struct("items"), "chars")
    docs = chars.withColumn("kind", F.pmod(F.hash("book"), F.lit(3)))
    root = scratch_path(spark, "review")
    plain, legacy = _json(version=F.lit(2), chars=F.col("chars")), _json(books=F.create_map("book", F.col("chars")))
    shards.write_documents(docs.select(F.concat("book", F.lit(".json")).alias("name"), F.when(F.col("kind") == 0, plain).when(F.col("kind") == 1, legacy).otherwise(F.lit('{"chars": {')).alias("content")), f"{root}/main")
    lost = docs.where("kind = 2")
    for stamp, content in (("20200101", F.lit('{"chars": {"old": {"items": {}}}}')), ("20210101", plain), ("20220101", F.lit("broken"))):
        shards.write_documents(lost.select(F.lit(f"{stamp}.json").alias("name"), content.alias("content"), "book"), f"{root}/saved", folder="book")
    back = shards.review_items(spark, f"{root}/main", f"{root}/saved")
    return back.select("book", "char", "instance_id", F.col("filter.status").alias("filter_status"), F.col("review.status").alias("review_status"), F.col("review.decision").alias("decision"), F.col("review.segmented_path").alias("segmented_path"))


# ---- dictionary and catalogue ----


@query("select cast((dense_rank() over (order by method_id) - 1) * 1000 + row_number() over (partition by method_id order by ord_in_method, std_char) - 1 as bigint) as ord, method_id, method_name, std_char as char from standard_chars")
def read_dictionary(spark, d):
    """The dictionary as its JSON document, read back in order."""
    t = table(spark, d, "standard_chars")
    methods = t.groupBy("method_id", "method_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord_in_method", "std_char"))), lambda x: x["std_char"]).alias("chars"))
    one = methods.agg(F.array_sort(F.collect_list(F.struct(F.col("method_id").alias("id"), F.col("method_name").alias("name"), "chars"))).alias("methods"))
    path = scratch_path(spark, "dictionary")
    shards.write_documents(one.select(F.lit("standard_chars.json").alias("name"), _json(title=F.lit("t"), methods=F.col("methods")).alias("content")), path)
    return shards.dictionary(spark, path).select(F.col("ord").cast("bigint").alias("ord"), "method_id", "method_name", "char")


@query("select book, title, year, region, style from (select trim(bookid) as book, trim(宋刻本) as title, 年份 as year, trim(区域划分) as region, trim(刻体倾向) as style, row_number() over (partition by trim(bookid) order by book_no desc) as k from books_metadata where trim(bookid) <> '') where k = 1")
def read_catalogue(spark, d):
    """The catalogue as CSV with quotes, delimiters and line ends in its fields, read back: the last of repeated ids."""
    t = table(spark, d, "books_metadata").select(F.col("book_no").alias("Number"), F.col("bookid").alias("BookID"), "宋刻本", "年份", "区域划分", "刻体倾向")
    path = scratch_path(spark, "catalogue")
    t.write.option("header", True).option("escape", '"').option("quoteAll", False).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    empty = lambda c: F.coalesce(c, F.lit(""))
    back = shards.catalogue(spark, path)
    plain = table(spark, d, "books_metadata")
    null = plain.select(F.col("book_no").alias("Number"), *[F.col(c).isNull().alias(f"no_{k}") for k, c in (("title", "宋刻本"), ("region", "区域划分"), ("style", "刻体倾向"))])
    rows = back.join(null, "Number")
    kept = lambda c, k: F.when(~F.col(f"no_{k}"), empty(F.col(c))).alias(k)
    return rows.select(F.col("BookID").alias("book"), kept("宋刻本", "title"), F.col("年份").alias("year"), kept("区域划分", "region"), kept("刻体倾向", "style"))


# ---- images ----


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gray rasters of 8 by 8 as bitmap files, rows from the bottom up."""
    head = b"BM" + struct.pack("<IHHI", 54 + 1024 + 64, 0, 0, 54 + 1024) + struct.pack("<IiiHHIIiiII", 40, 8, 8, 1, 8, 0, 64, 2835, 2835, 256, 0)
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4)
    palette[:, 3] = 0
    for b in batches:
        gray = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.uint8).reshape(-1, 8, 8)[:, ::-1]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([head + palette.tobytes() + g.tobytes() for g in gray], pa.binary())], names=["name", "content"])


@query(with_views(V.PIXELS) + "select id, 8 as width, 8 as height, cast(sum(gray) as bigint) as total, cast(sum(gray * (x + 8 * y)) as bigint) as moment from pixels group by id")
def read_images(spark, d):
    """Rasters written as image files, listed, decoded and summed up; a file that is no image is dropped."""
    rows = V.pixels(spark, d).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "gray"))), lambda p: p["gray"]).alias("g"))
    files = rows.select(F.concat(F.col("id").cast("string"), F.lit(".bmp")).alias("name"), "g").mapInArrow(_bitmaps, "name string, content binary")
    path = scratch_path(spark, "images")
    shards.write_documents(files, path)
    shards.write_documents(rows.limit(1).select(F.lit("broken.bmp").alias("name"), F.lit("no image").alias("content")), path)
    listed = shards.image_files(spark, path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length")
    decoded = shards.decoded_images(spark, path).withColumn("name", F.regexp_extract("origin", "([^/]+)$", 1)).join(listed, "name")
    bytes_ = decoded.select(F.regexp_extract("name", "^[0-9]+", 0).cast("bigint").alias("id"), "width", "height", "channels", F.posexplode(F.split(F.hex("data"), "(?<=\\G..)")).alias("i", "v")).where("v <> '' and i % channels = 0")
    value, at = F.conv("v", 16, 10).cast("bigint"), F.floor(F.col("i") / F.col("channels"))
    return bytes_.groupBy("id", "width", "height").agg(F.sum(value).alias("total"), F.sum(value * at).alias("moment"))


# ---- second recognition ----


def _echo():
    """A stand-in for the service: the image's own text, with the share of its letters as confidence; it fails for empty images."""

    def send(images):
        if any(not i for i in images):
            raise RuntimeError("empty image")
        return [(i.decode(), 0.5) for i in images]

    return send


@query("select record_id, case when source_image is null then '' else coalesce(std_char, '-') end as text, case when source_image is null then 'error' else 'ready' end as state, case when source_image is null then 'no image' end as error from matched_books")
def second_recognition(spark, d):
    """Images sent in batches to a client per task; rows without an image are errors of their own."""
    m = table(spark, d, "matched_books").select("record_id", F.when(F.col("source_image").isNotNull(), F.coalesce("std_char", F.lit("-"))).cast("binary").alias("image"))
    return recognise(m, _echo, "record_id", "image", 32).select("record_id", "text", "state", "error")
