"""Reading and writing the document shards: OCR pages, matched, review and measured books, catalogue and dictionary.

Reads are schema-first (no inference pass), skip what can't be parsed and keep the file an unreadable row came from; writes are
partitioned by book, and a partition overwrite replaces only the books it holds."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.scalars import lenient_int, safe_name
from inkwell.operators.global_sort import partitions, runs, sorted_ranges
from inkwell.operators.review_state import latest
from inkwell.runtime import materialise

BOX = "struct<x:int,y:int,width:int,height:int>"
NORMAL_BOX = "struct<x:double,y:double,width:double,height:double>"
PAGE = f"success boolean, image_path string, image_size struct<width:int,height:int>, timestamp string, character_count int, full_text string, characters array<struct<index:int,text:string,confidence:double,bbox:{BOX},normalized_bbox:{NORMAL_BOX}>>, error string"
INSTANCE = f"struct<volume:int,page:string,char_index:int,source_image:string,bbox:{BOX},normalized_bbox:{NORMAL_BOX},confidence:double,method:string,ocr_file:string>"
MATCHED = f"data map<string,array<{INSTANCE}>>, chars map<string,array<{INSTANCE}>>, books map<string,struct<chars:map<string,array<{INSTANCE}>>>>"
REVIEW_ITEM = "struct<filter:struct<status:string,timestamp:string>,review:struct<status:string,timestamp:string,method:string,decision:string,confirmed_path:string,segmented_path:string>>"
REVIEW = f"version int, chars map<string,struct<items:map<string,{REVIEW_ITEM}>>>, books map<string,map<string,struct<items:map<string,{REVIEW_ITEM}>>>>"
DICTIONARY = "title string, methods array<struct<id:int,name:string,chars:array<string>,description:string>>, all_chars array<string>"
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "tiff", "tif")


def _json(spark: SparkSession, path: str, schema: str, glob: str) -> DataFrame:
    """One row per file with its path; a file that can't be parsed has null in all other columns."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).option("pathGlobFilter", glob).json(path)
    return rows.withColumn("file", F.input_file_name())


def ocr_characters(spark: SparkSession, path: str) -> DataFrame:
    """One row per recognised character of every successful page below ``path`` (``*_ocr.json``): file, image_path, index, text,
    confidence, bbox, normalized_bbox. Failed pages and files that can't be parsed give none."""
    pages = _json(spark, path, PAGE, "*_ocr.json").where("success")
    return pages.select("file", "image_path", "image_size", F.explode("characters").alias("c")).select("file", "image_path", "image_size", "c.*")


def _stem(file: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(F.try_url_decode(file), "/"), -1), "\\.json$", "")


def _matched_books(spark: SparkSession, path: str) -> DataFrame:
    """(book, chars) of the matched files below ``path`` that can be read."""
    raw = _json(spark, path, MATCHED, "*.json")
    own = F.coalesce("data", "chars")
    single = raw.where(own.isNotNull()).select(_stem(F.col("file")).alias("book"), own.alias("chars"))
    many = raw.where(own.isNull()).select(F.explode("books").alias("book", "b")).select("book", F.col("b.chars").alias("chars"))
    return single.unionByName(many).where("chars is not null")


def _instance_rows(books: DataFrame) -> DataFrame:
    by_char = books.select("book", F.explode("chars").alias("char", "list"))
    return by_char.select("book", "char", F.posexplode("list").alias("ord", "i")).select("book", "char", "ord", "i.*")


def matched_instances(spark: SparkSession, path: str) -> DataFrame:
    """Matched shards in any of their three layouts (data, chars, books by name) as rows (book, char, ord, instance); the book of
    the first two is the file's stem. A later layout counts only where the ones before it are missing."""
    return _instance_rows(_matched_books(spark, path))


def matched_with_fallback(spark: SparkSession, *stores: str) -> DataFrame:
    """Like ``matched_instances`` over several stores (a folder of shards, one of cached shards, the file of all books): each book
    comes from the first store in which it can be read."""
    found = None
    for path in stores:
        books = _matched_books(spark, path)
        found = books if found is None else found.unionByName(books.join(found.select("book").distinct(), "book", "left_anti"))
    return _instance_rows(found)


def review_items(spark: SparkSession, path: str, backups: str | None = None) -> DataFrame:
    """Review shards as rows (book, char, instance_id, filter, review). A book whose shard can't be parsed is read from its newest
    backup that can (``backups/<book>/<time>.json``, by name)."""

    def rows(raw: DataFrame) -> DataFrame:
        single = raw.where("chars is not null").select("book", "chars")
        many = raw.where("chars is null").select(F.explode("books").alias("book", "chars"))
        items = single.unionByName(many).select("book", F.explode("chars").alias("char", "c")).select("book", "char", F.explode("c.items").alias("instance_id", "i"))
        return items.where("i is not null").select("book", "char", "instance_id", "i.filter", "i.review")

    main = _json(spark, path, REVIEW, "*.json").withColumn("book", _stem(F.col("file")))
    readable = "chars is not null or books is not null"
    good = main.where(readable)
    if backups is None:
        return rows(good)
    saved = _json(spark, backups, REVIEW, "*.json").where(readable)
    saved = saved.withColumn("book", F.element_at(F.split(F.try_url_decode("file"), "/"), -2))
    lost = main.select("book").join(good.select("book"), "book", "left_anti")
    newest = latest(saved.join(lost, "book", "left_semi"), ["book"], [F.col("file")])
    return rows(good).unionByName(rows(newest.select(*good.columns)))


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """The dictionary's entries: ord, method_id, method_name, char."""
    d = spark.read.schema(DICTIONARY).option("multiLine", True).json(path)
    m = d.select(F.posexplode("methods").alias("m", "x")).select("m", "x.id", "x.name", F.posexplode("x.chars").alias("c", "char"))
    return m.select((F.col("m") * 1000 + F.col("c")).alias("ord"), F.col("id").alias("method_id"), F.col("name").alias("method_name"), "char")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue's CSV with trimmed fields and whole numbers where they are; blank ids are left out, the last of repeated ids
    (by the catalogue's own number) wins."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    t = raw.select(*[F.trim(F.col(f"`{c}`")).alias(c) for c in raw.columns]).where("coalesce(BookID, '') <> ''")
    return latest(t.withColumns({"年份": F.col("年份").try_cast("int"), "Number": lenient_int(F.col("Number"))}), ["BookID"], [F.col("Number")])


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime) of every image below ``path``, without reading their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where(F.lower(F.regexp_extract("path", "\\.([A-Za-z]+)$", 1)).isin(*IMAGE_SUFFIXES)).select("path", "length", "modificationTime")


def decoded_images(spark: SparkSession, path: str) -> DataFrame:
    """(origin, width, height, channels, data) of the images that can be decoded; those that can't are dropped."""
    return spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path).select("image.origin", "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")


def write_by_book(df: DataFrame, path: str, keys: tuple[str, ...] = ("book",), per_book: int = 1) -> None:
    """One folder per book (or per engine and book) with ``per_book`` files, replacing the folders of the books that ``df`` holds and
    no others. Rows are spread over ``per_book`` tasks per book, so that a book with a third of all rows can be split."""
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if not t.startswith("map")]), F.lit(per_book))
    shuffled = df.repartition(*keys, salt)
    shuffled.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


#: Rows of a file of a book at most; rows that are read back as one batch at least.
FILE_ROWS, READ_ROWS = 100_000, 10_000
_NO_BOOK = "__HIVE_DEFAULT_PARTITION__"


def book_folder(book: str | None) -> str:
    """The name of a book's folder, as Spark names partitions; that of an empty name, for which Spark has none, is a lone %."""
    if book is None:
        return f"book={_NO_BOOK}"
    return "book=" + (re.sub(r"""["#%'*/:=?\\{\[\]^\x00-\x1f\x7f]""", lambda m: f"%{ord(m[0]):02X}", book) or "%")


def folder_book(folder: str) -> str | None:
    name = folder.removeprefix("book=")
    return None if name == _NO_BOOK else "" if name == "%" else unquote(name)


def _system(path: str):
    from pyarrow import fs

    local = "://" not in path or path.startswith("file:")
    return (fs.LocalFileSystem(), path.removeprefix("file://").removeprefix("file:")) if local else fs.FileSystem.from_uri(path)


def write_book_files(df: DataFrame, path: str, order: list[str]) -> DataFrame:
    """Write ``df`` below the new folder ``path``, a folder per ``book``, and return the index (name, rows) of its files. The table is
    sorted into ranges by book and ``order`` (which should tell rows apart), and a task writes what it has of a book: a book of few
    rows is one file, or two where a range ends, and a large one as many as it has ranges or ``FILE_ROWS``. Many small files cost
    their task a little each, and the driver nothing: it neither lists nor moves them. A file appears whole or not at all; a task
    that is repeated writes the same again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        system, root = _system(path)
        task, told, held, count = TaskContext.get().partitionId(), [], [], 0

        def write() -> None:
            rows = pa.Table.from_batches(held)
            folder = book_folder(rows.column("book")[0].as_py())
            system.create_dir(f"{root}/{folder}", recursive=True)
            name, draft = f"{folder}/part-{task:05d}-{len(told):07d}.parquet", f"{root}/{folder}/.{uuid.uuid4().hex}"
            with system.open_output_stream(draft) as out:
                pq.write_table(rows.drop_columns(["book"]), out, write_statistics=False, store_schema=False)
            system.move(draft, f"{root}/{name}")
            told.append((name, rows.num_rows))

        for b in batches:
            if not b.num_rows:
                continue
            starts = runs([b.column("book")])
            for start, end in zip(starts, np.append(starts[1:], b.num_rows), strict=True):
                part = b.slice(int(start), int(end - start))
                if held and (count >= FILE_ROWS or held[-1].column("book")[0] != part.column("book")[0]):
                    write()
                    held, count = [], 0
                held.append(part)
                count += part.num_rows
        if held:
            write()
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in told], pa.string()), pa.array([k for _, k in told], pa.int64())], names=["name", "rows"])

    return materialise(sorted_ranges(df, ["book"], [F.col(c).asc() for c in order]).mapInArrow(run, "name string, rows bigint"))


def read_book_files(index: DataFrame, path: str, schema: str) -> DataFrame:
    """The rows of the files of ``index`` (of ``write_book_files``) below ``path``: book, from the folder's name, and the columns of
    ``schema``. Tasks get files by number; a file that is missing or has other rows than the index says fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        system, root = _system(path)
        held, count = [], 0
        for b in batches:
            for name, rows in zip(b.column("name").to_pylist(), b.column("rows").to_pylist(), strict=True):
                with system.open_input_file(f"{root}/{name}") as f:
                    t = pq.ParquetFile(f).read()
                if t.num_rows != rows:
                    raise ValueError(f"{name} has {t.num_rows} rows instead of {rows}")
                held.append(t.add_column(0, "book", pa.array([folder_book(name.split("/")[0])] * rows, pa.string())))
                count += rows
                if count >= READ_ROWS:
                    yield from pa.concat_tables(held).combine_chunks().to_batches()
                    held, count = [], 0
        if held:
            yield from pa.concat_tables(held).combine_chunks().to_batches()

    return index.repartition(max(24, partitions(index))).mapInArrow(run, f"book string, {schema}")


def write_report(df: DataFrame, path: str, form: str = "csv") -> None:
    """A report as csv (quoted, with header), json (null for what is not finite) or text."""
    safe = df.select(*[F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])
    if form == "csv":
        safe.write.mode("overwrite").option("header", True).csv(path)
    elif form == "json":
        safe.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    elif form == "text":
        safe.select(F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NA")) for c in safe.columns]).alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"no report form {form}")


def write_documents(df: DataFrame, path: str, name: str = "name", content: str = "content", folder: str | None = None) -> DataFrame:
    """Write each row's ``content`` (text or bytes) as the file ``path/name``, or ``path/folder/name`` with the folder that a column
    gives, and return the index (name, bytes). A file appears whole or not at all: it is written beside its place and moved there, so a task that is repeated writes the same again. Names are
    cleaned of slashes; null contents write nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        root = path.removeprefix("file://").removeprefix("file:")
        system, root = fs.FileSystem.from_uri(path) if "://" in path and not path.startswith("file:") else (fs.LocalFileSystem(), root)
        system.create_dir(root, recursive=True)
        for b in batches:
            told = []
            for n, c, below in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                if c is None:
                    continue
                if below:
                    n = f"{below}/{n}"
                    system.create_dir(f"{root}/{below}", recursive=True)
                data = c.encode() if isinstance(c, str) else bytes(c)
                draft = f"{root}/.{uuid.uuid4().hex}"
                with system.open_output_stream(draft) as out:
                    out.write(data)
                system.move(draft, f"{root}/{n}")
                told.append((n, len(data)))
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in told], pa.string()), pa.array([k for _, k in told], pa.int64())], names=["name", "bytes"])

    rows = df.select(safe_name(F.col(name)).alias("name"), content, F.lit("").alias("below") if folder is None else safe_name(F.col(folder)).alias("below"))
    return materialise(rows.mapInArrow(run, "name string, bytes bigint"))
