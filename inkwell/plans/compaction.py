"""Queries of the general problems 3 and 5, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators.compaction import GROUPS_PER_TASK, consolidate, consolidate_files, kept_images, read_consolidated, same_image_members, same_image_pairs
from inkwell.operators.packed_values import explode_values
from inkwell.runtime import scratch_path, table

#: Bytes of a consolidated file, by the sizes the items state.
GROUP_BYTES = 64 * 1024 * 1024


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = table(spark, sf_dir, "books_metadata").select("book_no", "刻体倾向")
    return explode_values(books, "刻体倾向", at_least=2).select("book_no", "pos", "tag")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items are consolidated first; the pairs are read from the published files."""
    slim = table(spark, sf_dir, "review_books").select("item_id", "segmented_path", "confirmed_path", "shard_file", "item_bytes")
    folder, _ = consolidate(slim, "shard_file", F.col("item_bytes"), ["item_id"], GROUP_BYTES)
    return same_image_pairs(read_consolidated(spark, folder, "item_id bigint, segmented_path string, confirmed_path string"))


def p5_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image once in few files: how many rows every published file holds and how many bytes were dealt to it, by its place."""
    kept = kept_images(table(spark, sf_dir, "review_books"))
    _, manifest = consolidate(kept, "shard_file", F.col("item_bytes"), ["item_id", "image"], GROUP_BYTES)
    return manifest.select("grp", "rows", "load")


def p5_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image once with the item that keeps it, read back from the published files; items without an image come once too."""
    kept = kept_images(table(spark, sf_dir, "review_books"))
    folder, _ = consolidate(kept, "shard_file", F.col("item_bytes"), ["item_id", "image"], GROUP_BYTES)
    back = read_consolidated(spark, folder, "item_id bigint, image string")
    return back.select("item_id", F.regexp_extract("image", "[^/]*$", 0).alias("name"))


def p5_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the published files hold in all, and whether they are few and evenly filled: no more than the bytes ask for and one
    per task, none above twice the size of a file."""
    kept = kept_images(table(spark, sf_dir, "review_books"))
    _, manifest = consolidate(kept, "shard_file", F.col("item_bytes"), ["item_id", "image"], GROUP_BYTES)
    most = F.ceil(F.sum("load") / GROUP_BYTES) + F.ceil(F.sum("load") / (GROUP_BYTES * GROUPS_PER_TASK))
    return manifest.agg(F.sum("rows").alias("n"), F.sum("load").alias("total"), (F.count(F.lit(1)) <= most).alias("few"), (F.max("load") <= 2 * GROUP_BYTES).alias("even"))


def p5_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item with the first item of its image."""
    return same_image_members(table(spark, sf_dir, "review_books"))


def p5_small_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items written as files of about a thousand rows, consolidated file by file without moving a row, and read back."""
    items = table(spark, sf_dir, "review_books").select("item_id", "instance_id", "segmented_path", "written_at")
    folder = scratch_path(spark, "shards")
    items.repartition(max(1, items.count() // 1000), "item_id").write.parquet(folder)
    listed = spark.read.format("binaryFile").load(folder).select(F.col("path").alias("file"), F.col("length").alias("bytes"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema.fields)
    merged, _ = consolidate_files(listed, schema, 1024 * 1024)
    return read_consolidated(spark, merged, schema)


QUERIES = {f.__name__: f for f in (p3_found, p5_found, p5_files, p5_totals, p5_members, p5_small_files, p5_images)}

_ONE = r"""(?:"(?:[^"]|"")*"|“[^”]*”|「[^」]*」|[^"“「、，,﹑､;；/／|｜+＋\t\n]+)"""
_SPACE = r"[\s\x{A0}\x{3000}\x{2000}-\x{200A}\x{202F}]"

_NAMED = r"""with named as (
  select distinct item_id, key from (
    select item_id, lower(regexp_extract(p, '\.[A-Za-z0-9]+$', 0)) as ext,
      regexp_replace(regexp_replace(regexp_extract(p, 'data/(.*)$', 1), '\.[A-Za-z0-9]+$', ''), '^results/manual/(segmented|confirmed)/', 'glyph/') || ext as key
    from (select item_id, regexp_replace(regexp_replace(replace(url_decode(raw), '\', '/'), '/(\.?/)+', '/', 'g'), '[^/]+/\.\./', '', 'g') as p
      from (select item_id, unnest([segmented_path, confirmed_path]) as raw from review_books) where raw <> ''))"""

#: The single style values of every catalogue row: clean (book_no, vals).
STYLE_VALUES = rf"""with v as (
  select book_no, list_filter(list_transform(regexp_extract_all("刻体倾向", '{_ONE}'), lambda s: regexp_replace(s, '^{_SPACE}+|{_SPACE}+$', '', 'g')), lambda s: s <> '') as vals from books_metadata
), clean as (
  select book_no, list_filter(list_transform(vals, lambda s: regexp_replace(case when s[1] = '"' then replace(s[2:-2], '""', '"') when s[1] in ('“', '「') then s[2:-2] else s end, '^{_SPACE}+|{_SPACE}+$', '', 'g')), lambda s: s <> '') as vals from v
)"""

ORACLE = {
    "p3_found": STYLE_VALUES + " select book_no, cast(i as int) as pos, vals[i] as tag from (select book_no, vals, unnest(range(1, len(vals) + 1)) as i from clean where len(vals) >= 2)",
    "p5_found": _NAMED
    + ") select distinct a.item_id as item_id_a, b.item_id as item_id_b from named a join named b on a.key = b.key and a.item_id < b.item_id",
    "p5_members": _NAMED + ") select distinct item_id, min(item_id) over (partition by key) as first_id from named",
    "p5_small_files": "select item_id, instance_id, segmented_path, written_at from review_books",
    "p5_totals": _NAMED
    + """), kept as (select max_by(item_id, struct_pack(a := written_at, b := item_id)) as item_id from named join (select item_id, written_at from review_books) using (item_id) group by key
  union all select item_id from review_books r where not exists (select 1 from named n where n.item_id = r.item_id))
  select count(*) as n, cast(sum(item_bytes) as bigint) as total, true as few, true as even from kept join review_books using (item_id)""",
    "p5_images": _NAMED
    + """), kept as (select key, max_by(item_id, struct_pack(a := written_at, b := item_id)) as item_id from named join (select item_id, written_at from review_books) using (item_id) group by key)
  select item_id, regexp_extract(key, '[^/]*$', 0) as name from kept union all select item_id, null from review_books r where not exists (select 1 from named n where n.item_id = r.item_id)""",
}
