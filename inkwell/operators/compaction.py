"""Far too many small files (problem 5): balanced longest-first scheduling into few files of good size.

Files (or the chunks of a file that is larger than a target file) are spread over tasks, some groups' worth of them each; a task
fixes its output groups from the bytes it has to place and deals its files out, longest first, to the least loaded group (a heap).
Each group is streamed through pyarrow into one new file. What was written is read back and compared with the input, all columns
of it, and a manifest is published by one rename. Files of failed or repeated attempts are in no manifest, so a reader never sees
them.

Rows that lie in one table and only name their file travel once, to the task that places it (``consolidate``); files that lie by
themselves are opened by that task, and nothing but their names and sizes travels (``consolidate_files``)."""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.paths import glyph_image_key
from inkwell.runtime import materialise, scratch_path, small

TARGET_BYTES = 128 * 1024 * 1024
#: Groups that one task deals its files to, on average.
GROUPS_PER_TASK = 4
#: Rows of a group that are kept until they are written together.
ROWS_HELD = 16_384

MANIFEST = "grp bigint, file string, rows bigint, bytes bigint, load bigint"


def deal(sizes: list[int], target: int) -> list[int]:
    """Group of each size: as many groups as the total needs at ``target`` bytes each, longest first to the least loaded."""
    groups = max(1, -(-sum(sizes) // max(1, target)))
    heap = [(0, g) for g in range(groups)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, g = heapq.heappop(heap)
        out[i] = g
        heapq.heappush(heap, (load + sizes[i], g))
    return out


def _units(files: DataFrame, target_bytes: int) -> DataFrame:
    """(file, chunk, bytes): files (file, bytes) in chunks of at most about the target. Null and negative sizes count as 0."""
    size = F.greatest(F.coalesce("bytes", F.lit(0)), F.lit(0)).cast("bigint")
    chunks = F.greatest(F.lit(1), F.ceil(size / F.lit(float(target_bytes)))).cast("int")
    one = files.select("file", size.alias("bytes"), chunks.alias("chunks"))
    return one.select("file", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.floor(F.col("bytes") / F.col("chunks")).cast("bigint").alias("bytes"), "chunks")


def _tasks(total: int, target_bytes: int) -> int:
    return max(1, -(-total // (target_bytes * GROUPS_PER_TASK)))


class _Groups:
    """The open output files of one task, by group."""

    def __init__(self, folder: str, tasks: int):
        from pyarrow import fs
        from pyspark import TaskContext

        self.part, self.tasks = TaskContext.get().partitionId(), tasks
        if "://" in folder or folder.startswith("file:"):
            self.system, self.base = fs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:", "file://", 1))
        else:
            self.system, self.base = fs.LocalFileSystem(), folder
        self.open: dict[int, list] = {}  # group -> writer, name, rows, batches held, rows held
        self.load: dict[int, int] = {}

    def add(self, group: int, batch: pa.RecordBatch) -> None:
        import pyarrow.parquet as pq

        if group not in self.open:
            name = f"part-{self.part + self.tasks * group:07d}-{uuid.uuid4().hex}.parquet"
            self.open[group] = [pq.ParquetWriter(f"{self.base}/{name}", batch.schema, filesystem=self.system, compression="zstd"), name, 0, [], 0]
        o = self.open[group]
        o[2] += batch.num_rows
        o[3].append(batch)
        o[4] += batch.num_rows
        if o[4] >= ROWS_HELD:
            self._flush(o)

    def _flush(self, o: list) -> None:
        if o[3]:
            o[0].write_table(pa.Table.from_batches(o[3]))
            o[3], o[4] = [], 0

    def close(self, group: int) -> pa.RecordBatch:
        o = self.open.pop(group)
        self._flush(o)
        o[0].close()
        told = [[self.part + self.tasks * group], [o[1]], [o[2]], [self.system.get_file_info(f"{self.base}/{o[1]}").size], [self.load.get(group, 0)]]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(told, kinds, strict=True)], names=["grp", "file", "rows", "bytes", "load"])

    def deal(self, keys: list, sizes: list[int], target: int) -> dict:
        groups = deal(sizes, target)
        for g, size in zip(groups, sizes, strict=True):
            self.load[g] = self.load.get(g, 0) + size
        return dict(zip(keys, groups, strict=True))


def _row_writer(folder: str, tasks: int, target: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Streams over the rows of one task: first a row per file (or chunk) with its bytes, which is dealt out, then the data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = _Groups(folder, tasks)
        units: list[tuple[str, int]] = []
        sizes: list[int] = []
        dealt: dict | None = None
        for b in batches:
            kind = b.column(0).to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(kind, 1))  # sorted by kind
            head, data = b.slice(0, cut), b.slice(cut)
            units += zip(head.column(1).to_pylist(), head.column(2).to_pylist(), strict=True)
            sizes += head.column(3).to_pylist()
            if not data.num_rows:
                continue
            if dealt is None:
                dealt = groups.deal(units, sizes, target)
            named = pa.StructArray.from_arrays([data.column(1), data.column(2)], names=["f", "c"])
            files = pa.Table.from_arrays([named.field(0), named.field(1)], names=["f", "c"]).combine_chunks()
            code = np.array([dealt[k] for k in zip(files.column("f").to_pylist(), files.column("c").to_pylist(), strict=True)])
            body = data.drop_columns(["__kind", "__file", "__chunk", "__bytes"])
            order = np.argsort(code, kind="stable")
            edges = [0, *(np.flatnonzero(np.diff(code[order])) + 1).tolist(), len(order)]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                groups.add(int(code[order[i]]), body.take(pa.array(order[i:j])))
        for g in sorted(groups.open):
            yield groups.close(g)

    return run


def _file_writer(folder: str, tasks: int, target: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Deals out the parquet files (or every so many row groups of a large one) that one task is given, and streams group by group
    through them into one new file each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        groups = _Groups(folder, tasks)
        units: list[tuple[str, int, int]] = []
        sizes: list[int] = []
        for b in batches:
            units += zip(*[b.column(i).to_pylist() for i in (0, 1, 3)], strict=True)
            sizes += b.column(2).to_pylist()
        dealt = groups.deal(units, sizes, target)
        for g in sorted(set(dealt.values())):
            for (path, chunk, chunks), of in dealt.items():
                if of != g:
                    continue
                with pq.ParquetFile(path.removeprefix("file://").removeprefix("file:"), filesystem=groups.system) as source:
                    for batch in source.iter_batches(row_groups=list(range(chunk, source.num_row_groups, chunks))):
                        groups.add(g, batch)
            if g in groups.open:
                yield groups.close(g)

    return run


def _fresh(spark: SparkSession, folder: str | None) -> str:
    folder = folder or scratch_path(spark, "compact")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    system = hadoop.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(hadoop.Path(f"{folder}/_manifest")):
        raise RuntimeError(f"{folder} has a manifest already")
    system.mkdirs(hadoop.Path(folder))
    return folder


def mark_of(columns: list[str]) -> Column:
    """A whole number of 32 bits from all columns of a row; sums of it tell tables apart, whatever the order of their rows."""
    return F.shiftrightunsigned(F.xxhash64(*[F.col(f"`{c}`") for c in columns]), 32)


def _marks(rows: DataFrame) -> tuple[int, int]:
    total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(mark_of(rows.columns).cast("decimal(20,0)")), F.lit(0))).head()
    return int(total[0]), int(total[1])


def _publish(spark: SparkSession, written: DataFrame, folder: str, want: tuple[int, int], schema) -> DataFrame:
    """The manifest of ``written``, published if the files that it lists hold the rows of the input: their number and the sum of
    their fingerprints, over all columns, as they are read back."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    system = hadoop.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    draft, published = f"{folder}/_manifest-{uuid.uuid4().hex}", hadoop.Path(f"{folder}/_manifest")
    written.write.parquet(draft)
    have = _marks(_listed(spark, folder, draft, schema))
    if have != want:
        raise RuntimeError(f"compaction wrote {have[0]} rows of {want[0]}, or other rows; nothing is published")
    if system.exists(published) or not system.rename(hadoop.Path(draft), published):
        raise RuntimeError(f"{folder} has a manifest already")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def consolidate(rows: DataFrame, file: str, size: Column, identity: list[str], target_bytes: int = TARGET_BYTES, folder: str | None = None) -> tuple[str, DataFrame]:
    """Write ``rows``, which lie in small files named by the column ``file``, into few files below ``folder``; returns the
    folder and its manifest (grp, file, rows, bytes, load: the bytes dealt to it). ``size`` gives the bytes of a row, ``identity``
    the columns by which a large file is cut into chunks. Rows with a null file are one file. Raises, and publishes nothing, unless
    the files hold exactly the rows of the input. An empty input gives an empty manifest.

    Files are added up first, so that a file with a third of all rows is known and dealt out in chunks; each row is shuffled
    once."""
    spark = rows.sparkSession
    folder = _fresh(spark, folder)
    named = F.coalesce(F.col(file).cast("string"), F.lit(""))
    sizes = rows.groupBy(named.alias("file")).agg(F.sum(F.greatest(F.coalesce(size, F.lit(0)), F.lit(0))).cast("bigint").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.sum(mark_of(rows.columns).cast("decimal(20,0)")).alias("mark"))
    files = materialise(sizes)
    total = files.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("mark"), F.lit(0))).head()
    tasks = _tasks(int(total[0]), target_bytes)
    units = _units(files, target_bytes)
    large = units.where("chunks > 1").select(F.col("file").alias("__of"), F.col("chunks").alias("__chunks")).distinct()  # at most total / target
    chunk = F.coalesce(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in identity]), F.col("__chunks")).cast("int"), F.lit(0))
    data = rows.withColumn("__file", named).join(small(large), F.col("__file") == F.col("__of"), "left")
    data = data.select(F.lit(1).alias("__kind"), "__file", chunk.alias("__chunk"), F.lit(None).cast("bigint").alias("__bytes"), *[F.col(f"`{c}`") for c in rows.columns])
    heads = units.select(F.lit(0).alias("__kind"), F.col("file").alias("__file"), F.col("chunk").alias("__chunk"), F.col("bytes").alias("__bytes"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields])
    placed = heads.unionAll(data).repartition(tasks, "__file", "__chunk").sortWithinPartitions("__kind")
    manifest = _publish(spark, placed.mapInArrow(_row_writer(folder, tasks, target_bytes), MANIFEST), folder, (int(total[1]), int(total[2])), rows.schema)
    return folder, manifest


def consolidate_files(files: DataFrame, schema: str, target_bytes: int = TARGET_BYTES, folder: str | None = None) -> tuple[str, DataFrame]:
    """Write the parquet files that ``files`` lists (file: path, bytes) and that have the columns of ``schema`` into few files below
    ``folder``; returns the folder and its manifest. A file above the target is dealt out by row groups. Raises, and publishes
    nothing, unless the new files hold exactly the rows of the old ones. No file gives an empty manifest."""
    spark = files.sparkSession
    folder = _fresh(spark, folder)
    files = materialise(files.select("file", "bytes"))
    total = files.agg(F.coalesce(F.sum("bytes"), F.lit(0))).head()[0]  # one row
    tasks = _tasks(int(total), target_bytes)
    placed = _units(files, target_bytes).repartition(tasks, "file", "chunk")
    written = materialise(placed.select("file", "chunk", "bytes", "chunks").mapInArrow(_file_writer(folder, tasks, target_bytes), MANIFEST))
    roots = [r.root for r in files.select(F.regexp_replace("file", "/[^/]*$", "").alias("root")).distinct().limit(10_001).collect()]
    if len(roots) > 10_000:
        raise ValueError("the files lie in more than 10,000 folders: consolidate them folder by folder")
    old = spark.read.schema(schema).parquet(*roots).select("*", F.col("_metadata.file_path").alias("__path")) if roots else None
    want = (0, 0)
    if old is not None:
        plain = lambda c: F.regexp_replace(F.try_url_decode(c), "^file:/*", "/")
        listed = files.select(plain("file").alias("__listed"))
        want = _marks(old.withColumn("__at", plain("__path")).join(listed, F.col("__at") == F.col("__listed"), "left_semi").drop("__path", "__at"))
    return folder, _publish(spark, written, folder, want, schema)


def _listed(spark: SparkSession, folder: str, manifest: str, schema) -> DataFrame:
    listed = spark.read.schema(MANIFEST).parquet(manifest).select(F.col("file").alias("__listed"))
    rows = spark.read.schema(schema).option("pathGlobFilter", "part-*.parquet").parquet(folder)
    return rows.withColumn("__name", F.col("_metadata.file_name")).join(listed, F.col("__name") == F.col("__listed"), "left_semi").drop("__name")


def read_consolidated(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of the files that the manifest of ``folder`` lists, and of no others."""
    return _listed(spark, folder, f"{folder}/_manifest", schema)


def image_keys(segmented: str = "segmented_path", confirmed: str = "confirmed_path") -> Column:
    """array<string>: the distinct glyph images that a review item names; empty without any path."""
    return F.array_distinct(F.array_compact(F.array(glyph_image_key(segmented), glyph_image_key(confirmed))))


def same_image_pairs(items: DataFrame, id_col: str = "item_id") -> DataFrame:
    """(item_id_a, item_id_b), smaller first: the rows that name the same glyph image in either path. Rows without any path
    name no image; the same two rows are one pair, even over two images."""
    # explode_outer: for a plain explode the keys would be computed again to test that there are any
    named = items.select(F.col(id_col).alias("id"), F.explode_outer(image_keys()).alias("image")).where("image is not null").select("id", F.xxhash64("image").alias("k1"), F.xxhash64(F.lit("inkwell"), "image").alias("k2"))
    a, b = named.alias("a"), named.alias("b")
    met = a.join(b, (F.col("a.k1") == F.col("b.k1")) & (F.col("a.k2") == F.col("b.k2")) & (F.col("a.id") < F.col("b.id")))
    return met.select(F.col("a.id").alias(f"{id_col}_a"), F.col("b.id").alias(f"{id_col}_b")).distinct()


def same_image_members(items: DataFrame, id_col: str = "item_id") -> DataFrame:
    """(item_id, first_id): the items of each image with the smallest id among them; linear in the items, where pairs are not. An item
    that names two images has two rows, unless both have the same first item. Items without any path give none."""
    named = items.select(F.col(id_col).alias("id"), F.explode_outer(image_keys()).alias("image")).where("image is not null").select("id", F.xxhash64("image").alias("k1"), F.xxhash64(F.lit("inkwell"), "image").alias("k2"))
    first = named.groupBy("k1", "k2").agg(F.min("id").alias("first_id"))
    return named.join(first, ["k1", "k2"]).select(F.col("id").alias(id_col), "first_id").distinct()


def kept_images(items: DataFrame) -> DataFrame:
    """The items with one row per glyph image: all columns and ``image``; of several items that name an image, the one
    written last (then the largest item_id) keeps it, so each image comes once and none is lost. Items that name no image
    come once each, with a null image."""
    cols = [c for c in items.columns if c != "image"]
    one = items.select(*[F.col(f"`{c}`") for c in cols], F.explode_outer(image_keys()).alias("image"))
    without = one.where("image is null")
    record = F.struct(*[F.col(f"`{c}`") for c in cols])
    kept = one.where("image is not null").groupBy("image").agg(F.max_by(record, F.struct("written_at", "item_id")).alias("r")).select("r.*", "image")
    return kept.unionByName(without)
