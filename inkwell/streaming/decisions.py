"""Streams (extensions: the batch operators have the same results): a decision log to its latest state, and counts per window."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkwell.operators.review_state import latest


def decision_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """New parquet files of a decision log as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(stream: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events per type and window; rows later than ``late`` behind the newest are left out."""
    counts = stream.withWatermark(time, late).groupBy(F.window(time, width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("window.start").alias("start"), "event_type", "n", "total")


#: Parts of the state by a hash of the key; a batch rewrites the parts that it touches.
BUCKETS = 64


def _versions(spark: SparkSession, state_path: str) -> dict[int, int]:
    """The newest complete version of every bucket: folders ``b<bucket>/v<batch>`` with the mark of a finished write."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(state_path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out: dict[int, int] = {}
    for mark in system.globStatus(hadoop.Path(f"{state_path}/b*/v*/_SUCCESS")) or []:
        folder = mark.getPath().getParent()
        bucket, version = int(folder.getParent().getName()[1:]), int(folder.getName()[1:])
        out[bucket] = max(version, out.get(bucket, -1))
    return out


def _paths(state_path: str, versions: dict[int, int]) -> list[str]:
    return [os.path.join(state_path, f"b{b}", f"v{v}") for b, v in sorted(versions.items())]


def keep_latest(stream: DataFrame, state_path: str, checkpoint: str, keys: list[str], order: list[str], buckets: int = BUCKETS) -> StreamingQuery:
    """Upsert every micro-batch into the table of latest rows per key. The state lies in buckets by key; a batch merges the buckets
    that hold its keys and writes each as a new version, named by the batch's number, so that a batch that is replayed after a
    failure writes the same again. The version before the newest is kept, older ones are removed."""

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets)).cast("int")
        new = latest(batch, keys, [F.col(c) for c in order]).withColumn("__bucket", bucket).persist()
        try:
            touched = sorted(r[0] for r in new.select("__bucket").distinct().collect())  # no more than there are buckets
            before = {b: v for b, v in _versions(spark, state_path).items() if v < number}
            for b in touched:
                rows = new.where(F.col("__bucket") == b).drop("__bucket")
                if b in before:
                    rows = rows.unionByName(spark.read.schema(rows.schema).parquet(*_paths(state_path, {b: before[b]})))
                latest(rows, keys, [F.col(c) for c in order]).coalesce(1).write.mode("overwrite").parquet(f"{state_path}/b{b}/v{number}")
            _forget(spark, state_path, touched)
        finally:
            new.unpersist()

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _forget(spark: SparkSession, state_path: str, touched: list[int]) -> None:
    """Remove all but the two newest complete versions of the buckets."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    system = hadoop.Path(state_path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for b in touched:
        done = sorted((m.getPath().getParent() for m in system.globStatus(hadoop.Path(f"{state_path}/b{b}/v*/_SUCCESS")) or []), key=lambda p: int(p.getName()[1:]))
        for old in done[:-2]:
            system.delete(old, True)


def latest_version(spark: SparkSession, state_path: str, schema: str | None = None) -> DataFrame:
    """The rows of the newest complete version of every bucket that ``keep_latest`` wrote; versions that were not finished are not
    read. Without any, an empty table of ``schema``, or an error where none is given."""
    paths = _paths(state_path, _versions(spark, state_path))
    if paths:
        return spark.read.parquet(*paths)
    if schema is None:
        raise ValueError(f"{state_path} holds no complete version")
    return spark.createDataFrame([], schema)
