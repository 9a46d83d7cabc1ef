"""Write-back, retention and second-OCR queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators import review_state as RS
from inkwell.plans.registry import Registry
from inkwell.runtime import scratch_path, table
from inkwell.sources import views as V
from inkwell.sources.ocr_service import parsed_answer
from inkwell.sources.views import with_views
from inkwell.streaming.decisions import keep_latest, latest_version

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle
query = R.query

_LAST = "lastd as (select key, status from (select *, row_number() over (partition by key order by ts desc, event_id desc) as k from decisions) where k = 1)"


def _changes(spark, d):
    last = RS.latest(V.decisions(spark, d).select("key", "status", "ts", "event_id"), ["key"], [F.col("ts"), F.col("event_id")])
    return last.select(F.col("key").alias("item_id"), F.col("status").alias("filter_status"))


@query(with_views(V.DECISIONS, _LAST) + "select coalesce(item_id, key) as item_id, case when key is not null then status else filter_status end as filter_status from review_books full join lastd on item_id = key")
def bulk_writeback(spark, d):
    """Review items with the last decisions written over them; decisions on unknown items add rows."""
    return RS.upsert(table(spark, d, "review_books").select("item_id", "filter_status"), _changes(spark, d), ["item_id"])


@query(with_views(V.DECISIONS, _LAST) + "select item_id, case when key is not null then status else filter_status end as filter_status from review_books left join lastd on item_id = key")
def candidate_decision(spark, d):
    """The same for existing items only."""
    return RS.upsert(table(spark, d, "review_books").select("item_id", "filter_status"), _changes(spark, d), ["item_id"], insert=False)


@query(with_views(V.DECISIONS) + "select key, event_id, cast(k as int) as k from (select *, row_number() over (partition by key order by ts desc, event_id desc) as k from decisions) where k <= 5")
def backup_retention(spark, d):
    """The five newest snapshots of every key."""
    log = V.decisions(spark, d).select("key", "event_id", "ts")
    return RS.first_per(log, ["key"], [F.col("ts").desc(), F.col("event_id").desc()], 5, "k").select("key", "event_id", "k")


@query("""select record_id, case record_id % 5 when 4 then '' else std_char end as text, case record_id % 5 when 4 then 0.0 else coalesce(case when isfinite(confidence) then round(confidence, 4) end, 0.0) end as conf from matched_books""")
def ocr_answers(spark, d):
    """Answers of the OCR service in all their layouts, read back in one form."""
    m = table(spark, d, "matched_books")
    c = F.coalesce(F.when(~F.isnan("confidence"), F.round("confidence", 4)), F.lit(0.0))
    hit = F.struct(F.col("std_char").alias("text"), c.alias("confidence"))
    less = F.struct(F.lit("x").alias("text"), (c - 1).alias("confidence"))
    k = F.col("record_id") % 5
    answer = (
        F.when(k == 0, F.to_json(hit))
        .when(k == 1, F.to_json(F.struct(F.array(less, hit, less).alias("text_regions"))))
        .when(k == 2, F.to_json(F.struct(F.array(hit, less).alias("result"))))
        .when(k == 3, F.to_json(F.struct(F.array(hit).alias("data"))))
        .otherwise(F.lit("no json"))
    )
    return m.select("record_id", parsed_answer(answer).alias("a")).select("record_id", "a.text", F.col("a.confidence").alias("conf"))


@query("select user_id as key, event_type, ts from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1")
def stream_latest_decision(spark, d):
    """The log read as a stream (all that is there, in micro-batches) and kept as a table of latest rows: an extension, with the
    result of the batch operator."""
    log = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    out = scratch_path(spark, "stream")
    stream = log.select("event_id", F.col("user_id").alias("key"), "ts", "event_type")
    keep_latest(stream, f"{out}/state", f"{out}/progress", ["key"], ["ts", "event_id"]).awaitTermination()
    return latest_version(spark, f"{out}/state").select("key", "event_type", "ts")
