"""Small views and states of records: texts of pages, nested groups, keys made on demand, sessions, counters and written crops."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators import review_state as RS
from inkwell.operators.global_sort import numbered
from inkwell.plans.registry import Registry
from inkwell.plans.relational import _IID, _LAST_REVIEW, KEY, NORMAL, _keyed, _last
from inkwell.runtime import scratch_path, small, table
from inkwell.sources import shards
from inkwell.sources import views as V
from inkwell.sources.views import with_views

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle
query = R.query


@query(with_views(V.ENTRIES) + "select entry_id, aspect_ratio, face_ratio, ink_coverage from entries")
def finite_entries(spark, d):
    """Measurements with what is not finite as null."""
    return V.entries(spark, d).select("entry_id", *V.METRICS)


@query(with_views(V.INSTANCES) + "select ocr_file, array_to_string(list(ch order by idx nulls last, record_id), '') as text, coalesce(max(conf), 0) as conf from instances where ocr_file is not null and ch is not null group by ocr_file")
def ocr_text(spark, d):
    """The text of every recognised file in order of index, and its best confidence (0 without any)."""
    i = V.instances(spark, d).where("ocr_file is not null and ch is not null")
    order = F.struct(F.col("idx").isNull(), "idx", "record_id", "ch")
    g = i.groupBy("ocr_file").agg(F.array_sort(F.collect_list(order)).alias("l"), F.coalesce(F.max("conf"), F.lit(0.0)).alias("conf"))
    return g.select("ocr_file", F.array_join(F.transform("l", lambda x: x["ch"]), "").alias("text"), "conf")


@query(with_views(V.INSTANCES, V.DICTIONARY) + ", wanted as (select ch from dictionary order by ord, ch limit 5) select record_id, ch, book, volume, page, cast(row_number() over (partition by book, volume, page order by y, x, record_id) as int) as k from instances where ch in (select ch from wanted) and y is not null and x is not null")
def exact_text(spark, d):
    """The instances of a page whose text is one of the dictionary's first five characters, in reading order."""
    wanted = V.dictionary(spark, d).orderBy("ord", "ch").limit(5).select("ch").distinct()
    i = V.instances(spark, d).where("y is not null and x is not null").select("record_id", "ch", "book", "volume", "page", "x", "y").join(small(wanted), "ch", "left_semi")
    k = numbered(i, ["book", "volume", "page"], [F.col("y").asc(), F.col("x").asc(), F.col("record_id").asc()], "k")
    return k.select("record_id", "ch", "book", "volume", "page", F.col("k").cast("int").alias("k"))


@query(with_views(V.INSTANCES) + "select book, coalesce(volume, -1) as volume, count(distinct source_image) as files, min(source_image) as first from instances group by all")
def files_by_volume(spark, d):
    """Page images of every book and volume; an unknown volume is -1."""
    return V.instances(spark, d).groupBy("book", F.coalesce("volume", F.lit(-1)).alias("volume")).agg(F.count_distinct("source_image").alias("files"), F.min("source_image").alias("first"))


@query(with_views(V.INSTANCES, NORMAL, _LAST_REVIEW) + f""", k as (select distinct book, ch, {_IID} as instance_id from instances where ch is not null) select k.book, k.ch, k.instance_id, coalesce(r.filter_status, 'pending') as filter_status, coalesce(r.review_status, 'pending') as review_status, r.item_id is null as created from k left join lastr r using (book, ch, instance_id) where k.instance_id is not null""")
def ensured_items(spark, d):
    """An item for every matched key: the one there is, or a new one in its first state."""
    keys = _keyed(spark, d).where("instance_id is not null and ch is not null").select(*KEY).distinct()
    r = _last(RS.normalised(V.reviews(spark, d)), "item_id").select(*KEY, "filter_status", "review_status", "item_id")
    first = lambda c: F.coalesce(c, F.lit("pending")).alias(c)
    return keys.join(r, KEY, "left").select(*KEY, first("filter_status"), first("review_status"), F.col("item_id").isNull().alias("created"))


@query(with_views(V.DECISIONS) + ", r as (select key, max(case when status = 'pending' then ts end) as reset from decisions group by key) select key, count(*) filter (status in ('confirmed', 'accepted')) as completed, count(*) filter (status in ('dropped', 'rejected')) as failed, any_value(reset) as reset from decisions join r using (key) where reset is null or ts > reset group by key")
def session_progress(spark, d):
    """What was completed and failed since the session of a key was last reset."""
    log = V.decisions(spark, d)
    reset = log.groupBy("key").agg(F.max(F.when(F.col("status") == "pending", F.col("ts"))).alias("reset"))
    since = log.join(reset, "key").where("reset is null or ts > reset")
    return since.groupBy("key").agg(F.count_if(F.col("status").isin("confirmed", "accepted")).alias("completed"), F.count_if(F.col("status").isin("dropped", "rejected")).alias("failed"), F.first("reset").alias("reset"))


@query(with_views(V.DECISIONS) + """, k as (select *, row_number() over (partition by key order by ts desc, event_id desc) as k from decisions where status in ('confirmed', 'pending'))
  select key, case when status = 'confirmed' then 'confirmed' else 'unreviewed' end as status, case when status = 'confirmed' then 'need' else 'unknown' end as decision, case when status = 'confirmed' then event_id end as image from k where k = 1""")
def segmentation_state(spark, d):
    """Saved segmentations, and those that were taken back since: unreviewed, of unknown decision, without an image."""
    log = V.decisions(spark, d).where("status in ('confirmed', 'pending')").select("key", "status", "ts", "event_id")
    last, saved = RS.latest(log, ["key"], [F.col("ts"), F.col("event_id")]), F.col("status") == "confirmed"
    return last.select("key", F.when(saved, "confirmed").otherwise("unreviewed").alias("status"), F.when(saved, "need").otherwise("unknown").alias("decision"), F.when(saved, F.col("event_id")).alias("image"))


#: Outcomes of a candidate's preparation, the first that holds.
OUTCOMES = {
    "no_character": "ch is null",
    "no_source": "source_image is null",
    "no_file": "ocr_file is null",
    "no_volume": "volume is null",
    "no_page": "page is null",
    "no_box": "x is null or y is null or w is null or h is null",
    "empty_box": "w <= 0 or h <= 0",
    "beyond_page": "x < 0 or y < 0 or x + w > 1600 or y + h > 2400",
    "unsure": "conf < 0.8",
}
_OUTCOME = "case " + " ".join(f"when {c} then '{n}'" for n, c in OUTCOMES.items()) + " else 'ready' end"


@query(with_views(V.INSTANCES) + f", o as (select book, record_id, {_OUTCOME} as outcome from instances), k as (select *, row_number() over (partition by book, outcome order by record_id) as k from o) select book, outcome, count(*) as n, array_to_string(list(record_id order by k) filter (k <= 3), ',') as sample from k group by book, outcome")
def preparation_counters(spark, d):
    """Ten outcomes of the preparation of candidates per book, with the first three records of each."""
    o = V.instances(spark, d).select("book", "record_id", F.expr(_OUTCOME).alias("outcome"))
    n = o.groupBy("book", "outcome").agg(F.count(F.lit(1)).alias("n"))
    first = RS.first_per(o, ["book", "outcome"], [F.col("record_id").asc()], 3, "k").groupBy("book", "outcome").agg(F.array_sort(F.collect_list("record_id")).alias("l"))
    return n.join(first, ["book", "outcome"]).select("book", "outcome", "n", F.array_join(F.transform("l", lambda v: v.cast("string")), ",").alias("sample"))


@query("select book, method_name, min(record_id) as record_id, cast(row_number() over (partition by book order by min(record_id)) as int) as k from matched_books where method_name is not null group by book, method_name")
def first_occurrences(spark, d):
    """The methods of a book in the order in which they occur first."""
    m = table(spark, d, "matched_books").where("method_name is not null").groupBy("book", "method_name").agg(F.min("record_id").alias("record_id"))
    return RS.first_per(m, ["book"], [F.col("record_id").asc()], 2**31 - 1, "k")  # no more than the dictionary has methods


_CROPPED = "select book, std_char as ch, record_id, greatest(0, bbox.x - 5) as x0, greatest(0, bbox.y - 5) as y0, least(1600, bbox.x + bbox.width + 5) as x1, least(2400, bbox.y + bbox.height + 5) as y1 from matched_books where book is not null and std_char is not null and source_image is not null and bbox.width > 0 and bbox.height > 0 and bbox.x is not null and bbox.y is not null"


@query(_CROPPED)
def crop_partitions(spark, d):
    """The crops of all matched characters written in one folder per book, in several files for a large book, and read back."""
    i = V.instances(spark, d).where("book is not null and ch is not null and source_image is not null and w > 0 and h > 0 and x is not null and y is not null")
    crops = i.select("book", "ch", "record_id", F.greatest(F.lit(0), F.col("x") - 5).alias("x0"), F.greatest(F.lit(0), F.col("y") - 5).alias("y0"), F.least(F.lit(1600), F.col("x") + F.col("w") + 5).alias("x1"), F.least(F.lit(2400), F.col("y") + F.col("h") + 5).alias("y1"))
    path = scratch_path(spark, "crops")
    index = shards.write_book_files(crops, path, ["record_id"])
    return shards.read_book_files(index, path, "ch string, record_id bigint, x0 int, y0 int, x1 int, y1 int")


#: Fields of the legacy report, in their order.
LEGACY = ("item_id", "book", "std_char", "instance_id", "filter_status", "review_status", "decision")


@query("select " + ", ".join(LEGACY) + " from review_books")
def legacy_csv(spark, d):
    """The legacy report with its fields in a fixed order, written as CSV and read back by position."""
    path = scratch_path(spark, "legacy")
    shards.write_report(table(spark, d, "review_books").select(*LEGACY).withColumns({c: F.coalesce(c, F.lit("∅")) for c in LEGACY[1:]}), path, "csv")
    back = spark.read.option("header", True).option("multiLine", True).schema("item_id bigint, " + ", ".join(f"{c} string" for c in LEGACY[1:])).csv(path)
    return back.select("item_id", *[F.nullif(F.coalesce(c, F.lit("")), F.lit("∅")).alias(c) for c in LEGACY[1:]])
