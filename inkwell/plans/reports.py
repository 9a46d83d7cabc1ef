"""Views and reports: denormalised payloads, listings, counters, incremental skips and written tables read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkwell.functions import scalars as S
from inkwell.operators import review_state as RS
from inkwell.operators.global_sort import numbered, quantiles
from inkwell.plans.registry import Registry
from inkwell.plans.relational import _IID, _LAST_ENTRY, _LAST_REVIEW, CHAR_MEANS, DROPPED, KEY, NORMAL, _char_means, _keyed, _last
from inkwell.runtime import scratch_path, small, table
from inkwell.sources import shards
from inkwell.sources import views as V
from inkwell.sources.views import with_views

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle
query = R.query


@query(with_views(NORMAL) + f"select book, ch, instance_id, item_id, case when review_status = 'pending' then 'unreviewed' else review_status end as status, coalesce(nullif(confirmed_path, ''), nullif(segmented_path, '')) as path from normal where not {DROPPED} and filter_status = 'accepted'")
def combined_view(spark, d):
    a = RS.accepted(RS.normalised(V.reviews(spark, d)))
    return a.select(*KEY, "item_id", F.when(F.col("review_status") == "pending", "unreviewed").otherwise(F.col("review_status")).alias("status"), F.coalesce(F.nullif("confirmed_path", F.lit("")), F.nullif("segmented_path", F.lit(""))).alias("path"))


@query(with_views(NORMAL) + f"select distinct book from normal where not {DROPPED} and filter_status = 'accepted'")
def books_with_accepted(spark, d):
    return RS.accepted(RS.normalised(V.reviews(spark, d))).select("book").distinct()


@query(with_views(NORMAL) + f"select book, ch, instance_id, coalesce(nullif(confirmed_path, ''), nullif(segmented_path, '')) as path, cast(row_number() over (partition by book order by ch nulls first, instance_id nulls first, item_id) as int) as k from normal where not {DROPPED} and filter_status = 'accepted' and review_status = 'confirmed' and coalesce(confirmed_path, '') <> ''")
def confirmed_entries(spark, d):
    c = RS.confirmed(RS.normalised(V.reviews(spark, d))).where("coalesce(confirmed_path, '') <> ''")
    c = c.select("book", "ch", "instance_id", "item_id", F.col("confirmed_path").alias("path"))
    k = numbered(c, ["book"], [F.col("ch").asc_nulls_first(), F.col("instance_id").asc_nulls_first(), F.col("item_id").asc()], "k")
    return k.select("book", "ch", "instance_id", "path", F.col("k").cast("int").alias("k"))


@query(with_views(V.ENTRIES, CHAR_MEANS, V.BOOKS) + ", m as (select book, count(*) as chars, round(avg(aspect_ratio) + 1e-12, 9) as aspect from char_means group by book) select m.book, chars, aspect, title, coalesce(year, try_cast(split_part(m.book, '_', 2) as int)) as year, region, province, place from m left join books using (book)")
def book_rows(spark, d):
    m = _char_means(spark, d).groupBy("book").agg(F.count(F.lit(1)).alias("chars"), F.round(F.avg("aspect_ratio") + 1e-12, 9).alias("aspect"))
    return m.join(V.books(spark, d), "book", "left").select("book", "chars", "aspect", "title", F.coalesce("year", S.book_prefix(F.col("book"))["year"]).alias("year"), "region", "province", "place")


@query(with_views(V.INSTANCES, NORMAL, _LAST_REVIEW) + f""", m as (select book, ch, {_IID} as instance_id, max(record_id) as record_id, max(w) as w from instances group by all)
  select r.item_id, r.book, r.ch, r.instance_id, coalesce(nullif(r.confirmed_path, ''), '') as confirmed_path, regexp_extract(coalesce(r.confirmed_path, ''), '[^/\\\\]*$', 0) as image_name, r.decision, m.record_id, m.record_id is null as lookup_missing from lastr r left join m using (book, ch, instance_id)""")
def entry_projection(spark, d):
    """Analysis entries: the last review of each glyph with its matched source, flagged where there is none."""
    m = _keyed(spark, d).where("instance_id is not null").groupBy(*KEY).agg(F.max("record_id").alias("record_id"))
    r = _last(RS.normalised(V.reviews(spark, d)), "item_id").join(m, KEY, "left")
    path = F.coalesce("confirmed_path", F.lit(""))
    return r.select("item_id", *KEY, path.alias("confirmed_path"), F.regexp_extract(path, "[^/\\\\]*$", 0).alias("image_name"), "decision", "record_id", F.col("record_id").isNull().alias("lookup_missing"))


@query(with_views(V.ENTRIES, V.INSTANCES) + f", done as (select distinct book, ch, instance_id from entries where instance_id is not null and not lookup_missing and aspect_ratio is not null) select m.record_id from (select *, {_IID} as instance_id from instances) m where not exists (select 1 from done where done.book = m.book and done.ch = m.ch and done.instance_id = m.instance_id)")
def incremental_skip(spark, d):
    """Instances still to be measured: those with a valid measurement are skipped."""
    done = V.entries(spark, d).where("instance_id is not null and not lookup_missing and aspect_ratio is not null").select(*KEY).distinct()
    return _keyed(spark, d).join(done, KEY, "left_anti").select("record_id")


@query(with_views(V.INSTANCES) + "select record_id, book, ch from (select *, dense_rank() over (partition by book order by ch) as c, row_number() over (partition by book, ch order by record_id) as k from instances) where c <= 5 and k <= 2")
def scope_filter(spark, d):
    """The first five characters of every book and of each the first two instances."""
    i = V.instances(spark, d).select("record_id", "book", "ch")
    chars = RS.first_per(i.select("book", "ch").distinct(), ["book"], [F.col("ch").asc()], 5).select("book", "ch")
    return RS.first_per(i.join(chars, ["book", "ch"], "left_semi"), ["book", "ch"], [F.col("record_id").asc()], 2).select("record_id", "book", "ch")


@query(with_views(V.INSTANCES) + """, t as (select book, ch, record_id, w, row_number() over (partition by book, ch order by w desc, h desc, record_id) as by_width, row_number() over (partition by book, ch order by conf desc, record_id) as by_conf from instances where w > 0 and h > 0)
  select book, ch, record_id, cast(by_width as int) as by_width, cast(case when by_conf <= 5 then by_conf end as int) as by_conf from t where by_width <= 5""")
def width_against_rank(spark, d):
    """The five widest of every (book, character) with their place among the five most confident, if any."""
    i = V.instances(spark, d).where("w > 0 and h > 0").select("book", "ch", "record_id", "w", "h", "conf")
    wide = RS.first_per(i, ["book", "ch"], [F.col("w").desc(), F.col("h").desc(), F.col("record_id").asc()], 5, "by_width").select("book", "ch", "record_id", "by_width")
    sure = RS.first_per(i, ["book", "ch"], [F.col("conf").desc(), F.col("record_id").asc()], 5, "by_conf").select("record_id", "by_conf")
    return wide.join(sure, "record_id", "left").select("book", "ch", "record_id", "by_width", "by_conf")


@query(with_views(V.INSTANCES) + "select book, volume, page, count(*) filter (w > 0 and h > 0) as boxes, count(*) filter (w > 0 and h > 0 and conf >= 0.9) as sure, max_by(record_id, struct_pack(a := coalesce(w, -1), b := coalesce(h, -1), c := -coalesce(y, 1000000), d := -record_id)) as widest from instances group by all")
def page_boxes(spark, d):
    """Boxes of a page, those with high confidence, and the widest one (then taller, then higher up)."""
    c = lambda x, v: F.coalesce(x, F.lit(v))
    i = V.instances(spark, d)
    good = (F.col("w") > 0) & (F.col("h") > 0)
    return i.groupBy("book", "volume", "page").agg(F.count_if(good).alias("boxes"), F.count_if(good & (F.col("conf") >= 0.9)).alias("sure"), F.max_by("record_id", F.struct(c("w", -1), c("h", -1), -c("y", 1_000_000), -F.col("record_id"))).alias("widest"))


@query(with_views(V.INSTANCES) + "select book, count(distinct volume) as volumes, min(volume) as lo, max(volume) as hi, count(distinct source_image) as files, array_to_string(list_sort(list(distinct volume) filter (volume is not null)), ',') as list from instances group by book")
def volume_statistics(spark, d):
    g = V.instances(spark, d).groupBy("book").agg(F.count_distinct("volume").alias("volumes"), F.min("volume").alias("lo"), F.max("volume").alias("hi"), F.count_distinct("source_image").alias("files"), F.sort_array(F.collect_set("volume")).alias("l"))
    return g.select("book", "volumes", "lo", "hi", "files", F.array_join(F.transform("l", lambda v: v.cast("string")), ",").alias("list"))


_REASON = "case when source_image is null then 'no source' when w is null or w <= 0 or h <= 0 then 'no box' when conf < 0.8 then 'low confidence' else 'ok' end"


@query(with_views(V.INSTANCES) + f", r as (select book, record_id, {_REASON} as reason from instances), k as (select *, row_number() over (partition by book, reason order by record_id) as k from r) select book, reason, count(*) as n, array_to_string(list(record_id order by k) filter (k <= 3), ',') as sample from k group by book, reason")
def stage_counters(spark, d):
    """Outcomes per book with the first three records of each; the samples are taken in groups that Spark limits first."""
    r = V.instances(spark, d).select("book", "record_id", F.expr(_REASON).alias("reason"))
    n = r.groupBy("book", "reason").agg(F.count(F.lit(1)).alias("n"))
    first = RS.first_per(r, ["book", "reason"], [F.col("record_id").asc()], 3, "k").groupBy("book", "reason").agg(F.array_sort(F.collect_list("record_id")).alias("l"))
    return n.join(first, ["book", "reason"]).select("book", "reason", "n", F.array_join(F.transform("l", lambda v: v.cast("string")), ",").alias("sample"))


@query(with_views(V.ENTRIES) + ", b as (select book, count(face_ratio) as n, quantile_cont(face_ratio, 0.05) as lo, quantile_cont(face_ratio, 0.95) as hi, avg(face_ratio) as m from entries where face_ratio is not null group by book), c as (select book, avg(face_ratio) as mean, stddev_pop(face_ratio) as std, count(*) as kept from entries join b using (book) where face_ratio is not null and (n < 4 or round(face_ratio, 9) between round(lo, 9) and round(hi, 9)) group by book) select book, n, coalesce(kept, 0) as kept, round(coalesce(mean, m) + 1e-12, 9) as mean, round(std + 1e-12, 9) as std from b left join c using (book)")
def trimmed_mean_std(spark, d):
    """Mean and deviation within the 5 % quantiles; of all values where none is left."""
    from inkwell.plans.relational import trimmed

    e = V.entries(spark, d).where("face_ratio is not null").select("book", "face_ratio")
    b = e.groupBy("book").agg(F.count(F.lit(1)).alias("n"), F.avg("face_ratio").alias("m"))
    c = trimmed(e, ["book"], "face_ratio").groupBy("book").agg(F.avg("face_ratio").alias("mean"), F.stddev_pop("face_ratio").alias("std"), F.count(F.lit(1)).alias("kept"))
    return b.join(c, "book", "left").select("book", "n", F.coalesce("kept", F.lit(0)).alias("kept"), F.round(F.coalesce("mean", "m") + 1e-12, 9).alias("mean"), F.round(F.col("std") + 1e-12, 9).alias("std"))


@query(with_views(V.ENTRIES) + "select book, ch, count(aspect_ratio) as n, round(case when count(aspect_ratio) >= 2 then stddev_pop(aspect_ratio) end + 1e-12, 8) as std, round(quantile_cont(aspect_ratio, 0.5) + 1e-12, 8) as median from entries group by book, ch")
def within_char_std(spark, d):
    n, e = F.count("aspect_ratio"), V.entries(spark, d)
    base = e.groupBy("book", "ch").agg(n.alias("n"), F.round(F.when(n >= 2, F.stddev_pop("aspect_ratio")) + 1e-12, 8).alias("std"))
    median = quantiles(e, ["book", "ch"], "aspect_ratio", (0.5,)).select(F.col("book").alias("b"), F.col("ch").alias("c"), F.round(F.col("q")[0] + 1e-12, 8).alias("median"))
    return base.join(median, F.col("book").eqNullSafe(F.col("b")) & F.col("ch").eqNullSafe(F.col("c")), "left").select("book", "ch", "n", "std", "median")


@query(with_views(V.ENTRIES) + "select ch, " + ", ".join(f"round(quantile_cont(ink_coverage, {p}) + 1e-12, 8) as p{int(p * 100)}" for p in (0.05, 0.25, 0.5, 0.75, 0.95)) + " from entries where ink_coverage is not null group by ch")
def whiskers(spark, d):
    q = quantiles(V.entries(spark, d), ["ch"], "ink_coverage", (0.05, 0.25, 0.5, 0.75, 0.95))
    return q.select("ch", *[F.round(F.col("q")[i] + 1e-12, 8).alias(f"p{p}") for i, p in enumerate((5, 25, 50, 75, 95))])


@query("select doc_id, length(text) as chars, length(regexp_replace(text, '\\s', '', 'g')) as dense, cast(len(regexp_extract_all(text, '\\p{Han}')) as bigint) as han from documents where text is not null")
def text_lengths(spark, d):
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", F.length("text").cast("bigint").alias("chars"), F.length(F.regexp_replace("text", "[ \\t\\n\\f\\r]", "")).cast("bigint").alias("dense"), F.length(F.regexp_replace("text", "\\P{IsHan}", "")).cast("bigint").alias("han"))


@query("with c as (select ch, count(*) as n, count(distinct doc_id) as docs from (select doc_id, unnest(string_split(text, '')) as ch from documents where text <> '') group by ch) select c.ch, n, docs from c join (select distinct std_char from standard_chars) on ch = std_char")
def text_dictionary_counts(spark, d):
    """How often the dictionary's characters occur in the mails, and in how many: the characters are exploded and probe the
    broadcast dictionary before anything is shuffled."""
    chars = table(spark, d, "documents").where("text <> ''").select("doc_id", F.explode(F.split("text", "")).alias("ch"))
    known = small(V.dictionary(spark, d).select("ch").distinct())
    return chars.join(known, "ch", "left_semi").groupBy("ch", "doc_id").agg(F.count(F.lit(1)).alias("k")).groupBy("ch").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("docs"))


@query("select book, std_char as ch, count(*) as n, count(distinct char_index) as places from matched_books group by all")
def partitions_by_book(spark, d):
    """The matched table written with one folder per book and read back."""
    path = scratch_path(spark, "by_book")
    shards.write_by_book(table(spark, d, "matched_books").select("record_id", "book", "std_char", "char_index"), path)
    back = spark.read.schema("record_id bigint, std_char string, char_index int, book string").parquet(path)
    return back.groupBy("book", F.col("std_char").alias("ch")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("char_index").alias("places"))


@query("select book_no, bookid, 刻体倾向 as style, 区域划分 as region from books_metadata")
def report_round_trip(spark, d):
    """A report with quotes, delimiters and line ends in its fields, written as JSON and read back."""
    path = scratch_path(spark, "report")
    shards.write_report(table(spark, d, "books_metadata").select("book_no", "bookid", F.col("刻体倾向").alias("style"), F.col("区域划分").alias("region")), path, "json")
    return spark.read.schema("book_no bigint, bookid string, style string, region string").json(path)


@query(with_views(V.ENTRIES) + ", n as (select book, cast(measured_at as date) as day, count(*) as n from entries group by all) select book, day, n, sum(n) over (partition by book order by day) as total from n")
def running_totals(spark, d):
    """Measurements per book and day and their running total, over daily counts."""
    n = V.entries(spark, d).groupBy("book", F.col("measured_at").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("total", F.sum("n").over(Window.partitionBy("book").orderBy("day")))


@query(with_views(V.INSTANCES, NORMAL, _LAST_REVIEW) + f""", m as (select book, ch, {_IID} as instance_id, max_by(source_image, record_id) filter (source_image is not null) as source_image from instances group by all)
  select r.item_id, coalesce(nullif(r.confirmed_path, ''), nullif(r.segmented_path, ''), m.source_image) as source, case when nullif(r.confirmed_path, '') is not null then 'confirmed' when nullif(r.segmented_path, '') is not null then 'segmented' when m.source_image is not null then 'matched' end as kind
  from lastr r left join m using (book, ch, instance_id)""")
def source_cascade(spark, d):
    """Where the image of an item is found first: confirmed, segmented, else the matched page."""
    m = _keyed(spark, d).where("instance_id is not null and source_image is not null").groupBy(*KEY).agg(F.max_by("source_image", "record_id").alias("source_image"))
    r = _last(RS.normalised(V.reviews(spark, d)), "item_id").join(m, KEY, "left")
    conf, seg = F.nullif("confirmed_path", F.lit("")), F.nullif("segmented_path", F.lit(""))
    kind = F.when(conf.isNotNull(), "confirmed").when(seg.isNotNull(), "segmented").when(F.col("source_image").isNotNull(), "matched")
    return r.select("item_id", F.coalesce(conf, seg, "source_image").alias("source"), kind.alias("kind"))


_KIND = "case when contains(coalesce(source_image, ''), '_preprocessed') or contains(coalesce(source_image, ''), 'results/preprocessed/') then 'preprocessed' when contains(replace(coalesce(source_image, ''), '\\', '/'), 'data/raw/') then 'raw' else 'other' end"


@query(with_views(V.INSTANCES) + f""", v as (select book, ch, volume, page, {_KIND} as kind, idx, max(conf) as conf from instances group by all)
  select book, ch, volume, page, count(*) as n, array_to_string(list(kind || ':' || coalesce(cast(idx as varchar), '-') order by kind = 'preprocessed' desc, conf desc, idx asc nulls last, kind), ' ') as variants from v group by book, ch, volume, page""")
def ocr_variants(spark, d):
    """The distinct variants (kind, index) of every character on a page: preprocessed ones first, then by confidence and index."""
    i = V.instances(spark, d).withColumn("kind", S.source_kind(F.col("source_image")))
    v = i.groupBy("book", "ch", "volume", "page", "kind", "idx").agg(F.max("conf").alias("conf"))
    order = F.struct((F.col("kind") != "preprocessed").alias("a"), (-F.col("conf")).alias("b"), F.col("idx").isNull().alias("c"), F.coalesce("idx", F.lit(0)).alias("d"), "kind", "idx")
    g = v.groupBy("book", "ch", "volume", "page").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(order)).alias("l"))
    label = lambda x: F.concat(x["kind"], F.lit(":"), F.coalesce(x["idx"].cast("string"), F.lit("-")))
    return g.select("book", "ch", "volume", "page", "n", F.array_join(F.transform("l", label), " ").alias("variants"))


@query("with done as (select distinct book, std_char, instance_id, item_bytes % 10 as pad from review_books where review_status in ('confirmed', 'dropped') and instance_id is not null) select item_id from review_books r where not exists (select 1 from done d where d.book = r.book and d.std_char = r.std_char and d.instance_id = r.instance_id and d.pad = 5)")
def skip_same_pad(spark, d):
    """Items to be recognised again with pad 5: those that have a result with the same pad are skipped."""
    r = V.reviews(spark, d)
    done = r.where("review_status in ('confirmed', 'dropped') and instance_id is not null and item_bytes % 10 = 5").select(*KEY).distinct()
    return r.join(done, KEY, "left_anti").select("item_id")


@query("select record_id, regexp_replace(ocr_file, '_ocr\\.json$', '.png') as image, regexp_replace(regexp_replace(source_image, '_preprocessed(\\.[A-Za-z]+)$', '\\1'), 'results/preprocessed/', 'raw/') as original, regexp_replace(source_image, '^.*?(data/)', '\\1') as relative from matched_books")
def related_paths(spark, d):
    """The image of an OCR file, the original of a preprocessed page, and the path relative to the project."""
    src = F.col("source_image")
    original = F.regexp_replace(F.regexp_replace(src, "_preprocessed(\\.[A-Za-z]+)$", "$1"), "results/preprocessed/", "raw/")
    return table(spark, d, "matched_books").select("record_id", F.regexp_replace("ocr_file", "_ocr\\.json$", ".png").alias("image"), original.alias("original"), F.regexp_replace(src, "^.*?(data/)", "$1").alias("relative"))
