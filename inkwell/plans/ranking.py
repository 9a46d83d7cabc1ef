"""Windows, top-k, pagination and state queries over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkwell.functions import scalars as S
from inkwell.operators import review_state as RS
from inkwell.operators.global_sort import numbered
from inkwell.plans.registry import Registry
from inkwell.runtime import small, table
from inkwell.sources import views as V
from inkwell.sources.views import with_views

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle
query = R.query

_PRE = "coalesce(contains(source_image, 'preprocessed'), false)"


@query(with_views(V.GLYPHS) + "select book, instance_id, rank() over (partition by book order by w) + (count(*) over (partition by book, w) - 1) / 2.0 as rk from glyphs")
def avg_rank(spark, d):
    """Ranks with ties at their mean, from counts per (book, value): only distinct values are ordered, so a book of any size is
    no single window."""
    g = V.glyphs(spark, d)
    counts = g.groupBy("book", "w").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("book").orderBy("w"))
    ranks = counts.select("book", "w", (upto - F.col("c") + 1 + (F.col("c") - 1) / 2.0).alias("rk"))
    return g.join(ranks, ["book", "w"]).select("book", "instance_id", "rk")


@query(with_views(V.INSTANCES) + f"select book, ch, record_id from (select *, row_number() over (partition by book, ch order by {_PRE} desc, normalized_bbox is not null desc, conf desc, idx asc nulls last, record_id) as k from instances) where k = 1")
def best_instance(spark, d):
    i = V.instances(spark, d)
    best = F.struct(F.coalesce(F.contains("source_image", F.lit("preprocessed")), F.lit(False)), F.col("normalized_bbox").isNotNull(), "conf", F.coalesce(-F.col("idx"), F.lit(-(2**31))), -F.col("record_id"))
    return i.groupBy("book", "ch").agg(F.max_by("record_id", best).alias("record_id"))


@query(with_views(V.GLYPHS) + """, g as (select ch, book, avg(w) as mu from glyphs group by all), n as (select *, row_number() over (partition by ch order by book) as i, count(*) over (partition by ch) as n from g),
  e as (select ch, i, mu, n from n union all select ch, 1 - s, mu, n from n, (values (1), (2)) t(s) where i = 1 and s <= case when n >= 10 then 2 when n >= 5 then 1 else 0 end union all select ch, n + s, mu, n from n, (values (1), (2)) t(s) where i = n and s <= case when n >= 10 then 2 when n >= 5 then 1 else 0 end)
  select ch, i, round(sm, 9) as trend from (select ch, i, n, case when n >= 10 then avg(mu) over (partition by ch order by i rows between 2 preceding and 2 following) when n >= 5 then avg(mu) over (partition by ch order by i rows between 1 preceding and 1 following) else mu end as sm from e) where i between 1 and n""")
def smooth_trend(spark, d):
    """Moving averages of 5 (from 10 points), 3 (from 5) or 1 with the edges repeated, per character over books."""
    g = V.glyphs(spark, d).groupBy("ch", "book").agg(F.avg("w").alias("mu"))
    by = Window.partitionBy("ch")
    n = g.withColumn("i", F.row_number().over(by.orderBy("book"))).withColumn("n", F.count(F.lit(1)).over(by))
    pad = F.when(F.col("n") >= 10, 2).when(F.col("n") >= 5, 1).otherwise(0)
    first = F.when(F.col("i") == 1, F.sequence(1 - pad, F.lit(1))).when(F.col("i") < F.col("n"), F.array("i"))
    places = F.when((F.col("i") == 1) & (F.col("n") == 1), F.array("i")).when(F.col("i") == F.col("n"), F.sequence(F.col("n").cast("int"), (F.col("n") + pad).cast("int"))).otherwise(first)
    e = n.select("ch", "n", "mu", F.explode(places).alias("i"))
    over = lambda k: F.avg("mu").over(by.orderBy("i").rowsBetween(-k, k))
    return e.select("ch", "i", "n", F.when(F.col("n") >= 10, over(2)).when(F.col("n") >= 5, over(1)).otherwise(F.col("mu")).alias("t")).where("i between 1 and n").select("ch", "i", F.round("t", 9).alias("trend"))


@query(with_views(V.PIXELS) + """, c as (select id, x, avg(case when gray < 128 then 1.0 else 0.0 end) as cov from pixels group by all), r as (select id, x, cov, x - row_number() over (partition by id order by x) as grp from c where cov > 0.5)
  select id, min(x) as start, max(x) as stop, round(sum(cov), 6) as mass from r group by id, grp""")
def coverage_runs(spark, d):
    """Runs of neighbouring columns whose share of dark pixels is above one half, with their mass (gaps and islands)."""
    c = V.pixels(spark, d).groupBy("id", "x").agg(F.avg(F.when(F.col("gray") < 128, 1.0).otherwise(0.0)).alias("cov")).where("cov > 0.5")
    r = c.withColumn("grp", F.col("x") - F.row_number().over(Window.partitionBy("id").orderBy("x")))
    return r.groupBy("id", "grp").agg(F.min("x").alias("start"), F.max("x").alias("stop"), F.round(F.sum("cov"), 6).alias("mass")).drop("grp")


@query(with_views(V.BOOKS) + ", r as (select region, count(*) as n from books group by region), o as (select region, sum(n) over (order by region) - n + row_number() over (order by region) - 1 as base from r) select book, region, cast(base + row_number() over (partition by region order by book) as bigint) as pos from books join o using (region)")
def group_positions(spark, d):
    """Places with one more between regions: numbers within a region, from a global sort, plus an offset per region from a prefix
    sum of counts."""
    b = numbered(V.books(spark, d).select("book", "region"), ["region"], [F.col("book").asc()], "k")
    counts = b.groupBy("region").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("region")
    base = counts.select("region", (F.sum("n").over(before) - F.col("n") + F.row_number().over(before) - 1).alias("base"))
    return b.join(base, "region").select("book", "region", (F.col("base") + F.col("k")).alias("pos"))


def _candidates(spark, d):
    return V.instances(spark, d).where("w > 0 and h > 0")


@query(with_views(V.INSTANCES) + "select book, ch, record_id, cast(k as int) as rank from (select *, row_number() over (partition by book, ch order by w desc, conf >= 0.8 desc, conf desc, record_id) as k from instances where w > 0 and h > 0) where k <= 16")
def topk_candidates(spark, d):
    order = [F.col("w").desc(), (F.col("conf") >= 0.8).desc(), F.col("conf").desc(), F.col("record_id").asc()]
    return RS.first_per(_candidates(spark, d).select("book", "ch", "record_id", "w", "conf"), ["book", "ch"], order, 16, "rank").select("book", "ch", "record_id", "rank")


@query(with_views(V.INSTANCES) + """, a as (select *, row_number() over (partition by book, ch order by w desc, h desc, record_id) as got from instances where w > 0 and h > 0 and conf >= 0.8)
  select book, ch, record_id, cast(rank as int) as rank from (select book, ch, record_id, row_number() over (partition by book, ch order by h desc, conf desc, record_id) as rank from a where got <= 5)""")
def topk_early_stop(spark, d):
    """The first five that are accepted in the order of acquisition (width), then ranked by another order."""
    a = RS.first_per(_candidates(spark, d).where("conf >= 0.8").select("book", "ch", "record_id", "w", "h", "conf"), ["book", "ch"], [F.col("w").desc(), F.col("h").desc(), F.col("record_id").asc()], 5, "got")
    return RS.first_per(a, ["book", "ch"], [F.col("h").desc(), F.col("conf").desc(), F.col("record_id").asc()], 5, "rank").select("book", "ch", "record_id", "rank")


@query(with_views(V.INSTANCES) + """, t as (select book, ch, record_id, row_number() over (partition by book, ch order by w desc, conf desc, record_id) as r from instances where w > 0 and h > 0), o as (select i.book, i.ch, i.record_id, coalesce(case when t.r <= 3 then t.r end, 1000000) as r from instances i left join t using (record_id))
  select book, ch, record_id, cast(k as int) as place from (select *, row_number() over (partition by book, ch order by r, record_id) as k from o) where k between 11 and 20""")
def instances_page(spark, d):
    """The second page of ten by an external order (the three widest first); rows that it does not rank come last."""
    i = V.instances(spark, d).select("book", "ch", "record_id", "w", "h", "conf")
    ranked = RS.first_per(i.where("w > 0 and h > 0"), ["book", "ch"], [F.col("w").desc(), F.col("conf").desc(), F.col("record_id").asc()], 3, "r").select("record_id", "r")
    o = i.join(ranked, "record_id", "left").withColumn("r", F.coalesce("r", F.lit(1_000_000)))
    return RS.first_per(o, ["book", "ch"], [F.col("r").asc(), F.col("record_id").asc()], 20, "place").where("place > 10").select("book", "ch", "record_id", "place")


@query(with_views(V.BOOKS) + "select book, row_number() over (order by coalesce(year, 9999), coalesce(try_cast(split_part(book, '_', 1) as int), 9999), book) as k from books")
def chronological(spark, d):
    """Places of all books by year, order and id; missing ones last. One global sort, so that no task sorts the catalogue or a year."""
    b = V.books(spark, d).select("book", F.coalesce("year", F.lit(9999)).alias("y"), F.coalesce(S.book_prefix(F.col("book"))["ord"], F.lit(9999)).alias("o"))
    places = numbered(b.withColumn("all", F.lit(1)), ["all"], [F.col("y").asc(), F.col("o").asc(), F.col("book").asc()], "k")
    return places.select("book", "k")


@query(with_views(V.INSTANCES, V.DICTIONARY) + ", f as (select ch, min(ord) as ord from dictionary group by ch), c as (select ch, count(*) as n from instances group by ch) select ch, n, coalesce(ord, 1000000000) as ord from c left join f using (ch)")
def dict_order(spark, d):
    first = V.dictionary(spark, d).groupBy("ch").agg(F.min("ord").alias("ord"))
    return V.instances(spark, d).groupBy("ch").agg(F.count(F.lit(1)).alias("n")).join(small(first, V.dictionary(spark, d)), "ch", "left").select("ch", "n", F.coalesce("ord", F.lit(1_000_000_000)).alias("ord"))


@query(with_views(V.BOOKS) + ", o as (select book, region, list_position(['神泉路', '三江口路', '龙谷路'], region) as k from books) select book, region, cast(k as int) as k from o where k > 0")
def region_list_order(spark, d):
    wish = F.array(*map(F.lit, ["神泉路", "三江口路", "龙谷路"]))
    return V.books(spark, d).select("book", "region", F.array_position(wish, F.col("region")).cast("int").alias("k")).where("k > 0")


@query(with_views(V.DECISIONS) + "select key, min(event_id) as next from decisions s where status not in ('confirmed', 'dropped') and ts > (select coalesce(max(ts), timestamp '1970-01-01') from decisions v where v.key = s.key and v.status = 'confirmed') group by key")
def next_unvisited(spark, d):
    """The first open event of each key behind its last confirmed one."""
    s = V.decisions(spark, d)
    last = s.where("status = 'confirmed'").groupBy("key").agg(F.max("ts").alias("seen"))
    behind = s.where("status not in ('confirmed', 'dropped')").join(last, "key", "left").where("seen is null or ts > seen")
    return behind.groupBy("key").agg(F.min("event_id").alias("next"))


# ---- variants ----


@query("select book, std_char as ch, count(distinct coalesce(source_image, '') || '|' || coalesce(ocr_file, '') || '|' || coalesce(char_index, -1)) as variants, count(*) as n, greatest(0, count(*) - count(distinct coalesce(source_image, '') || '|' || coalesce(ocr_file, '') || '|' || coalesce(char_index, -1))) as removed from matched_books group by all")
def variant_identity(spark, d):
    m = table(spark, d, "matched_books")
    v = F.count_distinct(F.coalesce("source_image", F.lit("")), F.coalesce("ocr_file", F.lit("")), F.coalesce("char_index", F.lit(-1)))
    return m.groupBy("book", F.col("std_char").alias("ch")).agg(v.alias("variants"), F.count(F.lit(1)).alias("n")).withColumn("removed", F.greatest(F.lit(0), F.col("n") - F.col("variants")))


# ---- state ----


@query(with_views(V.DECISIONS) + "select key, status, ts from (select *, row_number() over (partition by key order by ts desc, event_id desc) as k from decisions) where k = 1")
def latest_decision(spark, d):
    return RS.latest(V.decisions(spark, d).select("key", "status", "ts", "event_id"), ["key"], [F.col("ts"), F.col("event_id")]).select("key", "status", "ts")


@query(with_views(V.DECISIONS) + """, f as (select key, case when status in ('confirmed', 'accepted') then 'accepted' else status end as filter_status, row_number() over (partition by key order by ts desc, event_id desc) as k from decisions where status <> 'pending'),
  r as (select key, status as review_status, row_number() over (partition by key order by ts desc, event_id desc) as k from decisions where status in ('confirmed', 'dropped')) select f.key, filter_status, review_status from f left join (select * from r where k = 1) r using (key) where f.k = 1""")
def review_forces_accept(spark, d):
    """Filter and review state of each key: a review event also sets the filter."""
    log = V.decisions(spark, d)
    at = F.struct("ts", "event_id")
    review = F.when(F.col("status").isin("confirmed", "dropped"), F.col("status"))
    out = log.where("status <> 'pending'").groupBy("key").agg(
        F.max_by(F.when(F.col("status").isin("confirmed", "accepted"), "accepted").otherwise(F.col("status")), at).alias("filter_status"),
        F.max_by(review, F.when(review.isNotNull(), at)).alias("review_status"),
    )
    return out.select("key", "filter_status", "review_status")


@query(with_views(V.DECISIONS) + """, n as (select *, row_number() over (partition by key order by ts desc, event_id desc) as k, max(case when status = 'dropped' then ts end) over (partition by key) as dropped_at from decisions)
  select key, case when status = 'dropped' then 'dropped' when dropped_at is not null then 'revived' else 'never dropped' end as state, case when status <> 'dropped' then event_id end as image from n where k = 1""")
def need_drop_reducer(spark, d):
    """A drop clears the image; a later need revives the item."""
    g = V.decisions(spark, d).groupBy("key").agg(F.max_by(F.struct("status", "event_id"), F.struct("ts", "event_id")).alias("l"), F.count_if(F.col("status") == "dropped").alias("drops"))
    dropped = F.col("l.status") == "dropped"
    return g.select("key", F.when(dropped, "dropped").when(F.col("drops") > 0, "revived").otherwise("never dropped").alias("state"), F.when(~dropped, F.col("l.event_id")).alias("image"))


@query(with_views(V.DECISIONS) + "select key, cast(json_extract(props, '$.k') as int) as note, ts from (select *, row_number() over (partition by key order by ts desc, event_id desc) as k from decisions where status in ('confirmed', 'dropped')) where k = 1 and status = 'confirmed'")
def marks_current(spark, d):
    """Marks put and not taken back since; the note is read from the event's JSON."""
    last = RS.latest(V.decisions(spark, d).where("status in ('confirmed', 'dropped')"), ["key"], [F.col("ts"), F.col("event_id")])
    return last.where("status = 'confirmed'").select("key", F.get_json_object("props", "$.k").cast("int").alias("note"), "ts")


@query(with_views(V.DECISIONS) + "select status, count(*) as n, count(distinct key) as keys, max(ts) as last_update from decisions group by status")
def progress_stats(spark, d):
    return V.decisions(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("keys"), F.max("ts").alias("last_update"))
