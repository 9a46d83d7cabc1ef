"""Matched instances, review items and candidates clustered by their boxes on a page; candidates in the order of the review
pages; counts and reports over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions import scalars as S
from inkwell.operators import boxes as B
from inkwell.operators import review_state as RS
from inkwell.operators.global_sort import numbered
from inkwell.plans.registry import Registry
from inkwell.plans.relational import _IID, _LAST_ENTRY, _LAST_REVIEW, DROPPED, KEY, NORMAL, _keyed, _last
from inkwell.runtime import materialise, table
from inkwell.sources import views as V
from inkwell.sources.views import with_views

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle
query = R.query

# ---- boxes of a page ----

#: The page image that a path names: book folder, volume folder and number; data/external is another image.
_IMAGE = r"""regexp_extract(p, 'data/external/', 0) || '|' || regexp_extract(p, 'data/(?:raw|external|results/preprocessed)/([^/]+/[^/]+/page_0*[0-9]+)', 1)"""
_PATH = r"""regexp_replace(replace(url_decode(source_image), '\', '/'), '/(\.?/)+', '/', 'g')"""


def _near_sql(source: str) -> str:
    """CTEs box, rep and near over ``source`` (id, book, ch, volume, page, source_image, x, y, w, h)."""
    return rf"""box as (select id, x, y, w, h, hash(book, ch, volume, page, {_IMAGE}) as k1, book || '|' || ch || '|' || volume || '|' || page || '|' || {_IMAGE} as k2 from (select *, {_PATH} as p from {source})
    where source_image is not null and volume is not null and page is not null and ch is not null and book is not null and w > 0 and h > 0 and x is not null and y is not null and id is not null),
  rep as (select k1, k2, x, y, w, h, min(id) as rep from box group by all),
  near as (select a.rep as src, b.rep as dst from rep a join rep b on a.k1 = b.k1 and a.k2 = b.k2 and a.rep < b.rep
  where least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) >= 0.8 * least(a.w, b.w) and least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) >= 0.8 * least(a.h, b.h)
    and greatest(a.w, b.w) <= 1.6 * least(a.w, b.w) and greatest(a.h, b.h) <= 1.6 * least(a.h, b.h))"""


def _cluster_sql(source: str) -> str:
    return _near_sql(source) + f""", link as (select src as a, dst as b from near union select dst, src from near), reach as (select a as node, b as seen from link union select r.node, l.b from reach r join link l on r.seen = l.a),
  top as (select rep, least(rep, coalesce(min(seen), rep)) as first from rep left join reach on node = rep group by rep), named as (select id, first from box join rep using (k1, k2, x, y, w, h) join top using (rep)),
  cluster as (select s.id, coalesce(n.first, s.id) as cluster from {source} s left join named n using (id))"""


_SOURCE = "source as (select record_id as id, book, ch, volume, page, source_image, x, y, w, h, idx, conf, normalized_bbox, ocr_file from instances)"


def distinct_boxes(boxes: DataFrame) -> DataFrame:
    """The boxes of ``page_boxes`` once each, by their first row (rep)."""
    return boxes.groupBy("k1", "k2", "x", "y", "w", "h").agg(F.min("id").alias("rep"))


def clustered(matched: DataFrame, id_col: str) -> DataFrame:
    """(id, cluster): every row of a matched table with the first row of its cluster of near-overlapping boxes on a page; rows
    without a usable box are their own cluster. Identical boxes are one before pairs are looked for."""
    boxes = materialise(B.page_boxes(matched, id_col))
    reps = distinct_boxes(boxes)
    links = B.linked_groups(B.overlap_pairs(reps)).select(F.col("node").alias("rep"), "first")
    named = boxes.join(reps.join(links, "rep", "left").withColumn("first", F.coalesce("first", "rep")), ["k1", "k2", "x", "y", "w", "h"]).select("id", "first")
    return matched.select(F.col(id_col).alias("id")).join(named, "id", "left").select("id", F.coalesce("first", "id").alias("cluster"))


@query(with_views(V.INSTANCES, _SOURCE, _near_sql("source")) + "select src, dst from near")
def near_overlap_pairs(spark, d):
    """Pairs of distinct boxes (by their first records) that nearly coincide on a page image."""
    return B.overlap_pairs(distinct_boxes(B.page_boxes(table(spark, d, "matched_books"))))


def _instances(spark: SparkSession, d: str) -> DataFrame:
    return clustered(table(spark, d, "matched_books"), "record_id").withColumnRenamed("id", "record_id")


@query(with_views(V.INSTANCES, _SOURCE, _cluster_sql("source")) + "select id as record_id, cluster from cluster")
def page_clusters(spark, d):
    return _instances(spark, d)


_KIND = "case when contains(coalesce(source_image, ''), '/preprocessed/') or contains(coalesce(source_image, ''), '_preprocessed') or contains(coalesce(ocr_file, ''), '_preprocessed_ocr.json') then 'preprocessed' when starts_with(source_image, 'data/raw/') or contains(source_image, '/data/raw/') then 'raw' else 'other' end"


def _kind() -> Column:
    src, ocr = F.coalesce("source_image", F.lit("")), F.coalesce("ocr_file", F.lit(""))
    pre = src.contains("/preprocessed/") | src.contains("_preprocessed") | ocr.contains("_preprocessed_ocr.json")
    return F.when(pre, "preprocessed").when(src.startswith("data/raw/") | src.contains("/data/raw/"), "raw").otherwise("other")


_MEMBERS = f"member as (select c.cluster, s.*, {_KIND} as kind from cluster c join source s using (id))"
_VARIANTS = "variant as (select cluster, kind, source_image, ocr_file, idx, min_by(conf, id) as conf, min(id) as first, count(*) as c from member group by all)"


def _members(spark: SparkSession, d: str) -> DataFrame:
    i = V.instances(spark, d).select("record_id", "source_image", "ocr_file", "idx", "conf", "normalized_bbox", _kind().alias("kind"))
    return i.join(_instances(spark, d), "record_id")


def _variants(members: DataFrame) -> DataFrame:
    """The distinct variants of a cluster, each as its first record has it."""
    return members.groupBy("cluster", "kind", "source_image", "ocr_file", "idx").agg(F.min_by("conf", "record_id").alias("conf"), F.min("record_id").alias("first"), F.count(F.lit(1)).alias("c"))


@query(with_views(V.INSTANCES, _SOURCE, _cluster_sql("source"), _MEMBERS, _VARIANTS) + """select cluster, kind, source_image, ocr_file, idx, conf, cast(k as int) as k from (select *,
  row_number() over (partition by cluster order by kind = 'preprocessed' desc, conf desc, coalesce(idx, 1000000000), first) as k from variant)""")
def variant_rows(spark, d):
    """The variants of every cluster in their order, as rows: preprocessed ones first, then by confidence and index."""
    v = _variants(_members(spark, d))
    order = [F.col("pre").desc(), F.col("conf").desc(), F.col("i").asc(), F.col("first").asc()]
    k = numbered(v.withColumn("pre", F.col("kind") == "preprocessed").withColumn("i", F.coalesce("idx", F.lit(10**9))), ["cluster"], order, "k")
    return k.select("cluster", "kind", "source_image", "ocr_file", "idx", "conf", F.col("k").cast("int").alias("k"))


@query(with_views(V.INSTANCES, _SOURCE, _cluster_sql("source"), _MEMBERS, _VARIANTS) + """, best as (select cluster, id, kind, source_image from (select *, row_number() over (partition by cluster order by kind = 'preprocessed' desc, normalized_bbox is not null desc, conf desc, coalesce(idx, 1000000000), id) as k from member) where k = 1),
  kinds as (select cluster, kind, sum(c) as n, count(*) as v, min(rk) as rk from (select *, row_number() over (partition by cluster order by kind = 'preprocessed' desc, conf desc, coalesce(idx, 1000000000), first) as rk from variant) group by all),
  g as (select cluster, cast(sum(n) as bigint) as n, cast(sum(v) as bigint) as variants, array_to_string(list(kind order by rk), ',') as sources from kinds group by cluster)
  select cluster, id as best, n, variants, sources, b.kind as canonical, """ + r"""regexp_replace(source_image, '^.*?raw/([^/]+)/([^/]+)/(page_[0-9]+)\.[A-Za-z]+$', 'data/results/preprocessed/\1/\2/\3_preprocessed.png') as source_image from g join best b using (cluster)""")
def dedupe_instances(spark, d):
    """Of every cluster the preferred instance with its canonical path, how many instances and variants it stands for, and the
    kinds of their sources in the order of the variants."""
    m = materialise(_members(spark, d))
    i = F.coalesce("idx", F.lit(10**9))
    best = m.groupBy("cluster").agg(F.max_by(F.struct("record_id", "kind", "source_image"), F.struct(F.col("kind") == "preprocessed", F.col("normalized_bbox").isNotNull(), "conf", -i, -F.col("record_id"))).alias("b"))
    order = F.struct(F.col("kind") == "preprocessed", F.col("conf"), -i, -F.col("first"))
    kinds = _variants(m).groupBy("cluster", "kind").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.max(order).alias("o"))
    g = kinds.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("v").alias("variants"), F.reverse(F.array_sort(F.collect_list(F.struct("o", "kind")))).alias("l"))
    sources = F.array_join(F.transform("l", lambda x: x["kind"]), ",")
    return g.join(best, "cluster").select("cluster", F.col("b.record_id").alias("best"), "n", "variants", sources.alias("sources"), F.col("b.kind").alias("canonical"), S.preprocessed_path(F.col("b.source_image")).alias("source_image"))


@query(with_views(V.INSTANCES, _SOURCE, _cluster_sql("source"), _MEMBERS, _VARIANTS) + """, n as (select book, ch, count(distinct c.cluster) as instances from cluster c join source s using (id) group by all), v as (select s.book, s.ch, count(*) as variants from variant t join source s on t.cluster = s.id group by all)
  select book, ch, instances, variants, greatest(0, variants - instances) as removed from n join v using (book, ch)""")
def post_dedupe_totals(spark, d):
    """Instances, variants and what deduplication takes away, per (book, character)."""
    m = materialise(_members(spark, d))
    own = V.instances(spark, d).select(F.col("record_id").alias("cluster"), "book", "ch")
    per = _variants(m).groupBy("cluster").agg(F.count(F.lit(1)).alias("v")).join(own, "cluster")
    g = per.groupBy("book", "ch").agg(F.count(F.lit(1)).alias("instances"), F.sum("v").alias("variants"))
    return g.withColumn("removed", F.greatest(F.lit(0), F.col("variants") - F.col("instances")))


# ---- candidates: matched sources, reviews, measurements and recognitions of one key ----

#: The last matched row of a key is its source; a second recognition is ready unless it has no confidence, and matches from 0.9 on.
SOURCES = f"""src as (select * from (select record_id, book, ch, volume, page, idx, source_image, ocr_file, x, y, w, h, conf, {_IID} as instance_id, row_number() over (partition by book, ch, {_IID} order by record_id desc) as k from instances) where k = 1 and instance_id is not null and ch is not null)"""
CANDIDATES = """candidates as (select book, ch, instance_id, s.record_id, r.item_id, s.volume, s.page, s.idx, s.source_image, s.ocr_file, s.x, s.y, s.w, s.h, s.conf, r.filter_status, r.review_status, r.decision, nullif(r.confirmed_path, '') as confirmed_path, nullif(r.segmented_path, '') as segmented_path, r.review_at,
  case when e.entry_id is null then 'pending' when e.lookup_missing then 'error' else 'ready' end as segment_state, e.aspect_ratio, case when s.record_id is null then 'pending' when s.conf > 0 then 'ready' when e.lookup_missing then 'error' else 'pending' end as reocr_state, coalesce(s.conf >= 0.9, false) as matches
  from src s full join lastr r using (book, ch, instance_id) left join laste e using (book, ch, instance_id))"""
_CAND = with_views(V.INSTANCES, V.ENTRIES, NORMAL, _LAST_REVIEW, _LAST_ENTRY, SOURCES, CANDIDATES)


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """One row per key (book, character, instance id) that is matched or reviewed, with the states of all stages."""
    s = _last(_keyed(spark, d), "record_id").select(*KEY, "record_id", "volume", "page", "idx", "source_image", "ocr_file", "x", "y", "w", "h", "conf")
    r = _last(RS.normalised(V.reviews(spark, d)), "item_id").select(*KEY, "item_id", "filter_status", "review_status", "decision", F.nullif("confirmed_path", F.lit("")).alias("confirmed_path"), F.nullif("segmented_path", F.lit("")).alias("segmented_path"), "review_at")
    e = _last(V.entries(spark, d), "entry_id").select(*KEY, "lookup_missing", "aspect_ratio", F.lit(True).alias("measured"))
    c = s.join(r, KEY, "full").join(e, KEY, "left")
    lost = F.coalesce("lookup_missing", F.lit(False))
    segment = F.when(F.col("measured").isNull(), "pending").when(lost, "error").otherwise("ready")
    reocr = F.when(F.col("record_id").isNull(), "pending").when(F.col("conf") > 0, "ready").when(lost, "error").otherwise("pending")
    return c.withColumns({"segment_state": segment, "reocr_state": reocr, "matches": F.coalesce(F.col("conf") >= 0.9, F.lit(False))})


_GONE = "coalesce(review_status = 'dropped' or decision = 'drop', false)"


def _left(c: DataFrame) -> DataFrame:
    return c.where(~F.coalesce((F.col("review_status") == "dropped") | (F.col("decision") == "drop"), F.lit(False)))


@query(_CAND + f"select book, ch, instance_id, record_id, item_id from candidates where not {_GONE} and (filter_status = 'accepted' or matches)")
def visible(spark, d):
    """Candidates that the filter view shows: accepted or recognised as the character."""
    return _left(candidates(spark, d)).where((F.col("filter_status") == "accepted") | F.col("matches")).select(*KEY, "record_id", "item_id")


@query(_CAND + f"select book, ch, instance_id, record_id, item_id from candidates where not {_GONE} and (filter_status = 'accepted' or matches or reocr_state in ('ready', 'error'))")
def visible_with_mismatch(spark, d):
    return _left(candidates(spark, d)).where((F.col("filter_status") == "accepted") | F.col("matches") | F.col("reocr_state").isin("ready", "error")).select(*KEY, "record_id", "item_id")


_PRIORITY = "case when matches then 0 when filter_status = 'accepted' then case reocr_state when 'ready' then 1 when 'error' then 2 else 3 end when reocr_state = 'ready' then 4 when reocr_state = 'error' then 5 else 6 end"


def priority() -> Column:
    """Seven levels: recognised, accepted by the state of the recognition, the others by that state."""
    s = F.col("reocr_state")
    accepted = F.when(s == "ready", 1).when(s == "error", 2).otherwise(3)
    return F.when(F.col("matches"), 0).when(F.col("filter_status") == "accepted", accepted).when(s == "ready", 4).when(s == "error", 5).otherwise(6)


#: Largest page of candidates and of instances.
MOST_CANDIDATES, MOST_INSTANCES = 100, 200


def page_of(df: DataFrame, keys: list[str], order: list[Column], page: int = 1, size: int | None = 20, most: int = MOST_CANDIDATES) -> DataFrame:
    """One page of every group with ``place`` (from 1), ``total``, ``total_pages`` and ``has_more``. Page numbers below 1 are 1; sizes are
    clamped to 1 and ``most``; no size (None) is all of a group. Spark limits groups to the page's end before it shuffles them;
    without a size, places come from a global sort."""
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    if size is None:
        placed, first, n = numbered(df, keys, order, "place"), 0, None
    else:
        n = max(1, min(most, size))
        first = (max(1, page) - 1) * n
        placed = RS.first_per(df, keys, order, first + n, "place").where(F.col("place") > first)
    on = [F.col(f"p.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    out = placed.alias("p").join(total.alias("t"), on).select("p.*", "total")
    pages = F.lit(1) if n is None else F.ceil(F.col("total") / n)
    return out.withColumns({"place": F.col("place").cast("int"), "total_pages": pages.cast("int"), "has_more": F.lit(False) if n is None else F.col("total") > first + n})


_VISIBLE = f"v as (select *, {_PRIORITY} as level, coalesce(nullif(w, 0), 0) as w0, coalesce(h, 0) as h0 from candidates where not {_GONE} and (filter_status = 'accepted' or matches or reocr_state in ('ready', 'error')))"


@query(_CAND + f", {_VISIBLE} select book, ch, instance_id, cast(k as int) as place, n as total, n > 20 as has_more from (select *, row_number() over (partition by book, ch order by level, w0 desc, h0 desc, instance_id) as k, count(*) over (partition by book, ch) as n from v) where k <= 20")
def priority_page(spark, d):
    """The first page of 20 candidates of every (book, character): by priority, the widest first."""
    v = _left(candidates(spark, d)).where((F.col("filter_status") == "accepted") | F.col("matches") | F.col("reocr_state").isin("ready", "error"))
    v = v.select(*KEY, priority().alias("level"), F.coalesce("w", F.lit(0)).alias("w"), F.coalesce("h", F.lit(0)).alias("h"))
    order = [F.col("level").asc(), F.col("w").desc(), F.col("h").desc(), F.col("instance_id").asc()]
    return page_of(v, ["book", "ch"], order).select(*KEY, "place", "total", "has_more")


@query(_CAND + f", {_VISIBLE} select book, ch, instance_id, cast(k as int) as place, n as total from (select *, row_number() over (partition by book, ch order by level, coalesce(idx, 0), instance_id) as k, count(*) over (partition by book, ch) as n from v)")
def priority_all(spark, d):
    """All candidates of every (book, character) by priority and index (no page size)."""
    v = _left(candidates(spark, d)).where((F.col("filter_status") == "accepted") | F.col("matches") | F.col("reocr_state").isin("ready", "error"))
    v = v.select(*KEY, priority().alias("level"), F.coalesce("idx", F.lit(0)).alias("i"))
    return page_of(v, ["book", "ch"], [F.col("level").asc(), F.col("i").asc(), F.col("instance_id").asc()], size=None).select(*KEY, "place", "total")


@query(with_views(V.INSTANCES) + """, o as (select book, ch, record_id, coalesce(w, 0) as w, row_number() over (partition by book, ch order by record_id) as ord, row_number() over (partition by book, ch order by w desc nulls last, conf desc, record_id) as rk from instances),
  m as (select 'default' as mode, *, ord as a from o union all select 'external', *, case when rk <= 3 then rk else 1000000 + ord end from o union all select 'width_desc', *, -w from o), p as (select *, row_number() over (partition by mode, book, ch order by a, record_id) as k, count(*) over (partition by mode, book, ch) as n from m)
  select mode, book, ch, record_id, cast(k as int) as place, n as total, cast(ceil(n / 10) as int) as total_pages from p where k between 11 and 20""")
def instances_modes(spark, d):
    """The second page of ten instances of every (book, character) in each of the three orders: as stored, widest first, and by an
    external order (the three widest and surest) with the rest as stored."""
    i = V.instances(spark, d).select("book", "ch", "record_id", "w", "conf")
    top = RS.first_per(i, ["book", "ch"], [F.col("w").desc_nulls_last(), F.col("conf").desc(), F.col("record_id").asc()], 3, "rk").select("record_id", "rk")
    ranked = i.join(top, "record_id", "left").select("book", "ch", "record_id", F.coalesce("w", F.lit(0)).alias("w"), F.coalesce("rk", F.lit(4)).alias("rk"))
    modes = F.array(F.struct(F.lit("default").alias("mode"), F.lit(0).alias("a")), F.struct(F.lit("external").alias("mode"), F.col("rk").alias("a")), F.struct(F.lit("width_desc").alias("mode"), (-F.col("w")).alias("a")))
    each = ranked.select("book", "ch", "record_id", F.explode(modes).alias("m")).select("m.mode", "book", "ch", "record_id", "m.a")
    return page_of(each, ["mode", "book", "ch"], [F.col("a").asc(), F.col("record_id").asc()], 2, 10, MOST_INSTANCES).select("mode", "book", "ch", "record_id", "place", "total", "total_pages")


@query("with f as (select book, std_char, instance_id, min(item_id) as item_id from review_books where instance_id is not null and std_char is not null group by all) select book, std_char as ch, instance_id, item_id, cast(row_number() over (partition by book, std_char order by item_id) as int) as k from f")
def stored_order(spark, d):
    """Items of every (book, character) in the order in which they were stored first."""
    f = V.reviews(spark, d).where("instance_id is not null and ch is not null").groupBy(*KEY).agg(F.min("item_id").alias("item_id"))
    return numbered(f, ["book", "ch"], [F.col("item_id").asc()], "k").select(*KEY, "item_id", F.col("k").cast("int").alias("k"))


@query(with_views(V.INSTANCES) + "select record_id, book, volume, page, cast(k as int) as k, k <= 2 as big from (select *, row_number() over (partition by book, volume, page order by w desc, h desc, y, x, record_id) as k from instances where w > 0 and h > 0) where k <= 5")
def big_glyphs(spark, d):
    """The five largest glyphs of every page, the first two of which are labelled as big."""
    i = V.instances(spark, d).where("w > 0 and h > 0").select("record_id", "book", "volume", "page", "w", "h", "x", "y")
    order = [F.col("w").desc(), F.col("h").desc(), F.col("y").asc_nulls_last(), F.col("x").asc_nulls_last(), F.col("record_id").asc()]
    return RS.first_per(i, ["book", "volume", "page"], order, 5, "k").select("record_id", "book", "volume", "page", "k", (F.col("k") <= 2).alias("big"))


@query(with_views(V.INSTANCES) + "select ch, n, books, cast(row_number() over (order by n desc, ch) as int) as k from (select ch, count(*) as n, count(distinct book) as books from instances where ch is not null group by ch) qualify k <= 10")
def top_characters(spark, d):
    """The ten most frequent characters (a report)."""
    g = V.instances(spark, d).where("ch is not null").groupBy("ch").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("book").alias("books"))
    ten = g.orderBy(F.col("n").desc(), "ch").limit(10)
    return ten.withColumn("k", F.row_number().over(Window.orderBy(F.col("n").desc(), "ch")))


_CROP = "source_image is not null and x is not null and y is not null and w > 0 and h > 0 and least(1600, x + w + 5) - greatest(0, x - 5) > 0 and least(2400, y + h + 5) - greatest(0, y - 5) > 0"


@query(with_views(V.INSTANCES) + f"select ch, good, failed, cast(row_number() over (order by good desc, ch) as int) as k from (select ch, count(*) filter ({_CROP}) as good, count(*) filter (not coalesce({_CROP}, false)) as failed from instances where ch is not null group by ch) qualify k <= 10")
def crop_report(spark, d):
    """Crops that succeed and fail per character; the ten characters with most of them (a report)."""
    good = F.coalesce(F.expr(_CROP), F.lit(False))
    g = V.instances(spark, d).where("ch is not null").groupBy("ch").agg(F.count_if(good).alias("good"), F.count_if(~good).alias("failed"))
    ten = g.orderBy(F.col("good").desc(), "ch").limit(10)
    return ten.withColumn("k", F.row_number().over(Window.orderBy(F.col("good").desc(), "ch")))


_AS_FILE = "regexp_replace({c}, '(^|/)segmented/', '\\1confirmed/')"


@query(with_views(NORMAL) + f", listing as (select distinct {_AS_FILE.format(c='segmented_path')} as path from review_books where segmented_path <> ''), c as (select * from normal where not {DROPPED} and filter_status = 'accepted' and review_status = 'confirmed') select item_id, c.confirmed_path as path, coalesce(c.confirmed_path, '') = '' as no_path from c left join listing on listing.path = c.confirmed_path where listing.path is null")
def missing_images(spark, d):
    """Confirmed items whose image is not in the listing of written images (here the segmented ones, under their later names)."""
    r = V.reviews(spark, d)
    listing = r.where("segmented_path <> ''").select(F.regexp_replace("segmented_path", "(^|/)segmented/", "$1confirmed/").alias("path")).distinct()
    c = RS.confirmed(RS.normalised(r)).select("item_id", F.col("confirmed_path").alias("path"))
    return c.join(listing, "path", "left_anti").select("item_id", "path", (F.coalesce("path", F.lit("")) == "").alias("no_path"))


# ---- deduplicated reviews and candidates ----

_SCORE = "case when review_status = 'confirmed' or confirmed_path is not null then 6 when review_status = 'dropped' or decision = 'drop' then 5 when filter_status = 'accepted' then 4 when filter_status = 'rejected' then 3 else {rest} end"


def review_score(rest: Column | None = None) -> Column:
    """Confirmed (or with a confirmed path) before dropped, accepted, rejected and the rest."""
    r = F.col("review_status")
    confirmed, dropped = (r == "confirmed") | F.col("confirmed_path").isNotNull(), (r == "dropped") | (F.col("decision") == "drop")
    return F.when(confirmed, 6).when(dropped, 5).when(F.col("filter_status") == "accepted", 4).when(F.col("filter_status") == "rejected", 3).otherwise(F.lit(0) if rest is None else rest)


_REVIEWED = "reviewed as (select item_id as id, * from candidates where item_id is not null)"


@query(_CAND + f", {_REVIEWED}, {_cluster_sql('reviewed')} select cluster, id as best, n from (select c.cluster, c.id, count(*) over (partition by cluster) as n, row_number() over (partition by cluster order by {_SCORE.format(rest=0)} desc, coalesce(w, 0) desc, coalesce(idx, 1000000000), coalesce(review_at, '') desc, instance_id desc) as k from cluster c join reviewed using (id)) where k = 1")
def dedupe_review(spark, d):
    """Of every cluster of review items, by the boxes of their sources, the best: by state, width, index, time and id."""
    c = materialise(candidates(spark, d).where("item_id is not null"))
    groups = clustered(_with_bbox(c), "item_id").withColumnRenamed("id", "item_id")
    order = F.struct(review_score(), F.coalesce("w", F.lit(0)), -F.coalesce("idx", F.lit(10**9)), F.coalesce("review_at", F.lit("")), "instance_id")
    return c.join(groups, "item_id").groupBy("cluster").agg(F.max_by("item_id", order).alias("best"), F.count(F.lit(1)).alias("n"))


def _with_bbox(c: DataFrame) -> DataFrame:
    box = F.struct("x", "y", F.col("w").alias("width"), F.col("h").alias("height"))
    return c.withColumn("bbox", box).withColumnRenamed("ch", "std_char")


_REST = "case when matches then 2 when reocr_state in ('ready', 'error') or segment_state in ('ready', 'error') then 1 else 0 end"
_MATCHED = "sourced as (select record_id as id, * from candidates where record_id is not null)"


@query(_CAND + f", {_MATCHED}, {_cluster_sql('sourced')} select cluster, id as best, n from (select c.cluster, c.id, count(*) over (partition by cluster) as n, row_number() over (partition by cluster order by {_SCORE.format(rest=_REST)} desc, coalesce(w, 0) desc, coalesce(idx, 1000000000), segment_state = 'ready' desc, instance_id desc) as k from cluster c join sourced using (id)) where k = 1")
def dedupe_filter(spark, d):
    """Of every cluster of matched candidates the best: by state with the levels of recognition, width, index, segmentation, id."""
    c = materialise(candidates(spark, d).where("record_id is not null"))
    groups = clustered(_with_bbox(c), "record_id").withColumnRenamed("id", "record_id")
    rest = F.when(F.col("matches"), 2).when(F.col("reocr_state").isin("ready", "error") | F.col("segment_state").isin("ready", "error"), 1).otherwise(0)
    order = F.struct(review_score(rest), F.coalesce("w", F.lit(0)), -F.coalesce("idx", F.lit(10**9)), F.col("segment_state") == "ready", "instance_id")
    return c.join(groups, "record_id").groupBy("cluster").agg(F.max_by("record_id", order).alias("best"), F.count(F.lit(1)).alias("n"))


@query(_CAND + f"select book, ch, arg_max(instance_id, struct_pack(a := {_SCORE.format(rest=0)}, b := coalesce(w, 0), c := -coalesce(idx, 1000000000), d := coalesce(review_at, ''), e := instance_id)) as instance_id from candidates where item_id is not null group by all")
def best_review(spark, d):
    """The preferred review item of every (book, character)."""
    c = candidates(spark, d).where("item_id is not null")
    return c.groupBy("book", "ch").agg(F.max_by("instance_id", F.struct(review_score(), F.coalesce("w", F.lit(0)), -F.coalesce("idx", F.lit(10**9)), F.coalesce("review_at", F.lit("")), "instance_id")).alias("instance_id"))


@query(_CAND + f"select book, ch, arg_max(instance_id, struct_pack(a := {_SCORE.format(rest=_REST)}, b := coalesce(w, 0), c := -coalesce(idx, 1000000000), d := segment_state = 'ready', e := instance_id)) as instance_id from candidates group by all")
def best_filter_candidate(spark, d):
    """The preferred candidate of every (book, character), with the levels of the second recognition."""
    rest = F.when(F.col("matches"), 2).when(F.col("reocr_state").isin("ready", "error") | F.col("segment_state").isin("ready", "error"), 1).otherwise(0)
    order = F.struct(review_score(rest), F.coalesce("w", F.lit(0)), -F.coalesce("idx", F.lit(10**9)), F.col("segment_state") == "ready", "instance_id")
    return candidates(spark, d).groupBy("book", "ch").agg(F.max_by("instance_id", order).alias("instance_id"))


_PAYLOAD_STATE = "case when segment_state = 'error' and reocr_state = 'pending' then 'error' else reocr_state end"


@query(_CAND + f"""select book, ch, instance_id, coalesce(filter_status, 'pending') as filter_status, coalesce(review_status, 'pending') as review_status, coalesce(decision, 'need') as review_decision, coalesce(w, 0) as width, coalesce(h, 0) as height, coalesce(w, 0) as original_width, coalesce(h, 0) as original_height,
  case when segment_state = 'ready' then coalesce(w, 0) else 0 end as segmented_width, case when segment_state = 'ready' then coalesce(h, 0) else 0 end as segmented_height, volume, page, idx as char_index, x, y, w, h, source_image, case when record_id is not null then {_KIND} end as canonical_source,
  coalesce(confirmed_path, segmented_path) as preview_path, segment_state, case when reocr_state = 'ready' then ch end as reocr_text, case when reocr_state = 'ready' then conf end as reocr_confidence, matches as reocr_matches, {_PAYLOAD_STATE} as reocr_state, 5 as reocr_pad, 'paddle' as reocr_engine,
  case when segment_state = 'error' then 'no source' end as error from candidates where not {_GONE}""")
def filter_payload(spark, d):
    """The wide row of the filter view; dropped items are left out, and a failed segmentation makes a pending recognition an
    error."""
    c = _left(candidates(spark, d))
    zero = lambda v: F.coalesce(v, F.lit(0))
    ready, read = F.col("segment_state") == "ready", F.col("reocr_state") == "ready"
    state = F.when((F.col("segment_state") == "error") & (F.col("reocr_state") == "pending"), "error").otherwise(F.col("reocr_state"))
    return c.select(
        *KEY, *[F.coalesce(a, F.lit(b)).alias(n) for a, b, n in (("filter_status", "pending", "filter_status"), ("review_status", "pending", "review_status"), ("decision", "need", "review_decision"))],
        *[zero(a).alias(n) for a, n in (("w", "width"), ("h", "height"), ("w", "original_width"), ("h", "original_height"))],
        F.when(ready, zero("w")).otherwise(0).alias("segmented_width"), F.when(ready, zero("h")).otherwise(0).alias("segmented_height"), "volume", "page", F.col("idx").alias("char_index"), "x", "y", "w", "h", "source_image",
        F.when(F.col("record_id").isNotNull(), _kind()).alias("canonical_source"), F.coalesce("confirmed_path", "segmented_path").alias("preview_path"), "segment_state",
        F.when(read, F.col("ch")).alias("reocr_text"), F.when(read, F.col("conf")).alias("reocr_confidence"), F.col("matches").alias("reocr_matches"), state.alias("reocr_state"), F.lit(5).alias("reocr_pad"), F.lit("paddle").alias("reocr_engine"),
        F.when(F.col("segment_state") == "error", "no source").alias("error"),
    )


@query(with_views(NORMAL) + "select book, ch, count(*) as total, count(*) filter (review_status = 'confirmed') as confirmed, count(*) filter (decision = 'drop') as dropped, greatest(0, count(*) - count(*) filter (decision = 'drop')) as effective from normal where filter_status = 'accepted' group by book, ch")
def accepted_by_char(spark, d):
    """Accepted items of every (book, character): all, confirmed, not needed, and what is left."""
    n = RS.normalised(V.reviews(spark, d)).where("filter_status = 'accepted'")
    g = n.groupBy("book", "ch").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("review_status") == "confirmed").alias("confirmed"), F.count_if(F.col("decision") == "drop").alias("dropped"))
    return g.withColumn("effective", F.greatest(F.lit(0), F.col("total") - F.col("dropped")))


_KEYS = "keys as (select distinct book, ch, instance_id from src)"
_FILES = f"listing as (select distinct {_AS_FILE.format(c='segmented_path')} as path from review_books where segmented_path <> '')"
_COUNTS = {
    "raw_files": ("instances", "count(distinct case when contains(source_image, 'data/raw/') then source_image end)"),
    "preprocessed_files": ("instances", "count(distinct case when contains(source_image, 'results/preprocessed/') then source_image end)"),
    "ocr_files": ("instances", "count(distinct ocr_file)"),
    "matched_books": ("instances", "count(distinct book)"),
    "review_books": ("reviewed", "count(distinct book)"),
    "review_chars": ("reviewed", "count(distinct case when ch is not null then book || '|' || ch end)"),
    "selected_instances": ("reviewed", "count(case when filter_status = 'accepted' then 1 end)"),
    "lookup_entries": ("reviewed", "count(case when sourced then 1 end)"),
    "confirmed_segments": ("reviewed", "count(case when review_status = 'confirmed' then 1 end)"),
    "confirmed_non_drop": ("reviewed", "count(case when review_status = 'confirmed' and decision <> 'drop' then 1 end)"),
    "missing_segment_images": ("reviewed", "count(case when review_status = 'confirmed' and confirmed_path <> '' and not listed then 1 end)"),
    "chars_without_segments": ("per_char", "count(case when coalesce(selected, 0) = 0 and coalesce(confirmed, 0) = 0 then 1 end)"),
    "topk_books": ("decided", "count(distinct book)"),
    "topk_chars": ("decided", "count(distinct case when ch is not null then book || '|' || ch end)"),
    "topk_items": ("decided", "count(case when n > 0 then 1 end)"),
    "topk_pending": ("decided", "count(case when pending > 0 then 1 end)"),
    "analysis_books": ("entries", "count(distinct book)"),
    "analysis_entries": ("entries", "count(entry_id)"),
    "analysis_missing_images": ("entries", "count(case when aspect_ratio is null then 1 end)"),
    "analysis_missing_lookup": ("entries", "count(case when lookup_missing then 1 end)"),
}
_RULES = {
    "analysis_book_count_mismatch": ("warn", "analysis_books > 0 and analysis_books <> review_books"),
    "analysis_entry_count_mismatch": ("warn", "analysis_entries > 0 and analysis_entries <> confirmed_non_drop - missing_segment_images"),
    "analysis_missing": ("warn", "analysis_entries = 0"),
    "matched_books_missing": ("warn", "matched_books = 0 and review_books > 0"),
    "ocr_files_fewer_than_pages": ("info", "ocr_files < preprocessed_files"),
    "lookup_gap": ("warn", "lookup_entries < selected_instances"),
    "missing_segment_images": ("warn", "missing_segment_images > 0"),
}
_AUDIT_SQL = (
    with_views(V.INSTANCES, V.ENTRIES, NORMAL, SOURCES, _KEYS, _FILES)
    + """, reviewed as (select n.*, k.instance_id is not null as sourced, l.path is not null as listed from normal n left join keys k on n.book = k.book and n.ch = k.ch and n.instance_id = k.instance_id left join listing l on l.path = n.confirmed_path),
  per_char as (select book, ch, count(*) filter (filter_status = 'accepted') as selected, count(*) filter (review_status = 'confirmed') as confirmed from normal group by all),
  decided as (select book, std_char as ch, instance_id, count(*) as n, count(*) filter (coalesce(decision, '') not in ('need', 'drop')) as pending from review_books group by all), """
    + ", ".join(f"t_{t} as (select {', '.join(f'{e} as {n}' for n, (s, e) in _COUNTS.items() if s == t)} from {t})" for t in dict.fromkeys(s for s, _ in _COUNTS.values()))
    + ", counts as (select * from "
    + ", ".join(f"t_{t}" for t in dict.fromkeys(s for s, _ in _COUNTS.values()))
    + ") select * from ("
    + " union all ".join(f"select 'count' as kind, '{n}' as code, cast({n} as bigint) as value from counts" for n in _COUNTS)
    + " union all "
    + " union all ".join(f"select '{level}', '{code}', cast(1 as bigint) from counts where {rule}" for code, (level, rule) in _RULES.items())
    + ")"
)


@query(_AUDIT_SQL)
def audit_report(spark, d):
    """The counts of all stores and the rules that they break, as rows (kind, code, value). Each store is one aggregate."""
    r = RS.normalised(V.reviews(spark, d))
    keys = _keyed(spark, d).where("instance_id is not null and ch is not null").select(*KEY).distinct().withColumn("sourced", F.lit(True))
    listing = V.reviews(spark, d).where("segmented_path <> ''").select(F.regexp_replace("segmented_path", "(^|/)segmented/", "$1confirmed/").alias("confirmed_path")).distinct().withColumn("listed", F.lit(True))
    reviewed = r.join(keys, KEY, "left").join(listing, "confirmed_path", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("sourced", "listed")})
    stores = {
        "instances": V.instances(spark, d),
        "reviewed": reviewed,
        "per_char": r.groupBy("book", "ch").agg(F.count_if(F.col("filter_status") == "accepted").alias("selected"), F.count_if(F.col("review_status") == "confirmed").alias("confirmed")),
        "decided": V.reviews(spark, d).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce("decision", F.lit("")).isin("need", "drop")).alias("pending")),
        "entries": V.entries(spark, d),
    }
    counts = None
    for name, store in stores.items():  # one row each
        one = store.agg(*[F.expr(e).alias(n) for n, (s, e) in _COUNTS.items() if s == name])
        counts = one if counts is None else counts.join(F.broadcast(one), F.lit(True))
    told = [F.struct(F.lit("count").alias("kind"), F.lit(n).alias("code"), F.col(n).cast("bigint").alias("value")) for n in _COUNTS]
    broken = [F.when(F.expr(rule), F.struct(F.lit(level).alias("kind"), F.lit(code).alias("code"), F.lit(1).cast("bigint").alias("value"))) for code, (level, rule) in _RULES.items()]
    return counts.select(F.explode(F.array_compact(F.array(*told, *broken))).alias("r")).select("r.*")
