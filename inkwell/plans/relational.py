"""Filters, joins, set operations and aggregates over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkwell.functions import scalars as S
from inkwell.operators import review_state as RS
from inkwell.operators.global_sort import numbered, quantiles
from inkwell.plans.registry import Registry
from inkwell.plans.scalars import _REVIEW, _STATE
from inkwell.runtime import SMALL_ROWS, materialise, small, table
from inkwell.sources import views as V
from inkwell.sources.views import with_views

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle
query = R.query

#: Periods of years, half open but for the last.
PERIODS = S.periods("1127-1162,1162-1208,1208-1273")
PERIODS_SQL = "periods(label, k, lo, hi, closed) as (values " + ", ".join(f"('{a}', {i}, {b}, {c}, {str(e).lower()})" for i, (a, b, c, e) in enumerate(PERIODS)) + ")"
NORMAL = f"normal as (select item_id, book, std_char as ch, instance_id, {_STATE} as filter_status, {_REVIEW} as review_status, coalesce(nullif(decision, ''), case when {_REVIEW} = 'dropped' then 'drop' else 'need' end) as decision, segmented_path, confirmed_path, review_at, written_at from review_books)"
DROPPED = "(review_status = 'dropped' or decision = 'drop')"


# ---- filters ----


@query(with_views(NORMAL) + f"select item_id from normal where not {DROPPED} and filter_status = 'accepted'")
def accepted(spark, d):
    return RS.accepted(RS.normalised(V.reviews(spark, d))).select("item_id")


@query(with_views(NORMAL) + f"select item_id, book from normal where not {DROPPED} and filter_status = 'accepted' and review_status = 'confirmed'")
def confirmed(spark, d):
    return RS.confirmed(RS.normalised(V.reviews(spark, d))).select("item_id", "book")


@query(with_views(V.BOOKS) + "select book, region from books where region = '（空）' or contains(region, '路')")
def region_blank(spark, d):
    return V.books(spark, d).where((F.col("region") == S.BLANK_BUCKET) | F.col("region").contains("路")).select("book", "region")


@query(with_views(V.BOOKS) + "select book from books where list_has_any(tags, ['方笔体', '石味体', '（空）'])")
def style_overlap(spark, d):
    return V.books(spark, d).where(F.arrays_overlap("tags", F.array(*map(F.lit, ["方笔体", "石味体", "（空）"])))).select("book")


@query(with_views(V.BOOKS) + "select book, region from books where case region when '神泉路' then list_has_any(tags, ['方笔体', '大字疏朗']) when '龙谷路' then false else true end")
def region_style_map(spark, d):
    """Styles by region override; a region with an empty set drops its rows, one without an entry keeps them."""
    by_region = {"神泉路": ["方笔体", "大字疏朗"], "龙谷路": []}
    keep = F.lit(True)
    for region, styles in by_region.items():
        keep = F.when(F.col("region") == region, F.arrays_overlap("tags", F.array(*map(F.lit, styles)).cast("array<string>"))).otherwise(keep)
    return V.books(spark, d).where(keep).select("book", "region")


@query(with_views(V.BOOKS) + "select book from books where contains(lower(book || ' ' || coalesce(title, '')), lower('集注'))")
def search(spark, d):
    return V.books(spark, d).where(F.contains(F.lower(F.concat_ws(" ", "book", F.coalesce("title", F.lit("")))), F.lower(F.lit("集注")))).select("book")


@query(with_views(V.BOOKS) + "select book, year from books where region in ('神泉路', '龙谷路', '二溪八里') and not (year in (1131, 1200))")
def include_exclude(spark, d):
    return V.books(spark, d).where(F.col("region").isin("神泉路", "龙谷路", "二溪八里") & ~F.col("year").isin(1131, 1200)).select("book", "year")


def trimmed(values, group: list[str], value: str, q: float = 0.05):
    """Rows of ``values`` whose value lies within the q and 1-q quantiles (linear, to nine digits) of its group, bounds included; groups of fewer
    than four values keep all. Quantiles are aggregated first and joined back by the group."""
    q = min(max(q, 0.0), 0.25)
    bounds = quantiles(values, group, value, (q, 1 - q), total="__n", out="__b")
    kept = values.join(bounds, group)
    return kept.where((F.col("__n") < 4) | (F.lit(q) <= 0) | F.round(value, 9).between(F.round(F.col("__b")[0], 9), F.round(F.col("__b")[1], 9))).drop("__n", "__b")


@query(with_views(V.ENTRIES) + """, b as (select book, count(aspect_ratio) as n, quantile_cont(aspect_ratio, 0.05) as lo, quantile_cont(aspect_ratio, 0.95) as hi from entries where aspect_ratio is not null group by book)
  select entry_id, book, aspect_ratio from entries join b using (book) where aspect_ratio is not null and (n < 4 or round(aspect_ratio, 9) between round(lo, 9) and round(hi, 9))""")
def quantile_trim(spark, d):
    e = V.entries(spark, d).where("aspect_ratio is not null").select("entry_id", "book", "aspect_ratio")
    return trimmed(e, ["book"], "aspect_ratio").select("entry_id", "book", "aspect_ratio")


@query(with_views(V.INSTANCES) + "select reason, count(*) as n from (select case when ch is null or length(ch) <> 1 then 'not one character' when conf < 0.8 then 'low confidence' when coalesce(w, 0) <= 0 then 'no box' else 'accepted' end as reason from instances) group by reason")
def accept_chain(spark, d):
    """The first failing reason of every instance, counted."""
    reason = F.when(F.col("ch").isNull() | (F.length("ch") != 1), "not one character").when(F.col("conf") < 0.8, "low confidence").when(F.coalesce("w", F.lit(0)) <= 0, "no box").otherwise("accepted")
    return V.instances(spark, d).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(with_views(V.INSTANCES) + ", v as (select distinct book, volume from instances where volume >= 2), r as (select book, volume from (select *, row_number() over (partition by book order by volume) as k from v) where k <= 3) select record_id, book, volume from instances left join (select book as b2, volume as v2 from r) on book = b2 and volume = v2 where volume is null or v2 is not null")
def volume_window(spark, d):
    """Of every book the first three volumes there are from the second on; rows without a volume stay."""
    i = V.instances(spark, d)
    present = i.where("volume >= 2").select("book", "volume").distinct()
    window = RS.first_per(present, ["book"], [F.col("volume").asc()], 3).select("book", "volume")
    numbered = i.where("volume is not null").join(window, ["book", "volume"], "left_semi")
    return numbered.select("record_id", "book", "volume").unionByName(i.where("volume is null").select("record_id", "book", "volume"))


@query(with_views(V.INSTANCES) + "select distinct source_image as path from instances where source_image is not null and book || '/' || coalesce(page, '') not in (select book || '/' || coalesce(page, '') from instances where contains(source_image, 'preprocessed'))")
def pending(spark, d):
    """Page images of pages without a preprocessed one (an anti join with what is done)."""
    i = V.instances(spark, d).where("source_image is not null").select("book", F.coalesce("page", F.lit("")).alias("page"), "source_image")
    done = i.where(F.col("source_image").contains("preprocessed")).select("book", "page").distinct()
    return i.join(done, ["book", "page"], "left_anti").select(F.col("source_image").alias("path")).distinct()


_VALID = [("no glyph", "std_char is null"), ("no instance", "instance_id is null"), ("bad time", "review_at is null or not regexp_matches(review_at, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:]{8}(\\.[0-9]+)?Z$')"), ("no path", "coalesce(segmented_path, '') = '' and coalesce(confirmed_path, '') = ''")]


@query("select item_id, case " + " ".join(f"when {c} then '{n}'" for n, c in _VALID) + " end as error from review_books")
def validate_format(spark, d):
    """The first rule that an item breaks, null where none."""
    e = None
    for name, cond in _VALID:
        c = F.expr(cond.replace("regexp_matches(review_at, '", "regexp_like(review_at, r'"))
        e = F.when(c, name) if e is None else e.when(c, name)
    return table(spark, d, "review_books").select("item_id", e.alias("error"))


# ---- joins ----


@query(with_views(V.INSTANCES, V.DICTIONARY) + ", last as (select ch, max_by(method_name, ord) as method from dictionary group by ch) select record_id, ch, method from instances join last using (ch)")
def dict_match(spark, d):
    """Characters of the dictionary with their last method; the dictionary has a few hundred entries and is broadcast."""
    last = V.dictionary(spark, d).groupBy("ch").agg(F.max_by("method_name", "ord").alias("method"))
    return V.instances(spark, d).select("record_id", "ch").join(small(last, V.dictionary(spark, d)), "ch").select("record_id", "ch", "method")


@query(with_views(V.INSTANCES, V.BOOKS) + ", c as (select book, count(*) as n from instances group by book) select c.book, n, title, coalesce(b.year, try_cast(split_part(c.book, '_', 2) as int)) as year, coalesce(region, '（空）') as region from c left join books b using (book)")
def metadata_left(spark, d):
    counts = V.instances(spark, d).groupBy("book").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(V.books(spark, d), "book", "left").select("book", "n", "title", F.coalesce("year", S.book_prefix(F.col("book"))["year"]).alias("year"), F.coalesce("region", F.lit(S.BLANK_BUCKET)).alias("region"))


_IID = "case when volume is not null and page is not null and idx is not null then printf('册%02d_page%s_idx%d', volume, split_part(page, '_', -1), idx) end"
_LAST_REVIEW = "lastr as (select * from (select *, row_number() over (partition by book, ch, instance_id order by item_id desc) as k from normal where instance_id is not null and ch is not null) where k = 1)"
_LAST_ENTRY = "laste as (select * from (select *, row_number() over (partition by book, ch, instance_id order by entry_id desc) as k from entries where instance_id is not null and ch is not null) where k = 1)"


def _keyed(spark, d):
    i = V.instances(spark, d)
    return i.withColumn("instance_id", S.make_instance_id(F.col("volume"), F.col("page"), F.col("idx")))


KEY = ["book", "ch", "instance_id"]


def _last(df, order):
    return RS.latest(df.where("instance_id is not null and ch is not null"), KEY, [F.col(order)])


@query(with_views(V.INSTANCES, V.ENTRIES, V.BOOKS, NORMAL, _LAST_REVIEW, _LAST_ENTRY) + f""", m as (select *, {_IID} as instance_id from instances)
  select m.record_id, r.filter_status, r.review_status, e.aspect_ratio, b.region from m left join lastr r using (book, ch, instance_id) left join laste e using (book, ch, instance_id) left join books b using (book)""")
def four_way_state(spark, d):
    """Matched rows with the last review, the last measurement and the book, each joined by its key once."""
    r = _last(RS.normalised(V.reviews(spark, d)), "item_id").select(*KEY, "filter_status", "review_status")
    e = _last(V.entries(spark, d), "entry_id").select(*KEY, "aspect_ratio")
    m = _keyed(spark, d).select("record_id", *KEY)
    return m.join(r, KEY, "left").join(e, KEY, "left").join(V.books(spark, d).select("book", "region"), "book", "left").select("record_id", "filter_status", "review_status", "aspect_ratio", "region")


@query(with_views(V.INSTANCES, V.DICTIONARY) + ", p as (select distinct book, ch from instances) select book, method_id, array_to_string(list(ch order by ord), '') as chars from p join dictionary using (ch) group by book, method_id")
def methods_listing(spark, d):
    """Characters of every book by method, in the dictionary's order; one under two methods counts for both."""
    present = V.instances(spark, d).select("book", "ch").distinct()
    listed = present.join(small(V.dictionary(spark, d)), "ch").groupBy("book", "method_id").agg(F.array_sort(F.collect_list(F.struct("ord", "ch"))).alias("l"))
    return listed.select("book", "method_id", F.array_join(F.transform("l", lambda x: x["ch"]), "").alias("chars"))


@query(with_views(V.BOOKS, PERIODS_SQL) + ", p as (select book, year, label, row_number() over (partition by book order by k) as j from books join periods on year >= lo and (year < hi or closed and year = hi)) select book, year, label from p where j = 1")
def period_range_join(spark, d):
    """The first period that a year lies in; years in none give no row. The periods are a parameter, so the range join is an
    expression and needs no join."""
    label = None
    for name, lo, hi, closed in PERIODS:
        inside = (F.col("year") >= lo) & ((F.col("year") <= hi) if closed else (F.col("year") < hi))
        label = F.when(inside, name) if label is None else label.when(inside, name)
    return V.books(spark, d).withColumn("label", label).where("label is not null").select("book", "year", "label")


@query(with_views(V.DECISIONS, NORMAL) + f", acc as (select item_id, book, ch from normal where not {DROPPED} and filter_status = 'accepted'), marks as (select key, max(ts) as ts from decisions where status = 'confirmed' group by key) select key, ts, book, ch from marks left join acc on key = item_id")
def marks_export(spark, d):
    marks = V.decisions(spark, d).where("status = 'confirmed'").groupBy("key").agg(F.max("ts").alias("ts"))
    acc = RS.accepted(RS.normalised(V.reviews(spark, d))).select("item_id", "book", "ch")
    return marks.join(acc, marks["key"] == acc["item_id"], "left").select("key", "ts", "book", "ch")


@query("""with l as (select book, std_char, max(written_at) as ts, count(*) as n from review_books where filter_status = 'accepted' group by all), s as (select book, std_char, max(loaded_at) as ts, count(*) as n from matched_books group by all)
  select coalesce(l.book, s.book) as book, coalesce(l.std_char, s.std_char) as ch, case when s.book is null then 'local' when l.book is null or s.ts > l.ts or s.n > l.n then 'server' else 'local' end as winner,
  case when s.book is null then l.n when l.book is null or s.ts > l.ts or s.n > l.n then s.n else l.n end as n from l full join s on l.book = s.book and l.std_char is not distinct from s.std_char""")
def newest_or_larger_merge(spark, d):
    """Two stores in full outer join: the server's group wins if it is newer or has more instances."""
    lo = V.reviews(spark, d).where("filter_status = 'accepted'").groupBy("book", "ch").agg(F.max("written_at").alias("ts"), F.count(F.lit(1)).alias("n")).alias("l")
    se = table(spark, d, "matched_books").groupBy("book", F.col("std_char").alias("ch")).agg(F.max("loaded_at").alias("ts"), F.count(F.lit(1)).alias("n")).alias("s")
    both = lo.join(se, (F.col("l.book") == F.col("s.book")) & F.col("l.ch").eqNullSafe(F.col("s.ch")), "full")
    server = F.col("s.book").isNotNull() & (F.col("l.book").isNull() | (F.col("s.ts") > F.col("l.ts")) | (F.col("s.n") > F.col("l.n")))
    return both.select(F.coalesce("l.book", "s.book").alias("book"), F.coalesce("l.ch", "s.ch").alias("ch"), F.when(server, "server").otherwise("local").alias("winner"), F.when(server, F.col("s.n")).otherwise(F.col("l.n")).alias("n"))


@query(with_views(V.DICTIONARY, V.INSTANCES) + ", pairs as (select distinct book from instances), have as (select distinct book, ch from instances), firsts as (select ch, min(ord) as ord from dictionary group by ch) select p.book, f.ord, f.ch from pairs p cross join firsts f where not exists (select 1 from have h where h.book = p.book and h.ch = f.ch)")
def missing_chars_anti(spark, d):
    """Dictionary characters that a book lacks: each book's set of dictionary characters (no more than the dictionary has), taken
    from the list of them all. The dictionary is small by nature; one that grew beyond ``SMALL_ROWS`` is an error, not a driver's or
    a broadcast's burden."""
    firsts = V.dictionary(spark, d).groupBy("ch").agg(F.min("ord").alias("ord"))
    if firsts.limit(SMALL_ROWS + 1).count() > SMALL_ROWS:
        raise ValueError("the dictionary has too many characters for one list")
    listed = firsts.agg(F.collect_list(F.struct("ord", "ch")).alias("all"))
    books = V.instances(spark, d).where("book is not null").select("book", "ch")
    have = books.join(F.broadcast(firsts.select(F.col("ch").alias("known"))), F.col("ch") == F.col("known"), "left").groupBy("book").agg(F.collect_set("known").alias("have"))
    missing = have.join(F.broadcast(listed), F.lit(True)).select("book", F.explode(F.filter("all", lambda x: ~F.array_contains(F.col("have"), x["ch"]))).alias("m"))
    return missing.select("book", "m.ord", "m.ch")


@query("select item_id, segmented_path as path from review_books r where segmented_path <> '' and not exists (select 1 from review_books c where c.confirmed_path = regexp_replace(r.segmented_path, 'manual/segmented/', 'manual/confirmed/'))")
def orphans_anti(spark, d):
    r = V.reviews(spark, d)
    conf = r.where("confirmed_path is not null").select(F.col("confirmed_path").alias("c")).distinct()
    seg = r.where("segmented_path <> ''").select("item_id", F.col("segmented_path").alias("path"), F.regexp_replace("segmented_path", "manual/segmented/", "manual/confirmed/").alias("c"))
    return seg.join(conf, "c", "left_anti").select("item_id", "path")


@query(with_views(V.INSTANCES) + f", k as (select distinct book, ch, {_IID} as instance_id from instances) select r.item_id, k.instance_id is null as stale from review_books r left join k on r.book = k.book and r.std_char = k.ch and r.instance_id = k.instance_id")
def stale_items(spark, d):
    keys = _keyed(spark, d).where("instance_id is not null").select(*KEY).distinct().withColumn("hit", F.lit(True))
    return V.reviews(spark, d).join(keys, KEY, "left").select("item_id", F.col("hit").isNull().alias("stale"))


@query(with_views(V.BOOKS, "asked(k, q) as (values (1, '0000003'), (2, '0000001_'), (3, 'ALL'))") + """, hit as (select book, k, case when q in ('ALL', '*') then 3 when split_part(book, '_', 1) = q then 0 when starts_with(book, q) then 1 when book = q then 2 end as prio from books cross join asked)
  select book, k, prio from (select *, row_number() over (partition by book order by k) as j from hit where prio is not null) where j = 1""")
def book_resolution(spark, d):
    """Books by id, by prefix or all, for a list of wishes: each book once, for the first wish that it fits."""
    wishes = ["0000003", "0000001_", "ALL"]
    fits = [F.when(F.lit(q in ("ALL", "*")), 3).when(F.substring_index("book", "_", 1) == q, 0).when(F.col("book").startswith(q), 1).when(F.col("book") == q, 2) for q in wishes]
    first = F.coalesce(*[F.when(f.isNotNull(), F.struct(F.lit(k + 1).alias("k"), f.alias("prio"))) for k, f in enumerate(fits)])
    return V.books(spark, d).select("book", first.alias("w")).where("w is not null").select("book", "w.k", "w.prio")


@query("""with l as (select book, std_char, instance_id, segmented_path, row_number() over (partition by book, std_char order by item_id) - 1 as i from review_books), m as (select book, std_char, record_id, row_number() over (partition by book, std_char order by record_id) - 1 as i from matched_books)
  select m.record_id, l.instance_id from l join m on l.book = m.book and l.std_char = m.std_char and l.i = m.i""")
def positional_join(spark, d):
    """Two lists per (book, character) joined by place; places come from a global sort, so that a list of any length is spread."""
    place = lambda df, order: numbered(df, ["book", "ch"], [F.col(order).asc()], "i")
    lo = place(V.reviews(spark, d).where("ch is not null").select("book", "ch", "item_id", "instance_id"), "item_id")
    m = place(V.instances(spark, d).select("book", "ch", "record_id"), "record_id")
    return lo.join(m, ["book", "ch", "i"]).select("record_id", "instance_id")


# ---- set operations ----


@query(with_views(V.GLYPHS) + "select ch from glyphs group by ch having count(distinct book) = (select count(distinct book) from glyphs)")
def common_keys(spark, d):
    return common(V.glyphs(spark, d), "book", "ch")


def common(df, group: str, key: str):
    """(key): the keys that every group has. Both counts are small aggregates; one row is broadcast."""
    pairs = df.select(group, key).distinct()
    total = pairs.agg(F.count_distinct(group).alias("__all"))
    return pairs.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).join(F.broadcast(total), F.col("__n") == F.col("__all")).select(key)


@query(with_views(V.INSTANCES) + f", u as (select book, ch, {_IID} as instance_id, 'matched' as src from instances union all select book, std_char, instance_id, 'review' from review_books) select book, src, count(*) as n, count(distinct (ch, instance_id)) as keys from u where instance_id is not null and ch is not null group by book, src")
def candidate_union(spark, d):
    u = _keyed(spark, d).select(*KEY, F.lit("matched").alias("src")).unionByName(V.reviews(spark, d).select(*KEY, F.lit("review").alias("src")))
    return u.where("instance_id is not null and ch is not null").groupBy("book", "src").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ch", "instance_id").alias("keys"))


@query(with_views(V.DECISIONS) + "select key, case when status in ('confirmed', 'accepted') then 'completed' else 'failed' end as state from (select *, row_number() over (partition by key order by ts desc, event_id desc) as k from decisions) where k = 1")
def done_failed_latest(spark, d):
    """Completed or failed, whichever the key was marked with last."""
    last = RS.latest(V.decisions(spark, d).select("key", "status", "ts", "event_id"), ["key"], [F.col("ts"), F.col("event_id")])
    return last.select("key", F.when(F.col("status").isin("confirmed", "accepted"), "completed").otherwise("failed").alias("state"))


@query(with_views(V.BOOKS) + "select region, tag, count(*) as n from (select region, unnest(tags) as tag from books) group by all")
def distinct_tags(spark, d):
    return V.books(spark, d).select("region", F.explode("tags").alias("tag")).groupBy("region", "tag").agg(F.count(F.lit(1)).alias("n"))


# ---- aggregates ----


@query(with_views(V.INSTANCES) + "select book, count(*) as n, count(distinct ch) as chars from instances group by book")
def book_counts(spark, d):
    return V.instances(spark, d).groupBy("book").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ch").alias("chars"))


@query(with_views(V.INSTANCES) + "select ch, count(distinct book) as books from instances group by ch")
def char_coverage(spark, d):
    return V.instances(spark, d).groupBy("ch").agg(F.count_distinct("book").alias("books"))


@query(with_views(NORMAL) + f"""select book, ch, count(*) filter (filter_status <> 'pending') as processed, count(*) filter (filter_status = 'accepted') as accepted, count(*) filter (filter_status = 'rejected') as rejected,
  count(*) filter (not {DROPPED}) as effective from normal group by book, ch""")
def progress_by_char(spark, d):
    n = RS.normalised(V.reviews(spark, d))
    return n.groupBy("book", "ch").agg(F.count_if(F.col("filter_status") != "pending").alias("processed"), F.count_if(F.col("filter_status") == "accepted").alias("accepted"), F.count_if(F.col("filter_status") == "rejected").alias("rejected"), F.count_if(~RS.is_dropped()).alias("effective"))


@query(with_views(NORMAL) + "select book, count(distinct ch) filter (filter_status <> 'pending') as chars, count(*) filter (filter_status = 'accepted') as accepted, count(*) filter (filter_status = 'rejected') as rejected from normal group by book")
def progress_by_book(spark, d):
    n = RS.normalised(V.reviews(spark, d))
    return n.groupBy("book").agg(F.count_distinct(F.when(F.col("filter_status") != "pending", F.col("ch"))).alias("chars"), F.count_if(F.col("filter_status") == "accepted").alias("accepted"), F.count_if(F.col("filter_status") == "rejected").alias("rejected"))


@query("select book, std_char as ch, count(*) filter (decision = 'need') as need, count(*) filter (decision = 'drop') as dropped, count(*) filter (coalesce(decision, '') not in ('need', 'drop')) as pending from review_books group by all")
def decision_counts(spark, d):
    dec = F.coalesce("decision", F.lit(""))
    return V.reviews(spark, d).groupBy("book", "ch").agg(F.count_if(dec == "need").alias("need"), F.count_if(dec == "drop").alias("dropped"), F.count_if(~dec.isin("need", "drop")).alias("pending"))


def _fixed_box(spark, d, nearest: bool):
    """(book, lb): the side of the box that holds nine of ten glyphs of a book, with a margin."""
    long = V.glyphs(spark, d).select("book", F.greatest("w", "h").alias("side"))
    return quantiles(long, ["book"], "side", (0.9,), nearest).select("book", F.ceil(F.col("q")[0] * 1.05).cast("int").alias("lb"))


@query(with_views(V.GLYPHS) + "select book, cast(ceil(quantile_disc(greatest(w, h), 0.9) * 1.05) as int) as lb from glyphs group by book")
def fixed_box_nearest(spark, d):
    return _fixed_box(spark, d, True).select("book", "lb")


@query(with_views(V.GLYPHS) + "select book, cast(ceil(quantile_cont(greatest(w, h), 0.9) * 1.05) as int) as lb from glyphs group by book")
def fixed_box_linear(spark, d):
    return _fixed_box(spark, d, False).select("book", "lb")


def _char_means(spark, d):
    e = V.entries(spark, d)
    means = e.groupBy("book", "ch").agg(*[F.avg(m).alias(m) for m in V.METRICS])
    return means.where("aspect_ratio is not null and face_ratio is not null")


CHAR_MEANS = "char_means as (select book, ch, avg(aspect_ratio) as aspect_ratio, avg(face_ratio) as face_ratio, avg(ink_coverage) as ink_coverage from entries group by book, ch having avg(aspect_ratio) is not null and avg(face_ratio) is not null)"


@query(with_views(V.ENTRIES, CHAR_MEANS) + "select book, ch, round(aspect_ratio + 1e-12, 10) as aspect_ratio, round(face_ratio + 1e-12, 10) as face_ratio, round(ink_coverage + 1e-12, 10) as ink_coverage from char_means")
def char_means(spark, d):
    return _char_means(spark, d).select("book", "ch", *[F.round(F.col(m) + 1e-12, 10).alias(m) for m in V.METRICS])


@query(with_views(V.ENTRIES, CHAR_MEANS) + "select book, count(*) as chars, round(avg(aspect_ratio) + 1e-12, 10) as aspect_ratio, round(avg(face_ratio) + 1e-12, 10) as face_ratio, round(avg(ink_coverage) + 1e-12, 10) as ink_coverage from char_means group by book")
def book_means_macro(spark, d):
    """Means of the character means; a hair is added so that halves round to one side in any engine."""
    return _char_means(spark, d).groupBy("book").agg(F.count(F.lit(1)).alias("chars"), *[F.round(F.avg(m) + 1e-12, 10).alias(m) for m in V.METRICS])


@query(with_views(V.GLYPHS) + ", lb as (select book as b, ceil(quantile_disc(greatest(w, h), 0.9) * 1.05) as lb from glyphs group by book) select book, round(count(*) filter (ch <> 0 and (w > lb or h > lb)) / greatest(1, count(*)), 10) as rate from glyphs join lb on book = b group by book")
def clipping_rate(spark, d):
    """Share of glyphs larger than the book's box; glyphs of the blank character (0 here) count below the line only."""
    g = V.glyphs(spark, d)
    lb = _fixed_box(spark, d, True)
    return g.join(lb, "book").groupBy("book").agg(F.round(F.count_if((F.col("ch") != 0) & ((F.col("w") > F.col("lb")) | (F.col("h") > F.col("lb")))) / F.greatest(F.lit(1), F.count(F.lit(1))), 9).alias("rate"))


def _period(year):
    label = None
    for name, lo, hi, closed in PERIODS:
        inside = (year >= lo) & ((year <= hi) if closed else (year < hi))
        label = F.when(inside, name) if label is None else label.when(inside, name)
    return label


PERIOD_CASE = "case " + " ".join(f"when year >= {lo} and year {'<=' if c else '<'} {hi} then '{n}'" for n, lo, hi, c in PERIODS) + " end"


def _book_stats(spark, d):
    means = _char_means(spark, d)
    return means.groupBy("book").agg(F.avg("aspect_ratio").alias("mu"), F.stddev_pop("aspect_ratio").alias("sigma"), F.count(F.lit(1)).alias("chars"))


BOOK_STATS = "book_stats as (select book, avg(aspect_ratio) as mu, stddev_pop(aspect_ratio) as sigma, count(*) as chars from char_means group by book)"


@query(with_views(V.ENTRIES, CHAR_MEANS, BOOK_STATS, V.BOOKS) + f""", p as (select region, {PERIOD_CASE} as period, mu, sigma from book_stats join books using (book))
  select period, region, count(*) as n, round(avg(mu) + 1e-12, 9) as mu_mean, round(quantile_cont(mu, 0.5) + 1e-12, 9) as mu_median, round(stddev_pop(mu) + 1e-12, 9) as mu_std, round(avg(sigma) + 1e-12, 9) as sigma_mean, round(quantile_cont(sigma, 0.5) + 1e-12, 9) as sigma_median from p where period is not null group by all""")
def region_period_summary(spark, d):
    p = materialise(_book_stats(spark, d).join(V.books(spark, d).select("book", "year", "region"), "book").withColumn("period", _period(F.col("year"))).where("period is not null").select("period", "region", "mu", "sigma"))
    r = lambda c, a: F.round(c + 1e-12, 9).alias(a)
    by = ["period", "region"]
    out = p.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), r(F.avg("mu"), "mu_mean"), r(F.stddev_pop("mu"), "mu_std"), r(F.avg("sigma"), "sigma_mean"))
    for c in ("mu", "sigma"):
        out = out.join(quantiles(p, by, c, (0.5,)).select(*by, r(F.col("q")[0], f"{c}_median")), by, "left")
    return out.select(*by, "n", "mu_mean", "mu_median", "mu_std", "sigma_mean", "sigma_median")


@query(with_views(V.ENTRIES, CHAR_MEANS, V.BOOKS) + f""", b as (select book, avg(aspect_ratio) as a, avg(face_ratio) as f, avg(ink_coverage) as i from char_means group by book), p as (select {PERIOD_CASE} as period, a, f, i from b join books using (book))
  select period, metric, round(avg(v) + 1e-12, 9) as mean, count(v) as n from (select period, unnest(['aspect_ratio', 'face_ratio', 'ink_coverage']) as metric, unnest([a, f, i]) as v from p where period is not null) group by all""")
def period_metric_mean(spark, d):
    b = _char_means(spark, d).groupBy("book").agg(*[F.avg(m).alias(m) for m in V.METRICS])
    p = b.join(V.books(spark, d).select("book", "year"), "book").withColumn("period", _period(F.col("year"))).where("period is not null")
    return p.unpivot(["period"], list(V.METRICS), "metric", "v").groupBy("period", "metric").agg(F.round(F.avg("v") + 1e-12, 9).alias("mean"), F.count("v").alias("n"))


@query(with_views(V.ENTRIES, V.BOOKS) + f", p as (select {PERIOD_CASE} as period, ink_coverage as v from entries join books using (book)) select period, count(v) as n, round(quantile_cont(v, 0.25), 9) as q1, round(quantile_cont(v, 0.5), 9) as median, round(quantile_cont(v, 0.75), 9) as q3 from p where period is not null group by period")
def period_quartiles(spark, d):
    p = V.entries(spark, d).select("book", F.col("ink_coverage").alias("v")).join(V.books(spark, d).select("book", "year"), "book").withColumn("period", _period(F.col("year"))).where("period is not null")
    q = quantiles(p, ["period"], "v", (0.25, 0.5, 0.75))
    return q.select("period", "n", *[F.round(F.col("q")[i], 9).alias(a) for i, a in enumerate(("q1", "median", "q3"))])


@query(with_views(V.ENTRIES) + "select coalesce(book, '(all)') as book, count(*) as n, count(*) filter (lookup_missing) as lookup_missing, count(distinct ch) as chars, count(*) filter (aspect_ratio is null) as missing from entries group by rollup(book)")
def manifest_rollup(spark, d):
    return V.entries(spark, d).rollup("book").agg(F.count(F.lit(1)).alias("n"), F.count_if("lookup_missing").alias("lookup_missing"), F.count_distinct("ch").alias("chars"), F.count_if(F.col("aspect_ratio").isNull()).alias("missing")).withColumn("book", F.coalesce("book", F.lit("(all)")))


_RULES = {"no_character": "ch is null", "no_instance": "instance_id is null", "confirmed_without_path": "review_status = 'confirmed' and coalesce(confirmed_path, '') = ''", "dropped_but_accepted": "review_status = 'dropped' and filter_status = 'accepted'", "no_time": "review_at is null"}


@query(with_views(NORMAL) + "select code, count(*) as n from (select unnest([" + ", ".join(f"case when {c} then '{k}' end" for k, c in _RULES.items()) + "]) as code from normal) where code is not null group by code")
def audit_rules(spark, d):
    n = RS.normalised(V.reviews(spark, d))
    return n.select(F.explode(F.array_compact(F.array(*[F.when(F.expr(c), k) for k, c in _RULES.items()]))).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(with_views(V.INSTANCES) + "select book, volume, page, array_to_string(list(ch order by y, x, record_id), '') as text, max(conf) as conf from instances where y is not null and page is not null group by all")
def page_full_text(spark, d):
    """Characters of a page in reading order, and the best confidence; what lies on no known page has no order."""
    i = V.instances(spark, d).where("y is not null and page is not null").groupBy("book", "volume", "page").agg(F.array_sort(F.collect_list(F.struct("y", "x", "record_id", "ch"))).alias("l"), F.max("conf").alias("conf"))
    return i.select("book", "volume", "page", F.array_join(F.transform("l", lambda x: x["ch"]), "").alias("text"), "conf")


@query(with_views(V.GLYPHS) + """, o as (select book, w, row_number() over (partition by book order by w, instance_id) as k, count(*) over (partition by book) as n from glyphs), q as (select book, n, p, (n + 1) * p as h from (select distinct book, n from o) cross join (values (0.25), (0.75)) t(p)),
  e as (select q.book, q.p, min(case when o.k = greatest(1, least(n_, cast(floor(q.h) as bigint))) then w end) + (q.h - floor(q.h)) * (min(case when o.k = greatest(1, least(n_, cast(floor(q.h) as bigint) + 1)) then w end) - min(case when o.k = greatest(1, least(n_, cast(floor(q.h) as bigint))) then w end)) as v from q join (select *, n as n_ from o) o on q.book = o.book group by q.book, q.p, q.h)
  select g.book, g.n, g.mean, g.std, g.lo, g.hi, g.median, round(a.v, 9) as q1, round(b.v, 9) as q3 from (select book, count(*) as n, round(avg(w), 9) as mean, round(stddev_pop(w), 9) as std, min(w) as lo, max(w) as hi, round(quantile_cont(w, 0.5), 9) as median from glyphs group by book) g
  join e a on g.book = a.book and a.p = 0.25 join e b on g.book = b.book and b.p = 0.75""")
def descriptive_stats(spark, d):
    """Mean, population deviation, extremes, median and exclusive quartiles ((n+1)p-th value, interpolated) per book, from counts
    per value: the values of the places that are asked for come from one global sort."""
    g = V.glyphs(spark, d)
    base = g.groupBy("book").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("w"), 9).alias("mean"), F.round(F.stddev_pop("w"), 9).alias("std"), F.min("w").alias("lo"), F.max("w").alias("hi"))
    median = quantiles(g, ["book"], "w", (0.5,)).select("book", F.round(F.col("q")[0], 9).alias("median"))
    counts = g.groupBy("book", "w").agg(F.count(F.lit(1)).alias("c"))
    ordered = counts.withColumn("upto", F.sum("c").over(Window.partitionBy("book").orderBy("w"))).join(base.select("book", "n"), "book")
    out = base.join(median, "book")
    for p, name in ((0.25, "q1"), (0.75, "q3")):
        h = (F.col("n") + 1) * p
        at = lambda k: F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.least(F.col("n"), k)), F.col("w")))
        q = ordered.groupBy("book", "n").agg(at(F.floor(h)).alias("a"), at(F.floor(h) + 1).alias("b"))
        out = out.join(q.select("book", F.round(F.col("a") + (h - F.floor(h)) * (F.col("b") - F.col("a")), 9).alias(name)), "book")
    return out.select("book", "n", "mean", "std", "lo", "hi", "median", "q1", "q3")
