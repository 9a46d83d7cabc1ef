"""Scalar functions and projections over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import scalars as S
from inkwell.operators import review_state as RS
from inkwell.plans.registry import Registry
from inkwell.runtime import table
from inkwell.sources import views as V

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle
query = R.query


@query(f"""select book_no, cast(i as int) as pos, tags[i] as tag from (select book_no, tags, unnest(range(1, len(tags) + 1)) as i from (select book_no,
  case when len({V.TAGS}) > 0 then {V.TAGS} else ['（空）'] end as tags from books_metadata))""")
def style_tags_split(spark, d):
    t = table(spark, d, "books_metadata").select("book_no", F.posexplode(S.style_tags(F.col("刻体倾向"))).alias("p", "tag"))
    return t.select("book_no", (F.col("p") + 1).alias("pos"), "tag")


@query(r"""select record_id, cast(coalesce(nullif(regexp_extract(source_image, '册([0-9]+)', 1), ''), nullif(regexp_extract(source_image, '(?i)vol(?:ume)?[_-]?([0-9]+)', 1), ''),
  nullif(regexp_extract(source_image, '第([0-9]+)册', 1), ''), nullif(regexp_extract(source_image, '(?i)(?:^|[/_-])v([0-9]+)', 1), '')) as int) as vol from matched_books""")
def volume_number(spark, d):
    return table(spark, d, "matched_books").select("record_id", S.volume_number(F.col("source_image")).alias("vol"))


@query("""select record_id, case when ocr_file is null then null when contains(ocr_file, '/') and not regexp_matches(split_part(ocr_file, '/', 1), '册[0-9]+|(?i:vol(ume)?[_-]?[0-9]+)|第[0-9]+册|(?i:(^|[/_-])v[0-9]+)')
  then split_part(ocr_file, '/', 1) else '' end as folder from matched_books""")
def path_book(spark, d):
    return table(spark, d, "matched_books").select("record_id", F.when(F.col("ocr_file").isNotNull(), S.book_of_path(F.col("ocr_file"))).alias("folder"))


@query("""select record_id, case when volume is not null and page is not null and char_index is not null then printf('册%02d_page%s_idx%d', volume, split_part(page, '_', -1), char_index) end as instance_id from matched_books""")
def instance_id_make(spark, d):
    return table(spark, d, "matched_books").select("record_id", S.make_instance_id(F.col("volume"), F.col("page"), F.col("char_index")).alias("instance_id"))


@query("""select item_id, cast(nullif(regexp_extract(instance_id, '^册([0-9]+)_page([0-9]+)_idx([0-9]+)$', 1), '') as int) as volume, nullif(regexp_extract(instance_id, '^册([0-9]+)_page([0-9]+)_idx([0-9]+)$', 2), '') as page,
  cast(nullif(regexp_extract(instance_id, '^册([0-9]+)_page([0-9]+)_idx([0-9]+)$', 3), '') as int) as idx from review_books""")
def instance_id_parse(spark, d):
    return table(spark, d, "review_books").select("item_id", S.parse_instance_id(F.col("instance_id")).alias("p")).select("item_id", "p.volume", "p.page", "p.idx")


@query(r"""select record_id, regexp_replace(source_image, '^.*?raw/([^/]+)/([^/]+)/(page_[0-9]+)\.[A-Za-z]+$', 'data/results/preprocessed/\1/\2/\3_preprocessed.png') as path from matched_books""")
def path_normalise(spark, d):
    return table(spark, d, "matched_books").select("record_id", S.preprocessed_path(F.col("source_image")).alias("path"))


@query(r"""select book_no, regexp_replace(刻体倾向, '[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1C-\x1F]+', '', 'g') as style from books_metadata""")
def text_normalise(spark, d):
    return table(spark, d, "books_metadata").select("book_no", S.strip_all_space(F.col("刻体倾向")).alias("style"))


@query("""with m as (select record_id, normalized_bbox as n from matched_books where normalized_bbox is not null), b as (select record_id, cast(round_even(n.x * 1600, 0) as int) as x0, cast(round_even((1 - n.y - n.height) * 2400, 0) as int) as y0, cast(round_even(n.width * 1600, 0) as int) as w0,
  cast(round_even(n.height * 2400, 0) as int) as h0, greatest(0, least(x0, 1599)) as x, greatest(0, least(y0, 2399)) as y from m)
  select record_id, cast(x as int) as x, cast(y as int) as y, cast(greatest(1, least(w0, 1600 - x)) as int) as width, cast(greatest(1, least(h0, 2400 - y)) as int) as height from b""")
def box_denormalise(spark, d):
    m = table(spark, d, "matched_books").where("normalized_bbox is not null")
    return m.select("record_id", S.pixel_box(F.col("normalized_bbox"), F.lit(1600), F.lit(2400)).alias("b")).select("record_id", "b.*")


@query("""select record_id, greatest(0.0, least(1.0, case when v > 1 then v / 100 else v end)) as conf from (select record_id, case when confidence is null or isnan(confidence) then 0.75 else confidence end as v from matched_books)""")
def min_conf_normalise(spark, d):
    return table(spark, d, "matched_books").select("record_id", S.min_confidence(F.col("confidence")).alias("conf"))


@query("""select book_no, try_cast(split_part(bookid, '_', 1) as int) as ord, try_cast(split_part(bookid, '_', 2) as int) as year, coalesce(nullif(array_to_string(string_split(bookid, '_')[3:], '_'), ''), '') as rest from books_metadata""")
def book_prefix(spark, d):
    return table(spark, d, "books_metadata").select("book_no", S.book_prefix(F.col("bookid")).alias("p")).select("book_no", "p.*")


@query("""with t as (select book_no, string_split(宋刻本, '') as ch, 宋刻本 from books_metadata where 宋刻本 is not null and not contains(宋刻本, ':') and not contains(宋刻本, ';') and not contains(宋刻本, '|') and trim(宋刻本) <> '')
  select book_no, cast(len(string_split(宋刻本 || '|' || upper(宋刻本), '|')) as int) as n, string_split(宋刻本 || '|' || upper(宋刻本), '|')[2] as second from t""")
def str_map_styles(spark, d):
    """Round trip of ``region:style|style`` texts built from the catalogue."""
    b = table(spark, d, "books_metadata").where("`宋刻本` is not null and not `宋刻本` rlike '[:;|]' and trim(`宋刻本`) <> ''")
    m = S.styles_by_region(F.concat(F.lit("r:"), "宋刻本", F.lit("|"), F.upper("宋刻本"), F.lit(";q:x")))
    return b.select("book_no", F.size(m["r"]).alias("n"), m["r"][1].alias("second"))


@query("""select record_id, case when 1 = 1 then regexp_extract(book, '^([^_]*_[^_]*)', 1) end as label, replace(book, '/', '_') as safe, coalesce(case when isfinite(confidence) then printf('%.4f', confidence) end, 'NA') as conf from matched_books""")
def labels_and_numbers(spark, d):
    return table(spark, d, "matched_books").select("record_id", S.short_label(F.col("book")).alias("label"), S.safe_name(F.col("book")).alias("safe"), S.formatted(F.col("confidence")).alias("conf"))


@query(r"""select record_id, case when contains(p, 'results/preprocessed/') or contains(p, '_preprocessed') then 'preprocessed' when contains(p, 'data/raw/') then 'raw' else 'other' end as kind
  from (select record_id, replace(coalesce(source_image, ''), '\', '/') as p from matched_books)""")
def source_kind(spark, d):
    return table(spark, d, "matched_books").select("record_id", S.source_kind(F.col("source_image")).alias("kind"))


_STATE = """case when filter_status in ('pending', 'accepted', 'rejected') then filter_status when review_status is not distinct from 'confirmed' then 'accepted' else 'pending' end"""
_REVIEW = """case when review_status in ('pending', 'confirmed', 'dropped') then review_status when decision is not distinct from 'drop' then 'dropped' else 'pending' end"""


@query(f"select item_id, {_STATE} as state from review_books")
def filter_state_norm(spark, d):
    return V.reviews(spark, d).select("item_id", RS.filter_state(F.col("filter_status"), F.col("review_status")).alias("state"))


@query(f"select item_id, {_REVIEW} as state, coalesce(nullif(decision, ''), case when {_REVIEW} = 'dropped' then 'drop' else 'need' end) as decision from review_books")
def review_state_norm(spark, d):
    return RS.normalised(V.reviews(spark, d)).select("item_id", F.col("review_status").alias("state"), "decision")


@query("""select item_id, case when review_status = 'pending' then 'unreviewed' else review_status end as status, coalesce(nullif(decision, ''), 'unknown') as legacy_decision, review_status as back_status,
  case when review_status = 'confirmed' and decision = 'drop' then 'need' else coalesce(nullif(decision, ''), '') end as back_decision from review_books""")
def legacy_roundtrip(spark, d):
    back = RS.from_legacy(RS.legacy_entry(V.reviews(spark, d)))
    return back.select("item_id", "status", "legacy_decision", F.col("review_status").alias("back_status"), F.col("decision").alias("back_decision"))


@query(r"""select item_id, coalesce(nullif(confirmed_path, ''), regexp_replace(nullif(segmented_path, ''), '(^|/)segmented/', '\1confirmed/')) as path from review_books""")
def confirmed_path(spark, d):
    return V.reviews(spark, d).select("item_id", RS.confirmed_path(F.col("confirmed_path"), F.col("segmented_path")).alias("path"))


@query("""select record_id, coalesce(nullif(bbox.width, 0), nullif(cast(round_even(normalized_bbox.width * 1600, 0) as int), 0), 0) as width, coalesce(nullif(bbox.height, 0), nullif(cast(round_even(normalized_bbox.height * 2400, 0) as int), 0), 0) as height,
  coalesce(ocr_file, '') as ocr_file from matched_books""")
def source_projection(spark, d):
    """Sizes where 0 means missing: the box's own, else that of the normalised box, else 0."""
    size = lambda n, k: F.coalesce(F.nullif(F.col("bbox")[n], F.lit(0)), F.nullif(F.bround(F.col("normalized_bbox")[n] * k).cast("int"), F.lit(0)), F.lit(0)).alias(n)
    return table(spark, d, "matched_books").select("record_id", size("width", 1600), size("height", 2400), F.coalesce("ocr_file", F.lit("")).alias("ocr_file"))


@query("""select item_id, case when nullif(confirmed_path, '') is not null then 'confirmed' when nullif(segmented_path, '') is not null and item_bytes > 0 then 'segmented' else 'none' end as kind,
  coalesce(nullif(confirmed_path, ''), case when item_bytes > 0 then nullif(segmented_path, '') end) as preview from review_books""")
def preview_resolve(spark, d):
    conf, seg = F.nullif("confirmed_path", F.lit("")), F.when(F.col("item_bytes") > 0, F.nullif("segmented_path", F.lit("")))
    return V.reviews(spark, d).select("item_id", F.when(conf.isNotNull(), "confirmed").when(seg.isNotNull(), "segmented").otherwise("none").alias("kind"), F.coalesce(conf, seg).alias("preview"))


@query("""with n as (select book, std_char, instance_id, max_by(segmented_path, item_id) as segmented_path from review_books where segmented_path <> '' and instance_id is not null and std_char is not null group by all)
  select r.item_id, coalesce(nullif(r.segmented_path, ''), n.segmented_path) as segmented_path, coalesce(nullif(r.decision, ''), 'need') as decision from review_books r left join n using (book, std_char, instance_id)""")
def backfill(spark, d):
    """Empty fields are filled from the newest row of the same glyph that has them."""
    r = V.reviews(spark, d)
    fill = r.where("segmented_path <> '' and instance_id is not null and ch is not null").groupBy("book", "ch", "instance_id").agg(F.max_by("segmented_path", "item_id").alias("new"))
    return r.join(fill, ["book", "ch", "instance_id"], "left").select("item_id", F.coalesce(F.nullif("segmented_path", F.lit("")), "new").alias("segmented_path"), F.coalesce(F.nullif("decision", F.lit("")), F.lit("need")).alias("decision"))
