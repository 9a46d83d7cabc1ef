"""Queries of the problems of this subpackage, over the whole tables, and the SQL that DuckDB can check them with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm.bpe import decode_ids, encode_texts, token_counts
from inkwell.llm.components import duplicate_groups
from inkwell.llm.lookalikes import lookalike_terms, metadata_values, terms_sql
from inkwell.llm.packing import pack
from inkwell.llm.ranked import first_of_groups, percentiles, value_counts
from inkwell.llm.splitting import rejoined, split_texts
from inkwell.llm.survivors import best_of_groups, confidence_of
from inkwell.plans.compaction import STYLE_VALUES
from inkwell.runtime import materialise, table

CAPACITY = 8192
PIECE_TOKENS, PIECE_OVERLAP = 512, 64
METRICS = ("aspect_ratio", "face_ratio", "ink_coverage")
POINTS = (0.05, 0.25, 0.5, 0.75, 0.95)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = table(spark, sf_dir, "matched_books")
    return best_of_groups(matched, duplicate_groups(matched), dealt=False).select("group_id", "best_record_id")


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused record of each group, field by field, with values as the records hold them."""
    matched = table(spark, sf_dir, "matched_books")
    fused = best_of_groups(matched, duplicate_groups(matched))
    sides = [F.col("normalized_bbox_raw")[c].alias(f"nb_{c}") for c in ("x", "y", "width", "height")]
    return fused.select("group_id", "best_record_id", *[F.col(f"{c}_raw").alias(c) for c in ("source_image", "confidence", "char_index")], *sides)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(table(spark, sf_dir, "matched_books"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_terms(metadata_values(table(spark, sf_dir, "books_metadata")), table(spark, sf_dir, "script_terms"))


#: What a group is about, by its number: dimension and metric.
WHAT = [(d, m) for d in ("book", "std_char") for m in METRICS]


def measurements(bundle: DataFrame) -> DataFrame:
    """(what, key, day, value, tie): every measurement once for its book and once for its character, by the place in ``WHAT``; ``tie``
    is a hash that tells equal values apart."""
    rows = F.array(*[F.struct(F.lit(i).cast("tinyint").alias("what"), F.col(d).alias("key"), F.col(m).alias("value")) for i, (d, m) in enumerate(WHAT)])
    return bundle.select(F.explode(rows).alias("r"), F.col("measured_at").cast("date").alias("day"), F.shiftright(F.hash("entry_id"), 20).cast("smallint").alias("tie")).select("r.*", "day", "tie")


GROUP = ["what", "key"]


def _named(df: DataFrame) -> DataFrame:
    name = lambda k: F.element_at(F.array(*[F.lit(w[k]) for w in WHAT]), F.col("what") + 1)
    return df.select(name(0).alias("dim"), "key", name(1).alias("metric"), "n", *[F.round(c, 9).alias(c) for c in df.columns if c not in (*GROUP, "n")])


def p6_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(percentiles(measurements(table(spark, sf_dir, "analysis_bundle")), GROUP, POINTS, ties="tie"))


def p6_combined_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same percentiles from the states of single days, combined."""
    long = measurements(table(spark, sf_dir, "analysis_bundle"))
    days = value_counts(long, ["day", *GROUP])
    return _named(percentiles(value_counts(days.drop("day"), GROUP), GROUP, POINTS))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("bbox")
    rows = table(spark, sf_dir, "matched_books").where((b["width"] > 0) & (b["height"] > 0)).select("record_id", "book", "std_char", b["width"].alias("w"), confidence_of().alias("c"))
    top = first_of_groups(rows, ["book", "std_char"], [F.col("w").desc(), F.col("c").desc(), F.col("record_id").asc()], 3)
    return top.select("record_id", "place")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"))


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts again, from their ids."""
    return decode_ids(encode_texts(table(spark, sf_dir, "documents")))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_counts(table(spark, sf_dir, "documents")), CAPACITY)


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_texts(table(spark, sf_dir, "documents"), PIECE_TOKENS, PIECE_OVERLAP)


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has to hold of the containers: none above its capacity or with a slot missing, every text's tokens in it once."""
    sizes = materialise(token_counts(table(spark, sf_dir, "documents")))
    packed = materialise(pack(sizes, CAPACITY))
    filled = packed.where("container_id is not null")
    bins = filled.groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("c"), F.count_distinct("slot").alias("d"), F.max("slot").alias("m"))
    over = bins.agg(F.count_if((F.col("n") > CAPACITY) | (F.col("c") != F.col("m")) | (F.col("d") != F.col("m"))).alias("bad_containers"))
    texts = filled.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("c"), F.count_distinct("piece").alias("d"), F.max("piece").alias("m"), F.bool_and(F.col("token_from") == (F.col("piece") - 1) * CAPACITY).alias("in_order"))
    whole = (F.col("n") == F.col("n_tokens")) & (F.col("c") == F.col("m")) & (F.col("d") == F.col("m")) & F.col("in_order")
    seen = sizes.join(texts, "doc_id", "left").agg(F.count_if(F.col("n_tokens").isNotNull() & whole).alias("whole_texts"), F.count_if(F.col("n_tokens").isNull() & F.col("n").isNull()).alias("null_texts"))
    return over.join(F.broadcast(seen), F.lit(True))  # one row each


def p10_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts again, from their pieces without the overlaps."""
    return rejoined(p10_pieces(spark, sf_dir))


def p10_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has to hold of the pieces: none above the limit, each but the first begins the overlap (up to three tokens more)
    before the last one's end, numbered from 1 without a gap."""
    behind = Window.partitionBy("doc_id").orderBy("piece")
    p = p10_pieces(spark, sf_dir).select("doc_id", "piece", "token_from", "n_tokens")
    shared = F.lag(F.col("token_from") + F.col("n_tokens")).over(behind) - F.col("token_from")
    good = (F.col("n_tokens") <= PIECE_TOKENS) & (F.row_number().over(behind) == F.col("piece")) & F.coalesce(shared.between(PIECE_OVERLAP, PIECE_OVERLAP + 3), F.col("token_from") == 0)
    return p.select("doc_id", good.alias("good")).groupBy("doc_id").agg(F.bool_and("good").alias("good"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_records, p2_found, p4_found, p6_percentiles, p6_combined_days, p7_found, p8_ids, p8_round_trip, p9_containers, p9_checks, p10_pieces, p10_round_trip, p10_limits)
}

_CONFIDENCE = "case when confidence is null or isnan(confidence) then 0 when confidence > 1 then confidence / 100 else confidence end"

_GROUPS = r"""
with recursive image as (
  select *, regexp_replace(replace(url_decode(source_image), '\', '/'), '/(\.?/)+', '/', 'g') as path from matched_books
), box as (
  select record_id, book, std_char, volume, page, bbox.x as x, bbox.y as y, bbox.width as w, bbox.height as h,
         regexp_extract(path, 'data/external/', 0) || '|' || regexp_extract(path, 'data/(?:raw|external|results/preprocessed)/([^/]+/[^/]+/page_0*[0-9]+)', 1) as img
  from image where source_image is not null and volume is not null and page is not null and bbox.width > 0 and bbox.height > 0
), edge as (
  select a.record_id as s, b.record_id as t
  from box a join box b on a.book = b.book and a.std_char = b.std_char and a.volume = b.volume and a.page = b.page and a.img = b.img and a.record_id <> b.record_id
  where least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) >= 0.8 * least(a.w, b.w) and least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) >= 0.8 * least(a.h, b.h)
    and greatest(a.w, b.w) <= 1.6 * least(a.w, b.w) and greatest(a.h, b.h) <= 1.6 * least(a.h, b.h)
), reach as (select s as node, s as seen from edge union select r.node, e.t from reach r join edge e on r.seen = e.s
), groups as (select node as record_id, min(seen) as group_id from reach group by node)
"""

ORACLE = {
    "p1_found": _GROUPS
    + rf"""select group_id, record_id as best_record_id from (select g.group_id, g.record_id, row_number() over (partition by g.group_id order by
  coalesce(regexp_matches(m.path, 'data/results/preprocessed/'), false) desc, (m.normalized_bbox is not null) desc, {_CONFIDENCE} desc, m.char_index asc nulls last, g.record_id) as k
from groups g join image m using (record_id)) where k = 1""",
    "p1_records": _GROUPS
    + rf""", rec as (
  select g.group_id, m.record_id, m.source_image, m.normalized_bbox as nb, m.confidence, m.char_index, case when regexp_matches(m.path, 'data/results/preprocessed/') then 2.0 else 1.0 end
      * pow(cast(0.5 as double), greatest(-100, least(100, coalesce(date_diff('day', cast(m.loaded_at as date), date '2022-01-01'), 3650) / 180.0))) as vote,
    regexp_matches(m.path, 'data/results/preprocessed/') as pre, {_CONFIDENCE} as conf
  from groups g join image m using (record_id)
), place as (select *, row_number() over (partition by group_id order by conf desc, char_index asc nulls last, record_id) as pl, row_number() over (partition by group_id order by pre desc, (nb is not null) desc, conf desc, char_index asc nulls last, record_id) as pb from rec
), long as (
  select group_id, record_id, pl, vote, unnest(['s', 'n', 'c', 'i']) as field, unnest([case when pre then 'preprocessed' else 'other scan' end,
    case when nb is not null then concat_ws(' ', {", ".join(f"coalesce(cast(cast(floor(nb.{c} * 1000 + 0.5) as bigint) as varchar), '-')" for c in ("x", "y", "width", "height"))}) end,
    case when conf > 0 then cast(cast(floor(conf * 100 + 0.5) as bigint) as varchar) end, cast(char_index as varchar)]) as value from place
), ballot as (select group_id, field, value, round(log2(sum(vote)), 9) as v, min(pl) as pl, min_by(record_id, pl) as voter from long where value is not null group by all
), won as (select *, row_number() over (partition by group_id, field order by v desc, case when field = 'c' then pl end, value desc) as k from ballot
), by_field as (select group_id, max(case when field = 's' then voter end) as s, max(case when field = 'n' then voter end) as n, max(case when field = 'c' then voter end) as c, max(case when field = 'i' then voter end) as i from won where k = 1 group by group_id)
  select f.group_id, b.record_id as best_record_id, s.source_image, c.confidence, i.char_index, n.nb.x as nb_x, n.nb.y as nb_y, n.nb.width as nb_width, n.nb.height as nb_height
  from by_field f join place b on f.group_id = b.group_id and b.pb = 1 left join rec s on f.s = s.record_id left join rec c on f.c = c.record_id left join rec i on f.i = i.record_id left join rec n on f.n = n.record_id""",
    "p2_found": _GROUPS + "select record_id, group_id from groups",
    "p7_found": f"""select record_id, cast(k as int) as place from (select record_id, row_number() over (partition by book, std_char order by bbox.width desc, {_CONFIDENCE} desc, record_id) as k
from matched_books where bbox.width > 0 and bbox.height > 0) where k <= 3""",
}
ORACLE["p4_found"] = terms_sql(STYLE_VALUES)
ORACLE["p8_round_trip"] = "select doc_id, text from documents"
ORACLE["p9_checks"] = "select 0 as bad_containers, count(text) as whole_texts, count(*) - count(text) as null_texts from documents"
ORACLE["p10_round_trip"] = "select doc_id, text from documents where text <> ''"
ORACLE["p10_limits"] = "select doc_id, true as good from documents where text <> ''"
ORACLE["p6_percentiles"] = ORACLE["p6_combined_days"] = (
    "with long as ("
    + " union all ".join(f"select '{d}' as dim, {d} as key, '{m}' as metric, {m} as value from analysis_bundle" for d in ("book", "std_char") for m in METRICS)
    + ") select dim, key, metric, count(*) as n, "
    + ", ".join(f"round(quantile_cont(value, {p}), 9) as p{p * 100:g}" for p in POINTS)
    + " from long where value is not null and isfinite(value) group by dim, key, metric"
)
