"""Raster queries over pixel rows, and layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions.scalars import finite
from inkwell.operators import raster as K
from inkwell.operators.global_sort import numbered
from inkwell.plans.registry import Registry
from inkwell.sources import views as V
from inkwell.sources.views import with_views

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle
query = R.query

DARK = 120


@query(with_views(V.PIXELS) + """, hist as (select id, gray, count(*) as c from pixels group by all), s as (select id, gray, sum(c) over w as n0, sum(c * gray) over w as s0, sum(c) over (partition by id) as n, sum(c * gray) over (partition by id) as s from hist window w as (partition by id order by gray)),
  v as (select id, gray, case when n > n0 then round(cast(n0 as double) * cast(n - n0 as double) * (cast(s0 as double) / n0 - cast(s - s0 as double) / nullif(n - n0, 0)) * (cast(s0 as double) / n0 - cast(s - s0 as double) / nullif(n - n0, 0)), 6) else -1 end as b from s)
  select id, gray as threshold from (select *, row_number() over (partition by id order by b desc, gray) as k from v) where k = 1""")
def otsu_threshold(spark, d):
    return K.otsu(V.pixels(spark, d))


@query(with_views(V.PIXELS) + f"select id, x, count(*) filter (gray < {DARK}) / count(*) as coverage from pixels group by all")
def projection_coverage(spark, d):
    return K.projection(V.pixels(spark, d), "x", F.col("gray") < DARK)


@query(with_views(V.PIXELS) + "select id, black, round(case when total > black then black / (total - black) end, 9) as ink from (select id, count(*) filter (gray < 160) as black, count(*) as total from pixels group by id)")
def fixed_box_ink(spark, d):
    """Black by white below 160; null where nothing is white."""
    return K.ink_counts(V.pixels(spark, d), 160, False).select("id", "black", F.round(F.try_divide(F.col("black"), F.nullif(F.col("total") - F.col("black"), F.lit(0))), 9).alias("ink"))


@query(with_views(V.PIXELS) + "select id, round(count(*) filter (gray <= 128) / count(*), 4) as ratio from pixels group by id")
def black_ratio(spark, d):
    return K.ink_counts(V.pixels(spark, d), 128, True).select("id", F.round(F.col("black") / F.col("total"), 4).alias("ratio"))


@query(with_views(V.PIXELS) + "select id, round(case when total > black then black / (total - black) end, 9) as ratio, total = black as infinite from (select id, count(*) filter (gray < 128) as black, count(*) as total from pixels group by id)")
def gray_ratio_legacy(spark, d):
    """Black by white below 128; all black is flagged, since its ratio is infinite."""
    k = K.ink_counts(V.pixels(spark, d), 128, False)
    white = F.col("total") - F.col("black")
    ratio = F.when(white > 0, F.try_divide(F.col("black").cast("double"), white)).otherwise(F.lit(float("inf")))
    return k.select("id", F.round(finite(ratio), 9).alias("ratio"), (white == 0).alias("infinite"))


@query(with_views(V.PIXELS) + """, b as (select id, min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1 from pixels where gray <= 110 group by id)
  select id, cast(greatest(0, x0 - 1) as int) as x, cast(greatest(0, y0 - 1) as int) as y, cast(least(7, x1 + 1) - greatest(0, x0 - 1) + 1 as int) as w, cast(least(7, y1 + 1) - greatest(0, y0 - 1) + 1 as int) as h from b""")
def shrink_to_ink(spark, d):
    return K.ink_box(V.pixels(spark, d), 110, 1, 8, 8)


@query(with_views(V.INSTANCES) + "select book, ch, record_id, cast((k - 1) % 10 as int) as col, cast((k - 1) // 10 as int) as row from (select book, ch, record_id, row_number() over (partition by book, ch order by record_id) as k from instances)")
def montage_layout(spark, d):
    """Tiles of every (book, character) in rows of ten."""
    t = numbered(V.instances(spark, d).select("book", "ch", "record_id"), ["book", "ch"], [F.col("record_id").asc()], "k")
    return t.select("book", "ch", "record_id", ((F.col("k") - 1) % 10).cast("int").alias("col"), F.floor((F.col("k") - 1) / 10).cast("int").alias("row"))


@query("select record_id, greatest(0, bbox.x - 10) as x0, greatest(0, bbox.y - 10) as y0, least(1600, bbox.x + bbox.width + 10) as x1, least(2400, bbox.y + bbox.height + 10) as y1 from matched_books where bbox.x is not null and bbox.y is not null and bbox.width is not null and bbox.height is not null and least(1600, bbox.x + bbox.width + 10) - greatest(0, bbox.x - 10) >= 10 and least(2400, bbox.y + bbox.height + 10) - greatest(0, bbox.y - 10) >= 10")
def roi_crop(spark, d):
    """Crop boxes with a margin of ten, clamped to the page; those below ten pixels and rows without a box are left out."""
    i = V.instances(spark, d).where("x is not null and y is not null and w is not null and h is not null")
    crop = i.select("record_id", F.greatest(F.lit(0), F.col("x") - 10).alias("x0"), F.greatest(F.lit(0), F.col("y") - 10).alias("y0"), F.least(F.lit(1600), F.col("x") + F.col("w") + 10).alias("x1"), F.least(F.lit(2400), F.col("y") + F.col("h") + 10).alias("y1"))
    return crop.where("x1 - x0 >= 10 and y1 - y0 >= 10")


_LINKED = f""", ink as (select id, x, y, id * 64 + y * 8 + x as n from pixels where gray < {DARK}), link as (select a.n as a, b.n as b from ink a join ink b on a.id = b.id and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1),
  reach as (select a as node, b as seen from link union select r.node, l.b from reach r join link l on r.seen = l.a), part as (select node, min(seen) as label from reach group by node),
  comp as (select id, label, min(x) as x, min(y) as y, max(x) - min(x) + 1 as w, max(y) - min(y) + 1 as h, count(*) as area from ink join part on n = node group by id, label)"""


@query(with_views(V.PIXELS) + _LINKED + " select id, label, x, y, w, h, area from comp")
def components(spark, d):
    return K.components(V.pixels(spark, d), F.col("gray") < DARK, 8)


@query(with_views(V.PIXELS) + _LINKED + """, t as (select *, case when x <= 0 or y <= 0 or x + w >= 8 or y + h >= 8 then 'border_touch' when x <= 1 or y <= 1 or x + w >= 7 or y + h >= 7 then 'edge_zone' else 'interior' end as tier from comp)
  select id, label, tier, case when area < case tier when 'border_touch' then 3 when 'edge_zone' then 2 else 1 end then 'area' when tier <> 'interior' and greatest(w, h) >= 4 * least(w, h) then 'aspect' when least(w, h) <= 1 then 'thin' end as reason from t""")
def component_filter(spark, d):
    parts = K.components(V.pixels(spark, d), F.col("gray") < DARK, 8)
    return K.classified(parts, 8, 8, max_aspect=4.0, min_dim=1).select("id", "label", "tier", "reason")


@query(with_views(V.PIXELS) + f""", c as (select id, x, count(*) filter (gray < {DARK}) / count(*) as cov from pixels group by all), o as (select id, x, x - row_number() over (partition by id order by x) as g from c where cov > 0.3), r as (select id, min(x) as s, max(x) + 1 as e from o group by id, g),
  b as (select id, min(s) filter (not (e <= 2 and e - s <= 1.6)) as lo, max(e) filter (not (s >= 6 and e - s <= 1.6)) as hi, max(e) as me, min(s) as ms from r group by id), z as (select id, least(7, coalesce(lo, me)) as lo, coalesce(hi, ms) as hi from b)
  select i.id, cast(coalesce(z.lo, 0) as int) as lo, cast(case when z.id is null then 8 else greatest(z.lo + 1, least(8, z.hi)) end as int) as hi from (select distinct id from pixels) i left join z on i.id = z.id""")
def projection_trim(spark, d):
    cov = K.projection(V.pixels(spark, d), "x", F.col("gray") < DARK)
    return K.projection_trim(cov, "x", 8, 0.3, 0.2, 0.3)


@query(with_views(V.PIXELS) + ", c as (select id, count(*) filter (gray < 160) as black from pixels where x between 1 and 6 and y between 1 and 6 group by id) select id, black, round(case when black < 36 then black / (36 - black) end, 9) as ink from c")
def centre_crop_ink(spark, d):
    """Ink by white within a fixed box of six around the middle."""
    c = K.centre_crop(V.pixels(spark, d), 8, 8, 6).groupBy("id").agg(F.count_if(F.col("gray") < 160).alias("black"))
    return c.select("id", "black", F.round(F.try_divide(F.col("black"), F.nullif(36 - F.col("black"), F.lit(0))), 9).alias("ink"))


@query(with_views(V.PIXELS) + f""", c as (select id, x, count(*) filter (gray < {DARK}) / count(*) as cov from pixels group by all), t as (select *, max(cov) over (partition by id) as top from c), o as (select id, x, cov, top, x - row_number() over (partition by id order by x) as g from t where cov >= 0.35 * top and top > 0),
  r as (select id, top, min(x) as s, max(x) as e, max(cov) as peak from o group by id, top, g having max(x) - min(x) + 1 between 1 and 2),
  l as (select r.id, min(e + 1) as cut from r left join c on c.id = r.id and c.x = r.e + 1 where e < 3 and peak - coalesce(cov, 0) >= 0.4 * top group by r.id), q as (select r.id, min(8 - s) as cut from r left join c on c.id = r.id and c.x = r.s - 1 where s >= 5 and peak - coalesce(cov, 0) >= 0.4 * top group by r.id)
  select i.id, cast(coalesce(l.cut, 0) as int) as "left", cast(coalesce(q.cut, 0) as int) as "right" from (select distinct id from pixels) i left join l using (id) left join q using (id)""")
def border_trim(spark, d):
    return K.border_cuts(V.pixels(spark, d), F.col("gray") < DARK, 8)


@query(with_views(V.PIXELS) + """, ink as (select id, x, y from pixels where gray < 150), hr as (select id, y, min(x) as x0, max(x) as x1 from (select *, x - row_number() over (partition by id, y order by x) as g from ink) group by id, y, g having max(x) - min(x) + 1 >= 4 and (y <= 1 or y >= 6)),
  vr as (select id, x, min(y) as y0, max(y) as y1 from (select *, y - row_number() over (partition by id, x order by y) as g from ink) group by id, x, g having max(y) - min(y) + 1 >= 4 and (x <= 1 or x >= 6)), cr as (select * from hr join vr using (id) where x between x0 and x1 and y between y0 and y1),
  f as (select id, unnest(range(x0, x1 + 1)) as x, y from cr union select id, x, unnest(range(y0, y1 + 1)) as y from cr), n as (select id, count(*) as n from ink group by id), k as (select id, count(*) as f from f group by id) select id, cast(x as int) as x, cast(y as int) as y from f join n using (id) join k using (id) where k.f <= 0.5 * n.n""")
def frame_removal(spark, d):
    """Pixels of frames (runs of half the raster near an edge that cross)."""
    return K.frame_pixels(V.pixels(spark, d), F.col("gray") < 150, 8, 8, 0.5)


def _components_sql(name: str, where: str) -> str:
    """CTEs of the 8-connected components of pixels: <name> (id, x, y, gray, label)."""
    return f"""{name}_ink as (select id, x, y, gray, id * 64 + y * 8 + x as n from pixels where {where}), {name}_link as (select a.n as a, b.n as b from {name}_ink a join {name}_ink b on a.id = b.id and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1),
  {name}_reach as (select a as node, b as seen from {name}_link union select r.node, l.b from {name}_reach r join {name}_link l on r.seen = l.a), {name}_part as (select node, min(seen) as label from {name}_reach group by node),
  {name} as (select id, x, y, gray, label from {name}_ink join {name}_part on n = node)"""


#: Gray levels and the least stroke of the noise queries.
STROKE, MID, LEAST = 110, 125, 6

_ramp = lambda v, lo, hi: f"greatest(0.0, least(1.0, (round({v}, 9) - {lo}) / ({hi} - {lo})))"
_NOISE = f"""{_components_sql('dark', f'gray <= {STROKE}')}, {_components_sql('mid', f'gray > {STROKE} and gray < {MID}')}, stroke as (select d.id, d.x, d.y from dark d join (select id, label from dark group by all having count(*) >= {LEAST}) using (id, label)),
  away as (select m.id, m.label, m.x, m.y, m.gray, sqrt(min((m.x - s.x) * (m.x - s.x) + (m.y - s.y) * (m.y - s.y))) as d from mid m left join stroke s on m.id = s.id group by all),
  part as (select id, label, count(*) as area, greatest(max(x) - min(x) + 1, max(y) - min(y) + 1) / least(max(x) - min(x) + 1, max(y) - min(y) + 1) as aspect, avg(d) as near, stddev_pop(d) / (avg(d) + 1) as spread from away group by id, label),
  scored as (select *, round(0.4 * (1 - {_ramp('aspect', 2.0, 5.0)}) + 0.6 * case when near is null then 1.0 else 0.5 * {_ramp('near', 1.5, 2.0)} + 0.5 * {_ramp('spread', 0.2, 0.25)} end, 6) as score from part), named as (select *, score >= 0.4 and area between 2 and 200000 as noise from scored)"""


@query(with_views(V.PIXELS, _NOISE) + " select id, label, area, round(aspect, 9) as aspect, score, noise from named")
def noise_removal(spark, d):
    """Components of mid-gray pixels with their scores."""
    scores, _ = K.noise_scores(V.pixels(spark, d), 8, STROKE, MID, stroke=LEAST)
    return scores.select("id", "label", "area", F.round("aspect", 9).alias("aspect"), "score", "noise")


_RING = """noise as (select a.* from away a join named n on a.id = n.id and a.label = n.label where n.noise), around as (select distinct n.id, n.label, p.x, p.y, p.gray from noise n join pixels p on p.id = n.id and (p.x - n.x) * (p.x - n.x) + (p.y - n.y) * (p.y - n.y) <= 4
    where not exists (select 1 from noise o where o.id = n.id and o.label = n.label and o.x = p.x and o.y = p.y)),
  ground as (select n.id, n.label, cast(floor(coalesce(quantile_cont(gray, 0.5) filter (gray >= 130), quantile_cont(gray, 0.5), 245)) as int) as g from (select distinct id, label from noise) n left join around a on a.id = n.id and a.label = n.label group by n.id, n.label)"""


@query(with_views(V.PIXELS, _NOISE, _RING) + " select n.id, x, y, gray, g as new from noise n join ground on n.id = ground.id and n.label = ground.label where d is null or d >= 1.5")
def selective_removal(spark, d):
    """Pixels of noise away from strokes, with the background that replaces them (radius 2, light from 130 on)."""
    return K.without_noise(V.pixels(spark, d), 8, STROKE, MID, 1.5, 2, 130, stroke=LEAST)


@query(with_views(V.PIXELS) + " select a.id, a.x, a.y, (any_value(a.gray) + 2) * count(*) < sum(b.gray) as ink from pixels a join pixels b on a.id = b.id and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1 group by a.id, a.x, a.y")
def adaptive_threshold(spark, d):
    """Ink by the mean of the neighbourhood."""
    return K.local_ink(V.pixels(spark, d))


@query()
def border_bounds(spark, d):
    """All of the border trim, of which ``border_trim`` is a single step."""
    return K.border_bounds(V.pixels(spark, d), F.col("gray") < DARK, 8, 8, reach=0.4, most=0.25)


@query()
def projection_bounds(spark, d):
    """All of the projection trim, of which ``projection_trim`` is the cut of columns."""
    return K.projection_bounds(V.pixels(spark, d), F.col("gray") < DARK, 8, 8, (0.3, 0.01), 0.3)
