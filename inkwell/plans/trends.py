"""Rank correlation, slopes, influence and resampling over series of books."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators import trends as T
from inkwell.operators.global_sort import numbered, quantiles
from inkwell.operators.review_state import first_per
from inkwell.plans.registry import Registry
from inkwell.plans.relational import CHAR_MEANS, _char_means, common, trimmed
from inkwell.runtime import materialise
from inkwell.sources import views as V
from inkwell.sources.views import with_views

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle
query = R.query

#: The series of the queries: per character, the mean aspect ratio of its glyphs in every book, over the books' years.
SERIES = "series as (select e.ch, e.book, b.year as x, round(avg(aspect_ratio) + 1e-12, 6) as y from entries e join books b using (book) where e.ch is not null and aspect_ratio is not null and b.year is not null group by all)"
_VIEWS = (V.ENTRIES, V.BOOKS, SERIES)


def _series(spark, d):
    means = V.entries(spark, d).where("ch is not null and aspect_ratio is not null").groupBy("ch", "book").agg(F.round(F.avg("aspect_ratio") + 1e-12, 6).alias("y"))
    return means.join(V.books(spark, d).where("year is not null").select("book", F.col("year").alias("x")), "book").select("ch", "book", "x", "y")


RANKED = """ranked as (select ch, book, x, y, rank() over (partition by ch order by x) + (count(*) over (partition by ch, x) - 1) / 2.0 as rx, rank() over (partition by ch order by y) + (count(*) over (partition by ch, y) - 1) / 2.0 as ry from series)"""
#: A correlation over at least two rows with two different values on each side.
_RHO = "case when count(*) >= 2 and stddev_pop(rx) > 0 and stddev_pop(ry) > 0 then round(corr(rx, ry), 6) end"


@query(with_views(V.GLYPHS) + """, aspect as (select book, ch, avg(h / greatest(1, w)) as v from glyphs group by all), shared as (select ch from aspect group by ch having count(*) = (select count(distinct book) from aspect)),
  kept as (select book, ch, v from aspect join shared using (ch)), b as (select book, count(*) as n, quantile_cont(v, 0.05) as lo, quantile_cont(v, 0.95) as hi from kept group by book),
  core as (select book, v from kept join b using (book) where n < 4 or round(v, 9) between round(lo, 9) and round(hi, 9)), s as (select book, avg(v) as mu, stddev_pop(v) as sigma, count(*) as n from core group by book),
  r as (select *, rank() over (order by round(mu, 9)) as rm, rank() over (order by book) as rb from s), c as (select round(corr(rm, rb), 6) as rho from r) select book, n, round(mu, 8) as mu, round(sigma, 8) as sigma, rho from s cross join c""")
def trend_mu_sigma_common_trimmed(spark, d):
    """The flagship: per book the trimmed mean and deviation of the aspect ratio over the characters that all books share, and the
    rank correlation of the means with the order of books."""
    aspect = V.glyphs(spark, d).groupBy("book", "ch").agg(F.avg(F.col("h") / F.greatest(F.lit(1), "w")).alias("v"))
    kept = aspect.join(common(aspect, "book", "ch"), "ch", "left_semi")
    s = trimmed(kept, ["book"], "v").groupBy("book").agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sigma"), F.count(F.lit(1)).alias("n"))
    s = materialise(s)
    points = s.select(F.lit(1).alias("g"), F.col("book").alias("x"), F.round("mu", 9).alias("y"))
    for value, out in (("x", "rx"), ("y", "ry")):
        points = T.with_sorted_rank(points, ["g"], value, ["x"], out)
    rho = points.agg(F.round(T.correlation(F.col("rx"), F.col("ry")), 6).alias("rho"))
    return s.join(F.broadcast(rho), F.lit(True)).select("book", "n", F.round("mu", 8).alias("mu"), F.round("sigma", 8).alias("sigma"), "rho")


@query(with_views(*_VIEWS, RANKED) + f"select ch, count(*) as n, {_RHO} as rho from ranked group by ch")
def spearman(spark, d):
    return T.spearman(_series(spark, d), ["ch"]).select("ch", "n", F.round("rho", 6).alias("rho"))


_PAIRS = """pair as (select a.ch, b.x - a.x as dx, b.y - a.y as dy from series a join series b on a.ch = b.ch and a.book < b.book), cnt as (select s.ch, count(*) filter (dx * dy > 0) as c, count(*) filter (dx * dy < 0) as d, count(*) filter (dx = 0 and dy <> 0) as tx, count(*) filter (dy = 0 and dx <> 0) as ty, count(*) filter (dx = 0 and dy = 0) as tb from (select distinct ch from series) s left join pair using (ch) group by s.ch)"""


@query(with_views(*_VIEWS, _PAIRS) + "select ch, round((c - d) / nullif(sqrt(cast(c + d + tx + tb as double) * (c + d + ty + tb)), 0), 6) as tau from cnt")
def kendall_joint_ties(spark, d):
    return T.pair_counts(_series(spark, d), ["ch"]).select("ch", F.round(T.tau_of_counts(True), 6).alias("tau"))


@query(with_views(*_VIEWS, _PAIRS) + "select ch, round((c - d) / nullif(sqrt(cast(c + d + tx as double) * (c + d + ty)), 0), 6) as tau from cnt")
def kendall_textbook(spark, d):
    return T.pair_counts(_series(spark, d), ["ch"]).select("ch", F.round(T.tau_of_counts(False), 6).alias("tau"))


@query(with_views(*_VIEWS, _PAIRS) + "select ch, round(quantile_cont(dy / dx, 0.5), 6) as slope from pair where dx <> 0 group by ch")
def theil_sen(spark, d):
    return T.theil_sen(_series(spark, d), ["ch"]).select("ch", F.round("slope", 6).alias("slope"))


@query(with_views(*_VIEWS) + ", i as (select ch, y, row_number() over (partition by ch order by x, book) as k from series) select ch, round(case when count(*) > 1 then regr_slope(y, k) end + 1e-12, 9) as slope, round(case when count(*) > 1 then regr_intercept(y, k) end + 1e-12, 9) as intercept from i group by ch")
def linear_fit(spark, d):
    i = numbered(_series(spark, d), ["ch"], [F.col("x").asc(), F.col("book").asc()], "k")
    many = F.count(F.lit(1)) > 1
    return i.groupBy("ch").agg(F.round(F.when(many, F.regr_slope("y", "k")) + 1e-12, 9).alias("slope"), F.round(F.when(many, F.regr_intercept("y", "k")) + 1e-12, 9).alias("intercept"))


_LEFT = f"""o as (select a.ch, b.book as book0, a.x, a.y from series a join series b on a.ch = b.ch and a.book <> b.book), l as (select ch, book0, rank() over (partition by ch, book0 order by x) + (count(*) over (partition by ch, book0, x) - 1) / 2.0 as rx, rank() over (partition by ch, book0 order by y) + (count(*) over (partition by ch, book0, y) - 1) / 2.0 as ry from o),
  f as (select ch, case when count(*) >= 2 and stddev_pop(rx) > 0 and stddev_pop(ry) > 0 then corr(rx, ry) end as rho, count(*) as size from ranked group by ch), loo as (select ch, book0, case when count(*) >= 2 and stddev_pop(rx) > 0 and stddev_pop(ry) > 0 then corr(rx, ry) end - rho as delta from l join f using (ch) where size >= 3 group by ch, book0, rho)"""


@query(with_views(*_VIEWS, RANKED, _LEFT) + "select ch, book0 as book, round(delta, 6) as delta from loo")
def influence_loo(spark, d):
    return T.leave_one_out(_series(spark, d), ["ch"], "book").select("ch", "book", F.round("delta", 6).alias("delta"))


@query(with_views(*_VIEWS, RANKED, _LEFT) + f""", top as (select ch, book0 from (select *, row_number() over (partition by ch order by round(abs(delta), 7) desc nulls last, book0) as k from loo) where k <= 2), rest as (select s.* from series s anti join top on s.ch = top.ch and s.book = top.book0),
  rr as (select ch, rank() over (partition by ch order by x) + (count(*) over (partition by ch, x) - 1) / 2.0 as rx, rank() over (partition by ch order by y) + (count(*) over (partition by ch, y) - 1) / 2.0 as ry from rest) select ch, count(*) as n, {_RHO} as rho from rr group by ch""")
def sensitivity_top2_rho(spark, d):
    """The rank correlation without the two most influential points."""
    s = _series(spark, d)
    loo = T.leave_one_out(s, ["ch"], "book").withColumn("size", F.round(F.abs("delta"), 7))
    top = first_per(loo, ["ch"], [F.col("size").desc_nulls_last(), F.col("book").asc()], 2).select("ch", "book")
    return T.spearman(s.join(top, ["ch", "book"], "left_anti"), ["ch"]).select("ch", "n", F.round("rho", 6).alias("rho"))


# ---- metrics over books, with their resamples ----

#: Per metric, the books' means of character means over the books' years.
TRENDS = """trend_of as (select metric, x, y from (select unnest(['aspect_ratio', 'face_ratio', 'ink_coverage']) as metric, year as x, unnest([a, f, i]) as y from (select book, round(avg(aspect_ratio) + 1e-12, 6) as a, round(avg(face_ratio) + 1e-12, 6) as f, round(avg(ink_coverage) + 1e-12, 6) as i from char_means group by book) join books using (book) where year is not null) where y is not null),
  numbered as (select *, row_number() over (partition by metric order by x, y) - 1 as i, count(*) over (partition by metric) as n from trend_of)"""
_TRENDS = (V.ENTRIES, CHAR_MEANS, V.BOOKS, TRENDS)


def _metric_trends(spark, d):
    means = _char_means(spark, d).groupBy("book").agg(*[F.round(F.avg(m) + 1e-12, 6).alias(m) for m in V.METRICS])
    by_year = means.join(V.books(spark, d).where("year is not null").select("book", "year"), "book")
    return by_year.unpivot(["year"], list(V.METRICS), "metric", "y").where("y is not null").select("metric", F.col("year").alias("x"), "y")


def _resampled(tag: str, times: int = T.RESAMPLES) -> str:
    """The SQL of ``trends.replicates``."""
    return f"""draw as (select p.metric, r, cast(('0x' || substr(md5('{tag}|' || p.metric || '|' || r || '|' || p.i), 1, 12)) as bigint) % p.n as i from numbered p cross join range(1, {times + 1}) t(r) where p.n >= 3),
  sample as (select d.metric, d.r, q.x, q.y from draw d join numbered q using (metric, i))"""


_SAMPLE_RANKS = "sr as (select metric, r, rank() over (partition by metric, r order by x) + (count(*) over (partition by metric, r, x) - 1) / 2.0 as rx, rank() over (partition by metric, r order by y) + (count(*) over (partition by metric, r, y) - 1) / 2.0 as ry from sample), srho as (select metric, case when stddev_pop(rx) > 0 and stddev_pop(ry) > 0 then corr(rx, ry) end as v from sr group by metric, r)"
_CI = "select metric, case when count(v) >= 10 then quantile_cont(v, 0.025) end as lo, case when count(v) >= 10 then quantile_cont(v, 0.975) end as hi from {t} group by metric"
#: Kendall's tau of every group of ``{t}`` by ``{by}``, from counts of distinct points.
_TAU = """{t}_d as (select {by}, x, y, count(*) as c from {t} group by all), {t}_p as (select {aby}, sum(case when (b.x - a.x) * (b.y - a.y) > 0 then a.c * b.c end) as cc, sum(case when (b.x - a.x) * (b.y - a.y) < 0 then a.c * b.c end) as dd, sum(case when b.x = a.x then a.c * b.c end) as tx, sum(case when b.y = a.y then a.c * b.c end) as ty
    from {t}_d a join {t}_d b on {on} and (a.x < b.x or a.x = b.x and a.y < b.y) group by all),
  {t}_s as (select {by}, sum(c * (c - 1) / 2) as same, sum(c) as n from {t}_d group by all),
  {t}_tau as (select {by}, n, (coalesce(cc, 0) - coalesce(dd, 0)) / nullif(sqrt(cast(coalesce(cc, 0) + coalesce(dd, 0) + coalesce(tx, 0) + same as double) * (coalesce(cc, 0) + coalesce(dd, 0) + coalesce(ty, 0) + same)), 0) as tau from {t}_s left join {t}_p using ({by}))"""
_TAU_SAMPLE = _TAU.format(t="sample", by="metric, r", aby="a.metric, a.r", on="a.metric = b.metric and a.r = b.r")
_TAU_OWN = _TAU.format(t="trend_of", by="metric", aby="a.metric", on="a.metric = b.metric")
_OWN = "own as (select metric, count(*) as n, case when count(*) >= 2 and stddev_pop(rx) > 0 and stddev_pop(ry) > 0 then corr(rx, ry) end as rho from (select metric, rank() over (partition by metric order by x) + (count(*) over (partition by metric, x) - 1) / 2.0 as rx, rank() over (partition by metric order by y) + (count(*) over (partition by metric, y) - 1) / 2.0 as ry from trend_of) group by metric)"
#: Two-sided p of rho by the normal tail: 1 less the error function as a series of positive terms.
_P = "case when n >= 3 and rho is not null then case when abs(rho) >= 1 or z > 6 then 0.0 else greatest(0.0, least(1.0, 1 - 2 / sqrt(pi()) * exp(-z * z) * list_sum(list_transform(range(0, 151), lambda k: z * coalesce(list_product(list_transform(range(1, k + 1), lambda j: 2 * z * z / (2 * j + 1))), 1))))) end end"
_WITH_Z = "withz as (select *, abs(rho) * sqrt((n - 2) / greatest(1e-12, 1 - rho * rho)) / sqrt(2) as z from own)"


@query(with_views(*_TRENDS, _OWN, _WITH_Z, _TAU_OWN, _resampled("rho"), _SAMPLE_RANKS, f"ci as ({_CI.format(t='srho')})") + f"select metric, w.n, round(rho, 6) as rho, round({_P.replace('n >= 3', 'w.n >= 3')}, 6) as p_rho, round(tau, 6) as tau, round(lo, 6) as rho_ci_lo, round(hi, 6) as rho_ci_hi from withz w join trend_of_tau t using (metric) left join ci using (metric)")
def trend_bundle(spark, d):
    """Per metric over the books' years: rho with its p and interval, and tau."""
    s = T.rho_trends(_metric_trends(spark, d), "metric").withColumn("p_rho", T.rho_p(F.col("rho"), F.col("n")))
    return s.select("metric", "n", *[F.round(c, 6).alias(c) for c in ("rho", "p_rho", "tau", "rho_ci_lo", "rho_ci_hi")])


@query(with_views(*_TRENDS, _resampled("tau_ci"), _TAU_SAMPLE, "taus as (select metric, tau as v from sample_tau)", f"ci as ({_CI.format(t='taus')})") + "select metric, round(lo, 6) as tau_ci_lo, round(hi, 6) as tau_ci_hi from ci")
def bootstrap_ci(spark, d):
    """The interval of tau by resampling; that of rho is in the bundle."""
    return T.tau_interval(_metric_trends(spark, d), "metric").select("metric", F.round("tau_ci_lo", 6).alias("tau_ci_lo"), F.round("tau_ci_hi", 6).alias("tau_ci_hi"))


_SHUFFLED = f"""moved as (select p.metric, r, p.y, row_number() over (partition by p.metric, r order by cast(('0x' || substr(md5('tau_p|' || p.metric || '|' || r || '|' || p.i), 1, 12)) as bigint), p.i) - 1 as i from numbered p cross join range(1, {T.RESAMPLES + 1}) t(r) where p.n >= 3), sample as (select m.metric, m.r, q.x, m.y from moved m join numbered q using (metric, i))"""


@query(with_views(*_TRENDS, _SHUFFLED, _TAU_SAMPLE, _TAU_OWN) + f"select o.metric, case when o.n >= 3 and o.tau is not null then (1 + count(*) filter (round(abs(s.tau), 12) >= round(abs(o.tau), 12))) / {T.RESAMPLES + 1}.0 end as p_tau from trend_of_tau o left join sample_tau s using (metric) group by o.metric, o.n, o.tau")
def perm_p(spark, d):
    """The p of tau by shuffling."""
    return T.tau_permutation_p(_metric_trends(spark, d), "metric")


def _irls_sql(method: str, rounds: int = 20) -> str:
    """Unrolled rounds of reweighted least squares over ``trend_of``: the slope of the last one."""
    weight = "least(1.0, 1.345 / greatest(u, 1e-300))" if method == "huber" else "case when u < 4.685 then (1 - (u / 4.685) ** 2) ** 2 else 0.0 end"
    m = method[0]
    parts = [f"{m}w0 as materialized (select metric, x, y, 1.0::double as w from trend_of where metric in (select metric from trend_of group by metric having count(*) >= 2))"]
    for k in range(rounds):
        parts.append(f"{m}m{k} as materialized (select metric, sum(w) as sw, sum(w * x) / sum(w) as mx, sum(w * y) / sum(w) as my from {m}w{k} group by metric)")
        parts.append(f"{m}s{k} as materialized (select metric, any_value(mx) as mx, any_value(my) as my, coalesce(sum(w * (x - mx) * (y - my)) / nullif(sum(w * (x - mx) ** 2), 0), 0) as slope from {m}w{k} join {m}m{k} using (metric) group by metric)")
        if k < rounds - 1:
            parts.append(f"{m}r{k} as materialized (select metric, x, y, y - my - slope * (x - mx) as o from {m}w{k} join {m}s{k} using (metric))")
            parts.append(f"{m}c{k} as materialized (select metric, 1.4826 * median(abs(o - mo)) as mad, any_value(sd) as sd from {m}r{k} join (select metric, median(o) as mo, stddev_pop(o) as sd from {m}r{k} group by metric) using (metric) group by metric)")
            parts.append(f"{m}w{k + 1} as materialized (select metric, x, y, {weight} as w from (select metric, x, y, abs(o) / case when mad > 1e-12 then mad when sd > 0 then sd else 1.0 end as u from {m}r{k} join {m}c{k} using (metric)))")
    return ", ".join(parts)


@query(with_views(*_TRENDS, _irls_sql("huber"), _irls_sql("bisquare")) + "select metric, round(h.slope, 7) as huber, round(b.slope, 7) as bisquare from hs19 h join bs19 b using (metric)")
def robust_irls(spark, d):
    return T.robust_slopes(_metric_trends(spark, d), "metric").select("metric", F.round("huber", 7).alias("huber"), F.round("bisquare", 7).alias("bisquare"))


@query()
def trend_seeded(spark, d):
    """The same statistics with the draws of a seeded generator, over series of as many points as there are books in ``glyphs``."""
    s = V.glyphs(spark, d).groupBy("ch", "book").agg(F.round(F.avg("w"), 1).alias("y")).withColumnRenamed("book", "x")
    return T.seeded_trends(s, "ch")


# ---- scalar metrics of books ----

_SCALARS = """lb as (select book, ceil(quantile_disc(greatest(w, h), 0.9) * 1.05) as lb from instances where w > 0 and h > 0 group by book), clip as (select i.book, any_value(lb) as lb, count(*) filter (w > lb.lb or h > lb.lb) / count(*) as rate from instances i join lb on i.book = lb.book where w > 0 and h > 0 group by i.book),
  trend_of as (select metric, x, y from (select unnest(['lb', 'rate']) as metric, year as x, unnest([lb, round(rate, 9)]) as y from clip join books using (book) where year is not null))"""


@query(with_views(V.INSTANCES, V.BOOKS, _SCALARS, _OWN, _WITH_Z, _TAU_OWN) + f"select metric, w.n, round(rho, 6) as rho, round({_P.replace('n >= 3', 'w.n >= 3')}, 6) as p_rho, round(tau, 6) as tau from withz w join trend_of_tau using (metric)")
def scalar_trends(spark, d):
    """Trends of the books' fixed box and clipping rate over their years."""
    i = V.instances(spark, d).where("w > 0 and h > 0").select("book", "w", "h")
    lb = quantiles(i.withColumn("side", F.greatest("w", "h")), ["book"], "side", (0.9,), nearest=True).select("book", F.ceil(F.col("q")[0] * 1.05).cast("double").alias("lb"))
    clip = i.join(lb, "book").groupBy("book", "lb").agg(F.round(F.count_if((F.col("w") > F.col("lb")) | (F.col("h") > F.col("lb"))) / F.count(F.lit(1)), 9).alias("rate"))
    by_year = clip.join(V.books(spark, d).where("year is not null").select("book", F.col("year").alias("x")), "book")
    s = materialise(by_year.unpivot(["x"], ["lb", "rate"], "metric", "y").select("metric", "x", "y"))
    tau = T.pair_counts(s, ["metric"]).select("metric", F.round(T.tau_of_counts(True), 6).alias("tau"))
    rho = T.spearman(s, ["metric"]).withColumn("p", T.rho_p(F.col("rho"), F.col("n")))
    return rho.join(tau, "metric").select("metric", "n", F.round("rho", 6).alias("rho"), F.round("p", 6).alias("p_rho"), "tau")


#: Resamples of a trend within a group of books.
GROUP_RESAMPLES = 300

_GROUPED = f"""stat as (select book, round(avg(aspect_ratio) + 1e-12, 6) as mu from char_means group by book), trend_of as (select region as metric, row_number() over (partition by region order by year nulls last, book) as x, mu as y from stat join books using (book)),
  numbered as (select *, row_number() over (partition by metric order by x, y) - 1 as i, count(*) over (partition by metric) as n from trend_of), {_resampled('group', GROUP_RESAMPLES)}, {_SAMPLE_RANKS}, ci as ({_CI.format(t='srho')})"""


@query(with_views(V.ENTRIES, CHAR_MEANS, V.BOOKS, _GROUPED, _OWN) + "select metric as region, o.n, round(rho, 6) as rho, round(lo, 6) as lo, round(hi, 6) as hi from own o left join ci using (metric)")
def group_index_trend(spark, d):
    """Within every region the trend of the books' means over their places by year, with an interval of 300 resamples."""
    means = _char_means(spark, d).groupBy("book").agg(F.round(F.avg("aspect_ratio") + 1e-12, 6).alias("y"))
    own = means.join(V.books(spark, d).select("book", "region", "year"), "book")
    placed = numbered(own, ["region"], [F.col("year").asc_nulls_last(), F.col("book").asc()], "x").select("region", "x", "y")
    s = T.rho_trends(placed, "region", "group", GROUP_RESAMPLES)
    return s.select("region", "n", F.round("rho", 6).alias("rho"), F.round("rho_ci_lo", 6).alias("lo"), F.round("rho_ci_hi", 6).alias("hi"))
