"""Densities on grids, aggregations over samples, rasters, and consensus estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..fixtures import LOCS_SQL, SAMPLES_SQL, TRACE_SQL

from ..operators import consensus as H

from ..operators import neighbors as N
from ..operators import samples as SA
from ..operators import scoring as S
from ..operators.consensus import SAMPLE
from ..registry import query
from .clusters import SIZES, nb, sizes, stats
from .joins import CONT_SQL, PIECES_SQL
from .joins import pieces as cut
from .prep import EMITTERS_SQL, W, r, source_emitters

SM = f"with {LOCS_SQL}, {SAMPLES_SQL}"
TR = f"with {LOCS_SQL}, {TRACE_SQL}"


def L(c):
    return F.col(c).cast("long").alias(c)


_GRID = f"""{LOCS_SQL}, gb as (select pair, max(greatest(sigma_x,sigma_y)) as sm, count(*) as t, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from locs group by pair),
gc as (select pair, sm/2e0 as h, t, x0-3*sm as x0, y0-3*sm as y0, ceil((x1+3*sm-(x0-3*sm))/(sm/2e0))::bigint as nx, ceil((y1+3*sm-(y0-3*sm))/(sm/2e0))::bigint as ny from gb),
cell as (select *, unnest(range(0, ny+1)) as iy from (select *, unnest(range(0, nx+1)) as ix from gc)),
gr as (select c.pair, ix, iy, any_value(c.x0) as x0, any_value(c.y0) as y0, any_value(h) as h, ln(sum(exp(-ln(2*pi()) - 0.5*ln(sigma_x*sigma_x*sigma_y*sigma_y) - 0.5*(pow(c.x0+ix*h-l.x,2)/(sigma_x*sigma_x)+pow(c.y0+iy*h-l.y,2)/(sigma_y*sigma_y))))) - ln(any_value(t)) as logg
 from cell c join locs l on c.pair=l.pair group by all)"""
_BILIN = """bl as (select s.track_id, s.pair, s.x, s.y, s.n, s.lx, s.ly, s.ex, s.ey, s.quad, s.ld, b.x0, b.y0, b.h, least(greatest((s.x-b.x0)/b.h,0),mx) as ux, least(greatest((s.y-b.y0)/b.h,0),my) as uy, mx, my
 from (select *, ex/lx as x, ey/ly as y from st) s join (select pair, any_value(x0) as x0, any_value(y0) as y0, any_value(h) as h, max(ix) as mx, max(iy) as my from gr group by pair) b using (pair)),
bi as (select *, least(floor(ux)::bigint, mx-1) as i0, least(floor(uy)::bigint, my-1) as j0 from bl),
lk as (select b.*, g0.logg*(1-(ux-i0))*(1-(uy-j0)) + g1.logg*(ux-i0)*(1-(uy-j0)) + g2.logg*(1-(ux-i0))*(uy-j0) + g3.logg*(ux-i0)*(uy-j0) as logg from bi b
 join gr g0 on g0.pair=b.pair and g0.ix=i0 and g0.iy=j0 join gr g1 on g1.pair=b.pair and g1.ix=i0+1 and g1.iy=j0 join gr g2 on g2.pair=b.pair and g2.ix=i0 and g2.iy=j0+1 join gr g3 on g3.pair=b.pair and g3.ix=i0+1 and g3.iy=j0+1)"""
_ST = EMITTERS_SQL[len(LOCS_SQL) + 2 :]  # the statistics, after the fixture's rows


def _rows(spark, d):
    return fx.locs(spark, d).select("pair", "x", "y", "sigma_x", "sigma_y", "sigma_xy")


@query("f10_locmix_grid", f"with {_GRID} select pair, ix, iy, round(logg,6) as logg from gr where logg > -600")
def f10(spark, d):
    return S.locmix_grid(_rows(spark, d), ["pair"]).filter("logg > -600").select("pair", L("ix"), L("iy"), r("logg", 6).alias("logg"))


def _looked_up(spark, d):
    return S.locmix_score(stats(spark, d), _rows(spark, d), ["pair"], ["track_id"])


@query("f11_bilinear_lookup", f"with {_GRID}, {_ST}, {_BILIN} select track_id, round(logg,5) as logg from lk")
def f11(spark, d):
    return _looked_up(spark, d).select("track_id", r("logg", 5).alias("logg"))


@query("f12_locmix_score", f"with {_GRID}, {_ST}, {_BILIN} select track_id, round((1-n)*ln(2*pi()) - 0.5*ld - 0.5*(quad - ex*ex/lx - ey*ey/ly) - 0.5*ln(lx*ly) + logg,4) as score from lk")
def f12(spark, d):
    return _looked_up(spark, d).select("track_id", r("score", 4).alias("score"))


def _map(spark, d):
    return N.settle(S.intensity_map(source_emitters(spark, d), 0.1), "map")


@query("f13_intensity_map")
def f13(spark, d):
    return _map(spark, d).select("ix", "iy", r("logg", 6).alias("logg"))


@query("f14_intensity_integral", f"with {EMITTERS_SQL} select round((max(x)-min(x))*(max(y)-min(y)),6) as integral from em")
def f14(spark, d):
    return S.intensity_integral(S.constant_map(_map(spark, d))).select(r("integral", 6).alias("integral"))


@query("f15_intensity_normalize", f"with {EMITTERS_SQL} select round((max(x)-min(x))*(max(y)-min(y)),6) as integral from em")
def f15(spark, d):
    return S.intensity_integral(S.intensity_normalize(_map(spark, d))).select(r("integral", 6).alias("integral"))


@query("f16_intensity_score")
def f16(spark, d):
    from ..operators.clusters import log_ml, posterior, stats_columns

    p = S.bilinear(posterior(stats(spark, d)), _map(spark, d), [], ["track_id"])
    return p.select("track_id", r(log_ml(*stats_columns()) + F.col("logg"), 4).alias("score"))


@query("f17_k_posterior_weights", f"{TR}, s as (select partition_id, k, -0.5e0*(k-3)*(k-3) + lgamma(k+1) as s from (select distinct partition_id, k from trace)), e as (select *, exp(s - max(s) over (partition by partition_id)) as e from s) select partition_id, k, round(e/sum(e) over (partition by partition_id),9) as weight from e")
def f17(spark, d):
    t = fx.trace(spark, d).select("partition_id", "k").distinct().withColumn("score", -0.5 * (F.col("k") - 3) * (F.col("k") - 3))
    return S.k_posterior(t, ["partition_id"]).select("partition_id", L("k"), r("weight").alias("weight"))


@query("f18_rho_posterior", f"{SIZES} select 1e0+sum(k) as shape, round(0.5e0+sum(0.09e0),9) as rate from tot")
def f18(spark, d):
    t = sizes(spark, d).groupBy("pair").agg(F.count("*").alias("k")).withColumn("area", F.lit(0.09))
    return S.rho_posterior(t, 1.0, 0.5).withColumn("rate", r("rate"))


@query("f19_count_loglik_curve", f"""{SIZES}, g as (select unnest(range(50,81,5))::double as value), l as (select value, sum({nb('n', '2e0', 'value')}) + ln(value) - 0.1e0*value as lp from sz, g group by value), m as (select max(lp) as m from l)
 select value, round(lp,5) as log_post, round(exp(lp-m)/sum(exp(lp-m)) over (),8) as weight from l, m""")
def f19(spark, d):
    c = S.count_curve(sizes(spark, d), [float(v) for v in range(50, 81, 5)], "mu", 2.0)
    return c.select("value", r("log_post", 5).alias("log_post"), r("weight", 8).alias("weight"))


@query("g1_emitter_count_hist", f"{TR} select partition_id, k, count(*) as n from trace group by all")
def g1(spark, d):
    # the trace's k as clusters of as many single rows
    t = fx.trace(spark, d).withColumn("cluster", F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))))
    return SA.emitter_count_hist(t).select("partition_id", L("k"), "n")


CORE_SQL = f"""{SAMPLES_SQL}, cw as (select partition_id, iter, cluster, avg(case when loc_id%7=0 then 0e0 else 1e0 end) as w from samples group by all),
kw as (select partition_id, iter, sum(w) as k from cw group by all)"""


def _weighted(spark, d):
    s = fx.samples(spark, d)
    members = fx.locs(spark, d).select(F.col("pair").alias("partition_id"), "loc_id", (F.col("loc_id") % 7 == 0).alias("is_overlap"))
    return SA.core_weighted_k(s, members)


@query("g2_core_weighted_k", f"with {LOCS_SQL}, {CORE_SQL} select partition_id, iter, round(k,9) as k from kw")
def g2(spark, d):
    return _weighted(spark, d).select("partition_id", L("iter"), r("k").alias("k"))


@query("g3_field_k_posterior", f"with {LOCS_SQL}, {CORE_SQL} select k, count(*) as n from (select iter, round_even(round(sum(k),9),0)::bigint as k from kw group by iter) group by k")
def g3(spark, d):
    return SA.field_k_posterior(_weighted(spark, d))


@query("g4_convergence_trace", f"with {LOCS_SQL}, {CORE_SQL} select iter, round_even(round(sum(k),9),0)::bigint as k, 5e0 + iter*0.1e0 as mu from kw where iter%3=0 group by iter")
def g4(spark, d):
    w = _weighted(spark, d)
    hyper = w.filter("iter % 3 = 0").select("iter").distinct().withColumn("mu", F.expr("5e0 + iter*0.1e0"))
    return SA.convergence_trace(w, hyper).select(L("iter"), "k", "mu")


@query("g5_partition_samples", f"{SM} select iter, count(*) as n from samples where iter>2 and (iter-2)%5=0 group by iter")
def g5(spark, d):
    return SA.thin(fx.samples(spark, d), 2, 5).groupBy(L("iter")).agg(F.count("*").alias("n"))


PSM_SQL = f"""{SAMPLES_SQL}, psm as (select partition_id, i, j, count(*) as n_together, count(*)/12e0 as p from (select a.partition_id, a.loc_id as i, b.loc_id as j from samples a join samples b on a.partition_id=b.partition_id and a.iter=b.iter and a.cluster=b.cluster and a.loc_id<b.loc_id) group by all)"""


@query("g6_psm", f"with {LOCS_SQL}, {PSM_SQL} select partition_id, i, j, n_together, round(p,9) as p from psm")
def g6(spark, d):
    return SA.psm(fx.samples(spark, d)).select("partition_id", "i", "j", "n_together", r("p").alias("p"))


SE_SQL = f"""{SAMPLES_SQL}, se as (select partition_id, iter, cluster, count(*) as n, sum(x/(sigma_x*sigma_x))/sum(1/(sigma_x*sigma_x)) as x, sum(y/(sigma_y*sigma_y))/sum(1/(sigma_y*sigma_y)) as y, 1/sum(1/(sigma_x*sigma_x)) as vx, 1/sum(1/(sigma_y*sigma_y)) as vy from samples join locs using (loc_id) group by all)"""


@query("g7_nn_dist_hist", f"""with {LOCS_SQL}, {SE_SQL}, d as (select a.partition_id, a.iter, a.cluster, min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))) as d from se a join se b on a.partition_id=b.partition_id and a.iter=b.iter and a.cluster<>b.cluster group by all)
 select floor(d/(0.1e0/100))::bigint as bin, count(*) as n from d where d<0.1e0 group by 1""")
def g7(spark, d):
    return SA.nn_dist_hist(fx.samples(spark, d), fx.locs(spark, d)).select(L("bin"), "n")


def _raster(spark, d, samples):
    return SA.posterior_raster(H.sample_emitters(samples, fx.locs(spark, d)), 0.001)


@query("g8_posterior_raster")
def g8(spark, d):
    return _raster(spark, d, fx.samples(spark, d)).select("ix", "iy", r("mass").alias("mass"))


@query("g8_raster_mass", f"with {LOCS_SQL}, {SE_SQL} select round(count(*)::double,6) as mass from se")
def g8_mass(spark, d):
    return _raster(spark, d, fx.samples(spark, d)).agg(r(F.sum("mass"), 6).alias("mass"))


@query("g9_raster_lattice", f"""{W}, g as (select pair, max(greatest(sigma_x,sigma_y)) as s, min(x) as a, max(x) as b, min(y) as c, max(y) as e from locs group by pair)
 select pair, floor((a-(3*s+0.004e0))/0.004e0)::bigint as ix0, floor((c-(3*s+0.004e0))/0.004e0)::bigint as iy0, floor((b+3*s+0.004e0)/0.004e0)::bigint as ix1, floor((e+3*s+0.004e0)/0.004e0)::bigint as iy1 from g""")
def g9(spark, d):
    return SA.partition_lattice(fx.locs(spark, d), ["pair"], 0.004)


_RAS = "ra as (select floor(x/0.01e0)::bigint as ix, floor(y/0.01e0)::bigint as iy, count(*)::double as mass from locs where loc_id%2=0 group by all), rb as (select floor(x/0.01e0)::bigint as ix, floor(y/0.01e0)::bigint as iy, count(*)::double as mass from locs where loc_id%2=1 group by all)"


def _count_raster(df):
    return SA.lattice(df, 0.01).groupBy("ix", "iy").agg(F.count("*").cast("double").alias("mass"))


@query("g10_raster_merge", f"""{W}, {_RAS}, mg as (select ix, iy, sum(mass) as mass from (select * from ra union all select * from rb) group by all), mv as (select floor(((ix+0.5e0)*0.01e0)/0.025e0)::bigint as ix, floor(((iy+0.5e0)*0.01e0)/0.025e0)::bigint as iy, mass from mg)
 select ix, iy, sum(mass) as mass from mv where ix>=0 and iy>=0 and ix<100 and iy<60 group by all""")
def g10(spark, d):
    locs = fx.locs(spark, d)
    m = SA.merge_rasters(_count_raster(locs.filter("loc_id % 2 = 0")), _count_raster(locs.filter("loc_id % 2 = 1")))
    return SA.merge_by_centre(m, 0.01, (0.0, 0.0), 0.025, (0.0, 0.0), (100, 60))


@query("g11_raster_resample", f"""{W}, g as (select floor(x/0.01e0)::bigint as ix, floor(y/0.01e0)::bigint as iy, count(*)::double as mass from locs group by all),
 jx as (select *, unnest(range(floor(ix*0.01e0/0.004e0)::bigint, ceil((ix+1)*0.01e0/0.004e0)::bigint)) as kx from g), jy as (select *, unnest(range(floor(iy*0.01e0/0.004e0)::bigint, ceil((iy+1)*0.01e0/0.004e0)::bigint)) as ky from jx),
 s as (select kx, ky, mass, greatest(0, least((ix+1)*0.01e0,(kx+1)*0.004e0)-greatest(ix*0.01e0,kx*0.004e0))/0.01e0 as sx, greatest(0, least((iy+1)*0.01e0,(ky+1)*0.004e0)-greatest(iy*0.01e0,ky*0.004e0))/0.01e0 as sy from jy)
 select kx as ix, ky as iy, round(sum(mass*sx*sy),6) as mass from s where sx>1e-9 and sy>1e-9 group by all""")
def g11(spark, d):
    return SA.resample(_count_raster(fx.locs(spark, d)), 0.01, 0.004).filter("mass > 1e-6").select("ix", "iy", r("mass", 6).alias("mass"))


@query("g12_raster_percentile_scale", f"""{W}, g as (select floor(x/0.01e0)::bigint as ix, floor(y/0.01e0)::bigint as iy, count(*)::double as mass from locs group by all), o as (select mass, row_number() over (order by mass) as k, count(*) over () as n from g), v as (select mass as v from o where k = greatest(1, round_even(0.99e0*n,0)::bigint))
 select ix, iy, round_even(least(255, mass/v*255),0)::int as level from g, v""")
def g12(spark, d):
    return SA.percentile_scale(_count_raster(fx.locs(spark, d))).select("ix", "iy", "level")


@query("g13_k_trace", f"{SM} select partition_id, iter, count(distinct cluster) as k from samples where iter%2=0 group by all")
def g13(spark, d):
    return SA.k_trace(fx.samples(spark, d), 2).select("partition_id", L("iter"), "k")


@query("h1_map_n", f"""{TR}, h as (select partition_id, k, count(*) as n from trace group by all), sp as (select partition_id, unnest(range(0, max(k)+1)) as k from h group by partition_id),
 d as (select sp.partition_id, sp.k, coalesce(n,0) as n from sp left join h on sp.partition_id=h.partition_id and sp.k=h.k),
 w as (select *, avg(n) over (partition by partition_id order by k rows between 1 preceding and 1 following) as m from d),
 q as (select partition_id, arg_max(k,(n,-k)) as top, max(n) as n1, arg_max(k,(m,-k)) as sm from w group by partition_id),
 s as (select q.*, (select max(n) from w where w.partition_id=q.partition_id and w.k<>q.top) as n2 from q)
 select partition_id, case when coalesce(n2,0)>0 and n1/n2<1.5 then sm else top end as k, case when coalesce(n2,0)=0 then 'Infinity'::double else round(n1/n2,9) end as confidence from s""")
def h1(spark, d):
    h = fx.trace(spark, d).groupBy("partition_id", "k").agg(F.count("*").alias("n"))
    m = H.map_n(h.withColumn("k", F.col("k").cast("int")), ["partition_id"])
    return m.select("partition_id", L("k"), F.when(F.col("confidence") < float("inf"), r("confidence")).otherwise(F.col("confidence")).alias("confidence"))


@query("h2_filter_k", f"{SM}, k as (select partition_id, iter, count(distinct cluster) as k from samples group by all), b as (select partition_id, arg_min(k, (abs(k-3), k)) as k from k group by partition_id) select k.partition_id, k.iter from k join b on k.partition_id=b.partition_id and k.k=b.k")
def h2(spark, d):
    s = fx.samples(spark, d)
    t = s.select("partition_id").distinct().withColumn("k", F.lit(3).cast("long"))
    return H.filter_k(s, t).select("partition_id", L("iter")).distinct()


@query("h3_reference_sample", f"""with {LOCS_SQL}, {SE_SQL}, m as (select partition_id, iter, avg(x) as mx, avg(y) as my from se group by all), c as (select partition_id, avg(x) as cx, avg(y) as cy from se group by all)
 select partition_id, arg_min(iter, (round(pow(mx-cx,2)+pow(my-cy,2),18), iter)) as iter from m join c using (partition_id) group by partition_id""")
def h3(spark, d):
    return H.reference_sample(H.sample_emitters(fx.samples(spark, d), fx.locs(spark, d))).select("partition_id", L("iter"))


@query("h4_median_refine")
def h4(spark, d):
    pos = N.settle(H.sample_emitters(fx.samples(spark, d), fx.locs(spark, d)), "positions")
    m = H.median_refine(pos, N.settle(H.reference_sample(pos), "start"))
    return m.select("partition_id", "slot", r("x", 8).alias("x"), r("y", 8).alias("y"))


def _est(df):
    return df.select(*[c for c in df.columns if c in ("partition_id", "slot", "cluster")], r("x", 8).alias("x"), r("y", 8).alias("y"), r("sigma_x").alias("sigma_x"), r("sigma_y").alias("sigma_y"), "n")


@query("h5_mapn_collapsed")
def h5(spark, d):
    return _est(H.mapn_collapsed(fx.samples(spark, d), fx.locs(spark, d)))


@query("h6_psm_components", f"with {LOCS_SQL} select pair as partition_id, count(distinct track_id) as k from locs group by pair")
def h6(spark, d):
    # most pairs of one source are together in most samples, and few of two are
    return H.psm_components(fx.samples(spark, d), fx.locs(spark, d).select(F.col("pair").alias("partition_id"), "loc_id"))


@query("h7_mapn_psm")
def h7(spark, d):
    members = fx.locs(spark, d).select(F.col("pair").alias("partition_id"), "loc_id")
    k = N.settle(H.psm_components(fx.samples(spark, d), members), "k")
    return _est(H.mapn_collapsed(fx.samples(spark, d), fx.locs(spark, d), k))


H8_SQL = f"""{PSM_SQL}, ba as (select partition_id, sum(p*p) as base from psm group by all),
ad as (select a.partition_id, a.iter, sum(1-2*p) as gain from samples a join samples b on a.partition_id=b.partition_id and a.iter=b.iter and a.cluster=b.cluster and a.loc_id<b.loc_id join psm on psm.partition_id=a.partition_id and psm.i=a.loc_id and psm.j=b.loc_id group by all),
dist as (select partition_id, iter, base+gain as distance from ad join ba using (partition_id))"""


@query("h8_association_distance", f"with {LOCS_SQL}, {H8_SQL} select partition_id, iter, round(distance,6) as distance from dist")
def h8(spark, d):
    return H.association_distance(fx.samples(spark, d)).select("partition_id", L("iter"), r("distance", 6).alias("distance"))


# pairs that are together in two samples, from the sizes of their clusters' overlaps
DAHL_SQL = f"""{SAMPLES_SQL}, ov as (select a.partition_id, a.iter, b.iter as other, count(*) as n from samples a join samples b on a.partition_id=b.partition_id and a.loc_id=b.loc_id group by a.partition_id, a.iter, b.iter, a.cluster, b.cluster),
tg as (select partition_id, iter, other, sum(n*(n-1)/2) as m from ov group by all), ba as (select partition_id, sum(m)/144e0 as base from tg group by partition_id),
dist as (select partition_id, iter, any_value(base) + max(case when iter=other then m end) - 2*sum(m)/12e0 as distance from tg join ba using (partition_id) group by partition_id, iter)"""


@query("h9_dahl", f"with {LOCS_SQL}, {DAHL_SQL}, b as (select partition_id, arg_min(iter,(round(distance,7),iter)) as iter from dist group by partition_id) select s.partition_id, s.loc_id, s.cluster from samples s join b on s.partition_id=b.partition_id and s.iter=b.iter")
def h9(spark, d):
    return H.dahl(fx.samples(spark, d)).select("partition_id", "loc_id", "cluster")


@query("h10_cluster_stability", f"""with {LOCS_SQL}, {PSM_SQL}, s1 as (select * from samples where iter=1), pr as (select a.partition_id, a.cluster, coalesce(p,0) as p from s1 a join s1 b on a.partition_id=b.partition_id and a.cluster=b.cluster and a.loc_id<b.loc_id left join psm on psm.partition_id=a.partition_id and psm.i=a.loc_id and psm.j=b.loc_id)
 select c.partition_id, c.cluster, c.n, round(coalesce(s,1),9) as stability from (select partition_id, cluster, count(*) as n from s1 group by all) c left join (select partition_id, cluster, avg(p) as s from pr group by all) q on c.partition_id=q.partition_id and c.cluster=q.cluster""")
def h10(spark, d):
    s = fx.samples(spark, d)
    return H.cluster_stability(s.filter("iter = 1"), samples=s).select("partition_id", "cluster", "n", r("stability").alias("stability"))


@query("h11_mapn_overlap")
def h11(spark, d):
    return _est(H.mapn_overlap(fx.samples(spark, d), fx.locs(spark, d)))


_VI = """ja as (select partition_id, iter, sum(n)::double as t, sum(n*ln(n)) as j from ct group by all), aa as (select partition_id, iter, sum(m*ln(m)) as a from (select partition_id, iter, ref, sum(n)::double as m from ct group by all) group by all), bb as (select partition_id, iter, sum(m*ln(m)) as b from (select partition_id, iter, cluster, sum(n)::double as m from ct group by all) group by all)"""


@query("h12_vi_distance", f"{SM}, {CONT_SQL}, {_VI} select partition_id, iter, round(abs((a+b-2*j)/t),8) as vi from ja join aa using (partition_id, iter) join bb using (partition_id, iter)")
def h12(spark, d):
    s = fx.samples(spark, d)
    v = H.vi_distance(H.contingency(s, s.filter("iter = 1")), SAMPLE)
    return v.select("partition_id", L("iter"), F.abs(r("vi", 8)).alias("vi"))


@query("h13_vi_select", f"""{SM}, ct as (select a.partition_id, a.iter, b.iter as other, a.cluster as ref, b.cluster, count(*) as n from samples a join samples b using (partition_id, loc_id) group by all),
 ja as (select partition_id, iter, other, sum(n)::double as t, sum(n*ln(n)) as j from ct group by all), aa as (select partition_id, iter, other, sum(m*ln(m)) as a from (select partition_id, iter, other, ref, sum(n)::double as m from ct group by all) group by all), bb as (select partition_id, iter, other, sum(m*ln(m)) as b from (select partition_id, iter, other, cluster, sum(n)::double as m from ct group by all) group by all),
 v as (select partition_id, iter, avg((a+b-2*j)/t) as vi from ja join aa using (partition_id, iter, other) join bb using (partition_id, iter, other) group by all)
 select partition_id, arg_min(iter, (round(vi,9), iter)) as iter, round(min(vi),8) as vi from v group by partition_id""")
def h13(spark, d):
    return H.vi_select(fx.samples(spark, d)).select("partition_id", L("iter"), r("vi", 8).alias("vi"))


@query("h14_global_labels", f"with {PIECES_SQL}, nm as (select distinct partition_id, track_id from mem join locs using (loc_id)), nl as (select *, row_number() over (order by partition_id, track_id) as label from nm) select loc_id, label from mem join locs using (loc_id) join nl using (partition_id, track_id)")
def h14(spark, d):
    members = N.settle(N.halo(N.settle(cut(spark, d), "pieces"), 0.006), "halo")
    labels = members.join(fx.locs(spark, d).select("loc_id", F.col("track_id").alias("cluster")), "loc_id").select("partition_id", "loc_id", "cluster")
    return H.global_labels(labels, members)


