"""Cluster statistics and scores."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..fixtures import LOCS_SQL, SAMPLES_SQL
from ..operators import clusters as E
from ..operators import localizations as L
from ..operators import scoring as S
from ..operators.consensus import SAMPLE
from ..registry import query
from .prep import EMITTERS_SQL, W, r, source_emitters

SM = f"with {LOCS_SQL}, {SAMPLES_SQL}"
#: log marginal likelihood of the fixture's clusters (no covariance), without the area.
_ML = "(1-n)*ln(2*pi()) - 0.5*ld - 0.5*(quad - ex*ex/lx - ey*ey/ly) - 0.5*ln(lx*ly)"
AREA = 0.09


def stats(spark, d):
    return E.cluster_stats(fx.locs(spark, d), ["track_id", "pair"])


@query("e1_cluster_stats", f"with {EMITTERS_SQL} select track_id, n, round(lx,2) as l_xx, round(ly,2) as l_yy, round(ex,2) as e_x, round(ey,2) as e_y, round(quad,1) as quad, round(ld,6) as log_det from st")
def e1(spark, d):
    s = stats(spark, d)
    return s.select("track_id", "n", r("l_xx", 2).alias("l_xx"), r("l_yy", 2).alias("l_yy"), r("e_x", 2).alias("e_x"), r("e_y", 2).alias("e_y"), r("quad", 1).alias("quad"), r("log_det", 6).alias("log_det"))


@query("e2_remove_rows", f"{W} select track_id, count(*) as n, round(sum(1/(sigma_x*sigma_x)),2) as l_xx, round(sum(x/(sigma_x*sigma_x)),2) as e_x from locs where loc_id%3<>0 group by track_id")
def e2(spark, d):
    locs = fx.locs(spark, d)
    rest = E.remove_rows(E.cluster_stats(locs, ["track_id"]), E.cluster_stats(locs.filter("loc_id % 3 = 0"), ["track_id"]), ["track_id"])
    return rest.filter("n > 0").select("track_id", "n", r("l_xx", 2).alias("l_xx"), r("e_x", 2).alias("e_x"))


@query("e3_posterior_mean_cov", f"with {EMITTERS_SQL} select emitter_id as track_id, round(x,8) as x, round(y,8) as y, round(sigma_x*sigma_x,12) as v_xx, round(sigma_y*sigma_y,12) as v_yy from em")
def e3(spark, d):
    p = E.posterior(stats(spark, d))
    return p.select("track_id", r("x", 8).alias("x"), r("y", 8).alias("y"), r("v_xx", 12).alias("v_xx"), r("v_yy", 12).alias("v_yy"))


@query("e4_emitters_from_labels", f"with {EMITTERS_SQL} select emitter_id, partition_id, round(x,8) as x, round(y,8) as y, round(sigma_x,9) as sigma_x, round(sigma_y,9) as sigma_y, n from em")
def e4(spark, d):
    return source_emitters(spark, d).select("emitter_id", "partition_id", r("x", 8).alias("x"), r("y", 8).alias("y"), r("sigma_x").alias("sigma_x"), r("sigma_y").alias("sigma_y"), "n")


@query("e5_emitters_3d", f"""{W}, c as (select track_id, x, y, (loc_id%100)*0.01e0 as z, sigma_x as sx, sigma_y as sy, 0.02e0 as sz, 0.2e0*sigma_x*sigma_y as xy, 0.1e0*sigma_x*0.02e0 as xz, -0.1e0*sigma_y*0.02e0 as yz from locs),
 i as (select *, sx*sx*(sy*sy*sz*sz-yz*yz)-xy*(xy*sz*sz-yz*xz)+xz*(xy*yz-sy*sy*xz) as det from c),
 m as (select track_id, x, y, z, (sy*sy*sz*sz-yz*yz)/det as a, (xz*yz-xy*sz*sz)/det as b, (xy*yz-xz*sy*sy)/det as c, (sx*sx*sz*sz-xz*xz)/det as d, (xy*xz-sx*sx*yz)/det as e, (sx*sx*sy*sy-xy*xy)/det as f from i),
 s as (select track_id, count(*) as n, sum(a) as a, sum(b) as b, sum(c) as c, sum(d) as d, sum(e) as e, sum(f) as f, sum(a*x+b*y+c*z) as p, sum(b*x+d*y+e*z) as q, sum(c*x+e*y+f*z) as r from m group by track_id),
 t as (select *, a*(d*f-e*e)-b*(b*f-e*c)+c*(b*e-d*c) as det from s)
 select track_id, n, round(((d*f-e*e)*p+(c*e-b*f)*q+(b*e-c*d)*r)/det,7) as x, round(((c*e-b*f)*p+(a*f-c*c)*q+(b*c-a*e)*r)/det,7) as y, round(((b*e-c*d)*p+(b*c-a*e)*q+(a*d-b*b)*r)/det,7) as z, round(sqrt((d*f-e*e)/det),8) as sigma_x, round(sqrt((a*d-b*b)/det),8) as sigma_z from t""")
def e5(spark, d):
    rows = fx.locs(spark, d).selectExpr("track_id", "x", "y", "(loc_id%100)*0.01e0 as z", "sigma_x", "sigma_y", "0.02e0 as sigma_z", "0.2e0*sigma_x*sigma_y as sigma_xy", "0.1e0*sigma_x*0.02e0 as sigma_xz", "-0.1e0*sigma_y*0.02e0 as sigma_yz")
    e = E.emitters_3d(rows, ["track_id"])
    return e.select("track_id", "n", r("x", 7).alias("x"), r("y", 7).alias("y"), r("z", 7).alias("z"), r("sigma_x", 8).alias("sigma_x"), r("sigma_z", 8).alias("sigma_z"))


@query("e6_log_ml", f"with {EMITTERS_SQL} select track_id, round({_ML},5) as log_ml, round({_ML}-ln({AREA}e0),5) as with_area from st")
def e6(spark, d):
    c = E.stats_columns()
    return stats(spark, d).select("track_id", r(E.log_ml(*c), 5).alias("log_ml"), r(E.log_ml(*c, F.lit(math.log(AREA))), 5).alias("with_area"))


@query("e7_log_predictive", f"""with {EMITTERS_SQL}, p as (select s.track_id, l.loc_id, {_ML} as before, s.n+1 as n, lx+1/(sigma_x*sigma_x) as lx, ly+1/(sigma_y*sigma_y) as ly, ex+x/(sigma_x*sigma_x) as ex, ey+y/(sigma_y*sigma_y) as ey,
  quad+x*x/(sigma_x*sigma_x)+y*y/(sigma_y*sigma_y) as quad, ld+ln(sigma_x*sigma_x*sigma_y*sigma_y) as ld from st s join locs l on s.pair=l.pair)
 select track_id, loc_id, round({_ML}-before,4) as gain from p""")
def e7(spark, d):
    g = E.log_predictive(stats(spark, d), fx.locs(spark, d).select("pair", "loc_id", "x", "y", "sigma_x", "sigma_y", "sigma_xy"), ["pair"], F.lit(math.log(AREA)))
    return g.select("track_id", "loc_id", r("gain", 4).alias("gain"))


@query("e8_multicue_stats", f"""with {EMITTERS_SQL}, q as (select track_id, sum(1/(sigma_x*sigma_x*1e6)) as l, sum(photons/(sigma_x*sigma_x*1e6)) as e, sum(photons*photons/(sigma_x*sigma_x*1e6)) as qq, sum(2*ln(sigma_x*1e3)) as ld1 from locs group by track_id)
 select track_id, n, round(x0,8) as x, round(e/l,6) as cue, round(1/l,8) as cue_var, round({_ML} + (1-n)*0.5*ln(2*pi()) - 0.5*ld1 - 0.5*(qq-e*e/l) - 0.5*ln(l),3) as score from (select *, ex/lx as x0 from st) join q using (track_id)""")
def e8(spark, d):
    m = E.multicue(fx.locs(spark, d).withColumn("sq", F.col("sigma_x") * 1e3), ["track_id"], "photons", "sq")
    return m.select("track_id", "n", r("x", 8).alias("x"), r("cue", 6).alias("cue"), r("cue_var", 8).alias("cue_var"), r("score", 3).alias("score"))


_MOTION = f"""with {EMITTERS_SQL}, dl as (select l.*, (frame-(a+b)/2e0)/greatest(b-a,1) as delta, 1/(sigma_x*sigma_x) as wx, 1/(sigma_y*sigma_y) as wy from locs l, (select min(frame) as a, max(frame) as b from locs)),
 mo as (select track_id, sum(delta*wx) as bx, sum(delta*delta*wx) as cx, sum(delta*wx*x) as dx, sum(delta*wy) as byy, sum(delta*delta*wy) as cy, sum(delta*wy*y) as dy from dl group by track_id),
 mp as (select *, cx+1e4-bx*bx/lx as sx, cy+1e4-byy*byy/ly as sy, dx-bx*ex/lx as rx, dy-byy*ey/ly as ry from st join mo using (track_id))"""


def _motion(spark, d):
    return E.motion_stats(L.motion_delta(fx.locs(spark, d)), ["track_id"])


@query("e9_motion_stats", f"{_MOTION} select track_id, round(bx,2) as b_xx, round(cx,2) as c_xx, round(dx,2) as d_x, round(byy,2) as b_yy, round(cy,2) as c_yy, round(dy,2) as d_y from mp")
def e9(spark, d):
    return _motion(spark, d).select("track_id", *[r(c, 2).alias(c) for c in ("b_xx", "c_xx", "d_x", "b_yy", "c_yy", "d_y")])


@query("e10_motion_log_ml", f"{_MOTION} select track_id, round({_ML} + 0.5*(rx*rx/sx+ry*ry/sy) - 0.5*ln(sx*sy) + 0.5*ln(1e8),4) as motion_score from mp")
def e10(spark, d):
    return E.motion_posterior(_motion(spark, d), 0.01).select("track_id", r("motion_score", 4).alias("motion_score"))


@query("e11_motion_posterior", f"{_MOTION} select track_id, round(rx/sx,7) as v_x, round(ry/sy,7) as v_y, round((ex-bx*rx/sx)/lx,7) as x, round((ey-byy*ry/sy)/ly,7) as y, round(1/sx,10) as drift_xx from mp")
def e11(spark, d):
    return E.motion_posterior(_motion(spark, d), 0.01).select("track_id", *[r(c, 7).alias(c) for c in ("v_x", "v_y", "x", "y")], r("drift_xx", 10).alias("drift_xx"))


@query("e12_motion_summary", f"{_MOTION} select count(*) as n, round(avg(rx/sx),7) as mean_x, round(stddev_samp(rx/sx),7) as std_x, round(avg(ry/sy),7) as mean_y, round(stddev_samp(ry/sy),7) as std_y from mp")
def e12(spark, d):
    s = E.motion_summary(E.motion_posterior(_motion(spark, d), 0.01))
    return s.select("n", *[r(c, 7).alias(c) for c in s.columns[1:]])


@query("e13_group_loglik_bic", f"""with {EMITTERS_SQL}, l as (select -ln(2*pi()) - 0.5*ln(l.sigma_x*l.sigma_x*l.sigma_y*l.sigma_y) - 0.5*((l.x-e.x)*(l.x-e.x)/(l.sigma_x*l.sigma_x)+(l.y-e.y)*(l.y-e.y)/(l.sigma_y*l.sigma_y)) as ll, l.track_id from locs l join em e on l.track_id=e.emitter_id)
 select round(sum(ll),3) as loglik, count(distinct track_id) as k, count(*) as n, round(-2*sum(ll)+2*count(distinct track_id)*ln(count(*)),3) as bic from l""")
def e13(spark, d):
    g = E.group_bic(fx.locs(spark, d), "track_id")
    return g.select(r("loglik", 3).alias("loglik"), "k", "n", r("bic", 3).alias("bic"))


@query("e14_count_summary", f"{SM} select partition_id, iter, cluster, count(*) as n from samples group by all having not bool_or(loc_id%97=0)")
def e14(spark, d):
    s = fx.samples(spark, d).withColumn("is_overlap", F.col("loc_id") % 97 == 0)
    return E.count_summary(s, SAMPLE + ["cluster"]).select("partition_id", F.col("iter").cast("long").alias("iter"), "cluster", "n")


@query("e15_initial_shape", f"{W}, c as (select count(*) as n from locs group by track_id) select round(case when count(*)<5 then 2 when stddev_samp(n)=0 then 20 else least(20,greatest(0.5,pow(avg(n)/stddev_samp(n),2))) end,6) as shape from c")
def e15(spark, d):
    return E.initial_shape(fx.locs(spark, d).groupBy("track_id").agg(F.count("*").alias("n"))).select(r("shape", 6).alias("shape"))


@query("e16_acceptance_rates", f"{W} select 'move'||(loc_id%3)::varchar as move, sum(loc_id%2)::bigint as accepted, count(*) as total, round(sum(loc_id%2)/count(*),9) as rate from locs group by 1")
def e16(spark, d):
    m = fx.locs(spark, d).select(F.concat(F.lit("move"), (F.col("loc_id") % 3).cast("string")).alias("move"), (F.col("loc_id") % 2).alias("accepted"), F.lit(1).cast("long").alias("total"))
    return E.acceptance(m).withColumn("rate", r("rate"))


@query("e17_mad_sigma", f"{W}, m as (select track_id, median(x) as m, count(*) as n from locs group by track_id) select track_id, round(case when any_value(n)<2 then 0 else 1.4826*median(abs(x-m)) end,9) as mad from locs join m using (track_id) group by track_id")
def e17(spark, d):
    return E.mad_sigma(fx.locs(spark, d), ["track_id"], "x").withColumn("mad", r("mad"))


_NB = "lgamma({n}+{r})-lgamma({r})-lgamma({n}+1)+{r}*ln({r}/({r}+{m}))+{n}*ln({m}/({r}+{m}))"


def nb(n, r_, m):
    return _NB.format(n=n, r=r_, m=m)


SIZES = f"{W}, sz as (select pair, track_id, count(*)::double as n from locs group by all), tot as (select pair, sum(n) as n, count(*)::double as k from sz group by pair)"


def sizes(spark, d):
    return fx.locs(spark, d).groupBy("pair", "track_id").agg(F.count("*").alias("n"))


@query("f1_negbin_logpmf", f"{SIZES} select track_id, round({nb('n', '2e0', '60e0')},7) as lp from sz")
def f1(spark, d):
    return sizes(spark, d).select("track_id", r(S.negbin(F.col("n").cast("double"), F.lit(2.0), F.lit(60.0)), 7).alias("lp"))


@query("f2_count_posterior", f"{SIZES} select pair, kk as k, round({nb('n', '(2e0*kk)', '(60e0*kk)')},6) as lp from tot, (select unnest(range(1,6)) as kk)")
def f2(spark, d):
    t = sizes(spark, d).groupBy("pair").agg(F.sum("n").cast("double").alias("n")).select("pair", "n", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k"))
    return t.select("pair", F.col("k").cast("long").alias("k"), r(S.count_posterior(F.col("n"), F.col("k").cast("double"), 2.0, 60.0), 6).alias("lp"))


@query("f3_count_map_k", f"""{SIZES}, c as (select pair, n, unnest(range(1, greatest(10, ceil(3*n/20e0))::bigint+1)) as kk from tot)
 select pair, n::bigint as n, arg_max(kk, (round({nb('n', '(2e0*kk)', '(20e0*kk)')},9), -kk)) as k from c group by all""")
def f3(spark, d):
    t = sizes(spark, d).groupBy("pair").agg(F.sum("n").alias("n"))
    return S.count_map_k(t, ["pair"], 2.0, 20.0).select("pair", "n", F.col("k").cast("long").alias("k"))


@query("f4_poisson_k_prior", f"{SIZES} select pair, round(-3e0*0.09e0 + k*(ln(3e0)+ln(0.09e0)) - lgamma(k+1),9) as lp from tot")
def f4(spark, d):
    t = sizes(spark, d).groupBy("pair").agg(F.count("*").cast("double").alias("k"))
    return t.select("pair", r(S.poisson_k(F.col("k"), F.lit(3.0), F.lit(AREA))).alias("lp"))


@query("f5_dm_partition", f"{SIZES} select pair, count(*) as k, sum(n)::bigint as n, round(lgamma(count(*)*1.5e0)-count(*)*lgamma(1.5e0)-lgamma(sum(n)+count(*)*1.5e0)+sum(lgamma(n+1.5e0)),6) as log_mass from sz group by pair")
def f5(spark, d):
    return S.dm_partition(sizes(spark, d), ["pair"], 1.5).withColumn("log_mass", r("log_mass", 6))


@query("f6_categorical_alloc", f"{SIZES} select pair, round(-n*ln(k),7) as lp from tot")
def f6(spark, d):
    t = sizes(spark, d).groupBy("pair").agg(F.sum("n").cast("double").alias("n"), F.count("*").cast("double").alias("k"))
    return t.select("pair", F.abs(r(S.categorical(F.col("n"), F.col("k")), 7)).alias("lp")).select("pair", (-F.col("lp")).alias("lp"))


@query("f7_product_nb_counts", f"{SIZES} select pair, count(*) as k, sum(n)::bigint as n, round(sum({nb('n', '2e0', '60e0')}),6) as counts, round(sum(lgamma(n+1))-lgamma(sum(n)+1),6) as assignment from sz group by pair")
def f7(spark, d):
    p = S.product_counts(sizes(spark, d), ["pair"], 2.0, 60.0)
    return p.select("pair", "k", "n", r("counts", 6).alias("counts"), r("assignment", 6).alias("assignment"))


_TARGET = {
    "Decoupled": "ml + cp + pk", "DecoupledLocmix": "mll + cp", "DMFlat": "ml + cp + dm + pk", "DMLocmix": "mll + cp + dm", "DirectNegBinFlat": "ml + nbs + f - lgamma(n+1) + pk",
    "DirectNegBinLocmix": "mll + nbs + f - lgamma(n+1)", "IPP": "ml + cp + dm + pk", "FazelFlat": "ml + cp - n*ln(k)",
}
#: Every cluster's score under the mean of its group's rows' densities.
_LOCMIX = f"""p as (select s.track_id, s.pair, s.n+1 as n, lx+1/(sigma_x*sigma_x) as lx, ly+1/(sigma_y*sigma_y) as ly, ex+x/(sigma_x*sigma_x) as ex, ey+y/(sigma_y*sigma_y) as ey,
  quad+x*x/(sigma_x*sigma_x)+y*y/(sigma_y*sigma_y) as quad, ld+ln(sigma_x*sigma_x*sigma_y*sigma_y) as ld from st s join locs l on s.pair=l.pair),
 v as (select track_id, pair, {_ML} as v from p), m as (select track_id, max(v) as m, count(*) as t from v group by track_id),
 lm as (select track_id, any_value(m)+ln(sum(exp(v-m)))-ln(any_value(t)) as score from v join m using (track_id) group by track_id)"""


def _locmix(spark, d):
    return S.locmix_exact(stats(spark, d), fx.locs(spark, d).select("pair", "x", "y", "sigma_x", "sigma_y", "sigma_xy"), ["pair"], ["track_id"])


@query("f8_log_target", f"""with {EMITTERS_SQL}, {_LOCMIX}, b as (select pair, count(*)::double as k, sum(n)::double as n, sum({_ML} - ln({AREA}e0)) as ml, sum(score) as mll, sum(lgamma(n+2e0)) as dms, sum({nb('n', '2e0', '60e0')}) as nbs, sum(lgamma(n+1)) as f from st join lm using (track_id) group by pair),
 c as (select *, {nb('n', '(2e0*k)', '(60e0*k)')} as cp, lgamma(2*k)-k*lgamma(2e0)-lgamma(n+2*k)+dms as dm, -3e0*{AREA}e0+k*(ln(3e0)+ln({AREA}e0))-lgamma(k+1) as pk from b)
 {' union all '.join(f"select '{t}' as target, pair, k::bigint as k, n::bigint as n, round({e},3) as score from c" for t, e in _TARGET.items())}""")
def f8(spark, d):
    local = _locmix(spark, d).select("track_id", F.col("score").alias("locmix"))
    s, out = stats(spark, d).join(local, "track_id"), None
    # a uniform intensity map has the density of the flat prior
    s = s.withColumn("uniform", E.log_ml(*E.stats_columns(), F.lit(math.log(AREA))))
    for t in S.TARGETS:
        spatial = "locmix" if t.endswith("Locmix") else "uniform" if t == "IPP" else None
        one = S.log_target(s, ["pair"], t, AREA, 2.0, 60.0, 3.0, spatial).select(F.lit(t).alias("target"), "pair", "k", "n", r("score", 3).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


@query("f9_locmix_exact", f"with {EMITTERS_SQL}, {_LOCMIX} select track_id, round(score,4) as score from lm")
def f9(spark, d):
    return _locmix(spark, d).select("track_id", r("score", 4).alias("score"))
