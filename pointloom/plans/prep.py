"""Sources, validation, sinks, and per-row work on localizations."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..exprs import mean_sigma
from ..fixtures import LOCS_SQL, SAMPLES_SQL
from ..operators import localizations as L
from ..operators.clusters import emitters
from ..operators.graph import components
from ..operators.neighbors import neighbor_pairs
from ..registry import query
from ..sources import tables as T


def r(c, digits=9):
    return F.round(c, digits)


W = f"with {LOCS_SQL}"
#: Emitters by source: posterior means of all rows of a user.
EMITTERS_SQL = f"""{LOCS_SQL}, st as (
 select track_id, count(*) as n, sum(1/(sigma_x*sigma_x)) as lx, sum(1/(sigma_y*sigma_y)) as ly,
        sum(x/(sigma_x*sigma_x)) as ex, sum(y/(sigma_y*sigma_y)) as ey,
        sum(x*x/(sigma_x*sigma_x) + y*y/(sigma_y*sigma_y)) as quad, sum(ln(sigma_x*sigma_x*sigma_y*sigma_y)) as ld, any_value(pair) as pair
 from locs group by track_id),
em as (select track_id as emitter_id, pair as partition_id, ex/lx as x, ey/ly as y, sqrt(1/lx) as sigma_x, sqrt(1/ly) as sigma_y, 0e0 as sigma_xy, n from st)"""


def source_emitters(spark, d):
    return emitters(fx.locs(spark, d), ["pair", "track_id"]).withColumnsRenamed({"track_id": "emitter_id", "pair": "partition_id"})


@query("a1_read_locs", f"{W} select loc_id, round(x,9) as x, round(y,9) as y, sigma_x, sigma_y, sigma_xy, frame from locs")
def a1(spark, d):
    return L.normalize(fx.locs(spark, d).drop("sigma_xy")).select("loc_id", r("x").alias("x"), r("y").alias("y"), "sigma_x", "sigma_y", "sigma_xy", "frame")


@query("a2_validate_locs", f"""{W}, v as (select case when loc_id%101=0 then null else x end as x, case when loc_id%103=0 then 0e0 else sigma_x end as sigma_x from locs)
select count(*) as n_rows, count(*) filter (x is null) as n_missing, count(*) filter (x is not null and sigma_x<=0) as n_flat, 0::bigint as n_depth from v""")
def a2(spark, d):
    broken = fx.locs(spark, d).withColumn("x", F.expr("case when loc_id%101=0 then null else x end")).withColumn("sigma_x", F.expr("case when loc_id%103=0 then 0e0 else sigma_x end"))
    return L.check_rows(broken)


@query("a3_empty_input", f"""{W} select 0::bigint as n_rows, 0::bigint as n_components, 0::bigint as n_emitters from (select count(*) as c from locs)
 union all select 1, 1, 1 from (select count(*) as c from locs) union all select 2, (select count(distinct pair) from locs where loc_id < 2), 2""")
def a3(spark, d):
    locs, out = fx.locs(spark, d), None
    for n in (0, 1, 2):
        some = locs.filter(F.col("loc_id") < n)
        comp = components(some, neighbor_pairs(some))
        row = some.agg(F.count("*").alias("n_rows")).crossJoin(comp.agg(F.countDistinct("component").alias("n_components"))).crossJoin(emitters(some, ["loc_id"]).agg(F.count("*").alias("n_emitters")))
        out = row if out is None else out.unionByName(row)
    return out


@query("a4_write_emitters_csv", f"with {EMITTERS_SQL} select round(x,8) as x_um, round(y,8) as y_um, round(sigma_x,9) as sigma_x_um, round(sigma_y,9) as sigma_y_um, sigma_xy, n as photons from em")
def a4(spark, d):
    path = T.shared_path(spark, "emitters")
    T.write_emitters_csv(source_emitters(spark, d), path)
    back = spark.read.csv(path, header=True, schema="x_um double, y_um double, sigma_x_um double, sigma_y_um double, sigma_xy double, photons long")
    return back.select(r("x_um", 8).alias("x_um"), r("y_um", 8).alias("y_um"), r("sigma_x_um").alias("sigma_x_um"), r("sigma_y_um").alias("sigma_y_um"), F.abs("sigma_xy").alias("sigma_xy"), "photons")


def _metrics(spark, d):
    e = source_emitters(spark, d)
    return fx.locs(spark, d).agg(F.count("*").alias("n_locs")).crossJoin(e.agg(F.count("*").alias("n_emitters"), F.max("n").alias("most"))).withColumn("ratio", F.col("n_locs") / F.col("n_emitters"))


@query("a5_write_metrics_json", f"{W} select count(*) as n_locs, count(distinct track_id) as n_emitters, (select max(c) from (select count(*) as c from locs group by track_id)) as most, round(count(*)/count(distinct track_id),9) as ratio from locs")
def a5(spark, d):
    path = T.shared_path(spark, "metrics")
    T.write_metrics_json(_metrics(spark, d), path)
    back = spark.read.schema("n_locs long, n_emitters long, most long, ratio double").json(path)
    return back.withColumn("ratio", r("ratio"))


@query("a6_write_summary")
def a6(spark, d):
    path = T.shared_path(spark, "summary")
    T.write_summary(_metrics(spark, d), path)
    return spark.read.text(path)


@query("a7_write_sweep_csv", f"{W} select (track_id%5) as n, count(*) as trials, round(avg(sigma_x),9) as mean_sigma from locs group by 1")
def a7(spark, d):
    path = T.shared_path(spark, "sweep")
    T.write_table_csv(fx.locs(spark, d).groupBy((F.col("track_id") % 5).alias("n")).agg(F.count("*").alias("trials"), F.avg("sigma_x").alias("mean_sigma")), path)
    return spark.read.csv(path, header=True, schema="n long, trials long, mean_sigma double").withColumn("mean_sigma", r("mean_sigma"))


def _archive(spark, d):
    path = T.shared_path(spark, "archive")
    s = fx.samples(spark, d)
    hyper = s.groupBy("iter").agg(F.lit(5.0).alias("mu"), F.lit(2.0).alias("shape"), F.lit(1.0).alias("rho"))
    for sync, half in enumerate((s.filter("iter <= 6"), s.filter("iter > 6"))):
        T.archive_samples(half, hyper.join(half.select("iter").distinct(), "iter"), path, "flat", sync)
    return path


S = f"with {LOCS_SQL}, {SAMPLES_SQL}"


@query("a8_archive_samples", f"{S} select partition_id, iter, count(*) as n, sum(loc_id)::bigint as ids from samples group by all")
def a8(spark, d):
    return T.read_archive(spark, _archive(spark, d)).groupBy(F.col("partition_id").cast("long").alias("partition_id"), "iter").agg(F.count("*").alias("n"), F.sum("loc_id").alias("ids")).withColumn("iter", F.col("iter").cast("long"))


@query("a9_read_archive", f"{S} select iter, loc_id, cluster from samples where partition_id = 3")
def a9(spark, d):
    return T.read_archive(spark, _archive(spark, d), 3).select(F.col("iter").cast("long").alias("iter"), "loc_id", "cluster")


@query("a10_replay", f"{S} select k, count(*) as n from (select partition_id, iter, count(distinct cluster) as k from samples group by all) group by k")
def a10(spark, d):
    from ..operators.samples import emitter_count_hist

    return T.replay(spark, _archive(spark, d), lambda s: emitter_count_hist(s, []), True, "flat")


@query("b1_resolve_tau", f"{W} select loc_id, 0.003e0 as tau_x, photons*1e-5 as tau_y from locs")
def b1(spark, d):
    return L.resolve_tau(fx.locs(spark, d).withColumn("t", F.col("photons") * F.lit(1e-5)), (0.003, "t")).select("loc_id", "tau_x", "tau_y")


@query("b2_apply_se_adjust", f"{W} select loc_id, round(sqrt(sigma_x*sigma_x+0.003e0*0.003e0),12) as sigma_x, round(sqrt(sigma_y*sigma_y+0.004e0*0.004e0),12) as sigma_y, sigma_xy, true as sigma_corrected from locs")
def b2(spark, d):
    once = L.apply_tau(fx.locs(spark, d), (0.003, 0.004))
    twice = L.apply_tau(once, 0.009)  # corrected rows stay
    return twice.select("loc_id", r("sigma_x", 12).alias("sigma_x"), r("sigma_y", 12).alias("sigma_y"), "sigma_xy", "sigma_corrected")


@query("b3_mean_sigma", f"{W} select loc_id, round(sqrt(sigma_x*sigma_y),12) as s from locs")
def b3(spark, d):
    return fx.locs(spark, d).select("loc_id", r(mean_sigma(F.col("sigma_x"), F.col("sigma_y")), 12).alias("s"))


#: A covariance for the fixture's rows: positive definite but for every thirteenth row.
_COV = "case when loc_id%13=0 then 1e-3 else sigma_x*sigma_y*0.3e0*((loc_id%5)-2)/2 end"


@query("b4_loc_precision", f"""{W}, c as (select loc_id, x, y, sigma_x*sigma_x as vx, sigma_y*sigma_y as vy, {_COV} as s from locs),
 e as (select *, case when vx*vy-s*s>0 then s else 0 end as k, case when vx*vy-s*s>0 then vx*vy-s*s else vx*vy end as det from c),
 f as (select *, vy/det as a, -k/det as b, vx/det as c2 from e)
 select loc_id, round(a,4) as l_xx, abs(round(b,4)) as l_xy, round(c2,4) as l_yy, round(a*x+b*y,4) as e_x, round(b*x+c2*y,4) as e_y, round(x*(a*x+b*y)+y*(b*x+c2*y),3) as quad, round(ln(det),9) as log_det, round(sqrt(vx+vy),12) as pos_sigma from f""")
def b4(spark, d):
    p = L.precision(fx.locs(spark, d).withColumn("sigma_xy", F.expr(_COV)))
    return p.select("loc_id", r("l_xx", 4).alias("l_xx"), F.abs(r("l_xy", 4)).alias("l_xy"), r("l_yy", 4).alias("l_yy"), r("e_x", 4).alias("e_x"), r("e_y", 4).alias("e_y"), r("quad", 3).alias("quad"), r("log_det").alias("log_det"), r("pos_sigma", 12).alias("pos_sigma"))


@query("b5_gaussian_contribution", f"{W} select loc_id, round(1/(sigma_x*sigma_x),4) as l, round(photons/(sigma_x*sigma_x),2) as e, round(photons*photons/(sigma_x*sigma_x),0) as quad, round(2*ln(sigma_x),9) as log_det from locs")
def b5(spark, d):
    t = L.scalar_contribution(F.col("photons"), F.col("sigma_x"))
    return fx.locs(spark, d).select("loc_id", r(t["l"], 4).alias("l"), r(t["e"], 2).alias("e"), r(t["quad"], 0).alias("quad"), r(t["log_det"]).alias("log_det"))


@query("b6_motion_delta", f"{W} select loc_id, round((frame-(a+b)/2e0)/greatest(b-a,1),12) as delta from locs, (select min(frame) as a, max(frame) as b from locs)")
def b6(spark, d):
    return L.motion_delta(fx.locs(spark, d)).select("loc_id", r("delta", 12).alias("delta"))


@query("b7_bbox", f"{W} select round(min(x),9) as x_min, round(max(x),9) as x_max, round(min(y),9) as y_min, round(max(y),9) as y_max from locs")
def b7(spark, d):
    b = L.bounding_box(fx.locs(spark, d))
    return b.select(*[r(c).alias(c) for c in b.columns])


@query("b8_padded_box", f"""{W}, g as (select pair, count(*) as n, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1, avg(sigma_x) as mx, avg(sigma_y) as my, median((sigma_x+sigma_y)/2) as ms from locs group by pair),
 p as (select pair, n, ms, x0-greatest(0.05*(x1-x0),3*mx) as x0, x1+greatest(0.05*(x1-x0),3*mx) as x1, y0-greatest(0.05*(y1-y0),3*my) as y0, y1+greatest(0.05*(y1-y0),3*my) as y1 from g),
 s as (select *, case when (x1-x0)*(y1-y0) < n*pi()*9*ms*ms then sqrt(n*pi()*9*ms*ms/((x1-x0)*(y1-y0))) else 1 end as k from p)
 select pair, n, round((x0+x1)/2-(x1-x0)/2*k,9) as x_min, round((x0+x1)/2+(x1-x0)/2*k,9) as x_max, round((y0+y1)/2-(y1-y0)/2*k,9) as y_min, round((y0+y1)/2+(y1-y0)/2*k,9) as y_max from s""")
def b8(spark, d):
    b = L.padded_box(fx.locs(spark, d), ["pair"])
    return b.select("pair", "n", *[r(c).alias(c) for c in b.columns[2:]])


@query("b9_compute_fov", f"""{W}, m as (select greatest(5*median(sqrt(sigma_x*sigma_y)),0.01e0) as m from locs)
 select round(min(x-sigma_x)-any_value(m),9) as x_min, round(max(x+sigma_x)+any_value(m),9) as x_max, round(min(y-sigma_y)-any_value(m),9) as y_min, round(max(y+sigma_y)+any_value(m),9) as y_max from locs, m""")
def b9(spark, d):
    b = L.field_of_view(fx.locs(spark, d))
    return b.select(*[r(c).alias(c) for c in b.columns])


@query("b10_exposure", f"""{W}, b as (select (max(x)-min(x))*(max(y)-min(y)) as a, count(*) as t from locs)
 select pair, count(*) as n, round(any_value(a)*count(*)/any_value(t),9) as exposure from locs, b group by pair""")
def b10(spark, d):
    return L.exposure(fx.locs(spark, d), ["pair"]).withColumn("exposure", r("exposure"))


@query("b11_mark_boundary", f"""{W}, g as (select pair, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1, 3*median(sqrt(sigma_x*sigma_y)) as m from locs group by pair)
 select loc_id, (x-x0<=m or x1-x<=m or y-y0<=m or y1-y<=m) as is_boundary from locs join g using (pair)""")
def b11(spark, d):
    return L.mark_boundary(fx.locs(spark, d), ["pair"]).select("loc_id", "is_boundary")


@query("b12_log_spatial_prior", f"{W}, b as (select min(x) as a, quantile_cont(x,0.5) as b, min(y) as c, max(y) as e from locs) select loc_id, case when x<=b.b then round(-ln((b.b-b.a)*(e-c)),9) else '-Infinity'::double end as lp from locs, b")
def b12(spark, d):
    locs = fx.locs(spark, d)
    box = locs.agg(F.min("x").alias("x_min"), F.median("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))
    both = locs.crossJoin(F.broadcast(box))
    lp = L.log_spatial_prior(F.col("x"), F.col("y"), {c: F.col(c) for c in box.columns})
    return both.select("loc_id", F.when(lp > F.lit(float("-inf")), r(lp)).otherwise(lp).alias("lp"))


@query("b13_size_filter", f"{W} select pair, count(*) as n, case when count(*)>=150 then 'skip' when count(*)>130 then 'split' else 'keep' end as action from locs group by pair")
def b13(spark, d):
    return L.size_filter(fx.locs(spark, d), "pair", 130, 150)
