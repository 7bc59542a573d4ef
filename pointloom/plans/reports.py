"""Calibration, grouping jobs, evaluation and chain statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..fixtures import LOCS_SQL, TRACE_SQL, TRUTH_SQL
from ..operators import calibration as C
from ..operators import consensus as H
from ..operators import evaluation as V
from ..operators import graph as G
from ..operators import neighbors as N
from ..operators.grouping import GroupingConfig, component_emitters, group_field, group_localizations, merge_groups, sample_groupings
from ..registry import query
from .chains import L
from .joins import WG_SQL
from .prep import EMITTERS_SQL, W, r, source_emitters

TR = f"with {LOCS_SQL}, {TRACE_SQL}"


def _pairs(spark, d):
    return H.within_group_pairs(fx.locs(spark, d), "track_id")


@query("i1_scaled_distance", f"with {WG_SQL} select i, j, round(d/sqrt(s2+2*0.002e0*0.002e0),8) as z from wg")
def i1(spark, d):
    return _pairs(spark, d).select("i", "j", r(C.scaled_distance(F.col("d"), F.col("s2"), 0.002), 8).alias("z"))


@query("i2_ks_rayleigh", f"with {WG_SQL}, z as (select g, d/sqrt(s2) as z from wg), k as (select g, abs(row_number() over (partition by g order by z)/count(*) over (partition by g) - (1-exp(-z*z/2))) as e from z) select g as track_id, round(max(e),8) as ks, count(*) as n from k group by g")
def i2(spark, d):
    z = _pairs(spark, d).withColumn("z", C.scaled_distance(F.col("d"), F.col("s2"), 0.0))
    return C.ks(z, ["track_id"], "z", C.rayleigh).select("track_id", r("ks", 8).alias("ks"), "n")


_CURVE = f"""{WG_SQL}, gr as (select unnest([0e0,0.001e0,0.002e0,0.003e0,0.004e0,0.006e0]) as tau), zz as (select tau, d/sqrt(s2+2*tau*tau) as z from wg, gr),
kz as (select tau, abs(row_number() over (partition by tau order by z)/count(*) over (partition by tau) - (1-exp(-z*z/2))) as e from zz), cv as (select tau, max(e) as ks from kz group by tau)"""
_TAUS = [0.0, 0.001, 0.002, 0.003, 0.004, 0.006]


@query("i3_ks_curve", f"with {_CURVE} select tau, round(ks,8) as ks from cv")
def i3(spark, d):
    return C.ks_curve(_pairs(spark, d), _TAUS).select("tau", r("ks", 8).alias("ks"))


@query("i4_mstep_pick", f"""with {_CURVE}, lv as (select min(ks)+0.01e0 as level, max(tau) as top from cv), nx as (select *, lead(tau) over (order by tau) as nt, lead(ks) over (order by tau) as nk from cv),
 b as (select * from nx, lv where ks<=level order by tau desc limit 1) select round(case when nt is null then tau else tau+(nt-tau)*(level-ks)/(nk-ks) end,9) as tau, tau=top as censored from b""")
def i4(spark, d):
    return C.pick(C.ks_curve(_pairs(spark, d), _TAUS)).select(r("tau").alias("tau"), "censored")


# 0 and 0.0002, then doubled until the last point isn't within the noise of the least, or it is the cap, which is off the grid
_STAGES = "(values (0e0,0),(0.0002e0,0),(0.0004e0,1),(0.0006e0,2),(0.0008e0,2),(0.001e0,3),(0.0012e0,3),(0.0014e0,3),(0.0015e0,3)) g(tau, stage)"


@query("i5_mstep_extend", f"""with {WG_SQL}, zz as (select tau, stage, d/sqrt(s2+2*tau*tau) as z from wg, {_STAGES}),
 kz as (select tau, stage, abs(row_number() over (partition by tau order by z)/count(*) over (partition by tau) - (1-exp(-z*z/2))) as e from zz), cv as (select tau, stage, max(e) as ks from kz group by tau, stage),
 st as (select stage, max_by(ks, tau) as top, min(ks) as least from cv group by stage), ok as (select stage, top <= min(least) over (order by stage) + 0.01e0 as goes_on from st),
 go as (select stage, coalesce(bool_and(goes_on) over (order by stage rows between unbounded preceding and 1 preceding), true) as reached from ok)
 select round(tau,6) as tau, round(ks,8) as ks from cv join go using (stage) where reached""")
def i5(spark, d):
    return C.extended_curve(_pairs(spark, d), [0.0, 0.0002], cap=0.0015).select(r("tau", 6).alias("tau"), r("ks", 8).alias("ks"))


@query("i6_tail", f"""with {WG_SQL}, q as (select d/sqrt(s2) as z, row_number() over (order by d/sqrt(s2)) as i, count(*) over () as n from wg)
 select round(max(abs(i/n-(1-exp(-z*z/2)))) filter (i between ceil(0.85e0*n) and floor(0.99e0*n)),8) as ks_tail, round(avg(z) filter (i between ceil(0.97e0*n) and floor(0.99e0*n))/sqrt(-2*ln(1-(0.97e0+0.99e0)/2)),8) as tail_ratio from q""")
def i6(spark, d):
    return C.tail(_pairs(spark, d), 0.0).select(r("ks_tail", 8).alias("ks_tail"), r("tail_ratio", 8).alias("tail_ratio"))


@query("i7_ks_halfnormal")
def i7(spark, d):
    return C.ks_curve(C.axis_pairs(fx.locs(spark, d), "track_id", "x"), _TAUS, axis=True).select("tau", r("ks", 8).alias("ks"))


@query("i8_block_tiles", f"with {WG_SQL}, lo as (select min(mx) as a, min(my) as b from wg) select floor((mx-a)/0.5e0)::bigint as tx, floor((my-b)/0.5e0)::bigint as ty, count(*) as n from wg, lo group by all")
def i8(spark, d):
    return C.block_tiles(_pairs(spark, d), 0.5).groupBy("tx", "ty").agg(F.count("*").alias("n"))


@query("i9_block_bootstrap_ci")
def i9(spark, d):
    return C.bootstrap_ci(_pairs(spark, d), 1.0)


def _tau_row(spark, e):
    low, high = e["bracket"] or (None, None)
    row = (e["tau"], e["converged"], e["censored"], e["start_overmerged"], low, high, e["low"], e["high"], e["n_boot_censored"], e["ks"], e["grid_top"], len(e["path"]))
    return spark.createDataFrame([row], "tau double, converged boolean, censored boolean, start_overmerged boolean, bracket_low double, bracket_high double, ci_low double, ci_high double, n_boot_censored int, ks double, grid_top double, steps int")


@query("i10_estimate_tau")
def i10(spark, d):
    locs = fx.locs(spark, d)
    return _tau_row(spark, C.estimate_tau(locs, C.component_groups(locs, C.GRID[-1], 0.25)))


@query("i11_estimate_tau_axis")
def i11(spark, d):
    locs = fx.locs(spark, d)
    e = C.estimate_tau_axis(locs, C.component_groups(locs, C.GRID[-1], 0.25))
    return spark.createDataFrame([(float(e["tau_x"]), float(e["tau_y"]), e["converged"], len(e["path"]))], "tau_x double, tau_y double, converged boolean, steps int")


@query("i12_auto_tau", f"{W} select count(*) as n, 0e0 as tau from locs")
def i12(spark, d):
    locs = fx.locs(spark, d).withColumn("sigma_corrected", F.lit(True))
    return locs.agg(F.count("*").alias("n")).withColumn("tau", F.lit(float(C.auto_tau(locs, "auto", None))))


def _members(spark, d):
    members, _ = G.partition_locs(fx.locs(spark, d), max_size=200)
    return N.settle(members.withColumn("sigma_xy", F.lit(0.0)), "members")


@query("j1_merge_groups")
def j1(spark, d):
    return merge_groups(_members(spark, d), N.knn_edges(fx.locs(spark, d), 8), GroupingConfig())


@query("j2_sample_groupings")
def j2(spark, d):
    return sample_groupings(_members(spark, d), GroupingConfig(chains=2))[0]


@query("j0_component_emitters", f"{W} select min(loc_id) as component, round(sum(x/(sigma_x*sigma_x))/sum(1/(sigma_x*sigma_x)),8) as x, round(sum(y/(sigma_y*sigma_y))/sum(1/(sigma_y*sigma_y)),8) as y, count(*) as n from locs group by pair")
def j0(spark, d):
    e = component_emitters(fx.locs(spark, d))
    return e.select("component", r("x", 8).alias("x"), r("y", 8).alias("y"), "n")


@query("j3_group_localizations")
def j3(spark, d):
    return group_localizations(fx.locs(spark, d))


@query("j3_field_outputs")
def j3_outputs(spark, d):
    f = group_field(fx.locs(spark, d))
    named = lambda name, key, value: [F.lit(name).alias("output"), F.col(key).cast("long").alias("k"), r(value).alias("value")]
    k = f.field_k.withColumn("n", F.col("n").cast("double")).select(*named("field k", "k", "n"))
    c = f.counts.withColumn("n", F.col("n").cast("double")).select(*named("clusters of k rows", "k", "n"))
    m = f.raster.groupBy("ix").agg(F.sum("mass").alias("mass")).select(*named("mass of column k", "ix", "mass"))
    return k.unionByName(c).unionByName(m)


MATCH_SQL = f"""{EMITTERS_SQL}, {TRUTH_SQL}, mt as (select * from (select e.emitter_id, arg_min(t.true_id, (sqrt((e.x-t.x)*(e.x-t.x)+(e.y-t.y)*(e.y-t.y)), t.true_id)) as true_id, min(sqrt((e.x-t.x)*(e.x-t.x)+(e.y-t.y)*(e.y-t.y))) as d from em e, truth t group by all) qualify row_number() over (partition by true_id order by d, emitter_id)=1),
ma as (select * from mt where d<=0.02e0)"""


def _matched(spark, d):
    e = N.settle(source_emitters(spark, d), "emitters")
    t = fx.truth(spark, d)
    return e, t, N.settle(N.match_positions(e, t), "matched")


@query("l1_match_metrics", f"with {MATCH_SQL}, c as (select count(*) as k, (select count(*) from em) as e, (select count(*) from truth) as t, sqrt(avg(d*d)) as rmse from ma) select k as n_matched, round(k/(e+t-k),9) as jaccard, round(k/e,9) as precision, round(k/t,9) as recall, round(2e0*k/(e+t),9) as f1, round(rmse,9) as rmse from c")
def l1(spark, d):
    e, t, m = _matched(spark, d)
    x = V.match_metrics(m, e, t)
    return x.select("n_matched", *[r(c).alias(c) for c in x.columns[1:]])


D2_SQL = f"""{MATCH_SQL}, d2 as (select ma.emitter_id, ma.true_id, pow(e.x-t.x,2)/pow(e.sigma_x,2)+pow(e.y-t.y,2)/pow(e.sigma_y,2) as d2 from ma join em e using (emitter_id) join truth t on t.true_id=ma.true_id)"""


@query("l2_mahalanobis", f"with {D2_SQL} select emitter_id, true_id, round(d2,5) as d2 from d2")
def l2(spark, d):
    e, t, m = _matched(spark, d)
    return V.mahalanobis(m, e, t).select("emitter_id", "true_id", r("d2", 5).alias("d2"))


@query("l3_calibration", f"with {D2_SQL} select round(sqrt(avg(d2)/2),7) as scale, round(avg((d2<=1)::int),9) as cover_1, round(1-exp(-0.5e0),9) as expect_1, round(avg((d2<=4)::int),9) as cover_4, round(1-exp(-2e0),9) as expect_4, round(avg((d2<=9)::int),9) as cover_9, round(1-exp(-4.5e0),9) as expect_9 from d2")
def l3(spark, d):
    e, t, m = _matched(spark, d)
    c = V.calibration(V.mahalanobis(m, e, t))
    return c.select(r("scale", 7).alias("scale"), *[r(x).alias(x) for x in c.columns[1:]])


@query("l4_oracle_rmse", f"with {MATCH_SQL} select round(sqrt(avg(d*d)),8) as rmse from (select m.* from mt m where d<=0.02e0 and emitter_id > 0)")
def l4(spark, d):
    return V.oracle_rmse(fx.locs(spark, d), fx.truth(spark, d)).select(r("rmse", 8).alias("rmse"))


@query("l5_empirical_counts", f"{W} select track_id, count(*) as n from locs where track_id<>0 group by track_id")
def l5(spark, d):
    return V.empirical_counts(fx.locs(spark, d))


@query("l6_report", f"""with {MATCH_SQL}, nn as (select a.emitter_id, min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))) as d from em a join em b on a.emitter_id<>b.emitter_id group by all), pk as (select count(*) as k from em group by partition_id),
 c as (select count(*) as k, (select count(*) from em) as e, (select count(*) from truth) as t, sqrt(avg(d*d)) as rmse from ma)
 select (select count(*) from locs) as n_locs, e as n_emitters, round((select count(*) from locs)/e,9) as ratio, (select round(median(d),9) from nn) as nn_median, (select median(k) from pk) as k_median, (select min(k) from pk) as k_least, (select max(k) from pk) as k_most, k as n_matched, round(rmse,9) as rmse from c""")
def l6(spark, d):
    e = N.settle(source_emitters(spark, d), "emitters")
    x = V.report(fx.locs(spark, d), e, fx.truth(spark, d))
    return x.select("n_locs", "n_emitters", r("ratio").alias("ratio"), r("nn_median").alias("nn_median"), "k_median", "k_least", "k_most", "n_matched", r("rmse").alias("rmse"))


@query("l7_partition_k", f"with {EMITTERS_SQL}, k as (select count(*) as k from em group by partition_id) select median(k) as median, min(k) as least, max(k) as most from k")
def l7(spark, d):
    return V.partition_k(source_emitters(spark, d))


#: Trials from the rows' counts: each source is one, recovered if its rows are many.
_TRIALS = "1 + track_id%3 as n, 20e0 as mu, 2.5e0*(track_id%5) as sep, case when n > 55 then 1 + track_id%3 else 0 end as k, case when n > 57 then 1 + track_id%3 else 0 end as k_flat, case when n > 60 then 1 + track_id%3 else 0 end as k_count, 0.001e0*n as rmse, 0.0009e0*(n%4) as oracle, 0.03e0*n as d2"


def _trials(spark, d):
    return fx.locs(spark, d).groupBy("track_id").agg(F.count("*").alias("n")).selectExpr(*_TRIALS.split(", "))


_TRIALS_SQL = f"""{W}, c as (select track_id, count(*) as n from locs group by track_id), tr as (select {_TRIALS} from c),
 cu as (select n, mu, sep, avg((k=n)::int) as rate, avg((k_flat=n)::int) as rate_flat, avg((k_count=n)::int) as rate_count, count(*) as trials, avg(rmse/oracle) filter (oracle>0) as rmse_ratio from tr group by all)"""


@query("l8_sweep_curves", f"{_TRIALS_SQL} select n, mu, sep, round(rate,9) as rate, round(rate_flat,9) as rate_flat, round(rate_count,9) as rate_count, trials, round(rmse_ratio,7) as rmse_ratio, round(sqrt(rate*(1-rate)/trials),9) as rate_err from cu")
def l8(spark, d):
    c = V.sweep_curves(_trials(spark, d))
    return c.select("n", "mu", "sep", *[r(x).alias(x) for x in ("rate", "rate_flat", "rate_count")], "trials", r("rmse_ratio", 7).alias("rmse_ratio"), r("rate_err").alias("rate_err"))


@query("l9_sweep_scorecard", f"""{_TRIALS_SQL}, w as (select *, lag(rate) over (partition by n, mu order by sep) as b from cu)
 select 'floor against counts' as rule, not exists (from cu where rate_count>0 and rate_flat<0.85*rate_count) as passed
 union all select 'resolved pairs are recovered', not exists (from cu where sep=10 and rate<0.9)
 union all select 'positions help', not exists (from cu x join cu y using (n, mu) where x.sep=0 and y.sep=5 and y.rate<=x.rate)
 union all select 'rates don''t drop', not exists (from w where rate<b-0.05e0)
 union all select 'errors are near the oracle''s', not exists (from cu where sep>=5 and rmse_ratio>1.3)
 union all select 'sigmas are calibrated', (select coalesce(sqrt(avg(d2)/2) between 0.7 and 1.3, false) from tr)""")
def l9(spark, d):
    trials = _trials(spark, d)
    return V.sweep_scorecard(V.sweep_curves(trials), trials)


@query("l10_sweep_grid")
def l10(spark, d):
    # every pair of sources is a trial: grouped on its own and scored against its two true sources
    em = N.settle(group_localizations(fx.locs(spark, d), GroupingConfig(overlap=0.006)), "emitters")
    m = N.match_positions(em, fx.truth(spark, d)).withColumn("trial", F.expr("true_id div 2"))
    return m.groupBy("trial").agg(F.count("*").alias("recovered"), r(F.sqrt(F.avg(F.col("d") ** 2)), 8).alias("rmse"))


@query("l11_throughput")
def l11(spark, d):
    import time

    locs, rows = fx.locs(spark, d), []
    for _ in range(3):
        t = time.perf_counter()
        n = locs.count()
        rows.append((n, 1, time.perf_counter() - t))
    return V.throughput(spark.createDataFrame(rows, "rows long, partitions int, seconds double")).select("rows", "partitions")


def _ess_sql(name: str, source: str, keys: str, value: str) -> str:
    """{name}_rh: keys, lag, rho; {name}: keys, ess."""
    on = " and ".join(f"a.{k}=b.{k}" for k in keys.split(", "))
    of = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""{name}_mm as (select {keys}, count(*) as n, avg({value}) as m, var_pop({value}) as v from {source} group by all), {name}_xx as (select {keys}, iter, {value}-m as x, n, v from {source} join {name}_mm using ({keys})),
{name}_rh as (select {of}, lag, any_value(a.n) as n, case when any_value(a.v)=0 then 1 else sum(a.x*coalesce(b.x,0))/(any_value(a.n)*any_value(a.v)) end as rho from (select *, unnest(range(0, n//2+1)) as lag from {name}_xx) a left join {name}_xx b on {on} and b.iter=a.iter+lag group by {of}, lag),
{name}_pr as (select {keys}, (lag-1)//2 as p, round(sum(rho),12) as s, any_value(n) as n from {name}_rh where lag>0 group by all having count(*)=2), {name}_lw as (select *, min(s) over (partition by {keys} order by p) as low from {name}_pr),
{name} as (select {keys}, case when any_value(n)<4 then any_value(n)::double else greatest(1, least(any_value(n)::double, any_value(n)/(1+2*coalesce(sum(s) filter (low>=0),0)))) end as ess from {name}_lw group by all)"""


_CHAIN = "partition_id, chain_id"
_ESS = _ess_sql("es", "trace", _CHAIN, "k")


@query("m1_autocorrelation", f"{TR}, {_ESS} select partition_id, chain_id, lag, round(rho,8) as rho from es_rh where lag<=n//4")
def m1(spark, d):
    return V.autocorrelation(fx.trace(spark, d), V.CHAIN, "k").select("partition_id", L("chain_id"), L("lag"), r("rho", 8).alias("rho"))


@query("m2_ess", f"{TR}, {_ESS} select partition_id, chain_id, round(ess,6) as ess from es")
def m2(spark, d):
    return V.ess(fx.trace(spark, d), V.CHAIN, "k").select("partition_id", L("chain_id"), r("ess", 6).alias("ess"))


_RHAT = """hf as (select partition_id, chain_id, iter>20 as h, avg(k) as m, var_samp(k) as v, count(*) as c from trace group by all), rg as (select partition_id, avg(v) as w, var_samp(m) as b, avg(c) as c from hf group by partition_id),
rt as (select partition_id, case when w>0 then sqrt((w*(c-1)/c+b)/w) when b>0 then 'Infinity'::double else 1 end as rhat from rg)"""


@query("m3_split_rhat", f"{TR}, {_RHAT} select partition_id, round(rhat,8) as rhat from rt")
def m3(spark, d):
    return V.split_rhat(fx.trace(spark, d), ["partition_id"], "k").select("partition_id", r("rhat", 8).alias("rhat"))


_NEAR_MODE = f"""md as (select k as mode from trace group by k order by count(*) desc, k limit 1), hits as (select partition_id, chain_id, iter, value, (k=value)::int::double as hit from trace, (select unnest(range(mode-2, mode+3)) as value from md)),
{_ess_sql("ie", "hits", "partition_id, chain_id, value", "hit")}"""


@query("m4_indicator_ess", f"{TR}, {_NEAR_MODE} select partition_id, chain_id, value, round(ess,6) as ess from ie")
def m4(spark, d):
    return V.indicator_ess(fx.trace(spark, d), V.CHAIN).select("partition_id", L("chain_id"), L("value"), r("ess", 6).alias("ess"))


@query("m5_mixing_report", f"""{TR}, {_ESS}, {_NEAR_MODE}, {_RHAT} select partition_id, chain_id, 'mean' as statistic, round(avg(k),6) as value from trace group by all union all select partition_id, chain_id, 'variance', round(var_samp(k),6) from trace group by all
 union all select partition_id, chain_id, 'ess', round(ess,6) from es union all select partition_id, chain_id, 'ess of k = ' || value, round(ess,6) from ie union all select partition_id, null, 'rhat', round(rhat,6) from rt
 union all select partition_id, chain_id, 'acceptance of move' || iter%3, round(sum((iter+k)%2)/count(*),6) from trace group by partition_id, chain_id, iter%3""")
def m5(spark, d):
    trace = fx.trace(spark, d)
    moves = trace.selectExpr("partition_id", "chain_id", "concat('move', iter % 3) as move", "(iter + k) % 2 as accepted", "1 as total")
    return V.mixing_report(trace, moves).select("partition_id", L("chain_id"), "statistic", r("value", 6).alias("value"))


#: Fixed values: |z| at which a two-sided p is 0.05, 0.05 / 2 and 0.05 / 3; the trace has three different k.
_M6 = f"""{TR}, gv as (select k as value, count(*)/(select count(*) from trace) as prob from trace group by k), hits as (select partition_id, chain_id, iter, value, prob, (k=value)::int::double as hit from trace, gv),
 {_ess_sql("ie", "hits", "partition_id, chain_id, value", "hit")}, vr as (select partition_id, chain_id, value, min(hit)<>max(hit) as varies, count(*)::double as n from hits group by all),
 et as (select partition_id, value, sum(case when varies then ess else n end) as ess from ie join vr using (partition_id, chain_id, value) group by all), fr as (select partition_id, value, avg(hit) as freq, any_value(prob) as prob from hits group by all),
 zz as (select *, case when ess>=30 and ess*least(prob,1-prob)>=5 then (freq-prob)/sqrt(prob*(1-prob)/ess) end as z from fr join et using (partition_id, value)), mm as (select *, count(z) over (partition by partition_id) as m from zz)
 select partition_id, value as k, round(freq,9) as freq, round(ess,6) as ess, round(z,6) as z, case when z is null then 'inconclusive' when abs(z)>case m when 1 then 1.9599639845 when 2 then 2.2414027276 else 2.3939797998 end then 'fail' else 'pass' end as verdict from mm"""


@query("m6_k_marginal_test", _M6)
def m6(spark, d):
    t = fx.trace(spark, d)
    given = t.groupBy("k").agg(F.count("*").alias("c")).crossJoin(t.agg(F.count("*").alias("t"))).select("k", (F.col("c") / F.col("t")).alias("prob"))
    return V.k_marginal_test(t, given).select("partition_id", L("k"), r("freq").alias("freq"), r("ess", 6).alias("ess"), r("z", 6).alias("z"), "verdict")


@query("m6_k_marginal_verdict", f"""select partition_id, count(z) as n_tested, count(*) filter (verdict='inconclusive') as n_inconclusive, count(*) filter (verdict='fail') as n_rejected,
 case when count(z)=0 then 'inconclusive' when count(*) filter (verdict='fail')>0 then 'fail' else 'pass' end as verdict from ({_M6}) group by partition_id""")
def m6_verdict(spark, d):
    return V.k_marginal_verdict(m6(spark, d))


@query("m7_conditional_tv", f"""{TR}, e as (select partition_id, k, (iter%3)::varchar as l, count(*)/40e0 as p from trace where chain_id=0 group by all), f as (select partition_id, k, (iter%3)::varchar as l, count(*)/40e0 as p from trace where chain_id=1 group by all),
 j as (select coalesce(e.partition_id,f.partition_id) as partition_id, coalesce(e.k,f.k) as k, coalesce(e.p,0) as pe, coalesce(f.p,0) as pf from e full join f on e.partition_id=f.partition_id and e.k=f.k and e.l=f.l),
 t as (select partition_id, k, sum(pe) as te, sum(pf) as tf from j group by all) select partition_id, k, round(0.5e0*sum(abs(pe/te - case when tf>0 then pf/tf else 0 end)),8) as tv from j join t using (partition_id, k) where te>=0.05 group by all""")
def m7(spark, d):
    t = fx.trace(spark, d)
    freq = lambda c: t.filter(F.col("chain_id") == c).groupBy("partition_id", "k", (F.col("iter") % 3).cast("string").alias("labelling")).agg((F.count("*") / 40.0).alias("p"))
    return V.conditional_tv(freq(0), freq(1), ["partition_id"]).select("partition_id", "k", r("tv", 8).alias("tv"))


_CAN = """cf as (select partition_id, iter, cluster, min(loc_id) as f from samples group by all), cn as (select *, row_number() over (partition by partition_id, iter order by f) as label from cf), cl as (select s.partition_id, s.iter, s.loc_id, c.label from samples s join cn c using (partition_id, iter, cluster))"""


@query("m8_canonical_labels", f"with {LOCS_SQL}, {fx.SAMPLES_SQL}, {_CAN} select partition_id, iter, loc_id, label from cl")
def m8(spark, d):
    return V.canonical_labels(fx.samples(spark, d), H.SAMPLE).select("partition_id", L("iter"), "loc_id", L("label"))


@query("m9_labelling_frequencies", f"with {LOCS_SQL}, {fx.SAMPLES_SQL}, {_CAN}, ky as (select partition_id, iter, max(label) as k, string_agg(label::varchar, ',' order by loc_id) as labelling from cl group by all) select partition_id, k, md5(labelling) as labelling, count(*) as n from ky group by all")
def m9(spark, d):
    lab = V.canonical_labels(fx.samples(spark, d), H.SAMPLE)
    return V.labelling_frequencies(lab, ["partition_id"], ["chain_id", "iter"]).select("partition_id", L("k"), F.md5("labelling").alias("labelling"), "n")
