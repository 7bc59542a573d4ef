"""Range and nearest-neighbour joins, matching, components and partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..fixtures import LOCS_SQL, SAMPLES_SQL, TRUTH_SQL
from ..operators import consensus as H
from ..operators import graph as G
from ..operators import neighbors as N
from ..registry import query
from .prep import EMITTERS_SQL, r, source_emitters

W = f"with {LOCS_SQL}"
S = f"with {LOCS_SQL}, {SAMPLES_SQL}"
#: Pairs of sources are far apart, so every near pair of rows is inside one.
PAIRS_SQL = f"""{LOCS_SQL}, pairs as (
 select a.loc_id as i, b.loc_id as j, a.pair, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) as d, sqrt(a.sigma_x*a.sigma_y)+sqrt(b.sigma_x*b.sigma_y) as s
 from locs a join locs b on a.pair=b.pair and a.loc_id<b.loc_id),
near as (select * from pairs where d < 3*s)"""


@query("c1_neighbor_pairs", f"with {PAIRS_SQL} select i, j, round(d,9) as d from near")
def c1(spark, d):
    return N.neighbor_pairs(fx.locs(spark, d)).select("i", "j", r("d").alias("d"))


@query("c2_pw_distance", f"with {PAIRS_SQL} select i, j, round(d/s,8) as pw from near")
def c2(spark, d):
    return N.scaled(N.neighbor_pairs(fx.locs(spark, d))).select("i", "j", r("pw", 8).alias("pw"))


@query("c3_neighbor_pairs_cached", f"""with {PAIRS_SQL}, t as (select unnest([0e0, 0.002e0, 0.005e0]) as tau),
 v as (select p.d, t.tau, sqrt(sqrt((a.sigma_x*a.sigma_x+tau*tau)*(a.sigma_y*a.sigma_y+tau*tau))) + sqrt(sqrt((b.sigma_x*b.sigma_x+tau*tau)*(b.sigma_y*b.sigma_y+tau*tau))) as s
  from pairs p join locs a on p.i=a.loc_id join locs b on p.j=b.loc_id, t)
 select tau, count(*) as n from v where d < 3*s group by tau""")
def c3(spark, d):
    pairs, taus = N.candidate_pairs(fx.locs(spark, d), 0.005), (0.0, 0.002, 0.005)
    # counted for all taus as they are found, not kept
    n = pairs.agg(*[F.count(F.when(N.is_near(tau), 1)).alias(f"n{k}") for k, tau in enumerate(taus)])
    each = F.array(*[F.struct(F.lit(tau).alias("tau"), F.col(f"n{k}").alias("n")) for k, tau in enumerate(taus)])
    return n.select(F.explode(each).alias("t")).select("t.*")


@query("c4_knn_join", f"""{W}, k as (select a.loc_id, b.loc_id as other, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) as d,
  row_number() over (partition by a.loc_id order by sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)), b.loc_id) as k from locs a join locs b on a.pair=b.pair and a.loc_id<>b.loc_id)
 select least(loc_id,other) as i, greatest(loc_id,other) as j, round(min(d),9) as d from k where k<=15 group by all""")
def c4(spark, d):
    return N.knn_edges(fx.locs(spark, d)).select("i", "j", r("d").alias("d"))


@query("c5_nearest_join", f"""{W}, {TRUTH_SQL}, k as (select l.loc_id, t.true_id, sqrt((l.x-t.x)*(l.x-t.x)+(l.y-t.y)*(l.y-t.y)) as d from locs l, truth t)
 select loc_id, arg_min(true_id, (d, true_id)) as true_id, round(min(d),9) as d from k group by loc_id""")
def c5(spark, d):
    return N.nearest(fx.locs(spark, d), fx.truth(spark, d), "loc_id", "true_id").select("loc_id", "true_id", r("d").alias("d"))


@query("c6_nn_distance", f"with {EMITTERS_SQL} select a.emitter_id, round(min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))),9) as d from em a join em b on a.emitter_id<>b.emitter_id group by all")
def c6(spark, d):
    e = N.settle(source_emitters(spark, d), "emitters")
    return N.nearest(e, e.withColumnRenamed("emitter_id", "other"), "emitter_id", "other", 1, skip_self=True).select("emitter_id", r("d").alias("d"))


def pieces(spark, d) -> DataFrame:
    """Rows of each pair of sources in pieces of at most fifty, along a Morton curve."""
    rows = fx.locs(spark, d).withColumn("component", F.col("pair"))
    p = G.split_oversized(rows, 50)
    return p.select((F.col("component") * 1000 + F.col("piece")).alias("partition_id"), F.col("component").alias("parent_id"), "loc_id", "x", "y", "sigma_x", "sigma_y")


_BITS = " + ".join(f"((((cx >> {k}) & 1) << {2 * k}) + (((cy >> {k}) & 1) << {2 * k + 1}))" for k in range(10))
PIECES_SQL = f"""{LOCS_SQL}, bx as (select pair, count(*) as n, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from locs group by pair),
cel as (select l.*, b.n, least(1023, floor((l.x-x0)/greatest(x1-x0,1e-12)*1024))::bigint as cx, least(1023, floor((l.y-y0)/greatest(y1-y0,1e-12)*1024))::bigint as cy,
 case when b.n>50 then greatest(2, ceil(b.n/45e0))::bigint else 1 end as np from locs l join bx b using (pair)),
pc as (select loc_id, pair, x, y, sigma_x, sigma_y, np, ((row_number() over (partition by pair order by {_BITS}, loc_id) - 1) * np // n)::bigint as piece from cel),
mem as (select pair*1000+piece as partition_id, pair as parent_id, * from pc)"""


@query("c7_halo_join", f"""with {PIECES_SQL}, h as (select distinct a.partition_id, b.loc_id from mem a join mem b on a.parent_id=b.parent_id and a.partition_id<>b.partition_id and sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))<=0.006e0)
 select partition_id, loc_id, false as is_overlap from mem union all select partition_id, loc_id, true from h""")
def c7(spark, d):
    return N.halo(N.settle(pieces(spark, d), "pieces"), 0.006).select("partition_id", "loc_id", "is_overlap")


BOUNDARY_SQL = """bd as (select pair, min(x) as bx0, max(x) as bx1, min(y) as by0, max(y) as by1, 3*median(sqrt(sigma_x*sigma_y)) as bm from locs group by pair),
bnd as (select l.* from locs l join bd using (pair) where x-bx0<=bm or bx1-x<=bm or y-by0<=bm or by1-y<=bm),
mg as (select median(sqrt(sigma_x*sigma_y)) as m from locs)"""


@query("c8_near_boundary", f"""with {EMITTERS_SQL}, {BOUNDARY_SQL} select distinct e.emitter_id from em e join bnd b on e.partition_id=b.pair, mg where sqrt((e.x-b.x)*(e.x-b.x)+(e.y-b.y)*(e.y-b.y)) <= 0.4e0*m""")
def c8(spark, d):
    locs = fx.locs(spark, d).withColumn("partition_id", F.col("pair"))
    marked = G.mark_boundary(locs, ["partition_id"])
    return H.near_boundary(source_emitters(spark, d), marked, 0.2 * G.median_sigma(locs)).select("emitter_id")


HALO_SQL = """hl as (select partition_id, parent_id, loc_id, x, y, sigma_x, sigma_y, false as is_overlap from mem union all
 select distinct a.partition_id, b.parent_id, b.loc_id, b.x, b.y, b.sigma_x, b.sigma_y, true from mem a join mem b on a.parent_id=b.parent_id and a.partition_id<>b.partition_id and sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))<=0.006e0),
pe as (select h.partition_id, l.track_id, sum(h.x/(l.sigma_x*l.sigma_x))/sum(1/(l.sigma_x*l.sigma_x)) as x, sum(h.y/(l.sigma_y*l.sigma_y))/sum(1/(l.sigma_y*l.sigma_y)) as y,
 sqrt(1/sum(1/(l.sigma_x*l.sigma_x))) as sigma_x, sqrt(1/sum(1/(l.sigma_y*l.sigma_y))) as sigma_y, count(*) as n
 from hl h join locs l using (loc_id) group by all)"""


def piece_emitters(spark, d):
    members = N.settle(N.halo(N.settle(pieces(spark, d), "pieces"), 0.006), "halo")
    rows = members.join(fx.locs(spark, d).select("loc_id", "track_id", "sigma_x", "sigma_y", "sigma_xy"), "loc_id")
    from ..operators.clusters import emitters

    return members, N.settle(emitters(rows, ["partition_id", "track_id"]), "emitters")


@query("c9_overlap_discard", f"""with {PIECES_SQL}, {HALO_SQL}, q as (select e.partition_id, e.track_id, min((e.x-h.x)*(e.x-h.x)+(e.y-h.y)*(e.y-h.y)) filter (not is_overlap) as own, min((e.x-h.x)*(e.x-h.x)+(e.y-h.y)*(e.y-h.y)) filter (is_overlap) as halo
  from pe e join hl h using (partition_id) group by all)
 select partition_id, track_id from q where halo is null or own <= halo""")
def c9(spark, d):
    members, e = piece_emitters(spark, d)
    return H.overlap_discard(e, members).select("partition_id", "track_id")


@query("c10_dedup_boundary")
def c10(spark, d):
    members, e = piece_emitters(spark, d)
    kept = H.overlap_discard(e, members).withColumn("emitter_id", F.col("partition_id") * 100_000 + F.col("track_id")).withColumn("near_boundary", F.lit(True))
    out = H.dedup_boundary(kept, 0.02)
    return out.select("emitter_id", "partition_id", r("x").alias("x"), r("y").alias("y"), "n")


@query("c11_match_positions", f"""with {EMITTERS_SQL}, {TRUTH_SQL}, n as (select e.emitter_id, arg_min(t.true_id, (sqrt((e.x-t.x)*(e.x-t.x)+(e.y-t.y)*(e.y-t.y)), t.true_id)) as true_id, min(sqrt((e.x-t.x)*(e.x-t.x)+(e.y-t.y)*(e.y-t.y))) as d from em e, truth t group by all)
 select emitter_id, true_id, round(d,9) as d from n where d<=0.02e0 qualify row_number() over (partition by true_id order by d, emitter_id)=1""")
def c11(spark, d):
    return N.match_positions(source_emitters(spark, d), fx.truth(spark, d)).select("emitter_id", "true_id", r("d").alias("d"))


CONT_SQL = """ct as (select s.partition_id, s.iter, r.cluster as ref, s.cluster, count(*) as n from samples s join (select * from samples where iter=1) r using (partition_id, loc_id) group by all)"""


@query("c12_contingency", f"{S}, {CONT_SQL} select partition_id, iter, ref, cluster, n from ct")
def c12(spark, d):
    s = fx.samples(spark, d)
    return H.contingency(s, s.filter("iter = 1")).select("partition_id", F.col("iter").cast("long").alias("iter"), "ref", "cluster", "n")


@query("c13_overlap_match", f"""{S}, {CONT_SQL}, b as (select *, row_number() over (partition by partition_id, iter, ref order by n desc, ref, cluster) as ra, row_number() over (partition by partition_id, iter, cluster order by n desc, ref, cluster) as rb from ct),
 m1 as (select partition_id, iter, ref, cluster, n from b where ra=1 and rb=1),
 rest as (select c.* from ct c anti join m1 on c.partition_id=m1.partition_id and c.iter=m1.iter and c.ref=m1.ref anti join m1 m2 on c.partition_id=m2.partition_id and c.iter=m2.iter and c.cluster=m2.cluster),
 b2 as (select *, row_number() over (partition by partition_id, iter, ref order by n desc, ref, cluster) as ra, row_number() over (partition by partition_id, iter, cluster order by n desc, ref, cluster) as rb from rest),
 mm as (select * from m1 union all select partition_id, iter, ref, cluster, n from b2 where ra=1 and rb=1)
 select partition_id, iter, sum(n)::bigint as overlap, count(*) as matched from mm group by all""")
def c13(spark, d):
    s = fx.samples(spark, d)
    m = H.overlap_match(H.contingency(s, s.filter("iter = 1")))
    return m.groupBy("partition_id", F.col("iter").cast("long").alias("iter")).agg(F.sum("n").alias("overlap"), F.count("*").alias("matched"))


@query("c14_position_match", f"""with {EMITTERS_SQL}, {TRUTH_SQL}, p as (select e.partition_id, e.emitter_id, t.true_id, (e.x-t.x)*(e.x-t.x)+(e.y-t.y)*(e.y-t.y) as d2 from em e join truth t on e.partition_id=t.true_id//2)
 select partition_id, emitter_id, true_id from p qualify row_number() over (partition by emitter_id order by d2, true_id)=1 and row_number() over (partition by true_id order by d2, emitter_id)=1""")
def c14(spark, d):
    truth = fx.truth(spark, d).withColumn("partition_id", F.expr("true_id div 2"))
    return H.position_match(source_emitters(spark, d), truth, ["partition_id"], "emitter_id", "true_id").select("partition_id", "emitter_id", "true_id")


@query("c15_co_assigned_pairs", f"{S} select a.partition_id, a.iter, count(*) as n_pairs, sum(a.loc_id*7 + b.loc_id)::bigint as digest from samples a join samples b on a.partition_id=b.partition_id and a.iter=b.iter and a.cluster=b.cluster and a.loc_id<b.loc_id group by all")
def c15(spark, d):
    p = H.co_assigned(fx.samples(spark, d))
    return p.groupBy("partition_id", F.col("iter").cast("long").alias("iter")).agg(F.count("*").alias("n_pairs"), F.sum(F.col("i") * 7 + F.col("j")).alias("digest"))


WG_SQL = f"""{LOCS_SQL}, wg as (select a.track_id as g, a.loc_id as i, b.loc_id as j, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) as d,
 a.sigma_x*a.sigma_x+b.sigma_x*b.sigma_x as s2, (a.x+b.x)/2 as mx, (a.y+b.y)/2 as my from locs a join locs b on a.track_id=b.track_id and a.loc_id<b.loc_id)"""


@query("c16_within_group_pairs", f"with {WG_SQL} select g as track_id, i, j, round(d,9) as d, round(s2,12) as s2, round(mx,9) as mx, round(my,9) as my from wg")
def c16(spark, d):
    p = H.within_group_pairs(fx.locs(spark, d), "track_id")
    return p.select("track_id", "i", "j", r("d").alias("d"), r("s2", 12).alias("s2"), r("mx").alias("mx"), r("my").alias("my"))


@query("d1_components", f"{W} select loc_id, min(loc_id) over (partition by pair) as component from locs")
def d1(spark, d):
    return G.near_components(fx.locs(spark, d))


@query("d2_precision_dbscan", f"""with {PAIRS_SQL}, dg as (select k, count(*) as n from (select i as k from near union all select j from near) group by k), core as (select k from dg where n >= 60),
 lab as (select l.loc_id, 1 + min(l.loc_id) over (partition by l.pair) as c from locs l join core on l.loc_id=k),
 bor as (select a.loc_id, min(lab.c) as c from locs a join (select i as u, j as v from near union all select j, i from near) e on e.u=a.loc_id join lab on lab.loc_id=e.v group by a.loc_id)
 select l.loc_id, coalesce(lab.c, bor.c, 0) as cluster from locs l left join lab using (loc_id) left join bor on bor.loc_id=l.loc_id""")
def d2(spark, d):
    locs = fx.locs(spark, d)
    return G.density_clusters(locs, None, 60).select("loc_id", "cluster")


@query("d3_refine_bridges")
def d3(spark, d):
    locs = fx.locs(spark, d)
    pairs = N.settle(N.neighbor_pairs(locs, 1.0), "pairs")
    return G.refine_bridges(N.settle(G.components(locs, pairs), "labels"), pairs, 5, 0.8)


@query("d4_split_oversized", f"with {PIECES_SQL} select loc_id, pair as component, piece, np as n_pieces from pc")
def d4(spark, d):
    rows = fx.locs(spark, d).select("loc_id", F.col("pair").alias("component"), "x", "y")
    return G.split_oversized(rows, 50).select("loc_id", "component", "piece", "n_pieces")


@query("d5_partition_locs", f"""with {PIECES_SQL}, f as (select pair, min(loc_id) as parent from locs group by pair),
 cm as (select f.parent*1000000 + case when np>1 then piece+1 else 0 end as partition_id, f.parent as parent_id, loc_id, x, y, np from pc join f using (pair)),
 h as (select distinct a.partition_id, b.loc_id from cm a join cm b on a.parent_id=b.parent_id and a.partition_id<>b.partition_id and a.np>1 and sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))<=0.006e0),
 al as (select partition_id, loc_id, false as is_overlap from cm union all select partition_id, loc_id, true from h),
 w as (select al.*, l.x, l.y, l.sigma_x, l.sigma_y from al join locs l using (loc_id)),
 g as (select partition_id, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1, 3*median(sqrt(sigma_x*sigma_y)) as m from w group by all)
 select partition_id, loc_id, is_overlap, (x-x0<=m or x1-x<=m or y-y0<=m or y1-y<=m) as is_boundary from w join g using (partition_id)""")
def d5(spark, d):
    members, _ = G.partition_locs(fx.locs(spark, d), max_size=50, overlap=0.006)
    return members.select("partition_id", "loc_id", "is_overlap", "is_boundary")


@query("d6_core_partition_id", f"with {PIECES_SQL} select loc_id, partition_id from mem")
def d6(spark, d):
    members = N.halo(N.settle(pieces(spark, d), "pieces"), 0.006)
    return G.core_partition(fx.locs(spark, d), members).select("loc_id", "partition_id")
