"""Matching of labellings and positions, and point estimates from chain samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import settle, unsent
from .clusters import cluster_stats, emitters, posterior
from .neighbors import mutual_best, within
from .together import component_names, distances, label_sums

SAMPLE = ["partition_id", "chain_id", "iter"]


def near_boundary(em: DataFrame, marked: DataFrame, margin: float) -> DataFrame:
    """Emitters within twice the margin of a boundary row of their own partition."""
    rows = marked.filter("is_boundary").select("partition_id", "x", "y")
    hit = within(em, rows, 2.0 * margin, ["partition_id"], ["emitter_id"]).select("emitter_id").distinct()
    return em.join(hit, "emitter_id", "left_semi")


def overlap_discard(em: DataFrame, members: DataFrame) -> DataFrame:
    """Keep an emitter if its nearest core row is at least as near as its nearest halo row. Members are few per partition."""
    keys = [c for c in em.columns if c not in ("x", "y", "sigma_x", "sigma_y", "sigma_xy", "n")]
    both = em.select(*keys, "x", "y").join(members.select("partition_id", F.col("x").alias("_x"), F.col("y").alias("_y"), "is_overlap"), "partition_id")
    d2 = (F.col("x") - F.col("_x")) ** 2 + (F.col("y") - F.col("_y")) ** 2
    near = both.groupBy(*keys).agg(F.min(F.when(~F.col("is_overlap"), d2)).alias("own"), F.min(F.when(F.col("is_overlap"), d2)).alias("halo"))
    keep = near.filter(F.col("halo").isNull() | (F.col("own") <= F.col("halo"))).select(*keys)
    return em.join(keep, keys, "left_semi")


def dedup_boundary(em: DataFrame, margin: float) -> DataFrame:
    """Merge near-boundary emitters of different partitions that are one source.

    Candidates within the margin are matched one to one (each other's nearest, in rounds) and merged if nearer than
    twice the root of their summed variances; positions and covariances are weighted by 1 / determinant, variances add
    harmonically, counts add, and the second row goes.
    """
    edge = em.filter("near_boundary")
    cols = ["emitter_id", "partition_id", "x", "y", "sigma_x", "sigma_y", "sigma_xy", "n"]
    every = edge.withColumn("_all", F.lit(0))
    right = every.select("_all", *[F.col(c).alias(f"b_{c}") for c in cols]).withColumns({"x": F.col("b_x"), "y": F.col("b_y")})
    left = every.select("_all", *[F.col(c).alias(f"a_{c}") for c in cols]).withColumns({"x": F.col("a_x"), "y": F.col("a_y")})
    pairs = within(left, right, margin, ["_all"], [f"a_{c}" for c in cols]).filter("a_partition_id < b_partition_id")
    pairs = settle(pairs.withColumns({"_low": F.least("a_emitter_id", "b_emitter_id"), "_high": F.greatest("a_emitter_id", "b_emitter_id")}), "pairs")
    keys = settle(pairs.select(F.col("a_emitter_id").alias("a"), F.col("b_emitter_id").alias("b"), "d"), "candidates")
    both = keys.unionByName(keys.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))  # an emitter may be on either side
    best = mutual_best(both, ["a"], ["b"], [F.col("d"), F.least("a", "b"), F.greatest("a", "b")], []).filter("a < b").select(F.col("a").alias("_low"), F.col("b").alias("_high")).distinct()
    m = pairs.join(best, ["_low", "_high"])
    var = sum((F.col(f"{k}_sigma_{a}") ** 2 for k in "ab" for a in "xy"), F.lit(0.0))
    m = m.filter(F.col("d") < 2.0 * F.sqrt(var))
    w = {k: 1.0 / (F.col(f"{k}_sigma_x") ** 2 * F.col(f"{k}_sigma_y") ** 2 - F.col(f"{k}_sigma_xy") ** 2 + 1e-10) for k in "ab"}
    mean = lambda a: (w["a"] * F.col(f"a_{a}") + w["b"] * F.col(f"b_{a}")) / (w["a"] + w["b"])
    harm = lambda a: F.sqrt(1.0 / (1.0 / F.col(f"a_sigma_{a}") ** 2 + 1.0 / F.col(f"b_sigma_{a}") ** 2 + 1e-10))
    merged = settle(m.select(F.col("a_emitter_id").alias("emitter_id"), F.col("b_emitter_id").alias("_gone"), mean("x").alias("_x"), mean("y").alias("_y"), harm("x").alias("_sx"), harm("y").alias("_sy"), mean("sigma_xy").alias("_sxy"), (F.col("a_n") + F.col("b_n")).alias("_n")), "merged")
    left_over = em.join(merged.select(F.col("_gone").alias("emitter_id")), "emitter_id", "left_anti").join(merged.drop("_gone"), "emitter_id", "left")
    pick = lambda a, b: F.coalesce(b, a).alias(a)
    return left_over.select("emitter_id", "partition_id", pick("x", "_x"), pick("y", "_y"), pick("sigma_x", "_sx"), pick("sigma_y", "_sy"), pick("sigma_xy", "_sxy"), pick("n", "_n"), "near_boundary")


def contingency(samples: DataFrame, reference: DataFrame) -> DataFrame:
    """Rows shared by each reference cluster and each cluster of each sample."""
    ref = reference.select("partition_id", "loc_id", F.col("cluster").alias("ref"))
    return samples.join(unsent(ref), ["partition_id", "loc_id"]).groupBy(*SAMPLE, "ref", "cluster").agg(F.count("*").alias("n"))


def overlap_match(table: DataFrame) -> DataFrame:
    """One-to-one matches of reference and sample clusters with the largest overlaps; ties to the lower labels."""
    return mutual_best(table, ["ref"], ["cluster"], [F.desc("n"), F.col("ref"), F.col("cluster")], SAMPLE)


def position_match(a: DataFrame, b: DataFrame, by: list[str], aid: str, bid: str) -> DataFrame:
    """One-to-one matches of two small sets of positions in each group, by squared distance."""
    pairs = a.select(*by, aid, "x", "y").join(b.select(*by, bid, F.col("x").alias("_x"), F.col("y").alias("_y")), by)
    pairs = pairs.select(*by, aid, bid, ((F.col("x") - F.col("_x")) ** 2 + (F.col("y") - F.col("_y")) ** 2).alias("d2"))
    return mutual_best(pairs, [aid], [bid], [F.col("d2"), F.col(aid), F.col(bid)], by)


def co_assigned(samples: DataFrame) -> DataFrame:
    """Pairs i < j of rows in one cluster of one sample. Partitions are bounded by the partitioning's largest size."""
    s = samples.select(*SAMPLE, "cluster", "loc_id")
    b = s.withColumnRenamed("loc_id", "j")
    return s.withColumnRenamed("loc_id", "i").join(b, [*SAMPLE, "cluster"]).filter("i < j")


def within_group_pairs(locs: DataFrame, group: str) -> DataFrame:
    """Pairs inside each group: distance, variance of the difference along x, midpoint."""
    v = (F.col("sigma_x") ** 2).alias("v")
    a = locs.select(group, F.col("loc_id").alias("i"), F.col("x").alias("xa"), F.col("y").alias("ya"), v)
    b = locs.select(group, F.col("loc_id").alias("j"), F.col("x").alias("xb"), F.col("y").alias("yb"), v.alias("vb"))
    p = a.join(b, group).filter("i < j")
    return p.select(group, "i", "j", F.sqrt((F.col("xa") - F.col("xb")) ** 2 + (F.col("ya") - F.col("yb")) ** 2).alias("d"), (F.col("v") + F.col("vb")).alias("s2"), ((F.col("xa") + F.col("xb")) / 2).alias("mx"), ((F.col("ya") + F.col("yb")) / 2).alias("my"))


def map_n(hist: DataFrame, by: list[str]) -> DataFrame:
    """Number of sources from a histogram (k, n): the mode, and its lead over the second; where that is under 1.5 the
    largest mean of three neighbouring bins decides. Ties go to the smaller k."""
    span = hist.groupBy(*by).agg(F.max("k").alias("b"))
    dense = span.select(*by, F.explode(F.sequence(F.lit(0), F.col("b").cast("int"))).alias("k")).join(hist, [*by, "k"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy(*by)
    smooth = F.avg("n").over(w.orderBy("k").rowsBetween(-1, 1))
    d = dense.withColumn("m", smooth).withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "k"))).withColumn("order", F.row_number().over(w.orderBy(F.desc("m"), "k")))
    g = d.groupBy(*by).agg(F.max(F.when(F.col("rank") == 1, F.struct("k", "n"))).alias("top"), F.max(F.when(F.col("rank") == 2, F.col("n"))).alias("second"), F.max(F.when(F.col("order") == 1, F.col("k"))).alias("smooth"))
    lead = F.when(F.coalesce("second", F.lit(0)) == 0, F.lit(float("inf"))).otherwise(F.col("top.n") / F.col("second"))
    return g.select(*by, F.when(lead < 1.5, F.col("smooth")).otherwise(F.col("top.k")).alias("k"), lead.alias("confidence"))


def sample_k(samples: DataFrame) -> DataFrame:
    return samples.groupBy(*SAMPLE).agg(F.countDistinct("cluster").alias("k"))


def filter_k(samples: DataFrame, target: DataFrame) -> DataFrame:
    """Samples whose number of clusters is the target's k, or the nearest there is (the lower of two)."""
    ks = sample_k(samples)
    t = target.select("partition_id", F.col("k").alias("t"))
    best = ks.select("partition_id", "k").distinct().join(t, "partition_id").groupBy("partition_id").agg(F.min_by("k", F.struct(F.abs(F.col("k") - F.col("t")), F.col("k"))).alias("k"))
    return samples.join(ks.join(best, ["partition_id", "k"]).select(*SAMPLE), SAMPLE, "left_semi")


def sample_emitters(samples: DataFrame, locs: DataFrame) -> DataFrame:
    """Posterior mean and covariance of every cluster of every sample."""
    rows = samples.join(unsent(locs.select("loc_id", "x", "y", "sigma_x", "sigma_y", "sigma_xy")), "loc_id")
    return posterior(cluster_stats(rows, [*SAMPLE, "cluster"])).select(*SAMPLE, "cluster", "n", "x", "y", "v_xx", "v_xy", "v_yy")


def reference_sample(positions: DataFrame) -> DataFrame:
    """The sample whose mean position is nearest to the pooled centroid; the earliest of equal ones."""
    m = positions.groupBy(*SAMPLE).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    c = positions.groupBy("partition_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    d2 = F.round((F.col("mx") - F.col("cx")) ** 2 + (F.col("my") - F.col("cy")) ** 2, 18)
    return m.join(c, "partition_id").groupBy("partition_id").agg(F.min_by(F.struct("chain_id", "iter"), F.struct(d2, "chain_id", "iter")).alias("r")).select("partition_id", "r.*")


def median_refine(positions: DataFrame, start: DataFrame, rounds: int = 10) -> DataFrame:
    """partition_id, slot, x, y: match every sample to the reference, take medians by slot, repeat."""
    ref = settle(positions.join(start, SAMPLE, "left_semi").select("partition_id", F.col("cluster").alias("slot"), "x", "y"), "reference")
    for _ in range(rounds):
        pairs = positions.select(*SAMPLE, "cluster", "x", "y").join(ref.withColumnsRenamed({"x": "_x", "y": "_y"}), "partition_id")
        pairs = pairs.withColumn("d2", (F.col("x") - F.col("_x")) ** 2 + (F.col("y") - F.col("_y")) ** 2)
        m = mutual_best(pairs, ["slot"], ["cluster"], [F.col("d2"), F.col("slot"), F.col("cluster")], SAMPLE)
        ref = settle(m.groupBy("partition_id", "slot").agg(F.median("x").alias("x"), F.median("y").alias("y")), "reference")
    return ref


def mapn_collapsed(samples: DataFrame, locs: DataFrame, target: DataFrame | None = None, rounds: int = 10) -> DataFrame:
    """Emitters at the most likely number of sources: positions by median refinement, sigmas from the reference sample."""
    if target is None:
        target = map_n(sample_k(samples).groupBy("partition_id", "k").agg(F.count("*").alias("n")), ["partition_id"])
    chosen = settle(filter_k(samples, target), "chosen")
    pos = settle(sample_emitters(chosen, locs), "positions")
    start = settle(reference_sample(pos), "start")
    ref = median_refine(pos, start, rounds)
    own = pos.join(start, SAMPLE, "left_semi").select("partition_id", F.col("cluster").alias("slot"), F.sqrt("v_xx").alias("sigma_x"), F.sqrt("v_yy").alias("sigma_y"), F.col("v_xy").alias("sigma_xy"), "n")
    return ref.join(own, ["partition_id", "slot"])


def psm_components(samples: DataFrame, members: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Number of components of each partition's rows that are together in at least half of its samples."""
    links = component_names(samples, threshold)
    lab = members.join(links, ["partition_id", "loc_id"], "left").withColumn("c", F.coalesce("component", "loc_id"))
    return lab.groupBy("partition_id").agg(F.countDistinct("c").alias("k"))


def association_distance(samples: DataFrame, psm: DataFrame | None = None) -> DataFrame:
    """Sum over pairs of (together - p)^2 for each sample. p is that of the samples themselves, from the overlaps of
    their clusters; or that of a given table, in which only pairs that are together need a join."""
    if psm is None:
        return distances(samples)
    base = psm.groupBy("partition_id").agg(F.sum(F.col("p") * F.col("p")).alias("base"))
    pairs = co_assigned(samples).join(psm.select("partition_id", "i", "j", "p"), ["partition_id", "i", "j"])
    gain = pairs.groupBy(*SAMPLE).agg(F.sum(1.0 - 2.0 * F.col("p")).alias("gain"))
    every = samples.select(*SAMPLE).distinct().join(base, "partition_id", "left").join(gain, SAMPLE, "left")
    return every.select(*SAMPLE, (F.coalesce("base", F.lit(0.0)) + F.coalesce("gain", F.lit(0.0))).alias("distance"))


def dahl(samples: DataFrame, psm: DataFrame | None = None) -> DataFrame:
    """The labelling of each partition with the least association distance; the first of equal ones."""
    d = association_distance(samples, psm)
    best = d.groupBy("partition_id").agg(F.min_by(F.struct("chain_id", "iter"), F.struct(F.round("distance", 7), "chain_id", "iter")).alias("b")).select("partition_id", "b.*")
    return samples.join(best, SAMPLE, "left_semi")


def cluster_stability(labels: DataFrame, psm: DataFrame | None = None, samples: DataFrame | None = None) -> DataFrame:
    """Mean p of the pairs inside each cluster; 1 for single rows. p is that of ``samples``, from the overlaps of their
    clusters with the labels', or that of a given table of pairs."""
    if psm is None:
        sums = label_sums(labels, samples).groupBy("partition_id", "cluster").agg(F.sum("pairs").alias("pairs"), F.sum("p").alias("p"))
        inside = sums.filter("pairs > 0").select("partition_id", "cluster", (F.col("p") / F.col("pairs")).alias("stability"))
    else:
        inside = co_assigned(labels).join(psm.select("partition_id", "i", "j", "p"), ["partition_id", "i", "j"], "left").groupBy("partition_id", "cluster").agg(F.avg(F.coalesce("p", F.lit(0.0))).alias("stability"))
    return labels.groupBy("partition_id", "cluster").agg(F.count("*").alias("n")).join(inside, ["partition_id", "cluster"], "left").withColumn("stability", F.coalesce("stability", F.lit(1.0)))


def mapn_overlap(samples: DataFrame, locs: DataFrame, psm: DataFrame | None = None) -> DataFrame:
    """Consensus positions: samples with the reference labelling's number of clusters are matched to it by overlap.

    A sample with a total overlap under half of the rows is skipped, a cluster needs half of its reference's rows;
    positions are means of the matched means, covariances the mean analytic one plus the sample covariance where
    there are three or more. A cluster that nothing matches keeps the reference's own estimate.
    """
    ref = settle(dahl(samples, psm), "reference")
    k = ref.groupBy("partition_id").agg(F.countDistinct("cluster").alias("k"), F.count("*").alias("rows"))
    same = sample_k(samples).join(k, ["partition_id", "k"]).select(*SAMPLE)
    chosen = samples.join(same, SAMPLE, "left_semi")
    m = settle(overlap_match(contingency(chosen, ref)), "matched")
    enough = m.groupBy(*SAMPLE).agg(F.sum("n").alias("total")).join(k, "partition_id").filter("total >= rows div 2").select(*SAMPLE)
    size = ref.groupBy("partition_id", F.col("cluster").alias("ref")).agg(F.count("*").alias("size"))
    good = m.join(enough, SAMPLE, "left_semi").join(size, ["partition_id", "ref"]).filter("n >= 0.5 * size").select(*SAMPLE, "cluster", "ref")
    pos = sample_emitters(chosen, locs).drop("n").join(good, [*SAMPLE, "cluster"])
    g = pos.groupBy("partition_id", "ref").agg(
        F.count("*").alias("m"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("v_xx").alias("vx"), F.avg("v_yy").alias("vy"), F.avg("v_xy").alias("vxy"),
        F.var_samp("x").alias("sx"), F.var_samp("y").alias("sy"), F.covar_samp("x", "y").alias("sxy"),
    )
    extra = lambda c: F.when(F.col("m") >= 3, F.col(c)).otherwise(0.0)
    g = g.select("partition_id", F.col("ref").alias("cluster"), "mx", "my", (F.col("vx") + extra("sx")).alias("wx"), (F.col("vy") + extra("sy")).alias("wy"), (F.col("vxy") + extra("sxy")).alias("wxy"))
    own = emitters(ref.join(unsent(locs.select("loc_id", "x", "y", "sigma_x", "sigma_y", "sigma_xy")), "loc_id"), ["partition_id", "cluster"])
    out = own.join(g, ["partition_id", "cluster"], "left")
    return out.select("partition_id", "cluster", F.coalesce("mx", "x").alias("x"), F.coalesce("my", "y").alias("y"), F.coalesce(F.sqrt("wx"), "sigma_x").alias("sigma_x"), F.coalesce(F.sqrt("wy"), "sigma_y").alias("sigma_y"), F.coalesce("wxy", "sigma_xy").alias("sigma_xy"), "n")


def _xlogx(c: Column) -> Column:
    return F.when(c > 0, c * F.log(c)).otherwise(0.0)


def vi_distance(table: DataFrame, by: list[str]) -> DataFrame:
    """Variation of information from a contingency table (ref, cluster, n)."""
    n = F.col("n").cast("double")
    joint = table.groupBy(*by).agg(F.sum(n).alias("t"), F.sum(_xlogx(n)).alias("j"))
    side = lambda c, a: table.groupBy(*by, c).agg(F.sum(n).alias("m")).groupBy(*by).agg(F.sum(_xlogx(F.col("m"))).alias(a))
    v = joint.join(side("ref", "a"), by).join(side("cluster", "b"), by)
    return v.select(*by, ((F.col("a") + F.col("b") - 2.0 * F.col("j")) / F.col("t")).alias("vi"))


def _vi_sums(own: list[tuple], others: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Each own sample's variation of information, summed over the other samples that share rows with it, and their
    number; samples are (rows, labels), sorted by row.

    All others over the same rows are counted together: one sort of (other, own label, other's label) per own sample.
    """
    out, count = np.zeros(len(own)), np.zeros(len(own), np.int64)
    alike: dict[bytes, list[np.ndarray]] = {}
    for rows, labels in others:
        alike.setdefault(rows.tobytes(), []).append(labels)
    for i, (rows, labels) in enumerate(own):
        for key, group in alike.items():
            theirs = np.frombuffer(key, rows.dtype)
            at, to = (slice(None), slice(None)) if key == rows.tobytes() else np.intersect1d(rows, theirs, True, True)[1:]
            a = np.unique(labels[at], return_inverse=True)[1]
            b = np.stack([np.unique(g[to], return_inverse=True)[1] for g in group])
            if not len(a):
                continue
            ka, kb = a.max() + 1, b.max() + 1
            both, n = np.unique(((np.arange(len(b))[:, None] * ka + a) * kb + b).ravel(), return_counts=True)
            side, m = np.unique((np.arange(len(b))[:, None] * kb + b).ravel(), return_counts=True)
            na = np.bincount(a)
            own_sum = len(b) * float((na * np.log(na)).sum())
            out[i] += (own_sum + float((m * np.log(m)).sum()) - 2.0 * float((n * np.log(n)).sum())) / len(a)
            count[i] += len(b)
    return out, count


def vi_select(samples: DataFrame, thin: int = 1, block: int = 64) -> DataFrame:
    """The visited sample with the least mean variation of information to all (thinned) samples; the first of equal ones.

    A sample is one vector of labels in the order of its rows, as long as its partition's ``max_size`` allows. Vectors
    meet in blocks of ``block`` of them, so no table has a row for each pair of samples or for their common rows; two
    samples are compared on the rows that both have; a sample's mean is over those it has any in common with, itself
    included.
    """
    s = samples.filter(F.col("iter") % thin == 0) if thin > 1 else samples
    rows = F.sort_array(F.collect_list(F.struct(F.col("loc_id").cast("long").alias("r"), F.col("cluster").cast("long").alias("c"))))
    vectors = s.filter("loc_id is not null and cluster is not null").groupBy(*SAMPLE).agg(rows.alias("v"))
    order = F.row_number().over(Window.partitionBy("partition_id").orderBy("chain_id", "iter"))
    number = vectors.select(*SAMPLE).withColumn("b", F.floor((order - 1) / block))  # of keys alone
    vectors = settle(vectors.join(number, SAMPLE).select("partition_id", "b", F.struct("chain_id", "iter", F.col("v.r").alias("rows"), F.col("v.c").alias("labels")).alias("s")), "vectors")
    blocks = settle(vectors.groupBy("partition_id", "b").agg(F.sort_array(F.collect_list("s")).alias("s")), "blocks")
    both = blocks.select("partition_id", F.col("s").alias("own")).join(blocks.select("partition_id", F.col("s").alias("others")), "partition_id")
    kinds = {f.name: f.dataType.simpleString() for f in samples.schema}
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in SAMPLE], "vi double", "n long"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = lambda c: [[(np.array(v["rows"], np.int64), np.array(v["labels"], np.int64)) for v in s] for s in c]
        for t in batches:
            own, others = t.column("own").to_pylist(), t.column("others").to_pylist()
            for part, a, x, y in zip(t.column("partition_id").to_pylist(), own, unpack(own), unpack(others), strict=True):
                sums, count = _vi_sums(x, y)
                yield pa.RecordBatch.from_pydict({
                    "partition_id": pa.array([part] * len(a), t.schema.field("partition_id").type),
                    "chain_id": pa.array([v["chain_id"] for v in a], own_type(t, "chain_id")), "iter": pa.array([v["iter"] for v in a], own_type(t, "iter")),
                    "vi": pa.array(sums), "n": pa.array(count),
                })

    def own_type(t: pa.RecordBatch, name: str) -> pa.DataType:
        return t.schema.field("own").type.value_type.field(name).type

    sums = both.mapInArrow(compare, schema).groupBy(*SAMPLE).agg((F.sum("vi") / F.sum("n")).alias("vi"))
    best = sums.groupBy("partition_id").agg(F.min_by(F.struct("chain_id", "iter", "vi"), F.struct(F.round("vi", 9), "chain_id", "iter")).alias("b"))
    return best.select("partition_id", "b.chain_id", "b.iter", "b.vi")


def global_labels(labels: DataFrame, members: DataFrame) -> DataFrame:
    """One label per row, from its core partition, unique over partitions; numbered in order of (partition, cluster).

    Numbers are dense, so they are the ranks in one ordered list of clusters (not of rows)."""
    core = labels.join(members.filter("not is_overlap").select("partition_id", "loc_id"), ["partition_id", "loc_id"])
    names = core.select("partition_id", "cluster").distinct()
    per = names.groupBy("partition_id").agg(F.count("*").alias("k"))
    before = per.withColumn("before", F.sum("k").over(Window.orderBy("partition_id").rowsBetween(Window.unboundedPreceding, -1)))
    rank = names.withColumn("rank", F.row_number().over(Window.partitionBy("partition_id").orderBy("cluster")))
    numbered = rank.join(before, "partition_id").select("partition_id", "cluster", (F.coalesce("before", F.lit(0)) + F.col("rank")).alias("label"))
    return core.join(numbered, ["partition_id", "cluster"]).select("loc_id", "label")
