"""Aggregations over chain samples (partition_id, chain_id, iter, loc_id, cluster) and sparse rasters."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..exprs import phi_cdf
from .consensus import SAMPLE, sample_emitters, sample_k
from .together import pair_counts

#: Aggregations over samples by name: functions of (samples, ...) -> DataFrame. Spark's final aggregation merges.
AGGREGATIONS: dict = {}


def aggregation(f):
    AGGREGATIONS[f.__name__] = f
    return f


@aggregation
def emitter_count_hist(samples: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How many samples have k clusters."""
    by = ["partition_id"] if by is None else by
    return sample_k(samples).groupBy(*by, "k").agg(F.count("*").alias("n"))


@aggregation
def core_weighted_k(samples: DataFrame, members: DataFrame) -> DataFrame:
    """Clusters of each sample, each counted by the share of its rows that are core rows."""
    s = samples.join(members.select("partition_id", "loc_id", "is_overlap"), ["partition_id", "loc_id"])
    c = s.groupBy(*SAMPLE, "cluster").agg(F.avg(F.when(F.col("is_overlap"), 0.0).otherwise(1.0)).alias("w"))
    return c.groupBy(*SAMPLE).agg(F.sum("w").alias("k"))


@aggregation
def field_k_posterior(weighted: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Histogram of the field's number of sources: partitions are summed by iteration (or ``by``), then rounded (half to even)."""
    f = weighted.groupBy(*(by or ["iter"])).agg(F.sum("k").alias("k"))
    return f.select(F.rint(F.round("k", 9)).cast("long").alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@aggregation
def convergence_trace(weighted: DataFrame, hyper: DataFrame) -> DataFrame:
    """The field's number of sources with the shared parameters of each recorded iteration."""
    return weighted.groupBy("iter").agg(F.rint(F.round(F.sum("k"), 9)).cast("long").alias("k")).join(hyper, "iter")


@aggregation
def thin(samples: DataFrame, burn_in: int, every: int = 5) -> DataFrame:
    return samples.filter((F.col("iter") > burn_in) & ((F.col("iter") - burn_in) % every == 0))


@aggregation
def psm(samples: DataFrame) -> DataFrame:
    """Pairs of rows that are together in some sample, and in what share of them. Only such pairs are stored."""
    return pair_counts(samples)


@aggregation
def nn_dist_hist(samples: DataFrame, locs: DataFrame, top: float = 0.1, bins: int = 100) -> DataFrame:
    """Histogram of the distance of every cluster mean to the nearest other one of its sample."""
    e = sample_emitters(samples, locs).select(*SAMPLE, "cluster", "x", "y")
    o = e.withColumnsRenamed({"cluster": "_c", "x": "_x", "y": "_y"})
    d = e.join(o, SAMPLE).filter("cluster != _c").groupBy(*SAMPLE, "cluster").agg(F.min(F.sqrt((F.col("x") - F.col("_x")) ** 2 + (F.col("y") - F.col("_y")) ** 2)).alias("d"))
    return d.filter(F.col("d") < top).groupBy(F.floor(F.col("d") / (top / bins)).alias("bin")).agg(F.count("*").alias("n"))


#: Up to this correlation a pixel's mass is a series in it; beyond, columns are integrated with fixed nodes.
WEAK = 0.1
_HERMITE_TERMS = 8
#: Eight Gauss-Legendre nodes on [-1, 1] and their weights. Fixed values.
_NODES8 = (
    (-0.9602898564975363, 0.1012285362903763), (-0.7966664774136267, 0.2223810344533745), (-0.5255324099163290, 0.3137066458778873), (-0.1834346424956498, 0.3626837833783620),
    (0.1834346424956498, 0.3626837833783620), (0.5255324099163290, 0.3137066458778873), (0.7966664774136267, 0.2223810344533745), (0.9602898564975363, 0.1012285362903763),
)


def _pdf(z):
    return F.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


def _weak_mass(df: DataFrame) -> DataFrame:
    """Adds m, by the tetrachoric series: sum rho^k/k! times differences of phi He_{k-1} along both axes."""
    edges = ("ex0", "ex1", "ey0", "ey1")
    df = df.withColumns({f"p_{e}": phi_cdf(F.col(e)) for e in edges}).withColumns({f"d_{e}": _pdf(F.col(e)) for e in edges})
    value = (F.col("p_ex1") - F.col("p_ex0")) * (F.col("p_ey1") - F.col("p_ey0"))
    he = {e: [F.lit(1.0), F.col(e)] for e in edges}
    for k in range(2, _HERMITE_TERMS):
        for e in edges:
            he[e].append(F.col(e) * he[e][-1] - float(k - 1) * he[e][-2])
    power = F.col("rho")
    for k in range(1, _HERMITE_TERMS + 1):
        x, y = (F.col(f"d_e{a}1") * he[f"e{a}1"][k - 1] - F.col(f"d_e{a}0") * he[f"e{a}0"][k - 1] for a in "xy")
        value = value + power * x * y / float(math.factorial(k))
        power = power * F.col("rho")
    return df.withColumn("m", value)


def _strong_mass(df: DataFrame) -> DataFrame:
    """Adds m: the conditional normal integrated over each pixel's column at fixed nodes."""
    nodes = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(w).alias("w")) for x, w in _NODES8])
    s = F.sqrt(1.0 - F.col("rho") * F.col("rho"))
    n = df.withColumn("_n", F.explode(nodes)).withColumn("u", (F.col("ex0") + F.col("ex1")) / 2.0 + (F.col("ex1") - F.col("ex0")) / 2.0 * F.col("_n.x"))
    n = n.withColumns({"p1": phi_cdf((F.col("ey1") - F.col("rho") * F.col("u")) / s), "p0": phi_cdf((F.col("ey0") - F.col("rho") * F.col("u")) / s)})
    part = F.col("_n.w") * _pdf(F.col("u")) * (F.col("p1") - F.col("p0")) * (F.col("ex1") - F.col("ex0")) / 2.0
    return n.groupBy("_id", "w", "ix", "iy").agg(F.sum(part).alias("m"))


@aggregation
def posterior_raster(clusters: DataFrame, pixel: float, weight: str | None = None) -> DataFrame:
    """ix, iy, mass: each cluster's Gaussian (x, y, v_xx, v_xy, v_yy) integrated over the pixels of its four-sigma box,
    scaled to its weight, and summed. Pixels are numbered on one lattice for all partitions."""
    c = clusters.withColumns({"sx": F.sqrt("v_xx"), "sy": F.sqrt("v_yy"), "w": F.col(weight) if weight else F.lit(1.0)})
    c = c.withColumn("rho", F.greatest(F.lit(-0.999), F.least(F.lit(0.999), F.col("v_xy") / (F.col("sx") * F.col("sy"))))).withColumn("_id", F.monotonically_increasing_id())
    for a in "xy":
        lo, hi = (F.floor((F.col(a) + k * 4.0 * F.col(f"s{a}")) / pixel) for k in (-1, 1))
        c = c.withColumn(f"i{a}", F.explode(F.sequence(lo, hi)))
    edge = lambda a, k: ((F.col(f"i{a}") + k) * pixel - F.col(a)) / F.col(f"s{a}")
    # the edges are columns first, so that each is computed once
    for a in "xy":
        for k in (0, 1):
            c = c.withColumn(f"e{a}{k}", edge(a, k))
    weak = F.abs(F.col("rho")) <= WEAK
    c = _weak_mass(c.filter(weak)).select("_id", "w", "ix", "iy", "m").unionByName(_strong_mass(c.filter(~weak)))
    total = F.sum("m").over(Window.partitionBy("_id"))
    return c.withColumn("m", F.col("w") * F.col("m") / total).groupBy("ix", "iy").agg(F.sum("m").alias("mass"))


def lattice(df: DataFrame, pixel: float, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Adds the pixel keys of x, y on the lattice through the origin."""
    return df.withColumns({"ix": F.floor((F.col("x") - origin[0]) / pixel), "iy": F.floor((F.col("y") - origin[1]) / pixel)})


def partition_lattice(locs: DataFrame, by: list[str], pixel: float) -> DataFrame:
    """Pixel range of each group's grid on the common lattice: its rows, and three largest sigmas and a pixel around."""
    g = locs.groupBy(*by).agg(F.max(F.greatest("sigma_x", "sigma_y")).alias("s"), *[f(a).alias(f"{k}{a}") for a in "xy" for k, f in (("lo", F.min), ("hi", F.max))])
    pad = 3.0 * F.col("s") + pixel
    return g.select(*by, *[F.floor((F.col(f"lo{a}") - pad) / pixel).alias(f"i{a}0") for a in "xy"], *[F.floor((F.col(f"hi{a}") + pad) / pixel).alias(f"i{a}1") for a in "xy"])


def merge_rasters(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("ix", "iy").agg(F.sum("mass").alias("mass"))


def merge_by_centre(raster: DataFrame, pixel: float, origin: tuple[float, float], to_pixel: float, to_origin: tuple[float, float], shape: tuple[int, int]) -> DataFrame:
    """Put pixels into those of another lattice in which their centres lie; what falls outside is dropped."""
    at = lambda k, i: F.floor(((F.col(i) + 0.5) * pixel + origin[k] - to_origin[k]) / to_pixel)
    moved = raster.select(at(0, "ix").alias("ix"), at(1, "iy").alias("iy"), "mass")
    return moved.filter((F.col("ix") >= 0) & (F.col("iy") >= 0) & (F.col("ix") < shape[0]) & (F.col("iy") < shape[1])).groupBy("ix", "iy").agg(F.sum("mass").alias("mass"))


def resample(raster: DataFrame, pixel: float, to_pixel: float) -> DataFrame:
    """Resample to another pixel size, conserving mass: shares by overlapping area."""
    r = raster
    for a in "xy":
        lo, hi = F.col(f"i{a}") * pixel, (F.col(f"i{a}") + 1) * pixel
        r = r.withColumn(f"j{a}", F.explode(F.sequence(F.floor(lo / to_pixel), F.ceil(hi / to_pixel) - 1)))
        share = F.greatest(F.lit(0.0), F.least(hi, (F.col(f"j{a}") + 1) * to_pixel) - F.greatest(lo, F.col(f"j{a}") * to_pixel)) / pixel
        r = r.withColumn(f"s{a}", share)
    return r.filter("sx > 0 and sy > 0").groupBy(F.col("jx").alias("ix"), F.col("jy").alias("iy")).agg(F.sum(F.col("mass") * F.col("sx") * F.col("sy")).alias("mass"))


def percentile_scale(raster: DataFrame, p: float = 0.99) -> DataFrame:
    """Adds level, 0 to 255: the order statistic round(p n) of the non-zero pixels becomes 255, more is clipped."""
    some = raster.filter("mass > 0")
    n = some.agg(F.count("*").alias("n"))
    counts = some.groupBy("mass").agg(F.count("*").alias("c"))
    # a value's rank from counts of equal values, found by a running total over values in ranges
    top = some.crossJoin(F.broadcast(n)).agg(F.max(F.greatest(F.lit(1), F.rint(F.lit(p) * F.col("n")).cast("long"))).alias("k")).first()["k"]
    value = order_statistic(counts, "mass", int(top or 1))
    return raster.withColumn("level", F.rint(F.least(F.lit(255.0), F.col("mass") / (value or 1.0) * 255.0)).cast("int"))


def order_statistic(counts: DataFrame, value: str, k: int) -> float | None:
    """The k-th smallest value of (value, c): narrow the range of values until few are left. No global sort."""
    df = counts.select(F.col(value).alias("v"), "c")
    box = df.agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count("*").alias("n")).first()
    if not box["n"]:
        return None
    a, b, before, n = box["a"], box["b"], 0, box["n"]
    while n > 1000 and b > a:
        width = (b - a) / 1000
        bin_ = F.least(F.lit(999), F.floor((F.col("v") - a) / width))
        rows = sorted(df.filter((F.col("v") >= a) & (F.col("v") <= b)).groupBy(bin_.alias("bin")).agg(F.sum("c").alias("c"), F.min("v").alias("a"), F.max("v").alias("b"), F.count("*").alias("n")).collect(), key=lambda r: r["bin"])
        for r in rows:
            if before + r["c"] >= k:
                a, b, n = r["a"], r["b"], r["n"]
                break
            before += r["c"]
    for r in df.filter((F.col("v") >= a) & (F.col("v") <= b)).orderBy("v").limit(2000).collect():
        before += r["c"]
        if before >= k:
            return r["v"]
    return b


def k_trace(samples: DataFrame, every: int = 1) -> DataFrame:
    """Number of clusters of each (thinned) iteration of each chain."""
    return sample_k(samples.filter(F.col("iter") % every == 0) if every > 1 else samples)
