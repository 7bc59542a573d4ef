"""One row per source: sums of precision terms, posterior means, scores, and other statistics of clusters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..exprs import inverse3
from .localizations import precision, scalar_contribution

LOG2PI = math.log(2 * math.pi)
SUMS = ("l_xx", "l_xy", "l_yy", "e_x", "e_y", "quad", "log_det")


def cluster_stats(locs: DataFrame, by: list[str]) -> DataFrame:
    """n and the sums of the precision terms; sums add, so they can be taken in parts and put together."""
    return precision(locs).groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in SUMS])


def remove_rows(stats: DataFrame, part: DataFrame, by: list[str]) -> DataFrame:
    """Statistics without those of a part of the rows."""
    p = part.select(*by, *[F.col(c).alias(f"_{c}") for c in ("n", *SUMS)])
    return stats.join(p, by, "left").select(*by, *[(F.col(c) - F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("n", *SUMS)])


def posterior(stats: DataFrame) -> DataFrame:
    """Adds x, y, v_xx, v_xy, v_yy: mean and covariance; (0, 0) and infinite where the precision is singular."""
    det = F.col("l_xx") * F.col("l_yy") - F.col("l_xy") ** 2
    ok, inf = det > 0, F.lit(float("inf"))
    cols = {
        "x": F.when(ok, (F.col("l_yy") * F.col("e_x") - F.col("l_xy") * F.col("e_y")) / det).otherwise(0.0),
        "y": F.when(ok, (F.col("l_xx") * F.col("e_y") - F.col("l_xy") * F.col("e_x")) / det).otherwise(0.0),
        "v_xx": F.when(ok, F.col("l_yy") / det).otherwise(inf),
        "v_xy": F.when(ok, -F.col("l_xy") / det).otherwise(0.0),
        "v_yy": F.when(ok, F.col("l_xx") / det).otherwise(inf),
    }
    return stats.withColumns(cols)


def emitters(labelled: DataFrame, by: list[str]) -> DataFrame:
    """One row per group: position, sigmas and the number of its rows."""
    p = posterior(cluster_stats(labelled, by))
    return p.select(*by, "x", "y", F.sqrt(F.greatest("v_xx", F.lit(0.0))).alias("sigma_x"), F.sqrt(F.greatest("v_yy", F.lit(0.0))).alias("sigma_y"), F.col("v_xy").alias("sigma_xy"), "n")


def emitters_3d(labelled: DataFrame, by: list[str]) -> DataFrame:
    """The same in three dimensions (sigma_z, sigma_xz, sigma_yz); rows' covariances must be positive definite."""
    v = lambda a: F.col(f"sigma_{a}") ** 2
    _, a, b, c, d, e, f = inverse3(v("x"), F.col("sigma_xy"), F.col("sigma_xz"), v("y"), F.col("sigma_yz"), v("z"))
    rows = labelled.withColumns({"a": a, "b": b, "c": c, "d": d, "e": e, "f": f})
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    rows = rows.withColumns({"p": F.col("a") * x + F.col("b") * y + F.col("c") * z, "q": F.col("b") * x + F.col("d") * y + F.col("e") * z, "r": F.col("c") * x + F.col("e") * y + F.col("f") * z})
    s = rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(k).alias(k) for k in "abcdefpqr"])
    _, A, B, C, D, E, G = inverse3(*[F.col(k) for k in "abcdef"])
    p, q, r = F.col("p"), F.col("q"), F.col("r")
    return s.select(*by, (A * p + B * q + C * r).alias("x"), (B * p + D * q + E * r).alias("y"), (C * p + E * q + G * r).alias("z"), F.sqrt(A).alias("sigma_x"), F.sqrt(D).alias("sigma_y"), F.sqrt(G).alias("sigma_z"), "n")


def log_ml(n: Column, log_det: Column, quad: Column, l_xx: Column, l_xy: Column, l_yy: Column, e_x: Column, e_y: Column, log_area: Column | None = None) -> Column:
    """Log marginal likelihood of a cluster, its position integrated out; 0 for an empty one, -inf if singular."""
    det = l_xx * l_yy - l_xy * l_xy
    best = (l_yy * e_x * e_x - 2.0 * l_xy * e_x * e_y + l_xx * e_y * e_y) / det
    value = (1.0 - n) * LOG2PI - 0.5 * log_det - 0.5 * (quad - best) - 0.5 * F.log(det)
    if log_area is not None:
        value = value - log_area
    return F.when(n == 0, 0.0).when(det <= 0, F.lit(float("-inf"))).otherwise(value)


def stats_columns(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in ("n", "log_det", "quad", "l_xx", "l_xy", "l_yy", "e_x", "e_y")]


def log_predictive(clusters: DataFrame, rows: DataFrame, by: list[str], log_area: Column) -> DataFrame:
    """Gain of adding each row (loc_id) to each cluster of its group; -log area for an empty cluster."""
    r = precision(rows).select(*by, "loc_id", *[F.col(c).alias(f"r_{c}") for c in SUMS])
    both = clusters.join(r, by)
    plus = [F.col("n") + 1, *[F.col(c) + F.col(f"r_{c}") for c in ("log_det", "quad", "l_xx", "l_xy", "l_yy", "e_x", "e_y")]]
    return both.withColumn("gain", F.when(F.col("n") == 0, -log_area).otherwise(log_ml(*plus) - log_ml(*stats_columns())))


def multicue(locs: DataFrame, by: list[str], value: str, sigma: str) -> DataFrame:
    """Position block and one scalar cue: sums, means, variances, and the score summed over blocks."""
    terms = scalar_contribution(F.col(value), F.col(sigma))
    rows = precision(locs).withColumns({f"q_{k}": c for k, c in terms.items()})
    s = rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in SUMS], *[F.sum(f"q_{k}").alias(f"q_{k}") for k in terms])
    one = (1.0 - F.col("n")) * 0.5 * LOG2PI - 0.5 * F.col("q_log_det") - 0.5 * (F.col("q_quad") - F.col("q_e") ** 2 / F.col("q_l")) - 0.5 * F.log("q_l")
    return posterior(s).withColumns({"cue": F.col("q_e") / F.col("q_l"), "cue_var": F.lit(1.0) / F.col("q_l"), "score": log_ml(*stats_columns()) + one})


def motion_stats(locs: DataFrame, by: list[str]) -> DataFrame:
    """Statistics with the sums that a constant drift adds: delta times, and its square times, the precision."""
    p = precision(locs)
    d = F.col("delta")
    return p.groupBy(*by).agg(
        F.count("*").alias("n"),
        *[F.sum(c).alias(c) for c in SUMS],
        *[F.sum(d * F.col(c)).alias(f"b_{c[2:]}") for c in ("l_xx", "l_xy", "l_yy")],
        *[F.sum(d * d * F.col(c)).alias(f"c_{c[2:]}") for c in ("l_xx", "l_xy", "l_yy")],
        *[F.sum(d * F.col(c)).alias(f"d_{c[2:]}") for c in ("e_x", "e_y")],
    )


def motion_posterior(stats: DataFrame, drift_sigma: float) -> DataFrame:
    """Adds drift v_x, v_y and its covariance s_*, the position given it, and motion_score, the gain of the drift.

    S = C + 1/drift_sigma^2 - B A^-1 B, r = d - B A^-1 e; v = S^-1 r.
    """
    lam = 1.0 / drift_sigma**2
    c = F.col
    s = stats.withColumn("det_a", c("l_xx") * c("l_yy") - c("l_xy") ** 2)
    s = s.withColumns({"i_xx": c("l_yy") / c("det_a"), "i_xy": -c("l_xy") / c("det_a"), "i_yy": c("l_xx") / c("det_a")})
    # M = A^-1 B
    s = s.withColumns({
        "m_xx": c("i_xx") * c("b_xx") + c("i_xy") * c("b_xy"), "m_xy": c("i_xx") * c("b_xy") + c("i_xy") * c("b_yy"),
        "m_yx": c("i_xy") * c("b_xx") + c("i_yy") * c("b_xy"), "m_yy": c("i_xy") * c("b_xy") + c("i_yy") * c("b_yy"),
    })
    s = s.withColumns({
        "s_xx": c("c_xx") + lam - (c("b_xx") * c("m_xx") + c("b_xy") * c("m_yx")),
        "s_xy": c("c_xy") - (c("b_xx") * c("m_xy") + c("b_xy") * c("m_yy")),
        "s_yy": c("c_yy") + lam - (c("b_xy") * c("m_xy") + c("b_yy") * c("m_yy")),
        "r_x": c("d_x") - (c("m_xx") * c("e_x") + c("m_yx") * c("e_y")),
        "r_y": c("d_y") - (c("m_xy") * c("e_x") + c("m_yy") * c("e_y")),
    })
    s = s.withColumn("det_s", c("s_xx") * c("s_yy") - c("s_xy") ** 2)
    s = s.withColumns({"v_x": (c("s_yy") * c("r_x") - c("s_xy") * c("r_y")) / c("det_s"), "v_y": (c("s_xx") * c("r_y") - c("s_xy") * c("r_x")) / c("det_s")})
    s = s.withColumns({"g_x": c("e_x") - c("b_xx") * c("v_x") - c("b_xy") * c("v_y"), "g_y": c("e_y") - c("b_xy") * c("v_x") - c("b_yy") * c("v_y")})
    s = s.withColumns({"x": c("i_xx") * c("g_x") + c("i_xy") * c("g_y"), "y": c("i_xy") * c("g_x") + c("i_yy") * c("g_y")})
    gain = 0.5 * (c("r_x") * c("v_x") + c("r_y") * c("v_y")) - 0.5 * F.log("det_s") + 0.5 * math.log(lam * lam)
    return s.withColumns({"motion_score": log_ml(*stats_columns()) + gain, "drift_xx": c("s_yy") / c("det_s"), "drift_xy": -c("s_xy") / c("det_s"), "drift_yy": c("s_xx") / c("det_s")})


def motion_summary(post: DataFrame) -> DataFrame:
    """Mean and sample deviation of the drifts that are finite."""
    ok = post.filter(~F.isnan("v_x") & ~F.isnan("v_y") & (F.abs("v_x") < float("inf")) & (F.abs("v_y") < float("inf")))
    return ok.agg(F.count("*").alias("n"), *[f(f"v_{a}").alias(f"{k}_{a}") for a in "xy" for k, f in (("mean", F.avg), ("std", F.stddev_samp))])


def group_bic(labelled: DataFrame, by: str) -> DataFrame:
    """Log-likelihood of the rows about their groups' weighted means, number of groups, and -2 ll + 2 K log N."""
    mean = posterior(cluster_stats(labelled, [by])).select(by, F.col("x").alias("mx"), F.col("y").alias("my"))
    rows = precision(labelled).join(mean, by)
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    ll = -LOG2PI - 0.5 * F.col("log_det") - 0.5 * (F.col("l_xx") * dx * dx + 2.0 * F.col("l_xy") * dx * dy + F.col("l_yy") * dy * dy)
    g = rows.agg(F.sum(ll).alias("loglik"), F.countDistinct(by).alias("k"), F.count("*").alias("n"))
    return g.withColumn("bic", -2.0 * F.col("loglik") + 2.0 * F.col("k") * F.log("n"))


def count_summary(members: DataFrame, by: list[str]) -> DataFrame:
    """Rows per cluster, without clusters that hold a halo row."""
    return members.groupBy(*by).agg(F.count("*").alias("n"), F.bool_or("is_overlap").alias("h")).filter("not h").drop("h")


def initial_shape(counts: DataFrame) -> DataFrame:
    """1 / CV^2 of counts n, between 0.5 and 20; 2 where there are fewer than five or they don't vary."""
    g = counts.agg(F.count("*").alias("k"), F.avg("n").alias("m"), F.stddev_samp("n").alias("s"))
    value = F.least(F.lit(20.0), F.greatest(F.lit(0.5), (F.col("m") / F.col("s")) ** 2))
    return g.select(F.when((F.col("k") < 5), 2.0).when(F.col("s") == 0, 20.0).otherwise(value).alias("shape"))


def acceptance(moves: DataFrame) -> DataFrame:
    return moves.groupBy("move").agg(F.sum("accepted").alias("accepted"), F.sum("total").alias("total")).withColumn("rate", F.col("accepted") / F.col("total"))


def mad_sigma(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """1.4826 times the median distance from the median; 0 for fewer than two values."""
    m = df.groupBy(*by).agg(F.median(value).alias("_m"), F.count("*").alias("_n"))
    return df.join(m, by).groupBy(*by).agg(F.when(F.first("_n") < 2, 0.0).otherwise(1.4826 * F.median(F.abs(F.col(value) - F.col("_m")))).alias("mad"))
