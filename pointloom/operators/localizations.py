"""Per-row work on localizations: normalizing, checking, uncertainty correction, precision terms, boxes, sizes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..exprs import mean_sigma

REQUIRED = ("x", "y", "sigma_x", "sigma_y")


def normalize(df: DataFrame) -> DataFrame:
    """Columns every operator relies on: a missing or null sigma_xy is 0, coordinates and sigmas are doubles."""
    out = df
    for c in REQUIRED:
        out = out.withColumn(c, F.col(c).cast("double"))
    return out.withColumn("sigma_xy", F.coalesce(F.col("sigma_xy").cast("double"), F.lit(0.0)) if "sigma_xy" in df.columns else F.lit(0.0))


def check_rows(df: DataFrame) -> DataFrame:
    """One row: how many rows there are, and how many are unusable, by reason."""
    missing = ~F.lit(True)
    for c in REQUIRED:
        missing = missing | F.col(c).isNull() | F.isnan(c)
    flat = (F.col("sigma_x") <= 0) | (F.col("sigma_y") <= 0)
    depth = F.col("z").isNotNull() if "z" in df.columns else F.lit(False)
    count = lambda c: F.count(F.when(c, 1))
    return df.agg(F.count("*").alias("n_rows"), count(missing).alias("n_missing"), count(~missing & flat).alias("n_flat"), count(depth).alias("n_depth"))


def validate(df: DataFrame, two_d: bool = True) -> DataFrame:
    """The normalized rows; raises on rows that can't be used, and on depth where only two dimensions are meant."""
    r = check_rows(df).first()
    if r["n_missing"] or r["n_flat"]:
        raise ValueError(f"{r['n_missing']} rows with missing values and {r['n_flat']} with a sigma that isn't positive")
    if two_d and r["n_depth"]:
        raise ValueError(f"{r['n_depth']} rows have a z; this path is for two dimensions")
    return normalize(df)


def resolve_tau(df: DataFrame, tau) -> DataFrame:
    """Columns tau_x, tau_y from a number, a pair of numbers, a column's name or a pair of names; all must be >= 0."""
    tx, ty = tau if isinstance(tau, (tuple, list)) else (tau, tau)
    col = lambda t: F.col(t).cast("double") if isinstance(t, str) else F.lit(float(t))
    out = df.withColumn("tau_x", col(tx)).withColumn("tau_y", col(ty))
    low = out.agg(F.min(F.least("tau_x", "tau_y")).alias("m")).first()["m"]
    if low is not None and low < 0:
        raise ValueError("tau must not be negative")
    return out


def apply_tau(df: DataFrame, tau, force: bool = False) -> DataFrame:
    """sigma' = sqrt(sigma^2 + tau^2); the covariance stays. Rows marked sigma_corrected stay too unless forced."""
    done = F.coalesce(F.col("sigma_corrected"), F.lit(False)) if "sigma_corrected" in df.columns else F.lit(False)
    keep = done & F.lit(not force)
    out = resolve_tau(df, tau)
    for a in "xy":
        out = out.withColumn(f"sigma_{a}", F.when(keep | (F.col(f"tau_{a}") == 0), F.col(f"sigma_{a}")).otherwise(F.sqrt(F.col(f"sigma_{a}") ** 2 + F.col(f"tau_{a}") ** 2)))
    return out.withColumn("sigma_corrected", done | (F.col("tau_x") > 0) | (F.col("tau_y") > 0)).drop("tau_x", "tau_y")


def precision(df: DataFrame) -> DataFrame:
    """Adds l_xx, l_xy, l_yy (inverse covariance), e_x, e_y, quad, log_det, pos_sigma; a covariance that isn't
    positive definite falls back to its diagonal."""
    vx, vy = F.col("sigma_x") ** 2, F.col("sigma_y") ** 2
    raw = vx * vy - F.col("sigma_xy") ** 2
    c = F.when(raw > 0, F.col("sigma_xy")).otherwise(0.0)
    det = F.when(raw > 0, raw).otherwise(vx * vy)
    out = df.withColumns({"l_xx": vy / det, "l_xy": -c / det, "l_yy": vx / det, "log_det": F.log(det), "pos_sigma": F.sqrt(vx + vy)})
    out = out.withColumns({"e_x": F.col("l_xx") * F.col("x") + F.col("l_xy") * F.col("y"), "e_y": F.col("l_xy") * F.col("x") + F.col("l_yy") * F.col("y")})
    return out.withColumn("quad", F.col("x") * F.col("e_x") + F.col("y") * F.col("e_y"))


def scalar_contribution(value: Column, sigma: Column) -> dict[str, Column]:
    """The same terms of one scalar cue."""
    w = F.lit(1.0) / (sigma * sigma)
    return {"l": w, "e": w * value, "quad": w * value * value, "log_det": 2.0 * F.log(sigma)}


def motion_delta(df: DataFrame) -> DataFrame:
    """Adds delta: the frame's distance from the middle of all frames, as a share of their span (at least one)."""
    span = df.agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"))
    both = df.crossJoin(F.broadcast(span))  # one row
    return both.withColumn("delta", (F.col("frame") - (F.col("lo") + F.col("hi")) / 2.0) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))).drop("lo", "hi")


def bounding_box(df: DataFrame) -> DataFrame:
    """One row of bounds, or none for an empty table or one without extent."""
    b = df.agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))
    return b.filter((F.col("x_max") > F.col("x_min")) & (F.col("y_max") > F.col("y_min")))


def padded_box(df: DataFrame, by: list[str]) -> DataFrame:
    """Bounds by group, padded by max(5 % of the extent, 3 mean sigmas) and scaled about their middle up to a floor
    area of n * pi * (3 median sigma)^2, sigma being the mean of both axes'."""
    sigma = (F.col("sigma_x") + F.col("sigma_y")) / 2.0
    g = df.groupBy(*by).agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.avg("sigma_x").alias("mx"), F.avg("sigma_y").alias("my"), F.median(sigma).alias("ms"))
    for a in "xy":
        pad = F.greatest(0.05 * (F.col(f"{a}1") - F.col(f"{a}0")), 3.0 * F.col(f"m{a}"))
        g = g.withColumn("p", pad).withColumn(f"{a}0", F.col(f"{a}0") - F.col("p")).withColumn(f"{a}1", F.col(f"{a}1") + F.col("p")).drop("p")
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    floor = F.col("n") * math.pi * (3.0 * F.col("ms")) ** 2
    g = g.withColumn("s", F.when(area < floor, F.sqrt(floor / area)).otherwise(1.0))
    out = {}
    for a in "xy":
        mid, half = (F.col(f"{a}0") + F.col(f"{a}1")) / 2.0, (F.col(f"{a}1") - F.col(f"{a}0")) / 2.0 * F.col("s")
        out |= {f"{a}_min": mid - half, f"{a}_max": mid + half}
    return g.select(*by, "n", *[c.alias(k) for k, c in out.items()])


def field_of_view(df: DataFrame, margin: float | None = None) -> DataFrame:
    """Bounds of all one-sigma circles and a margin: the given one or 5 median sigmas, at least 0.010."""
    s = mean_sigma(F.col("sigma_x"), F.col("sigma_y"))
    g = df.agg(F.min(F.col("x") - F.col("sigma_x")).alias("x0"), F.max(F.col("x") + F.col("sigma_x")).alias("x1"), F.min(F.col("y") - F.col("sigma_y")).alias("y0"), F.max(F.col("y") + F.col("sigma_y")).alias("y1"), F.median(s).alias("ms"))
    m = F.greatest(F.lit(float(margin)) if margin is not None else 5.0 * F.col("ms"), F.lit(0.010))
    return g.select((F.col("x0") - m).alias("x_min"), (F.col("x1") + m).alias("x_max"), (F.col("y0") - m).alias("y_min"), (F.col("y1") + m).alias("y_max"))


def exposure(df: DataFrame, by: list[str]) -> DataFrame:
    """Each group's share of the field's area by its share of the rows."""
    box = bounding_box(df).select(((F.col("x_max") - F.col("x_min")) * (F.col("y_max") - F.col("y_min"))).alias("area"))
    total = df.agg(F.count("*").alias("total"))
    g = df.groupBy(*by).agg(F.count("*").alias("n"))
    return g.crossJoin(F.broadcast(box)).crossJoin(F.broadcast(total)).select(*by, "n", (F.col("area") * F.col("n") / F.col("total")).alias("exposure"))


def mark_boundary(df: DataFrame, by: list[str], n_sigma: float = 3.0, margin: float | None = None) -> DataFrame:
    """Adds is_boundary: within the margin (n_sigma median sigmas of the group) of its group's box on any side."""
    s = mean_sigma(F.col("sigma_x"), F.col("sigma_y"))
    g = df.groupBy(*by).agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"), F.median(s).alias("_ms"))
    m = F.lit(margin) if margin is not None else F.lit(n_sigma) * F.col("_ms")
    near = (F.col("x") - F.col("_x0") <= m) | (F.col("_x1") - F.col("x") <= m) | (F.col("y") - F.col("_y0") <= m) | (F.col("_y1") - F.col("y") <= m)
    return df.join(g, by).withColumn("is_boundary", near).drop("_x0", "_x1", "_y0", "_y1", "_ms")


def log_spatial_prior(x: Column, y: Column, box: dict[str, Column]) -> Column:
    """-log(area) inside the box, minus infinity outside."""
    inside = (x >= box["x_min"]) & (x <= box["x_max"]) & (y >= box["y_min"]) & (y <= box["y_max"])
    area = (box["x_max"] - box["x_min"]) * (box["y_max"] - box["y_min"])
    return F.when(inside, -F.log(area)).otherwise(F.lit(float("-inf")))


def size_filter(df: DataFrame, by: str, max_size: int, skip_size: int) -> DataFrame:
    """Groups with their size and what is done with them: kept, split or skipped."""
    g = df.groupBy(by).agg(F.count("*").alias("n"))
    return g.withColumn("action", F.when(F.col("n") >= skip_size, "skip").when(F.col("n") > max_size, "split").otherwise("keep"))

