"""Column expressions that Spark has no function for. All stay in generated JVM code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stirling's series: Bernoulli numbers over 2k(2k-1). Fixed values.
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)
_SHIFT = 8


def lgamma(x: Column) -> Column:
    """log Gamma(x) for x > 0: shifted by eight, then Stirling's series."""
    z = x + _SHIFT
    product = x
    for k in range(1, _SHIFT):
        product = product * (x + k)
    inv = F.lit(1.0) / z
    inv2 = inv * inv
    series = F.lit(_STIRLING[-1])
    for c in reversed(_STIRLING[:-1]):
        series = series * inv2 + c
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series * inv - F.log(product)


def log_factorial(n: Column) -> Column:
    return lgamma(n + 1.0)


def erf(x: Column) -> Column:
    """A series of positive terms up to 3, a continued fraction beyond."""
    a = F.least(F.abs(x), F.lit(3.0))
    t = a * a
    series = F.lit(0.0)
    for n in range(55, 0, -1):  # sum of (2t)^n / (1*3*...*(2n+1)), from the inside
        series = (F.lit(1.0) + series) * t * (2.0 / (2 * n + 1))
    inner = F.lit(2 / math.sqrt(math.pi)) * F.exp(-t) * a * (series + 1.0)
    b = F.greatest(F.abs(x), F.lit(3.0))
    fraction = b
    for k in range(40, 0, -1):
        fraction = b + F.lit(k / 2) / fraction
    tail = F.exp(-b * b) / (fraction * math.sqrt(math.pi))
    return F.signum(x) * F.when(F.abs(x) < 3, inner).otherwise(F.lit(1.0) - tail)


def phi_cdf(z: Column) -> Column:
    """Standard normal distribution function."""
    return (F.lit(1.0) + erf(z / math.sqrt(2))) * 0.5


def det2(xx: Column, xy: Column, yy: Column) -> Column:
    return xx * yy - xy * xy


def inverse3(xx, xy, xz, yy, yz, zz) -> tuple[Column, ...]:
    """Determinant and the six entries of the inverse of a symmetric 3 x 3 matrix."""
    a, b, c = yy * zz - yz * yz, xz * yz - xy * zz, xy * yz - xz * yy
    det = xx * a + xy * b + xz * c
    return det, a / det, b / det, c / det, (xx * zz - xz * xz) / det, (xy * xz - xx * yz) / det, (xx * yy - xy * xy) / det


def mean_sigma(sx: Column, sy: Column, sz: Column | None = None) -> Column:
    """Root of the product of the sigmas, in three dimensions too."""
    return F.sqrt(sx * sy) if sz is None else F.sqrt(sx * sy * sz)


def logsumexp(value: Column, top: Column) -> Column:
    """Aggregate: log of the sum of exponentials, given the group's largest value as a column."""
    return F.first(top) + F.log(F.sum(F.exp(value - top)))
