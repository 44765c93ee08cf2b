"""Null-aware arithmetic. Results that a division can't give are null, never NaN or an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null where b is 0, null or not finite."""
    return F.try_divide(a.cast("double"), F.nullif(finite(b), F.lit(0.0)))


def safe_div_or_zero(a: Column, b: Column) -> Column:
    """As safe_div, but 0 / 0 is 0."""
    return F.when((a == 0) & (b == 0), F.lit(0.0)).otherwise(safe_div(a, b))


def zero_if_null(x: Column) -> Column:
    return F.coalesce(x.cast("double"), F.lit(0.0))


def moment_mean(x: Column, m: float = 1, n: float = 0) -> Column:
    """The generalized mean sum(x^m) / sum(x^n) as an aggregate; m = 1, n = 0 is the mean."""
    power = lambda k: F.when(x.isNotNull(), F.lit(1.0)) if k == 0 else x if k == 1 else F.pow(x, F.lit(float(k)))
    return safe_div(F.sum(power(m)), F.sum(power(n)))


def sample_std(x: Column) -> Column:
    """Sample standard deviation; of one value it is 0."""
    return F.when(F.count(x) == 1, F.lit(0.0)).otherwise(F.stddev_samp(x))


def weighted_mean(x: Column, w: Column) -> Column:
    """The mean of x by weights above 0."""
    good = finite(x).isNotNull() & (w > 0)
    return safe_div(F.sum(F.when(good, x * w)), F.sum(F.when(good, w)))


def equivalent_diameter(n: Column, dx: float, dim: int = 2) -> Column:
    """Diameter of the disk (dim 2) or ball (dim 3) of n cells of edge dx."""
    if dim == 2:
        return 2 * F.sqrt(n * (dx * dx) / F.pi())
    return 2 * F.pow(3 * n * dx**3 / (4 * F.pi()), F.lit(1.0 / 3.0))


def lognormal_pdf(x: Column, mu: Column, sigma: Column) -> Column:
    """0 where sigma isn't positive."""
    d = (F.log(x) - mu) / sigma
    return F.when(sigma > 0, F.exp(-d * d / 2) / (x * sigma * F.sqrt(2 * F.pi()))).otherwise(F.lit(0.0))


#: The coefficients of Lanczos' approximation of the gamma function with g = 7, n = 9.
LANCZOS = (
    0.99999999999980993,
    676.5203681218851,
    -1259.1392167224028,
    771.32342877765313,
    -176.61502916214059,
    12.507343278686905,
    -0.13857109526572012,
    9.9843695780195716e-6,
    1.5056327351493116e-7,
)


def log_gamma(z: Column) -> Column:
    """The logarithm of the gamma function for z > 0, by Lanczos' approximation."""
    y = z - 1
    series = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        series = series + F.lit(c) / (y + k)
    t = y + 7.5
    return 0.5 * F.log(2 * F.pi()) + (y + 0.5) * F.log(t) - t + F.log(series)


def gamma_pdf(x: Column, n: Column, mean: Column) -> Column:
    """Gamma density of shape n around its mean, in the normalised variable x / mean; 0 where n, x or mean isn't positive."""
    xi = x / mean
    log = n * F.log(n) - log_gamma(n) + (n - 1) * F.log(xi) - n * xi - F.log(mean)
    return F.when((n > 0) & (x > 0) & (mean > 0), F.exp(log)).otherwise(F.lit(0.0))
