"""Bin edges as arrays and the assignment of values to bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pad(x: Column) -> Column:
    return F.greatest(F.lit(1e-12), F.abs(x) * 1e-6)


def count_edges(low: Column, high: Column, n: int) -> Column:
    """n bins of equal width from low to high; where they are equal, from a little below to a little above."""
    a = F.when(low == high, low - _pad(low)).otherwise(low)
    b = F.when(low == high, high + _pad(high)).otherwise(high)
    inner = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.when(i == n, b).otherwise(a + i * (b - a) / n))
    return F.when(low.isNotNull() & high.isNotNull(), inner)


def width_edges(low: Column, high: Column, width: float) -> Column:
    """Edges low, low + width, ... as far as high, and one more where the last is below it, so that no value is without a bin; an
    edge that rounding alone puts off high is high. Where low and high are equal, one bin around them."""
    w = F.lit(float(width))
    slack = 2 * 2.220446049250313e-16 * F.greatest(F.abs(low), F.abs(high))
    near = F.round((high - low) / w)
    n = F.when(low + near * w - high > slack, near - 1).otherwise(near).cast("int")
    run = F.transform(F.sequence(F.lit(0), n), lambda i: F.when((i == n) & (F.abs(low + i * w - high) <= slack), high).otherwise(low + i * w))
    last = F.element_at(run, -1)
    run = F.when(last < high, F.concat(run, F.array(last + w))).otherwise(run)
    one = F.array(low - width / 2, low + width / 2)
    return F.when(low.isNotNull() & high.isNotNull(), F.when(low == high, one).otherwise(run))


def assign(x: Column, edges: Column, tolerant: bool = False) -> Column:
    """The number of the bin of x, from 1; bins are closed below, the last one above too; outside null.
    tolerant: values a rounding error above the last edge are in the last bin."""
    last, n = F.element_at(edges, -1), F.size(edges) - 1
    slack = F.greatest(F.lit(1e-12), 1e-12 * F.greatest(F.abs(last), F.lit(1.0))) if tolerant else F.lit(0.0)
    inside = (x >= F.element_at(edges, 1)) & (x <= last + slack)
    return F.when(inside, F.least(n, F.size(F.filter(edges, lambda e: e <= x))))


def bins(edges: DataFrame, keys: list[str] = ()) -> DataFrame:
    """One row per bin of edges (keys, edges): bin_id from 1, edge_lo, edge_hi, center."""
    parts = F.posexplode(F.slice("edges", 1, F.size("edges") - 1)).alias("at", "edge_lo")
    rows = edges.select(*keys, "edges", parts)
    rows = rows.select(*keys, (F.col("at") + 1).alias("bin_id"), "edge_lo", F.element_at("edges", F.col("at") + 2).alias("edge_hi"))
    return rows.withColumn("center", (F.col("edge_lo") + F.col("edge_hi")) / 2)
