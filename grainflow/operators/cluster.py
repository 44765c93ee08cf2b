"""Sizes of clusters: filters, statistics, fits, histograms, binned means and distributions, per step."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import binning
from ..functions.errors import positive, require
from ..functions.ranks import quantiles, running_sum
from ..functions.scalars import equivalent_diameter, gamma_pdf, lognormal_pdf, moment_mean, safe_div, sample_std

KEY = "step_index"
ATTRIBUTES = ("c_x", "c_y", "c_z", "vx", "vy", "vz")
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
#: Ranks of one value that are made in one place.
PIECE = 4096


@dataclass(frozen=True)
class Options:
    dx: float = 1.0
    dim: int = 2
    #: Inclusive ranges by column; bounds may be in either order, a column that a table hasn't is ignored with a warning.
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    diameter_range: tuple[float, float] | None = None
    mean_m: float = 1.0
    mean_n: float = 0.0
    bins: int = 30
    bin_size: float | None = None

    def __post_init__(self):
        require(self.dim in (2, 3), "BadDim", str(self.dim))
        require(self.mean_m > self.mean_n, "BadMeanPower", f"{self.mean_m}, {self.mean_n}")
        positive(self.bin_size, "BadHistogramBinSize")
        for c, bounds in {**self.ranges, "diameter": self.diameter_range}.items():
            require(bounds is None or len(bounds) == 2, "BadRange", c)


def diameters(df: DataFrame, o: Options = Options()) -> DataFrame:
    """Rows of clusters that pass the attribute ranges, with `diameter`; only finite ones above 0 and in their range."""
    require("Ncount" in df.columns, "MissingNcount")
    for c, bounds in o.ranges.items():
        if c in df.columns and c in ATTRIBUTES:
            df = df.where(F.col(c).between(min(bounds), max(bounds)))
        else:
            warnings.warn(f"the range of {c} is ignored: the table has no such attribute", stacklevel=2)
    d = equivalent_diameter(F.col("Ncount"), o.dx, o.dim)
    df = df.withColumn("diameter", d).where((F.col("diameter") > 0) & (F.col("diameter") < F.lit(float("inf"))))
    return df if o.diameter_range is None else df.where(F.col("diameter").between(min(o.diameter_range), max(o.diameter_range)))


def basic(x: Column, m: float = 1.0, n: float = 0.0) -> list[Column]:
    return [
        F.count(x).alias("n"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        moment_mean(x, m, n).alias("mean"),
        sample_std(x).alias("std"),
    ]


def stats(d: DataFrame, o: Options = Options()) -> DataFrame:
    out = d.groupBy(KEY).agg(*basic(F.col("diameter"), o.mean_m, o.mean_n)).join(quantiles(d, [KEY], "diameter", (0.5,)), KEY, "left")
    return out.withColumn("median", F.element_at("q", 1)).drop("q")


def summary(df: DataFrame, keys: list[str], column: str, m: float = 1.0, n: float = 0.0) -> DataFrame:
    """Basic statistics with the quantiles q05 ... q95, linearly interpolated."""
    out = df.groupBy(*keys).agg(*basic(F.col(column), m, n)).join(quantiles(df, keys, column, (0.5, *QUANTILES)), keys, "left")
    out = out.withColumn("median", F.element_at("q", 1))
    return out.select(*(c for c in out.columns if c != "q"), *(F.element_at("q", i + 2).alias(f"q{round(p * 100):02d}") for i, p in enumerate(QUANTILES)))


def fits(d: DataFrame) -> DataFrame:
    """Fits by moments: mu and sigma of a lognormal, gamma_n = mean^2 / variance (null unless the variance is above 0)."""
    x = F.col("diameter")
    variance = F.when(F.count(x) == 1, F.lit(0.0)).otherwise(F.var_samp(x))
    return d.groupBy(KEY).agg(F.avg(F.log(x)).alias("mu"), sample_std(F.log(x)).alias("sigma"), safe_div(F.avg(x) * F.avg(x), F.nullif(F.greatest(variance, F.lit(0.0)), F.lit(0.0))).alias("gamma_n"), F.avg(x).alias("mean"))


def edges(d: DataFrame, keys: list[str], column: str = "diameter", bins: int = 30, size: float | None = None) -> DataFrame:
    low, high = F.min(column), F.max(column)
    made = binning.width_edges(F.col("lo"), F.col("hi"), size) if size else binning.count_edges(F.col("lo"), F.col("hi"), bins)
    return d.groupBy(*keys).agg(low.alias("lo"), high.alias("hi")).select(*keys, made.alias("edges"))


def histogram(d: DataFrame, keys: list[str], column: str = "diameter", bins: int = 30, size: float | None = None) -> DataFrame:
    """One row per bin, empty ones too: bin_id, edge_lo, edge_hi, center, count, probability, pdf, and the counts from below.

    The edges are a small row per key; values are assigned to bins and counted before anything is moved by bin."""
    e = edges(d, keys, column, bins, size)
    placed = d.join(e, keys).withColumn("bin_id", binning.assign(F.col(column), F.col("edges")))
    n = placed.groupBy(*keys, "bin_id").agg(F.count("*").alias("count"))
    out = binning.bins(e, keys).join(n, [*keys, "bin_id"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    each = W.partitionBy(*keys)
    total = F.sum("count").over(each)
    out = out.withColumn("probability", safe_div(F.col("count"), total)).withColumn("pdf", safe_div(F.col("count"), total * (F.col("edge_hi") - F.col("edge_lo"))))
    return out.withColumn("cum_count", F.sum("count").over(each.orderBy("bin_id").rowsBetween(W.unboundedPreceding, 0)))


def fit_curves(d: DataFrame, points: int = 300) -> DataFrame:
    """The fitted densities at evenly spaced diameters from the smallest to the largest."""
    ends = d.groupBy(KEY).agg(F.greatest(F.min("diameter"), F.lit(2.220446049250313e-16)).alias("lo"), F.max("diameter").alias("hi")).join(fits(d), KEY)
    i = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")
    x = F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / (points - 1)
    at = ends.select("*", i).withColumn("x", x)
    return at.select(KEY, "i", "x", lognormal_pdf(F.col("x"), F.col("mu"), F.col("sigma")).alias("lognormal"), gamma_pdf(F.col("x"), F.col("gamma_n"), F.col("mean")).alias("gamma"))


def binned_mean(d: DataFrame, by: str, bins: int = 20, o: Options = Options()) -> DataFrame:
    """The generalized mean diameter by bins of a column; equal values give one bin of width 1."""
    require(by in d.columns, "BadXVar", by)
    ends = d.where(F.col(by).isNotNull()).groupBy(KEY).agg(F.min(by).alias("lo"), F.max(by).alias("hi"))
    one = F.array(F.col("lo") - 0.5, F.col("lo") + 0.5)
    e = ends.select(KEY, F.when(F.col("lo") == F.col("hi"), one).otherwise(binning.count_edges(F.col("lo"), F.col("hi"), bins)).alias("edges"))
    placed = d.join(e, KEY).withColumn("bin_id", binning.assign(F.col(by), F.col("edges")))
    found = placed.groupBy(KEY, "bin_id").agg(moment_mean(F.col("diameter"), o.mean_m, o.mean_n).alias("mean"), F.count("*").alias("count"))
    return binning.bins(e, [KEY]).join(found, [KEY, "bin_id"], "left").withColumn("count", F.coalesce("count", F.lit(0)))


def cdf(d: DataFrame, keys: list[str], column: str = "diameter") -> DataFrame:
    """The empirical distribution from both ends: each value with the number and share of values up to it and from it on.

    Ties have ranks of their own. Ranks come from counts of distinct values, summed by range; a value that holds a third of the
    rows is one row of the running sum, and its ranks are dealt out in pieces."""
    n = d.groupBy(*keys, column).agg(F.count("*").alias("copies"))
    total = n.groupBy(*keys).agg(F.sum("copies").alias("total"))
    upto = running_sum(n, keys, [F.col(column)], F.col("copies"), "upto").join(total, keys)
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(PIECE).cast("long"))).alias("piece")
    dealt = upto.select(*keys, column, "total", "copies", "upto", piece).repartition(*keys, column, "piece")
    first = F.col("upto") - F.col("copies") + 1 + F.col("piece")
    rows = dealt.select(*keys, column, "total", F.explode(F.sequence(first, F.least(F.col("upto"), first + PIECE - 1))).alias("rank"))
    down = F.col("total") - F.col("rank") + 1
    return rows.select(*keys, F.col(column).alias("x"), "rank", (F.col("rank") / F.col("total")).alias("cdf"), down.alias("rank_down"), (down / F.col("total")).alias("cdf_down"))
