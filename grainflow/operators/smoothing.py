"""Null-aware smoothing, gap filling, and the mean of points at one place."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.errors import require
from ..functions.ranks import ranked as in_order
from ..functions.tables import materialize
from .grid import TILE, numbered, whole_tiles

TINY = 2.220446049250313e-16
#: Places of tiles' boxes that are worked on together (a tile that alone has more is worked on by itself).
PLACES = 1 << 20


def weights(sigma: float) -> list[tuple[int, float]]:
    """A normalised Gaussian by whole offsets, out to three standard deviations."""
    r = max(1, math.ceil(3 * sigma))
    w = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    return [(k, x / sum(w)) for k, x in zip(range(-r, r + 1), w, strict=True)]


def smooth_1d(df: DataFrame, key: str, x: str, value: str, sigma: float, keep_null: bool = True) -> DataFrame:
    """Adds smooth: the Gaussian mean of the values that aren't null, over rows in the order of x within a key. sigma (in rows) of 0
    or less changes nothing; keep_null: rows without a value stay without.

    Places are counted over ranges of the order (no key is null, and x tells the rows of a key apart). Rows give their value to the
    places around them, which are summed by place: a shuffle on (key, place), whatever the length of a series."""
    if sigma <= 0:
        return df.withColumn("smooth", F.col(value))
    ranked = in_order(df, [key], [F.col(x)], "__at")
    table = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in weights(sigma)))).alias("t")
    given = ranked.where(F.col(value).isNotNull()).select(key, "__at", F.col(value).alias("__v"), table)
    sums = given.groupBy(key, (F.col("__at") + F.col("t.k")).alias("__at")).agg(F.sum(F.col("__v") * F.col("t.w")).alias("__num"), F.sum("t.w").alias("__den"))
    mean = F.when(F.col("__den") > TINY, F.col("__num") / F.col("__den"))
    # as sorted rows: after an explode Spark takes a table for as small as its file, and would send millions of rows through the driver
    out = ranked.join(sums.hint("merge"), [key, "__at"], "left").withColumn("smooth", F.when(F.col(value).isNotNull(), mean) if keep_null else mean)
    return out.drop("__at", "__num", "__den")


def _smoothed(t: dict[str, np.ndarray], w: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of rows of whole tiles, those that are their tile's own (one for each place) and the Gaussian means there; w: of an odd number of places.

    The boxes of tiles lie line after line in one array, with so many empty places behind each line that a kernel reaches no other
    line; then once more with the axes swapped."""
    r = len(w) // 2
    of = numbered([t["__key"], t["__tx"], t["__ty"]])
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    x, y = (v - np.minimum.reduceat(v, starts)[of] for v in (t["__x"], t["__y"]))
    wide, high = (np.maximum.reduceat(v, starts) + 1 + r for v in (x, y))
    area = wide * high
    cuts = np.flatnonzero(np.diff(np.cumsum(area) // PLACES)) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(starts)], strict=True):
        rows = slice(starts[a], starts[b] if b < len(starts) else len(of))
        known, own = t["__known"][rows], t["__own"][rows]
        tile = of[rows] - a
        base, width, height = np.cumsum(area[a:b]) - area[a:b], wide[a:b], high[a:b]
        along_y = base[tile] + x[rows] * height[tile] + y[rows]
        along_x = base[tile] + y[rows] * width[tile] + x[rows]
        box = np.repeat(np.arange(b - a), area[a:b])  # of each place
        line, place = np.divmod(np.arange(len(box)) - base[box], width[box])
        swapped, inside = base[box] + place * height[box] + line, line < height[box] - r  # the rest is what the first kernel put behind lines
        first = (np.convolve(np.bincount(along_y[known], v, len(box)), w, "same") for v in (t["__v"][rows][known], None))
        at, row = np.unique(along_x[own], return_index=True)
        num, den = (np.convolve(np.where(inside, v[swapped], 0.0), w, "same")[at] for v in first)
        some = den > TINY
        yield rows.start + np.flatnonzero(own)[row[some]], num[some] / den[some]


def smooth_2d(df: DataFrame, key: str, ix: str, iy: str, value: str, sigma: float, keep_null: bool = True) -> DataFrame:
    """As smooth_1d, on grid indices; absent cells count as null and get no row.

    Square tiles, each with the known cells that a kernel reaches beyond it, are smoothed on their own, first along one axis and then along
    the other: a cell goes to its tile once and its mean back to its row once, whatever the kernel. A task holds one tile, of 128 cells'
    side or twice the kernel's reach."""
    if sigma <= 0:
        return df.withColumn("smooth", F.col(value))
    w = np.array([x for _, x in weights(sigma)])
    r = len(w) // 2
    side = max(TILE, 2 * r)
    known = F.col(value).isNotNull()
    cells = df.where(F.col(key).isNotNull() & F.col(ix).isNotNull() & F.col(iy).isNotNull() & (known if keep_null else F.lit(True)))
    cells = cells.select(F.col(key).alias("__key"), F.col(ix).cast("long").alias("__x"), F.col(iy).cast("long").alias("__y"), known.alias("__known"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("__v"))
    # the first tile begins r places before 0, so that small grids lie in one tile and are seen from no other
    tile = lambda c, k=0: F.floor((F.col(c) + r + k) / side)
    seen = lambda c: F.explode(F.when(F.col("__known"), F.array_distinct(F.array(tile(c, -r), tile(c), tile(c, r)))).otherwise(F.array(tile(c))))
    dealt = cells.select("*", seen("__x").alias("__tx")).select("*", seen("__y").alias("__ty"))
    dealt = dealt.withColumn("__own", (F.col("__tx") == tile("__x")) & (F.col("__ty") == tile("__y")))
    kind = to_arrow_type(df.schema[key].dataType)

    def run(t: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for rows, mean in _smoothed(t, w):
            yield pa.RecordBatch.from_arrays([pa.array(t["__key"][rows], kind), pa.array(t["__x"][rows]), pa.array(t["__y"][rows]), pa.array(mean)], ["__key", "__x", "__y", "__mean"])

    means = whole_tiles(dealt, ["__key", "__tx", "__ty"], [], run, f"__key {df.schema[key].dataType.simpleString()}, __x bigint, __y bigint, __mean double")
    means = means.select(F.col("__key").alias(key), *(F.col(a).cast(df.schema[c].dataType).alias(c) for a, c in (("__x", ix), ("__y", iy))), "__mean")
    # as sorted rows: Spark can't tell how many means there are, and would send millions of rows through the driver
    out = df.join(means.hint("merge"), [key, ix, iy], "left").withColumn("smooth", F.when(known, F.col("__mean")) if keep_null else F.col("__mean"))
    return out.drop("__mean")


def fill(df: DataFrame, key: str, x: str, value: str, mode: str = "interp") -> DataFrame:
    """Adds filled. break and omit keep nulls; interp puts the straight line through the nearest values on both sides there, and
    carries the line of the two nearest on past the ends, where a series has two values or more. A series is cut into ranges, which
    hand on their first and last two points. No key is null."""
    require(mode in ("break", "omit", "interp"), "BadNaNMode", mode)
    if mode != "interp":
        return df.withColumn("filled", F.col(value))
    p = F.when(F.col(value).isNotNull(), F.struct(F.col(x).alias("x"), F.col(value).alias("v")))
    dealt = materialize(df.repartitionByRange(key, x).withColumn("__part", F.spark_partition_id()), "ranges")
    # within a range, in frames that only grow: what comes after is found in descending order
    back, ahead = (W.partitionBy(key, "__part").orderBy(o).rowsBetween(W.unboundedPreceding, -1) for o in (F.asc(x), F.desc(x)))
    # of every row, the known points before and after; then the second ones, found at the first
    first = dealt.withColumn("__p", p).withColumn("__lb", F.last("__p", ignorenulls=True).over(back)).withColumn("__la", F.last("__p", ignorenulls=True).over(ahead))
    known = F.when(F.col("__p").isNotNull(), F.struct("__lb", "__la"))
    near = first.withColumn("__lbb", F.last(known, ignorenulls=True).over(back)["__lb"]).withColumn("__laa", F.last(known, ignorenulls=True).over(ahead)["__la"])
    # what earlier and later ranges hand on: their two points next to this one, from a row per key and range
    ends = first.groupBy(key, "__part").agg(
        F.max("__p").alias("l1"), F.max(F.when(F.col("__la").isNotNull(), F.col("__p"))).alias("l2"), F.min("__p").alias("f1"), F.min(F.when(F.col("__lb").isNotNull(), F.col("__p"))).alias("f2")
    )
    sides = {}
    for name, one, two, order in (("b", "l1", "l2", F.asc), ("a", "f1", "f2", F.desc)):
        over = W.partitionBy(key).orderBy(order("__part")).rowsBetween(W.unboundedPreceding, -1)
        sides[name] = (over, F.when(F.col(one).isNotNull(), F.struct(F.col(one).alias("one"), F.coalesce(F.col(two), F.last(one, ignorenulls=True).over(over)).alias("two"))))
    ends = ends.withColumns({f"__h{n}": h for n, (_, h) in sides.items()})
    ends = ends.select(key, "__part", *(F.last(f"__h{n}", ignorenulls=True).over(over).alias(f"__c{n}") for n, (over, _) in sides.items()))
    two = near.join(ends, [key, "__part"])
    for n in "ba":
        two = two.withColumn(f"__{n}", F.coalesce(f"__l{n}", F.col(f"__c{n}.one")))
        two = two.withColumn(f"__{n}{n}", F.when(F.col(f"__l{n}").isNull(), F.col(f"__c{n}.two")).otherwise(F.coalesce(f"__l{n}{n}", F.col(f"__c{n}.one"))))
    through = lambda p, q: F.col(f"{p}.v") + (F.col(x) - F.col(f"{p}.x")) * F.try_divide(F.col(f"{q}.v") - F.col(f"{p}.v"), F.col(f"{q}.x") - F.col(f"{p}.x"))
    filled = F.coalesce(F.col(value), through("__b", "__a"), through("__b", "__bb"), through("__a", "__aa"))
    return two.select(*df.columns, filled.alias("filled"))


def duplicate_mean(df: DataFrame, key: str, x: str, y: str, z: str) -> DataFrame:
    """One row per place: the mean of its values that aren't null."""
    return df.groupBy(key, x, y).agg(F.avg(z).alias("mean"), F.count(z).alias("n"))


def color_limits(df: DataFrame, key: str, value: str) -> DataFrame:
    """Least and greatest value, a little apart where they are equal."""
    lo, hi = F.min(value), F.max(value)
    pad = F.when(lo == hi, F.greatest(F.lit(1e-12), F.abs(lo) * 1e-6)).otherwise(0.0)
    return df.groupBy(key).agg((lo - pad).alias("lo"), (hi + pad).alias("hi"))


def periodic_field(spark, nx: int, ny: int, seed: int = 7, modes: int = 2, threshold: float = 0.25) -> DataFrame:
    """A seeded random periodic field on nx by ny cells: Fourier modes from -modes to modes but the constant, with a random phase
    each, divided by the field's standard deviation; pore (ncount 0) above the threshold, else matrix (2)."""
    import numpy as np

    rng = np.random.default_rng(seed)
    table = [(kx, ky, float(rng.normal()), float(rng.uniform(0, 2 * math.pi))) for kx in range(-modes, modes + 1) for ky in range(-modes, modes + 1) if kx or ky]
    cells = spark.range(nx * ny).select((F.col("id") % nx).cast("int").alias("ix"), F.floor(F.col("id") / nx).cast("int").alias("iy"))
    value = sum((F.lit(a) * F.cos(2 * math.pi * (F.col("ix") * kx / nx + F.col("iy") * ky / ny) + phase) for kx, ky, a, phase in table), F.lit(0.0))
    raw = cells.withColumn("f", value)
    std = raw.agg(F.stddev_samp("f")).first()[0] or 1.0
    return raw.select(F.lit(1).alias("step_index"), F.col("ix").cast("double").alias("x"), F.col("iy").cast("double").alias("y"), F.when(F.col("f") / std > threshold, 0.0).otherwise(2.0).alias("ncount"))
