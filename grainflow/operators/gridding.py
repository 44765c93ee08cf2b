"""Points made ready for lines and maps: finite coordinates, rectangular grids, and the nearest value on a grid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.errors import require
from ..functions.scalars import finite
from ..functions.tables import discard, materialize
from .smoothing import duplicate_mean


def with_coordinates(df: DataFrame, key: str, coordinates: list[str]) -> DataFrame:
    """Rows whose coordinates are all finite; values may be null. Each key needs two for a line, three for a map."""
    good = df
    for c in coordinates:
        good = good.where(finite(F.col(c)).isNotNull())
    least = len(coordinates) + 1
    enough = df.select(key).distinct().join(good.groupBy(key).agg(F.count("*").alias("n")), key, "left").where(F.coalesce("n", F.lit(0)) < least)
    require(enough.limit(1).count() == 0, "TooFewPoints", f"{least} points with finite coordinates are needed")
    return good


def rectangular(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Per key: nx, ny, n, and whether distinct places fill the grid of their lines: nx * ny = n."""
    places = points.select(key, x, y).distinct()
    lines = places.groupBy(key).agg(F.count("*").alias("n"))
    for c, name in ((x, "nx"), (y, "ny")):
        lines = lines.join(places.select(key, c).distinct().groupBy(key).agg(F.count("*").alias(name)), key)
    return lines.select(key, "nx", "ny", "n", (F.col("nx") * F.col("ny") == F.col("n")).alias("is_rectangular"))


def as_grid(points: DataFrame, key: str, x: str, y: str, z: str) -> DataFrame:
    """key, place, ix, iy, x, y, z of the keys whose places fill the grid of their lines: the mean value at each, and the place's number
    in the order of y and then x. Only distinct lines are ranked."""
    places = duplicate_mean(points, key, x, y, z).withColumnRenamed("mean", "__z")
    full = rectangular(points, key, x, y).where("is_rectangular").select(key, F.col("nx").alias("__nx"))

    def line(c: str, i: str) -> DataFrame:
        return places.select(key, c).distinct().select(key, c, (F.row_number().over(W.partitionBy(key).orderBy(c)) - 1).alias(i))

    out = places.join(full, key).join(line(x, "ix"), [key, x]).join(line(y, "iy"), [key, y])
    return out.select(key, (F.col("iy") * F.col("__nx") + F.col("ix") + 1).alias("place"), "ix", "iy", F.col(x).alias("x"), F.col(y).alias("y"), F.col("__z").alias("z"))


def _outline(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The corners of the convex hull, counterclockwise; fewer than three where the points are in line."""
    order = np.lexsort((y, x))
    points = list(dict.fromkeys(zip(x[order].tolist(), y[order].tolist(), strict=True)))

    def half(ps: list) -> list:
        kept: list = []
        for p in ps:
            while len(kept) > 1 and (kept[-1][0] - kept[-2][0]) * (p[1] - kept[-2][1]) - (kept[-1][1] - kept[-2][1]) * (p[0] - kept[-2][0]) <= 0:
                kept.pop()
            kept.append(p)
        return kept[:-1]

    return np.array(half(points) + half(points[::-1]) if len(points) > 2 else points).reshape(-1, 2)


def hulls(points: DataFrame, key: str) -> DataFrame:
    """points: (key, x, y). Per key the corners of the convex hull as an array of (x, y): each task first keeps the corners of what
    it has, so that few points of a key meet."""
    kind = points.schema[key].dataType.simpleString()

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, part in batch.groupby(key, dropna=False):
                corners = _outline(part["x"].to_numpy(), part["y"].to_numpy())
                yield pd.DataFrame({key: [k] * len(corners), "x": corners[:, 0], "y": corners[:, 1]})

    def one(part: pd.DataFrame) -> pd.DataFrame:
        corners = _outline(part["x"].to_numpy(), part["y"].to_numpy())
        return pd.DataFrame({key: [part[key].iloc[0]], "corners": [[{"x": a, "y": b} for a, b in corners.tolist()]]})

    kept = points.select(key, "x", "y").mapInPandas(some, f"{key} {kind}, x double, y double")
    return kept.groupBy(key).applyInPandas(one, f"{key} {kind}, corners array<struct<x:double,y:double>>")


def _inside(x: Column, y: Column, corners: Column, slack: Column) -> Column:
    """Whether a place is in a convex hull or on its rim; a hull without area holds nothing."""
    after = F.concat(F.slice(corners, 2, F.size(corners)), F.slice(corners, 1, 1))
    turns = F.zip_with(corners, after, lambda a, b: (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"]))
    return (F.size(corners) > 2) & F.forall(turns, lambda t: t >= -slack)


def nearest_grid(points: DataFrame, key: str, x: str, y: str, z: str, size: tuple[int, int] | None = None) -> DataFrame:
    """key, ix, iy, x, y, z: the value of the nearest point at each node of a grid over the points' extent; null outside of their
    convex hull. Points at one place count as one with the mean of their values; those without a value don't count. size: nodes
    in x and y, ten at least; else as many as the square root of the number of places, eighty at least. Of equally near points
    the least in x and then y is taken. A key needs three places with a value.

    Nodes and points are dealt to square buckets; a node looks at its bucket and those around it, and is done once no other
    bucket can hold a nearer point. The few that aren't look again with buckets of twice the width."""
    places = duplicate_mean(points.select(F.col(key), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), finite(F.col(z)).alias("z")), key, "x", "y", "z")
    places = materialize(places.where("n > 0").select(key, "x", "y", F.col("mean").alias("z")), "places")
    ends = places.groupBy(key).agg(F.count("*").alias("n"), *(f(c).alias(f"{c}{k}") for c in "xy" for f, k in ((F.min, 0), (F.max, 1))))
    require(ends.where("n < 3").limit(1).count() == 0, "TooFewFiniteZ", "three places with a value are needed")
    side = F.greatest(F.lit(80), F.round(F.sqrt("n")).cast("int"))
    nx, ny = (side, side) if size is None else (F.lit(max(10, round(size[0]))), F.lit(max(10, round(size[1]))))
    width = F.sqrt(F.greatest((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), F.pow(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")), F.lit(2.0)) * 1e-6) / F.col("n"))
    ends = materialize(ends.withColumns({"nx": nx, "ny": ny, "w": F.when(width > 0, width).otherwise(1.0)}), "extents")
    at = lambda i, c, n: F.when(F.col(i) == F.col(n) - 1, F.col(f"{c}1")).otherwise(F.col(f"{c}0") + F.col(i) * (F.col(f"{c}1") - F.col(f"{c}0")) / (F.col(n) - 1))
    nodes = ends.withColumn("ix", F.explode(F.sequence(F.lit(0), F.col("nx") - 1))).repartition(key, "ix").withColumn("iy", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)))
    nodes = nodes.select(key, "ix", "iy", at("ix", "x", "nx").alias("x"), at("iy", "y", "ny").alias("y"), "x0", "y0", "w", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) * 1e-12).alias("slack"))
    inside = nodes.join(hulls(places, key), key).withColumn("in", _inside(F.col("x"), F.col("y"), F.col("corners"), F.col("slack"))).drop("corners", "slack")
    inside = materialize(inside, "nodes")
    open_, done, scale = inside.where("in"), inside.where("not in").select(key, "ix", "iy", "x", "y", F.lit(None).cast("double").alias("z")), 1.0
    near = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))).alias("step")
    while True:
        w = F.col("w") * scale
        bucket = lambda c: F.floor((F.col(c) - F.col(f"{c}0")) / w)
        dealt = places.join(ends.select(key, "x0", "y0", "w"), key).select(key, bucket("x").alias("bx"), bucket("y").alias("by"), F.struct("x", "y", "z").alias("p"))
        asked = open_.select("*", near).select(key, "ix", "iy", "x", "y", "x0", "y0", "w", (bucket("x") + F.col("step.a")).alias("bx"), (bucket("y") + F.col("step.b")).alias("by"))
        gap = (F.col("x") - F.col("p.x")) * (F.col("x") - F.col("p.x")) + (F.col("y") - F.col("p.y")) * (F.col("y") - F.col("p.y"))
        found = asked.join(dealt, [key, "bx", "by"]).groupBy(key, "ix", "iy").agg(F.min(F.struct(gap.alias("d2"), F.col("p.x").alias("px"), F.col("p.y").alias("py"), F.col("p.z").alias("z"))).alias("best"))
        looked = materialize(open_.join(found, [key, "ix", "iy"], "left"), "looked")
        sure = F.coalesce(F.col("best.d2") <= w * w, F.lit(False))
        done = done.unionByName(looked.where(sure).select(key, "ix", "iy", "x", "y", "best.z"))
        left = materialize(looked.where(~sure).drop("best"), "left")
        if left.isEmpty():
            discard(left)
            return done
        open_, scale = left, scale * 2
