"""Profiles of a grid along an axis: phase areas, interface length, connectivity, and sizes by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import binning
from ..functions.errors import ordered_range, require
from ..functions.scalars import moment_mean, safe_div
from .grid import STEP, Boundary, connects, edges

AXES = {"x": ("x", "y"), "y": ("y", "x")}


def axis_edges(cells: DataFrame, axis: str, step: float, bins: int, bounds=None) -> DataFrame:
    """Edges per step: of the range, or of the grid with half a cell at its ends; a range of one point is half a cell wider each way."""
    require(axis in AXES, "BadProfileAxis", axis)
    require(isinstance(bins, int) and bins >= 1, "BadProfileNumBins", str(bins))
    bounds = ordered_range(bounds)
    if bounds is None:
        ends = cells.groupBy(STEP).agg((F.min(axis) - step / 2).alias("lo"), (F.max(axis) + step / 2).alias("hi"))
    else:
        low, high = bounds if bounds[0] < bounds[1] else (bounds[0] - step / 2, bounds[1] + step / 2)
        ends = cells.select(STEP).distinct().withColumns({"lo": F.lit(low), "hi": F.lit(high)})
    return ends.select(STEP, binning.count_edges(F.col("lo"), F.col("hi"), bins).alias("edges"))


def _placed(df: DataFrame, e: DataFrame, at: str | Column, tolerant: bool = False) -> DataFrame:
    return df.join(e, STEP).withColumn("bin_id", binning.assign(F.col(at) if isinstance(at, str) else at, F.col("edges"), tolerant)).drop("edges").where("bin_id is not null")


def porosity(cells: DataFrame, axis: str, dx: float, dy: float, bins: int = 20, bounds=None) -> DataFrame:
    """Per step and bin of cell centres: areas of the phases, porosity, interface length (edges by their midpoints, none over a
    seam) and its ratios to the areas; ratios of a bin without cells are null."""
    step = dx if axis == "x" else dy
    e = axis_edges(cells, axis, step, bins, bounds)
    n = _placed(cells, e, axis).groupBy(STEP, "bin_id").agg(F.count("*").alias("v"), F.count_if(F.col("phase") == "pore").alias("p"))
    length = F.when(F.col("dir") == "x", F.lit(float(dy))).otherwise(F.lit(float(dx)))
    lines = edges(cells, Boundary()).where("n_pore = 1")
    i = _placed(lines, e, "mx" if axis == "x" else "my", tolerant=True).groupBy(STEP, "bin_id").agg(F.sum(length).alias("interface_length"))
    out = binning.bins(e, [STEP]).join(n, [STEP, "bin_id"], "left").join(i, [STEP, "bin_id"], "left").na.fill(0, ["v", "p"]).na.fill(0.0, ["interface_length"])
    area = dx * dy
    out = out.withColumns({"valid_area": F.col("v") * area, "pore_area": F.col("p") * area, "matrix_area": (F.col("v") - F.col("p")) * area})
    ratio = lambda c: safe_div(F.col("interface_length"), F.col(c))
    return out.drop("v", "p").withColumns({
        "porosity": safe_div(F.col("pore_area"), F.col("valid_area")), "specific_interface": ratio("valid_area"),
        "specific_interface_pore": ratio("pore_area"), "specific_interface_matrix": ratio("matrix_area"),
    })


def connectivity(cells: DataFrame, components: DataFrame, b: Boundary, axis: str, dx: float, dy: float, bins: int = 20, bounds=None) -> DataFrame:
    """Per step and bin of the pore components' centroids: those that connect along the other axis, their areas and share."""
    e = axis_edges(cells, axis, dx if axis == "x" else dy, bins, bounds)
    hit = connects(AXES[axis][1], b)
    c = _placed(components.where("phase = 'pore'"), e, f"centroid_{axis}", tolerant=True)
    n = c.groupBy(STEP, "bin_id").agg(F.count_if(hit).alias("connected_count"), F.sum(F.when(hit, F.col("area")).otherwise(0.0)).alias("connected_area"), F.sum("area").alias("component_area"))
    out = binning.bins(e, [STEP]).join(n, [STEP, "bin_id"], "left").na.fill(0, ["connected_count"]).na.fill(0.0, ["connected_area", "component_area"])
    return out.withColumns({"connected_fraction": F.coalesce(safe_div(F.col("connected_area"), F.col("component_area")), F.lit(0.0)), "is_connected": F.col("connected_count") > 0})


def positions(components: DataFrame, axis: str, step: float, bins: int = 20, bounds=None, m: float = 1.0, n: float = 0.0) -> DataFrame:
    """Per step, phase and bin of centroids: the generalized mean of the equivalent diameter and the number of components.

    Without a range the bins span the centroids, one bin of a cell's width where these are equal; with one they span it."""
    require(axis in AXES, "BadPositionAxis", axis)
    require(isinstance(bins, int) and bins >= 1, "BadPositionNumBins", str(bins))
    bounds, at = ordered_range(bounds), f"centroid_{axis}"
    keys = [STEP, "phase"]
    if bounds is None:
        ends = components.groupBy(*keys).agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
        one = F.array(F.col("lo") - step / 2, F.col("hi") + step / 2)
        e = ends.select(*keys, F.when(F.col("lo") == F.col("hi"), one).otherwise(binning.count_edges(F.col("lo"), F.col("hi"), bins)).alias("edges"))
    else:
        low, high = bounds if bounds[0] < bounds[1] else (bounds[0] - step / 2, bounds[1] + step / 2)
        e = components.select(*keys).distinct().select(*keys, binning.count_edges(F.lit(low), F.lit(high), bins).alias("edges"))
        components = components.where(F.col(at).between(*bounds))
    placed = components.join(e, keys).withColumn("bin_id", binning.assign(F.col(at), F.col("edges"), tolerant=True))
    found = placed.groupBy(*keys, "bin_id").agg(moment_mean(F.col("equiv_diameter"), m, n).alias("mean_diameter"), F.count("*").alias("count"))
    return binning.bins(e, keys).join(found, [*keys, "bin_id"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
