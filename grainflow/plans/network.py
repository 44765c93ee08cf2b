"""The two-phase network analysis of all steps at once: tables, the nested statistics of each step, and their changes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.errors import ordered_range, positive, require
from ..functions.scalars import moment_mean, safe_div_or_zero, weighted_mean
from ..functions.tables import materialize
from ..operators import cluster, grid, morphology, profiles
from ..operators.grid import STEP, Boundary

#: Fixed notes on what the topology counts.
NOTE_OPEN = "4-neighbour cell complex; beta1 is the number of holes."
NOTE_PERIODIC = "Wrapped 4-neighbour cell complex; beta1 counts holes and loops round the periodic axes."
NOTE_MISSING = " Missing cells are absent; loops around them count."


@dataclass(frozen=True)
class Options:
    threshold: float
    boundary: str = "open"
    connectivity: int = 4
    dx: float = 1.0
    dy: float = 1.0
    mean_m: float = 1.0
    mean_n: float = 0.0
    hist_bins: int = 30
    hist_size: float | None = None
    position_bins: int = 20
    position_range_x: tuple[float, float] | None = None
    position_range_y: tuple[float, float] | None = None
    profile_bins: int = 20
    profile_range_x: tuple[float, float] | None = None
    profile_range_y: tuple[float, float] | None = None
    skeleton: bool = True
    tile: int = grid.TILE

    def __post_init__(self):
        require(self.threshold is not None, "MissingThresholdN")
        require(self.connectivity == 4, "BadConnectivity", str(self.connectivity))
        require(self.mean_m > self.mean_n, "BadMeanPower", f"{self.mean_m}, {self.mean_n}")
        Boundary.of(self.boundary)
        positive(self.dx, "BadSpacing"), positive(self.dy, "BadSpacing"), positive(self.hist_size, "BadHistNumBins")
        for n, code in ((self.hist_bins, "BadHistNumBins"), (self.position_bins, "BadPositionNumBins"), (self.profile_bins, "BadProfileNumBins")):
            require(isinstance(n, int) and n >= 1, code, str(n))
        for bounds in (self.position_range_x, self.position_range_y, self.profile_range_x, self.profile_range_y):
            ordered_range(bounds)


class Network:
    """Tables of a network analysis, each made when it is asked for; all steps of the cells together.

    df: rows with step_index, x, y and ncount."""

    def __init__(self, df: DataFrame, o: Options):
        self.df, self.o, self.b = df, o, Boundary.of(o.boundary)

    @cached_property
    def cells(self) -> DataFrame:
        return materialize(grid.gridify(self.df, self.o.threshold), "cells")

    @cached_property
    def pieces(self) -> DataFrame:
        """What one pass over tiles tells: components, topology and the phases' sums come from it."""
        return grid.pieces(self.cells, self.b, self.o.tile)

    @cached_property
    def joined(self) -> tuple[DataFrame, DataFrame]:
        return grid.joined(self.pieces, self.b, self.o.tile)

    @cached_property
    def components(self) -> DataFrame:
        return materialize(grid.component_stats(self.pieces, *self.joined, self.o.dx, self.o.dy), "component-stats")

    @cached_property
    def globals(self) -> DataFrame:
        return grid.global_stats(self.pieces, self.o.dx, self.o.dy)

    @cached_property
    def topology(self) -> DataFrame:
        missing = self.cells.groupBy(STEP).agg((F.max("nx") * F.max("ny") > F.count("*")).alias("missing"))
        note = F.concat(F.lit(NOTE_PERIODIC if self.b.x or self.b.y else NOTE_OPEN), F.when(F.col("missing"), NOTE_MISSING).otherwise(""))
        return grid.topology(self.pieces, self.joined[0], self.b).join(missing, STEP).withColumn("note", note).drop("missing")

    @cached_property
    def connectivity(self) -> DataFrame:
        return grid.connectivity(self.cells, self.b, self.components, self.o.dx, self.o.dy)

    @cached_property
    def connected(self) -> DataFrame:
        return grid.connected(self.components, self.b)

    @cached_property
    def sizes(self) -> DataFrame:
        """Per step and phase: components, their largest area and share, and diameters' greatest, generalized and area-weighted mean."""
        d, a = F.col("equiv_diameter"), F.col("area")
        s = self.components.groupBy(STEP, "phase").agg(
            F.count("*").alias("component_count"), F.sum(a).alias("phase_area"), F.max(a).alias("largest_area"), F.max(d).alias("max_diameter"),
            moment_mean(d, self.o.mean_m, self.o.mean_n).alias("mean_diameter"), weighted_mean(d, a).alias("area_weighted_diameter"),
            F.sum("perimeter_open").alias("perimeter_open"), F.sum("interface_perimeter").alias("interface_perimeter"),
        )
        out = grid._both_phases(self.cells).select(STEP, "phase").join(s, [STEP, "phase"], "left")
        out = out.na.fill(0, ["component_count"]).na.fill(0.0, ["phase_area", "largest_area", "max_diameter", "perimeter_open", "interface_perimeter"])
        return out.withColumn("largest_fraction", safe_div_or_zero(F.col("largest_area"), F.col("phase_area")))

    def summary(self, column: str = "area") -> DataFrame:
        """Statistics and quantiles of the components' areas or diameters, per step and phase."""
        powers = (self.o.mean_m, self.o.mean_n) if column == "equiv_diameter" else (1.0, 0.0)
        return cluster.summary(self.components, [STEP, "phase"], column, *powers)

    @cached_property
    def histogram(self) -> DataFrame:
        return cluster.histogram(self.components, [STEP, "phase"], "equiv_diameter", self.o.hist_bins, self.o.hist_size)

    @cached_property
    def size_cdf(self) -> DataFrame:
        return cluster.cdf(self.components, [STEP, "phase"], "equiv_diameter")

    def positions(self, axis: str) -> DataFrame:
        o = self.o
        bounds, step = (o.position_range_x, o.dx) if axis == "x" else (o.position_range_y, o.dy)
        return profiles.positions(self.components, axis, step, o.position_bins, bounds, o.mean_m, o.mean_n)

    def profile(self, axis: str) -> DataFrame:
        """Porosity, interface and connectivity along an axis, a row per step and bin."""
        o = self.o
        bounds = o.profile_range_x if axis == "x" else o.profile_range_y
        p = profiles.porosity(self.cells, axis, o.dx, o.dy, o.profile_bins, bounds)
        c = profiles.connectivity(self.cells, self.components, self.b, axis, o.dx, o.dy, o.profile_bins, bounds)
        return p.join(c.drop("edge_lo", "edge_hi", "center"), [STEP, "bin_id"])

    def skeleton(self, phase: str) -> DataFrame:
        return morphology.skeleton(self.cells, self.b, phase)

    def skeleton_stats(self, phase: str) -> DataFrame:
        return morphology.skeleton_stats(self.cells, self.skeleton(phase), self.b, phase, self.o.dx, self.o.dy)

    @cached_property
    def thickness(self) -> DataFrame:
        return morphology.thickness(self.cells, self.b, self.o.dx, self.o.dy)

    @cached_property
    def series(self) -> DataFrame:
        """One flat row per step: the numbers whose course over the steps is asked for."""
        out = self.globals.select(STEP, "porosity", "interface_length", "specific_interface")
        for p in ("pore", "matrix"):
            t = self.topology.where(F.col("phase") == p).select(STEP, *(F.col(c).alias(f"{p}_{c}") for c in ("beta0", "beta1", "chi")))
            s = self.sizes.where(F.col("phase") == p).select(STEP, *(F.col(c).alias(f"{p}_{c}") for c in ("largest_fraction", "mean_diameter", "max_diameter")))
            out = out.join(t, STEP).join(s, STEP)
        return out

    @cached_property
    def stats(self) -> DataFrame:
        """One nested row per step: meta, topology, connectivity, geometry, size, thickness and network (skeletons, if enabled)."""
        o = self.o
        meta = self.cells.groupBy(STEP).agg(F.max("nx").alias("nx"), F.max("ny").alias("ny"), (F.max("nx") * F.max("ny") - F.count("*")).alias("missing_cells"))
        fixed = {"boundary": o.boundary, "threshold": float(o.threshold), "foreground_connectivity": 4, "hole_connectivity": 8, "dx": float(o.dx), "dy": float(o.dy), "mean_m": float(o.mean_m), "mean_n": float(o.mean_n)}
        out = meta.select(STEP, F.struct(*(F.lit(v).alias(k) for k, v in fixed.items()), "nx", "ny", "missing_cells").alias("meta"))
        phases = lambda df, cols, name: df.groupBy(STEP).pivot("phase", ["pore", "matrix"]).agg(F.first(F.struct(*cols))).select(STEP, F.struct("pore", "matrix").alias(name))
        c = self.connectivity.groupBy(STEP, "phase").pivot("axis", ["x", "y"]).agg(F.first(F.struct("is_connected", "connected_fraction", "component_count", "wraps", "percolates")))
        parts = [
            phases(self.topology, ["beta0", "beta1", "chi", "beta2", "note"], "topology"),
            phases(c, ["x", "y"], "connectivity"),
            self.globals.select(STEP, F.struct("porosity", "matrix_fraction", "interface_length", "specific_interface", "valid_area", "pore_area", "matrix_area").alias("geometry")),
            phases(self.sizes, ["component_count", "largest_area", "largest_fraction", "max_diameter", "mean_diameter", "area_weighted_diameter"], "size"),
            self.thickness.select(STEP, F.struct("min", "mean", "p1", "p5", "sample_count").alias("thickness")),
        ]
        if o.skeleton:
            nets = self.skeleton_stats("pore").withColumn("phase", F.lit("pore")).unionByName(self.skeleton_stats("matrix").withColumn("phase", F.lit("matrix")))
            parts.append(phases(nets, ["skeleton_length", "branch_points", "end_points", "branch_density"], "network"))
        for p in parts:
            out = out.join(p, STEP, "left")
        return out


def changes(series: DataFrame, columns: list[str], order: str = STEP) -> DataFrame:
    """Adds d_<column>: the change from the step before among those there; null at the first. A series has a row per step."""
    w = W.orderBy(order)
    before = lambda c: F.lag(c).over(w)
    return series.withColumns({f"d_{c}": F.col(c).cast("double") - before(c) for c in columns})


def evolution(df: DataFrame, o: Options, blocks: DataFrame | None = None) -> DataFrame:
    """The series of all steps with its changes; blocks: (step_index, ...) to which the steps are cut and whose columns are added."""
    if blocks is not None:
        df = df.join(blocks.select(STEP), STEP, "left_semi")
    out = changes(Network(df, o).series, ["pore_beta0", "pore_beta1", "matrix_beta0", "pore_largest_fraction"])
    return out if blocks is None else out.join(blocks, STEP)


def nested(df: DataFrame) -> Column:
    return F.to_json(F.struct(*df.columns))
