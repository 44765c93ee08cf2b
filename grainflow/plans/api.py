"""One entry for the four analyses of files in a folder."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.errors import AnalysisError, require
from ..functions.names import cell_volume, metadata
from ..operators import cluster, fields, grid, select, velocity
from ..sources import blocks, resolve, runlog
from .network import Network, Options, evolution

TASKS = ("chunk", "cluster", "vx", "network2d")
PROGRESS = ("auto", "off", "waitbar", "console")


def load(spark: SparkSession, path: str, select_by=None, index=None, timestep=None, time=None, log: str | None = None, log_module: int = 1, strict: bool = False, cache: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of the picked block, and the record of the choice. cache: a folder in which the index is kept for the next read."""
    table = blocks.cached_index(spark, [path], cache, strict) if cache else blocks.block_index(spark, [path], strict)
    rows = None
    if select.mode_of(select_by, index, timestep, time) == "time":
        require(log is not None, "MissingSlurmPath")
        parsed = runlog.read(spark, log)
        require(parsed.where(F.col("module_index") == log_module).limit(1).count() > 0, "BadSlurmModule", str(log_module))
        names = parsed.where(F.col("module_index") == log_module).select("names").first()[0]
        require({"Step", "Time"} <= set(names), "SlurmMissingCols", ", ".join(names))
        rows = runlog.steps(parsed, log_module)
    choice = select.pick(table, select_by, index, timestep, time, rows)
    one = choice.select("step_index").first()[0]  # the one block that was asked for
    return blocks.mask_empty(blocks.read_blocks(table.where(F.col("step_index") == one), blocks.columns_of(path))), choice


def _leaves(kind: T.StructType, above: str = "") -> Iterator[str]:
    """The names of a row's plain values, with dots."""
    for f in kind.fields:
        name = f"{above}.{f.name}" if above else f.name
        if isinstance(f.dataType, T.StructType):
            yield from _leaves(f.dataType, name)
        else:
            yield name


def as_text(df: DataFrame) -> DataFrame:
    """A summary for reading: a row of text per row, with a line "name = value" for each of its plain values, whatever the depth; lists
    as JSON, nulls as none."""

    def said(name: str) -> Column:
        kind = df.select(name).schema[0].dataType
        value = F.to_json(name) if isinstance(kind, T.ArrayType | T.MapType) else F.col(name).cast("string")
        return F.concat(F.lit(f"{name} = "), F.coalesce(value, F.lit("none")))

    return df.select(F.concat_ws("\n", *map(said, _leaves(df.schema)), F.lit("")).alias("value"))


class Results(Mapping):
    """Tables by name, each made when it is first asked for."""

    def __init__(self, **makers: Callable[[], object]):
        self.makers, self.made = makers, {}

    def __getitem__(self, name: str):
        if name not in self.made:
            self.made[name] = self.makers[name]()
        return self.made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.makers)

    def __len__(self) -> int:
        return len(self.makers)

    def write(self, folder: str, form: str = "parquet") -> None:
        """Writes every table below the folder, under its name; parquet, json or, for reading, text."""
        require(form in ("parquet", "json", "text"), "BadForm", form)
        for name, t in self.items():
            if isinstance(t, DataFrame):
                (as_text(t) if form == "text" else t).write.format(form).save(f"{folder.rstrip('/')}/{name}")


def analyze(spark: SparkSession, task: str, folder: str, file: str | None = None, dim: str = "2d", coord_scale: float = 1.0, progress: str = "auto", log: str | None = None, cache: str | None = None, **options) -> Results:
    """Runs one analysis on one block of the only file of its kind in the folder, or of the named file.

    task chunk: variable, dv (where it isn't given, the cell volume that the file's name gives, if it does), range_x, range_y. cluster: dx, dim3, ranges, diameter_range, mean_m, mean_n, bins, bin_size, by. vx:
    columns, factor. network2d: threshold and the other fields of network.Options. All: select_by, index, timestep, time.
    cache: a folder in which the file's index is kept. Returns DataFrames by name; nothing is computed before it is asked for, but
    for the choice of the block and the checks of a grid's coordinates."""
    task = task.strip().lower()
    require(task in TASKS, "BadTaskType", task)
    require(progress in PROGRESS, "BadMode", progress)
    require(task != "network2d" or dim.lower() == "2d", "BadNetworkChunkDim", dim)
    picks = {k: options.pop(k) for k in ("select_by", "index", "timestep", "time") if k in options}
    if log is None and picks.get("time") is not None:
        log = resolve.resolve(folder, "log")
    path = resolve.resolve(folder, dim.lower() if task in ("chunk", "network2d") else task, file)
    rows, choice = load(spark, path, log=log, cache=cache, **picks)
    if task == "chunk":
        options.setdefault("dv", None)
        if options["dv"] is None:
            with contextlib.suppress(AnalysisError):  # a name without a volume
                options["dv"] = cell_volume(path)
        found = fields.field(rows, options.pop("variable"), dim, scale=coord_scale, **options)
        return Results(selection=lambda: choice, field=lambda: found)
    if task == "cluster":
        by = options.pop("by", None)
        o = cluster.Options(**options)
        d = cluster.diameters(rows, o)
        makers = {
            "selection": lambda: choice, "clusters": lambda: d, "stats": lambda: cluster.stats(d, o), "fits": lambda: cluster.fits(d),
            "histogram": lambda: cluster.histogram(d, ["step_index"], "diameter", o.bins, o.bin_size), "curves": lambda: cluster.fit_curves(d), "cdf": lambda: cluster.cdf(d, ["step_index"]),
        }
        if by:
            require(by in d.columns, "BadXVar", by)
            makers["binned_mean"] = lambda: cluster.binned_mean(d, by, o=o)
        return Results(**makers)
    if task == "vx":
        names = velocity.density_columns(rows.columns, options.get("columns"))
        curves = velocity.cumulative(rows, options.get("columns"), options.get("factor", 0.001))
        return Results(selection=lambda: choice, curves=lambda: curves, plotted=lambda: velocity.plotted(curves, names))
    cells, o = network_input(rows, path, coord_scale, options)
    net = Network(cells, o)
    tables = {"cells": "cells", "components": "components", "global": "globals", "stats": "stats", "topology": "topology", "connectivity": "connectivity", "sizes": "sizes", "series": "series"}
    return Results(selection=lambda: choice, network=lambda: net, **{k: (lambda a=a: getattr(net, a)) for k, a in tables.items()})


def network_input(rows: DataFrame, path: str, coord_scale: float, options: dict) -> tuple[DataFrame, Options]:
    """Cells with scaled coordinates, and options whose spacing is given, from the file's name or from the coordinates."""
    require("threshold" in options and options["threshold"] is not None, "MissingThresholdN")
    require("Ncount" in rows.columns, "MissingNcount")
    x = next((c for c in ("Coord1", "c_x") if c in rows.columns), None)
    y = next((c for c in ("Coord2", "c_y") if c in rows.columns), None)
    require(x is not None and y is not None, "Not2DChunk", path)
    cells = rows.select("step_index", fields.scaled(F.col(x), coord_scale).alias("x"), fields.scaled(F.col(y), coord_scale).alias("y"), F.col("Ncount").alias("ncount"))
    grid.check(cells)
    for a in "xy":
        options[f"d{a}"], _ = grid.spacing(cells, a, options.get(f"d{a}"), path, coord_scale)
    return cells, Options(**options)


def evolve(spark: SparkSession, path: str, axis: str = "index", bounds=None, stride: int = 1, log: str | None = None, coord_scale: float = 1.0, cache: str | None = None, **options) -> DataFrame:
    """The network series over the blocks of a file, cut by index, timestep or time, every stride-th. With a log the physical
    time of each block is added; the range on the axis index then holds for timesteps."""
    require(axis in ("index", "timestep", "time"), "BadEvolutionSelectBy", axis)
    require(axis != "time" or log is not None, "MissingEvolutionSlurmPath")
    table = blocks.cached_index(spark, [path], cache) if cache else blocks.block_index(spark, [path])
    meta = table.select("step_index", "timestep")
    if log is not None:
        meta = select.times_of(meta, runlog.steps(runlog.read(spark, log)))
    by = "time" if axis == "time" else "timestep" if axis == "timestep" or log is not None else "step_index"
    meta = select.in_range(meta, by, bounds, stride)
    cells, o = network_input(blocks.read(spark, path, steps=meta, cache=cache), path, coord_scale, options)
    return evolution(cells, o, meta)


def selection_of(path: str) -> dict[str, float]:
    """What a file's name says of it."""
    return metadata(path)
