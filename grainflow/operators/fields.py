"""The value of one field per bin, with coordinates, scaled and cut to a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.errors import ordered_range, positive, require
from ..functions.physics import Units, first_present, variable


def coordinates(columns: list[str], dim: str = "1d") -> list[str] | None:
    """The columns of x and, for 2d, y; None if there are none."""
    x = first_present(columns, ("Coord1", "c_x", "Chunk"), None)
    y = first_present(columns, ("Coord2", "c_y"), None) if dim.lower() == "2d" else x
    return None if x is None or y is None else [x] if dim.lower() != "2d" else [x, y]


def scaled(x: Column, scale: float = 1.0) -> Column:
    return x if scale == 1.0 else x * F.lit(float(scale))


def field(df: DataFrame, name: str, dim: str = "1d", dv: float | None = None, scale: float = 1.0, range_x=None, range_y=None, units: Units = Units()) -> DataFrame:
    """step_index, row_id, x (and y in 2d) and value; ranges are inclusive and hold for scaled coordinates. A table without
    coordinates gives values alone and isn't cut."""
    positive(scale, "BadCoordScale")
    ranges = [ordered_range(range_x, "BadCoordRange"), ordered_range(range_y, "BadCoordRange")]
    require(dim.lower() in ("1d", "2d"), "BadChunkDim", dim)
    where, keys = coordinates(df.columns, dim), [c for c in ("step_index", "row_id") if c in df.columns]
    axes = [scaled(F.col(c), scale).alias(a) for c, a in zip(where or (), "xy", strict=False)]
    out = df.select(*keys, *axes, variable(df, name, dv, units).alias("value"))
    for a, bounds in zip("xy"[: len(axes)], ranges, strict=False):
        out = out if bounds is None else out.where(F.col(a).between(*bounds))
    return out
