"""Areal density summed from the fastest bin down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.errors import require

MARK, TOTAL, PARTS = "ArealDensity", "massArealDensity", ("mass1ArealDensity", "mass2ArealDensity")


def density_columns(columns: list[str], asked: list[str] | None = None) -> list[str]:
    """The asked columns that there are, or all whose name holds ArealDensity, in their order."""
    found = [c for c in asked if c in columns] if asked is not None else [c for c in columns if MARK in c]
    require(bool(found) or asked is not None, "NoDensityCols")
    return found


def cumulative(df: DataFrame, asked: list[str] | None = None, factor: float = 0.001) -> DataFrame:
    """step_index, row_id, v and each density summed over the rows at and above it in order of v, and then row_id.

    If a table has the total and both parts, the total is first set to the sum of the parts. A step's rows are velocity
    bins, so that the running sum has one small group per step."""
    require("Chunk" in df.columns, "MissingChunk")
    names = density_columns(df.columns, asked)
    if TOTAL in df.columns and all(p in df.columns for p in PARTS):
        df = df.withColumn(TOTAL, F.col(PARTS[0]) + F.col(PARTS[1]))
    down = W.partitionBy("step_index").orderBy(F.desc("v"), F.desc("row_id")).rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("v", F.col("Chunk") * F.lit(factor))
    return df.select("step_index", "row_id", "v", *(F.sum(c).over(down).alias(c) for c in names))


def plotted(curves: DataFrame, names: list[str]) -> DataFrame:
    """Per step, the curves worth drawing: those with a value above 0; the total alone if just one part is there with it."""
    top = curves.groupBy("step_index").agg(*(F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in names))
    shown = F.filter(F.array(*(F.when(F.col(c) > 0, F.lit(c)) for c in names)), lambda x: x.isNotNull())
    if TOTAL in names and all(p in names for p in PARTS):
        one = (F.col(PARTS[0]) > 0) != (F.col(PARTS[1]) > 0)
        shown = F.when(one & (F.col(TOTAL) > 0), F.filter(shown, lambda x: ~x.isin(*PARTS))).otherwise(shown)
    return top.select("step_index", shown.alias("plotted"))
