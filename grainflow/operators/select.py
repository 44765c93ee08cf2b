"""Picking blocks by index, timestep or physical time, and ranges of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.errors import AnalysisError, ordered_range, require
from ..functions.scalars import finite
from ..functions.tables import materialize


def nearest(requests: DataFrame, request: str, table: DataFrame, at: str, order: str, take: list[str]) -> DataFrame:
    """Each request with the columns `take` of the table's row whose `at` is nearest, of equally near ones the first by `order`.

    Both sides are laid on one line, sorted, and each request looks at the next row before and after it: nothing is crossed.
    The line is cut into ranges of at; the last row before and the first after each range come from a small aggregate. The rows
    after are found in descending order: a frame that grows costs a row each, one that shrinks would cost the rest of the range."""
    spark_rows = table.where(finite(F.col(at)).isNotNull()).select(F.col(at).cast("double").alias("x"), F.struct(F.col(order).alias("o"), *(F.col(c).alias(c) for c in take)).alias("row"))
    # rows at the same place: the first by order stands for all
    spark_rows = spark_rows.groupBy("x").agg(F.min_by("row", F.col("row.o")).alias("row"))
    asked = requests.select(F.col(request).cast("double").alias("x")).distinct().where(finite(F.col("x")).isNotNull())
    line = spark_rows.select("x", "row").unionByName(asked.select("x", F.lit(None).cast(spark_rows.schema["row"].dataType).alias("row"))).repartitionByRange("x").withColumn("part", F.spark_partition_id())
    line = materialize(line, "nearest")
    here = F.struct("x", "row")
    known = F.when(F.col("row").isNotNull(), here)
    ends = line.groupBy("part").agg(F.max_by(known, F.when(F.col("row").isNotNull(), F.col("x"))).alias("last"), F.min_by(known, F.when(F.col("row").isNotNull(), F.col("x"))).alias("first"))
    around = W.orderBy("part")  # one row per range: as many as there are partitions
    ends = ends.select("part", F.last("last", ignorenulls=True).over(around.rowsBetween(W.unboundedPreceding, -1)).alias("before_part"), F.last("first", ignorenulls=True).over(W.orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)).alias("after_part"))
    w = W.partitionBy("part").orderBy("x", F.col("row").isNull())
    found = line.select("part", "x", "row", F.last(known, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("b"), F.last(known, ignorenulls=True).over(W.partitionBy("part").orderBy(F.desc("x"), F.col("row").isNull()).rowsBetween(W.unboundedPreceding, 0)).alias("a"))
    found = found.where("row is null").join(ends, "part", "left").select("x", F.coalesce("b", "before_part").alias("b"), F.coalesce("a", "after_part").alias("a"))
    gap = lambda s: F.abs(F.col(f"{s}.x") - F.col("x"))
    choice = F.when(F.col("a").isNull(), F.col("b.row")).when(F.col("b").isNull(), F.col("a.row")).when(gap("b") < gap("a"), F.col("b.row")).when(gap("a") < gap("b"), F.col("a.row"))
    choice = F.coalesce(choice, F.when(F.col("b.row.o") <= F.col("a.row.o"), F.col("b.row")).otherwise(F.col("a.row")))
    found = found.select(F.col("x").alias("__x"), choice.alias("__row"))
    return requests.join(found, F.col(request).cast("double") == F.col("__x"), "left").select(*(requests[c] for c in requests.columns), *(F.col(f"__row.{c}").alias(c) for c in take))


def by_timestep(requests: DataFrame, blocks: DataFrame, request: str = "request") -> DataFrame:
    """Each requested timestep with the nearest block: request, step_index, timestep; of equally near ones the first."""
    return nearest(requests, request, blocks, "timestep", "step_index", ["step_index", "timestep"])


def by_time(requests: DataFrame, log: DataFrame, blocks: DataFrame, request: str = "request") -> DataFrame:
    """Each requested physical time with the nearest log row (row_id, step, time), and that row's step with the nearest block."""
    rows = nearest(requests, request, log, "time", "row_id", ["step", "time"])
    return nearest(rows, "step", blocks, "timestep", "step_index", ["step_index", "timestep"])


def times_of(blocks: DataFrame, log: DataFrame) -> DataFrame:
    """Blocks with the physical time of the nearest log step."""
    return nearest(blocks, "timestep", log, "step", "row_id", ["time"])


def mode_of(select_by: str | None, index=None, timestep=None, time=None) -> str:
    """How a block is picked: as said, or by what is given."""
    if select_by is None:
        select_by = "time" if time is not None else "timestep" if timestep is not None and index is None else "index"
    select_by = select_by.strip().lower()
    require(select_by in ("index", "timestep", "time"), "NeedSelector", select_by)
    return select_by


def pick(blocks: DataFrame, select_by: str | None = None, index=None, timestep=None, time=None, log: DataFrame | None = None) -> DataFrame:
    """One row: mode, requested, step_index, timestep (and step, time of the log row for mode time)."""
    spark, mode = blocks.sparkSession, mode_of(select_by, index, timestep, time)
    first = blocks.agg(F.count("*").alias("n")).first()["n"]
    require(first > 0, "NoBlocks")
    if mode == "index":
        require(index is not None, "MissingIndex")
        k = int(abs(index) + 0.5) * (1 if index >= 0 else -1)
        require(1 <= k <= first, "BadIndex", f"{k} of {first}")
        found = blocks.where(F.col("step_index") == k).select(F.lit(float(index)).alias("requested"), "step_index", "timestep")
    elif mode == "timestep":
        require(timestep is not None, "MissingTimeStep")
        found = by_timestep(spark.createDataFrame([(float(timestep),)], "requested double"), blocks, "requested")
    else:
        require(time is not None, "MissingTime")
        require(log is not None, "MissingSlurmPath")
        if log.limit(1).count() == 0:
            raise AnalysisError("SlurmNoFiniteRows")
        found = by_time(spark.createDataFrame([(float(time),)], "requested double"), log, blocks, "requested")
    return found.select(F.lit(mode).alias("mode"), *found.columns)


def in_range(blocks: DataFrame, axis: str | Column = "step_index", bounds=None, stride: int = 1) -> DataFrame:
    """Blocks whose axis is in the bounds, every stride-th of them in order."""
    require(isinstance(stride, int) and stride >= 1, "BadEvolutionStride", str(stride))
    bounds = ordered_range(bounds)
    x = F.col(axis) if isinstance(axis, str) else axis
    kept = blocks if bounds is None else blocks.where(x.between(*bounds))
    if stride == 1:
        return kept
    ranked = kept.withColumn("__rn", F.row_number().over(W.orderBy("step_index")))  # a row per block, not per cell
    return ranked.where((F.col("__rn") - 1) % stride == 0).drop("__rn")
