"""The evolution of the two phases, followed as steps arrive.

Each micro-batch is a job of the library's own: steps that are whole are measured, cells of others wait in a table for the next
batch. Both are written under the batch's number, so that a batch that is run again replaces what it had written. Differences
are made when the series is read, from a row per step, so that steps may come in any order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.grid import STEP
from ..plans.network import Network, Options, changes

CELLS = f"{STEP} int, x double, y double, ncount double, num_chunks int"
CHANGES = ["pore_beta0", "pore_beta1", "matrix_beta0", "pore_largest_fraction"]


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def _there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)


def follow(cells: DataFrame, folder: str, o: Options) -> DataStreamWriter:
    """A stream's writer, to be started with a checkpoint: cells (step_index, x, y, ncount, num_chunks), where a step is whole once
    it has num_chunks cells. Its series grows below folder, which all executors reach.

    Cells of a step that never becomes whole wait on; those of one that is whole already are passed over."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        waiting = f"{folder}/waiting/batch={number - 1}"
        now = batch.select(*(F.col(f.split()[0]).cast(f.split()[1]) for f in CELLS.split(", ")))
        if _there(spark, waiting):
            now = now.unionByName(spark.read.schema(CELLS).parquet(waiting))
        if _there(spark, f"{folder}/series"):
            earlier = spark.read.parquet(f"{folder}/series").where(F.col("batch") < number).select(STEP).distinct()
            now = now.join(earlier, STEP, "left_anti")
        place = f"{folder}/cells/batch={number}"
        now.write.mode("overwrite").parquet(place)
        now = spark.read.schema(CELLS).parquet(place)
        whole = now.groupBy(STEP).agg(F.count("*").alias("n"), F.max("num_chunks").alias("of")).where("n >= of").select(STEP)
        now.join(whole, STEP, "left_anti").write.mode("overwrite").parquet(f"{folder}/waiting/batch={number}")
        ready = now.join(whole, STEP, "left_semi").drop("num_chunks")
        Network(ready, o).series.write.mode("overwrite").parquet(f"{folder}/series/batch={number}")
        _delete(spark, place)
        _delete(spark, f"{folder}/waiting/batch={number - 2}")

    return cells.writeStream.foreachBatch(put)


def series(spark: SparkSession, folder: str) -> DataFrame:
    """The series of the steps that are whole so far, with the changes from the step before among them, as plans.network.evolution."""
    return changes(spark.read.parquet(f"{folder}/series").drop("batch"), CHANGES)
