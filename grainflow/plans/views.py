"""The driver's tables seen as what the analyses read: cells, clusters, velocity bins, physical sums, blocks and a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One grid: a cell per day and hour, its count of events and their total value."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.lit(1).alias("step_index"), (F.dayofmonth("ts") - 1).cast("double").alias("x"), F.hour("ts").cast("double").alias("y")).agg(
        F.count("*").cast("double").alias("ncount"), F.sum("value").alias("v")
    )


def cells_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids of 24 hours by 6 days, one for each six days."""
    e = table(spark, sf_dir, "events")
    d = F.dayofmonth("ts") - 1
    keys = [(F.floor(d / 6) + 1).cast("int").alias("step_index"), F.hour("ts").cast("double").alias("x"), (d % 6).cast("double").alias("y")]
    return e.groupBy(*keys).agg(F.count("*").cast("double").alias("ncount"), F.sum("value").alias("v"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids that grow in number with the table: one for each 32 order keys, a cell per order and line number, its quantity and price;
    orders of fewer lines miss cells."""
    li = table(spark, sf_dir, "lineitem")
    keys = [F.floor(F.col("l_orderkey") / 32).cast("int").alias("step_index"), F.col("l_orderkey").cast("double").alias("x"), F.col("l_linenumber").cast("double").alias("y")]
    return li.groupBy(*keys).agg(F.sum("l_quantity").cast("double").alias("ncount"), F.sum("l_extendedprice").alias("v"))


def threshold(df: DataFrame) -> float:
    """The median count, so that both phases are there at every scale."""
    return df.agg(F.median("ncount")).first()[0]


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cluster per part. Means of hundredths are taken from sums in the order of the table's rows, as one thread adds them: otherwise a mean
    that is a range's bound falls on either side by how the table is split. A part's rows are passed through, not held."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_discount", "l_tax", "_metadata.file_name", "_metadata.row_index")
    rows = W.partitionBy("l_partkey").orderBy("file_name", "row_index").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    li = li.withColumns({f"__{c}": F.sum(c).over(rows) for c in ("l_discount", "l_tax")})
    mean = lambda c: F.try_divide(F.max(f"__{c}"), F.count(c))
    return li.groupBy(F.lit(1).alias("step_index"), F.col("l_partkey").alias("row_id")).agg(
        F.count("*").cast("double").alias("Ncount"), F.avg("l_quantity").alias("c_x"), mean("l_discount").alias("c_y"), mean("l_tax").alias("vx")
    )


def vxbins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Velocity bins by quantity; row_id runs the other way, so that the order of rows isn't that of velocities."""
    li = table(spark, sf_dir, "lineitem")
    of = lambda s: F.sum(F.when(F.col("l_linestatus") == s, F.col("l_extendedprice")).otherwise(0.0))
    return li.groupBy(F.lit(1).alias("step_index"), F.col("l_quantity").alias("Chunk")).agg(
        (-F.max("l_quantity")).cast("int").alias("row_id"), of("O").alias("mass1ArealDensity"), of("F").alias("mass2ArealDensity"), F.sum("l_extendedprice").alias("massArealDensity")
    )


#: Sums that stand for a bin's momenta, second moments and virials, as SQL that Spark and DuckDB read alike.
SUMS = {
    "v_mass": "l_quantity", "v_mvx": "l_quantity * l_discount", "v_mvy": "l_quantity * l_tax", "v_mvz": "l_quantity * l_discount * l_tax",
    "c_ke": "l_quantity * (l_discount + l_tax)", "v_mvvxx": "l_quantity * l_discount * l_discount", "v_mvvyy": "l_quantity * l_tax * l_tax",
    "v_mvvzz": "l_quantity * l_discount * l_discount * l_tax", "v_mvvxy": "l_quantity * l_discount * l_tax", "v_mvvxz": "l_discount * l_tax * 3",
    "v_mvvyz": "l_tax * l_tax * 2", "c_virial_1_": "l_extendedprice / 100", "c_virial_2_": "l_extendedprice / 200", "c_virial_3_": "l_quantity * 30",
    "c_virial_4_": "l_discount * 1000", "c_virial_5_": "l_tax * 1000", "c_virial_6_": "l_quantity * 2",
}


def phys(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    keys = [F.lit(1).alias("step_index"), F.col("l_quantity").alias("Coord1"), F.col("l_linenumber").cast("double").alias("Coord2")]
    return li.groupBy(*keys).agg(F.count("*").cast("double").alias("Ncount"), *(F.expr(f"sum({x})").alias(c) for c, x in SUMS.items()))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block per day."""
    d = F.dayofmonth("ts")
    return table(spark, sf_dir, "events").select(d.alias("step_index"), (d * 100.0).alias("timestep")).distinct()


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log row per day: its step, and as time the value of events so far, to cents."""
    d = table(spark, sf_dir, "events").groupBy(F.dayofmonth("ts").alias("row_id")).agg(F.sum("value").alias("s"))
    run = W.orderBy("row_id").rowsBetween(W.unboundedPreceding, 0)  # thirty rows
    return d.select("row_id", (F.col("row_id") * 100.0 + 7).alias("step"), F.round(F.sum("s").over(run), 2).alias("time"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded: sums in another order differ in their last digits."""
    def one(c: str, kind: str) -> Column:
        return F.round(c, digits).alias(c) if kind == "double" else F.col(c)

    return df.select(*(one(c, k) for c, k in df.dtypes))
