"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from .errors import require


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where none is named, the context's checkpoint folder, or else the warehouse, if all tasks
    reach it: Spark runs on one machine, or the warehouse isn't on a machine's own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir", None) or ""
        alone = re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master)
        require(bool(found) and (bool(alone) or "://" in found and not found.startswith("file:")), "NoSharedFolder", "name one in spark.checkpoint.dir")
    return found.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/grainflow/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str, *metrics) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage is cut and nothing is computed twice.

    metrics: pairs of an Observation and its aggregates, filled by the write."""
    path = scratch(df.sparkSession, what)
    for observation, *aggregates in metrics:
        df = df.observe(observation, *aggregates)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._grainflow_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize wrote, once nothing will read them again. Others are left alone."""
    for t in tables:
        if path := getattr(t, "_grainflow_path", None):
            place = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
