"""Growing folders of cells as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import safe_div


def phase_counts(cells: DataFrame, threshold: float) -> DataFrame:
    """Per step: cells, pore cells and porosity of a stream or table of cells (step_index, ncount); for output mode update or complete.
    A step's state is one row of two counts."""
    n = cells.groupBy("step_index").agg(F.count("ncount").alias("valid_cells"), F.count_if(F.col("ncount") < threshold).alias("pore_cells"))
    return n.withColumn("porosity", safe_div(F.col("pore_cells"), F.col("valid_cells")))
