"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainflow.operators import graph


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: two columns of longs, in any order, with repeats and loops allowed; rows with a null are ignored.

    Returns (node, component) for every node with an edge to another one; component is the smallest node reachable. An empty
    table gives an empty one."""
    a, b = edges.columns
    return graph.components(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))).select("node", "component")
