"""Connected components of an edge table by alternating large-star and small-star rounds, with offsets along the edges.

An edge (u, v, ox, oy) says that v lies at u's place moved by the offset. The rounds keep, for every node, an edge to a smaller
one of its component, until all point at the smallest; the offsets then place every node relative to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.tables import discard, materialize


def _one_each(edges: DataFrame) -> DataFrame:
    """One of several edges between the same nodes: any will do to place a node."""
    return edges.groupBy("u", "v").agg(F.min(F.struct("ox", "oy")).alias("o")).select("u", "v", "o.ox", "o.oy")


#: Edges from which on a round looks for hubs.
MANY = 5_000


def _matched(rows: DataFrame, table: DataFrame, key: str, edges: int, how: str) -> DataFrame:
    """rows joined with table, which has a row per key. Rows of hubs, keys of more than a ten-thousandth of all edges (so that there are
    ten thousand at most), meet their row of the table by a broadcast and aren't gathered by key. Rows without hubs, as most are, take
    one plain join: each broadcast costs the driver a thread and some MB."""
    hubs = rows.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > max(1000, edges // 10_000)).select(key)
    if edges < MANY or hubs.isEmpty():
        return rows.join(table, key, how)
    hubs = F.broadcast(hubs)
    plain = rows.join(hubs, key, "left_anti").join(table, key, how)
    return plain.unionByName(rows.join(hubs, key, "left_semi").join(F.broadcast(table.join(hubs, key, "left_semi")), key, how))


def _least(edges: DataFrame, key: str) -> DataFrame:
    """Each node's least smaller neighbour and its offset, for the nodes that have one."""
    low = edges.groupBy("u").agg(F.min(F.struct("v", "ox", "oy")).alias("n"))
    return low.select(F.col("u").alias(key), F.col("n.v").alias("low"), F.col("n.ox").alias("lox"), F.col("n.oy").alias("loy"))


def _stars(edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """edges: u > v, n of them. The edges after one round, not yet written, and a table that they read. One large-star step (a node's larger neighbours go to its least neighbour, or stay with it where it
    is least itself) and one small-star step (its smaller neighbours, and itself, go to the least of them). Each step is a write: in one
    plan the second would hold the first seven times over."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    large = _matched(edges, _least(edges, "v"), "v", n, "left")
    large = _one_each(large.select("u", F.coalesce("low", "v").alias("v"), (F.col("ox") + zero("lox")).alias("ox"), (F.col("oy") + zero("loy")).alias("oy")))
    large = materialize(large, "large-stars")
    low = _least(large, "u")
    # v -> low: back from v to u, then on to low
    moved = _matched(large, low, "u", n, "inner").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"), (F.col("lox") - F.col("ox")).alias("ox"), (F.col("loy") - F.col("oy")).alias("oy"))
    return _one_each(moved.unionByName(low.select("u", F.col("low").alias("v"), F.col("lox").alias("ox"), F.col("loy").alias("oy")))), large


def components(edges: DataFrame) -> DataFrame:
    """edges: (u, v) or (u, v, ox, oy), in any direction, with repeats and loops allowed; rows with a null node are ignored.

    Returns (node, component, ox, oy) for each node with an edge to another one: component is the smallest node reachable, and
    lies at the node's place moved by the offset, along some path. An empty table gives an empty one. Rounds go on until one
    changes nothing; each about halves the depth. A round is two writes, of which the second also takes the edges' fingerprint;
    what it was made from is deleted then."""
    if "ox" not in edges.columns:
        edges = edges.select(F.col("u"), F.col("v"), F.lit(0).alias("ox"), F.lit(0).alias("oy"))
    up = F.col("u") > F.col("v")
    sign = F.when(up, 1).otherwise(-1)
    now = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), (sign * F.col("ox")).cast("int").alias("ox"), (sign * F.col("oy")).cast("int").alias("oy"))

    def written(e: DataFrame) -> tuple[DataFrame, tuple]:
        mark = Observation()
        sums = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")]
        out = materialize(e, "edges", (mark, *sums))
        return out, tuple(mark.get.get(k) for k in "nxs")

    now, before = written(_one_each(now))
    while before[0]:
        later, half = _stars(now, before[0])
        later, after = written(later)
        discard(now, half)
        now = later
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"), F.lit(0).alias("ox"), F.lit(0).alias("oy")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"), "ox", "oy").unionByName(roots)
