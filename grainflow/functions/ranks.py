"""Running sums and ranks over ordered rows, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .tables import materialize


def running_sums(df: DataFrame, keys: list[str], order: list[Column], values: dict[str, Column]) -> DataFrame:
    """Adds a column per value: its sum over the rows of a key up to this one in the order, which must tell rows apart.

    Keys aren't null. Rows are cut into ranges of key and order and summed within each; what comes before a range is a small table, a row per
    key and range. A group of any size is spread over as many tasks as it has ranges."""
    with_values = df.select("*", *(v.alias(f"__value_{n}") for n, v in values.items()))
    dealt = with_values.repartitionByRange(*(F.col(k) for k in keys), *order).withColumn("__part", F.spark_partition_id())
    dealt = materialize(dealt, "ranges")  # the ranges are sampled: they must not be dealt twice
    sums = dealt.groupBy(*keys, "__part").agg(*(F.sum(f"__value_{n}").alias(f"__sum_{n}") for n in values))
    earlier = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*keys, "__part", *(F.coalesce(F.sum(f"__sum_{n}").over(earlier), F.lit(0)).alias(f"__before_{n}") for n in values))
    so_far = W.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    here = dealt.select("*", *(F.sum(f"__value_{n}").over(so_far).alias(f"__here_{n}") for n in values))
    out = here.join(starts, [*keys, "__part"])
    return out.select(*df.columns, *((F.col(f"__before_{n}") + F.col(f"__here_{n}")).alias(n) for n in values))


def running_sum(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds name: the sum of value over the rows of a key up to this one in the order; see running_sums."""
    return running_sums(df, keys, order, {name: value})


def quantiles(df: DataFrame, keys: list[str], value: str | Column, shares: tuple[float, ...], name: str = "q") -> DataFrame:
    """Per key an array of the value's quantiles at the shares, between neighbours by the straight line; nulls don't count, and a key
    without a value has no row. Keys aren't null.

    Equal values are counted together; the counts of ranges of values tell which ranges hold the ranks that are asked for, and
    only these are looked into: no task holds a group's values."""
    value = F.col(value) if isinstance(value, str) else value
    one = [] if keys else [F.lit(0).alias("__all")]
    by = keys or ["__all"]
    counts = df.select(*keys, *one, value.cast("double").alias("__v")).where("__v IS NOT NULL").groupBy(*by, "__v").agg(F.count("*").alias("__copies"))
    dealt = materialize(counts.repartitionByRange(*by, "__v").withColumn("__part", F.spark_partition_id()), "ranges")
    parts = dealt.groupBy(*by, "__part").agg(F.sum("__copies").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    places = parts.select(*by, "__part", "__n", before.alias("__before"), F.sum("__n").over(W.partitionBy(*by)).alias("__total"))
    at = lambda p: F.lit(float(p)) * (F.col("__total") - 1)
    ends = [F.struct(F.lit(i).alias("i"), side(at(p)).cast("long").alias("rank"), weight(at(p)).alias("w")) for i, p in enumerate(shares) for side, weight in ((F.floor, lambda x: F.floor(x) + 1 - x), (lambda x: F.floor(x) + 1, lambda x: x - F.floor(x)))]
    asked = places.withColumn("__e", F.explode(F.array(*ends))).where("__e.rank >= __before AND __e.rank < __before + __n AND __e.w > 0")
    asked = asked.select(*by, "__part", "__e.i", (F.col("__e.rank") - F.col("__before")).alias("__rank"), "__e.w")
    upto = F.sum("__copies").over(W.partitionBy(*by, "__part").orderBy("__v").rowsBetween(W.unboundedPreceding, 0))
    looked = dealt.join(asked.select(*by, "__part").distinct(), [*by, "__part"], "left_semi").withColumn("__upto", upto)
    hits = looked.join(asked, [*by, "__part"]).where("__rank < __upto AND __rank >= __upto - __copies")
    each = hits.groupBy(*by, "i").agg(F.sum(F.col("__v") * F.col("w")).alias("q"))
    found = each.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("i", "q"))).alias("all"))
    return found.select(*keys, F.transform("all", lambda x: x["q"]).alias(name))


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds name: the row's number within its key, from 1."""
    return running_sum(df, keys, order, F.lit(1), name).withColumn(name, F.col(name).cast("int"))
