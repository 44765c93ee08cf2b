"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainflow.functions.tables import discard, materialize, scratch

__all__ = ["WORD", "discard", "materialize", "scratch", "slices", "spread_join", "table", "text_of"]

#: A word, as several contracts define it: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def slices(batch: pa.RecordBatch, text: int, size: int = 4 << 20, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most `rows` rows whose texts (a column by number) have `size` bytes together, but for single longer ones:
    what is made of a part in Python is bounded by bytes, not by a number of rows."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), np.int64)
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, side="right"))
        b = min(max(b, a + 1), a + rows)
        yield batch.slice(a, b - a)
        a = b


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], salt: Column, how: str = "inner") -> DataFrame:
    """many joined with a table of one row per key, without a task that holds all rows of a hot key: rows are dealt by key and salt
    (a number below some hundreds), and the other side follows to the pairs that exist. many is read twice. No key is null."""
    salted = many.withColumn("__salt", salt)
    placed = salted.select(*keys, "__salt").distinct().join(one, keys)
    return salted.join(placed, [*keys, "__salt"], how).drop("__salt")
