"""What the vector operators share: clean vectors, blocks of them packed into rows, and the meeting of blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.lit(False))


def arrays(column: pa.ListArray, dtype: str) -> list[np.ndarray]:
    """The vectors of a column, of whatever lengths."""
    values, at = np.asarray(column.values.to_numpy(zero_copy_only=False), dtype), column.offsets.to_numpy()
    return [values[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one, so that of rows that hold blocks few are Python objects at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def packs(df: DataFrame, keys: list[str], cols: list[str], make: Callable[[dict, list[dict]], dict], schema: str) -> DataFrame:
    """One row per key: what make gives for the rows of a key, which must be few enough for a task. schema: of make's columns."""
    head = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None

        def known(source: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            nonlocal types
            for batch in source:
                types = batch.schema
                yield from batch.to_pylist()

        for key, rows in groupby(known(batches), lambda r: tuple(r[k] for k in keys)):
            made = make(dict(zip(keys, key, strict=True)), list(rows))
            heads = {k: pa.array([v], types.field(k).type) for k, v in zip(keys, key, strict=True)}
            yield pa.RecordBatch.from_pydict(heads | {k: v if isinstance(v, pa.Array) else pa.array([v]) for k, v in made.items()})

    dealt = df.select(*keys, *cols).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, f"{head}, {schema}")


def meet(fixed: DataFrame, moving: DataFrame, keys: list[str], work: Callable[[dict, Iterator[dict]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """For each key the one row of fixed meets the rows of moving, one after another: only the fixed row stays in a task's memory,
    and it is sent once, however many meet it. A key without a fixed row gives nothing."""
    both = fixed.withColumn("__kind", F.lit(0)).unionByName(moving.withColumn("__kind", F.lit(1)), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby(rows_of(batches), lambda r: tuple(r[k] for k in keys)):
            first = next(rows)
            if first["__kind"] == 0:
                yield from work(first, rows)

    return both.repartition(*keys).sortWithinPartitions(*keys, "__kind").mapInArrow(run, schema)
