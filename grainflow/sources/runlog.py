"""Run logs: free text with tables that start at a line "Step CPU ...", each with its own columns."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.errors import require
from ..functions.names import sanitize
from . import ranges
from .blocks import _open, _size

ROWS = "path string, module_index int, row_id int, names array<string>, values array<double>, accepted boolean"
SCHEMA = pa.schema([("path", pa.string()), ("part", pa.int64()), ("module_index", pa.int32()), ("row_id", pa.int32()), ("names", pa.list_(pa.string())), ("values", pa.list_(pa.float64())), ("accepted", pa.bool_())])


def header(line: str) -> list[str] | None:
    """The column names of a line that starts a table, else None."""
    words = re.sub(r"^[\s#%*]+", "", line).split()
    return [sanitize(w) for w in words] if [w.lower() for w in words[:2]] == ["step", "cpu"] else None


def numbers(line: str, n: int) -> list[float] | None:
    """Exactly n finite numbers, else None."""
    words = line.split()
    if len(words) != n:
        return None
    try:
        found = [float(w) for w in words]
    except ValueError:
        return None
    return found if all(map(math.isfinite, found)) else None


#: A line that may start a table.
TABLE = re.compile(rb"(?i)step\s+cpu\b")


def _modules(lines: ranges.Lines) -> Iterator[tuple[int, list[str]]]:
    """The lines of a range that start a table, and its columns."""
    for m in TABLE.finditer(lines.data):
        k = int(np.searchsorted(lines.ends, m.start(), side="right"))
        text = lines.data[lines.starts[k] : lines.ends[k]].decode("utf-8", "replace") if k < len(lines) else ""
        if (found := header(text)) is not None:
            yield k, found


def read(spark: SparkSession, paths: list[str] | str, size: int = ranges.RANGE) -> DataFrame:
    """One row per line that follows a table's header, until the next: accepted ones with their values and a row_id from 1, the
    others without. A file without a table is an error.

    A task reads `size` bytes: one pass finds where tables start, from which each range knows the table that it begins in; the
    other parses. row_id is counted on over ranges. The driver holds a row per range."""
    paths = [paths] if isinstance(paths, str) else paths
    parts = [(p, i, a, a == 0) for p in paths for i, a in enumerate(range(0, max(1, _size(p)), size))]
    jobs = spark.createDataFrame(parts, "path string, part bigint, a bigint, first boolean").repartition(len(parts), "path", "part")

    def lines_of(r: dict) -> ranges.Lines:
        with _open(r["path"]) as source:
            return ranges.Lines.of(source, r["a"], min(r["a"] + size, source.size()), r["first"], True)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                found = [names for _, names in _modules(lines_of(r))]
                yield pa.RecordBatch.from_pydict({"path": [r["path"]], "part": [r["part"]], "tables": [len(found)], "last": pa.array([found[-1] if found else None], pa.list_(pa.string()))})

    entries, module, names, path = [], 0, None, None
    for r in sorted(jobs.mapInArrow(look, "path string, part bigint, tables bigint, last array<string>").collect(), key=lambda r: (r["path"], r["part"])):
        if r["path"] != path:
            require(path is None or module > 0, "NoStepCpuBlock", path)
            path, module, names = r["path"], 0, None
        entries.append((path, r["part"], module, names))
        module, names = module + r["tables"], r["last"] or names
    require(module > 0, "NoStepCpuBlock", path)
    known = spark.createDataFrame(entries, "path string, part bigint, module int, names array<string>")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                lines, module, names, row = lines_of(r), r["module"], r["names"], 0
                tables, rows = dict(_modules(lines)), []
                for k in range(len(lines)):
                    if k in tables:
                        module, names, row = module + 1, tables[k], 0
                    elif names:
                        values = numbers(lines.data[lines.starts[k] : lines.ends[k]].decode("utf-8", "replace"), len(names))
                        row += values is not None
                        rows.append((r["path"], r["part"], module, row if values else None, names, values, values is not None))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)

    found = jobs.join(known, ["path", "part"]).repartition(len(parts), "path", "part").mapInArrow(parse, ROWS.replace("path string,", "path string, part bigint,"))
    if len(parts) == len(paths):
        return found.drop("part")
    counts_ = found.groupBy("path", "part", "module_index").agg(F.max("row_id").alias("n"))  # few rows per range
    before = F.coalesce(F.sum("n").over(W.partitionBy("path", "module_index").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    found = found.join(counts_.select("path", "part", "module_index", before.cast("int").alias("before")), ["path", "part", "module_index"])
    return found.withColumn("row_id", F.col("row_id") + F.col("before")).select(*(x.split()[0] for x in ROWS.split(", ")))


def value(name: str) -> Column:
    """A column of a log row by its name; null if its table hasn't it."""
    return F.element_at(F.map_from_arrays("names", "values"), F.lit(name))


def counts(log: DataFrame) -> DataFrame:
    """Accepted and skipped rows of each table."""
    return log.groupBy("path", "module_index").agg(F.count_if("accepted").alias("accepted_rows"), F.count_if(~F.col("accepted")).alias("skipped_rows"))


def steps(log: DataFrame, module: int = 1) -> DataFrame:
    """Step and Time of a table's rows, for looking up one by the other: (row_id, step, time), finite ones only."""
    found = log.where(F.col("accepted") & (F.col("module_index") == module)).select("row_id", value("Step").alias("step"), value("Time").alias("time"))
    return found.where("step is not null and time is not null")
