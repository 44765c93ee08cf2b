"""Block files as a data source of Spark: format "blocks" reads, writes and follows them.

    register(spark)
    spark.read.format("blocks").load("/runs/bin2d_a.txt").where("timestep >= 1e6")   # other blocks aren't opened
    spark.readStream.format("blocks").load("/runs/bin2d_a.txt")                      # each block once, when it is whole
    df.write.format("blocks").mode("append").save("/runs/out")                       # files of whole blocks

Options of the reader: index, the place of an index as Parquet (blocks.cached_index writes it; without one the file is scanned as the
query is planned, which suits small files only), and strict."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from ..functions.errors import require
from . import blocks

FORMAT = "blocks"
#: Columns that a block has as a whole: filters on them choose blocks.
OF_BLOCK = ("step_index", "timestep", "num_chunks", "total_count")
#: Pushed filters as tests of the index.
TESTS: dict[type, Callable] = {
    EqualTo: lambda c, v: c == v,
    GreaterThan: lambda c, v: c > v,
    GreaterThanOrEqual: lambda c, v: c >= v,
    LessThan: lambda c, v: c < v,
    LessThanOrEqual: lambda c, v: c <= v,
    In: lambda c, v: c.isin(list(v)),
}


def files_of(path: str) -> list[str]:
    """A file, or the .txt files of a folder by name."""
    store, place = blocks.store_of(path)
    info = store.get_file_info(place)
    require(info.type != fs.FileType.NotFound, "FileNotFound", path)
    if info.type == fs.FileType.File:
        return [path]
    names = sorted(f.base_name for f in store.get_file_info(fs.FileSelector(place)) if f.type == fs.FileType.File and f.base_name.endswith(".txt"))
    return [f"{path.rstrip('/')}/{n}" for n in names]


@dataclass
class Pieces(InputPartition):
    """What one task parses: pieces of blocks, as an Arrow table in bytes, or nothing."""

    table: bytes | None

    def rows(self) -> list[dict]:
        return pa.ipc.open_stream(self.table).read_all().to_pylist() if self.table else []


def _partitions(index: pa.Table) -> list[Pieces]:
    """The pieces of an index's blocks in file order, so many in a partition as have blocks.BATCH bytes: the number of tasks follows the
    bytes, not the number of blocks."""
    index = index.sort_by([("path", "ascending"), ("step_index", "ascending")]).combine_chunks()
    pieces = pc.list_flatten(index["pieces"]).combine_chunks()
    if isinstance(pieces, pa.ChunkedArray):
        pieces = pa.concat_arrays(pieces.chunks) if pieces.num_chunks else pa.array([], index.schema.field("pieces").type.value_type)
    flat = index.select(["path", *OF_BLOCK]).take(pc.list_parent_indices(index["pieces"]))
    for i, f in enumerate(pieces.type):
        flat = flat.append_column(f.name, pieces.field(i))
    flat = flat.filter(pc.field("n") > 0).combine_chunks()
    sizes = np.asarray(pc.subtract(flat["end"], flat["start"]).to_numpy())
    group = (np.cumsum(sizes) - sizes) // blocks.BATCH
    ends = [*(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)] if len(sizes) else []
    out = []
    for a, z in zip([0, *ends[:-1]], ends, strict=False):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, flat.schema) as to:
            to.write_table(flat.slice(a, z - a))
        out.append(Pieces(sink.getvalue().to_pybytes()))
    return out or [Pieces(None)]


def _read(partition: Pieces, columns: list[str]) -> Iterator[pa.RecordBatch]:
    for part in blocks.small_batches(partition.rows()):
        yield from blocks.read_pieces(part, columns)


NAMES = [x.split()[0] for x in blocks.INDEX.split(", ")]


class Reader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], index: str | None, strict: bool):
        self.path, self.columns, self.index, self.strict = path, columns, index, strict
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of a block's columns with values, which hold for all its rows or none."""
        for f in filters:
            if type(f) in TESTS and f.attribute in {(c,) for c in OF_BLOCK} and f.value is not None and not (isinstance(f, In) and None in f.value):
                self.filters.append(f)
            else:
                yield f

    def _index(self, wanted: ds.Expression | None) -> pa.Table:
        if self.index:
            store, place = blocks.store_of(self.index)
            return ds.dataset(place, filesystem=store, format="parquet", schema=blocks.INDEX_SCHEMA).to_table(columns=NAMES, filter=wanted)
        rows, before = [], 0
        for path in files_of(self.path):
            found = [dict(zip(NAMES, row, strict=True)) for row in blocks.scan_blocks(path, self.strict)]
            rows += [r | {"step_index": before + n} for n, r in enumerate(found, 1)]
            before += len(found)
        table = pa.Table.from_pylist(rows, blocks.INDEX_SCHEMA)
        return table if wanted is None else table.filter(wanted)

    def partitions(self) -> Sequence[Pieces]:
        wanted = None
        for f in self.filters:
            test = TESTS[type(f)](ds.field(f.attribute[0]), f.value)
            wanted = test if wanted is None else wanted & test
        return _partitions(self._index(wanted))

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        yield from _read(partition, self.columns)


class Follower(DataSourceStreamReader):
    """Growing files. An offset holds for each file the byte up to which its blocks were given, and their number."""

    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns
        self.known: dict[str, tuple[int, int]] = {}
        self.found: dict[str, list[tuple]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for path in files_of(self.path):
            at, number = self.known.get(path, (0, 0))
            for row, end in blocks.whole_blocks(path, at, number):
                self.found.setdefault(path, []).append(row)
                at, number = end, row[1]
            self.known[path] = (at, number)
        return {p: list(x) for p, x in self.known.items() if x[1]}

    def partitions(self, start: dict, end: dict) -> Sequence[Pieces]:
        out = []
        for path, (stop, last) in end.items():
            at, number = start.get(path, (0, 0))
            rows = [r for r in self.found.get(path, []) if number < r[1] <= last]
            if len(rows) < last - number:  # a batch of an earlier run
                rows = [r for r, e in blocks.whole_blocks(path, at, number) if e <= stop and r[1] <= last]
            out += [dict(zip(NAMES, r, strict=True)) for r in rows]
        return _partitions(pa.Table.from_pylist(out, blocks.INDEX_SCHEMA))

    def commit(self, end: dict) -> None:
        for path, (_, last) in end.items():
            self.found[path] = [r for r in self.found.get(path, []) if r[1] > last]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        yield from _read(partition, self.columns)


@dataclass
class Part(WriterCommitMessage):
    """A task's file, as yet under a name of its own, with the first and last steps that it holds."""

    aside: str | None
    first: int = 0
    last: int = 0


class Writer(DataSourceArrowWriter):
    """Rows by step and row_id, each step in one task (save sees to both): a file a task, under its name only once all have succeeded."""

    def __init__(self, path: str, schema: T.StructType, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex
        self.columns = [f.name for f in schema.fields if f.name not in blocks.META.fieldNames()]
        missing = set(blocks.META.fieldNames()) - {"path"} - set(schema.fieldNames())
        require(not missing, "MissingColumns", ", ".join(sorted(missing)))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        store, place = blocks.store_of(self.path)
        task, out, part, left = TaskContext.get(), None, Part(None), 0
        step = row_id = None
        for batch in iterator:
            keys = [batch.column(c).to_pylist() for c in ("step_index", "timestep", "num_chunks", "total_count", "row_id")]
            values = [batch.column(c).to_pylist() for c in self.columns]
            lines = []
            for i, (s, t, n, total, r) in enumerate(zip(*keys, strict=True)):
                if out is None:
                    aside = f"{place}/.{self.job}-{task.partitionId()}-{task.taskAttemptId()}"
                    store.create_dir(place, recursive=True)
                    out, part = store.open_output_stream(aside), Part(aside, s, s)
                    lines += ["# blocks", "# timestep rows total", "# " + " ".join(self.columns)]
                if s != step:
                    require(left == 0 and (step is None or s > step), "UnorderedRows", f"step {s}")
                    lines.append(f"{t:.17g} {n} {0 if total is None else total:.17g}")
                    step, left, row_id = s, n, 0
                require(r == row_id + 1, "UnorderedRows", f"step {s}, row {r}")
                row_id, left = r, left - 1
                lines.append(" ".join("NaN" if v[i] is None else f"{v[i]:.17g}" for v in values))
            if lines:
                out.write(("\n".join(lines) + "\n").encode())
                part.last = step
        if out is not None:
            out.close()
            require(left == 0, "UnexpectedEOF", f"step {step} lacks {left} rows")
        return part

    def commit(self, messages: list[Part | None]) -> None:
        store, place = blocks.store_of(self.path)
        parts = sorted((m for m in messages if m and m.aside), key=lambda m: m.first)
        require(all(a.last < b.first for a, b in zip(parts, parts[1:], strict=False)), "UnorderedRows", "a step in two tasks")
        old = [] if not parts else files_of(self.path)
        if self.overwrite:
            for path in old:
                store.delete_file(blocks.store_of(path)[1])
            old = []
        for i, part in enumerate(parts, len(old)):
            store.move(part.aside, f"{place}/part-{i:06d}.txt")

    def abort(self, messages: list[Part | None]) -> None:
        store, place = blocks.store_of(self.path)
        if store.get_file_info(place).type != fs.FileType.Directory:
            return
        for f in store.get_file_info(fs.FileSelector(place)):
            if f.base_name.startswith(f".{self.job}-"):
                store.delete_file(f.path)


class Blocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        found = files_of(self.options["path"])
        require(bool(found), "NoMatch", self.options["path"])
        return blocks.row_schema(blocks.columns_of(found[0]))

    def _columns(self, schema: T.StructType) -> list[str]:
        return [f.name for f in schema.fields if f.name not in blocks.META.fieldNames()]

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options["path"], self._columns(schema), self.options.get("index"), self.options.get("strict", "false").lower() == "true")

    def streamReader(self, schema: T.StructType) -> Follower:
        return Follower(self.options["path"], self._columns(schema))

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known; filters reach it if spark.sql.python.filterPushdown.enabled is true, which this sets for the session."""
    spark.dataSource.register(Blocks)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def load(spark: SparkSession, path: str, cache: str, strict: bool = False) -> DataFrame:
    """A block file, or a folder of such as one, through the format, its index made by Spark's tasks and kept below cache."""
    register(spark)
    files = files_of(path)
    index = blocks.cached_index(spark, files, cache, strict)
    place = index.inputFiles()[0].rpartition("/")[0]
    if len(files) > 1:
        sizes = index.groupBy("path").agg(F.max("step_index").alias("n"))  # a row per file
        before = F.coalesce(F.sum("n").over(W.orderBy("path").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        place = f"{place}-chain"
        chain = index.join(sizes.select("path", before.cast("int").alias("before")), "path").withColumn("step_index", F.col("step_index") + F.col("before"))
        chain.select(NAMES).write.mode("overwrite").parquet(place)
    return spark.read.format(FORMAT).option("index", place).load(path)


def save(df: DataFrame, folder: str, mode: str = "append") -> None:
    """Writes rows (step_index, timestep, row_id and further columns; total_count, or else Ncount's sum) as files of whole blocks, which
    follow one another by name. A task writes a range of steps row by row; a step is in one file."""
    own = [c for c in df.columns if c not in blocks.META.fieldNames()]
    total = F.first("total_count") if "total_count" in df.columns else F.sum("Ncount") if "Ncount" in own else F.count("*")
    sizes = df.groupBy("step_index").agg(F.count("*").cast("int").alias("num_chunks"), total.cast("double").alias("total_count"))
    rows = df.select("step_index", F.col("timestep").cast("double").alias("timestep"), "row_id", *own).join(sizes, "step_index")
    dealt = rows.select("step_index", "timestep", "num_chunks", "total_count", "row_id", *own).repartitionByRange("step_index").sortWithinPartitions("step_index", "row_id")
    dealt.write.format(FORMAT).mode(mode).save(folder)
