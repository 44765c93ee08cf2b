"""Block files: three header lines (the third names the columns), then blocks of "timestep rows total" and that many rows.

A file is read in two jobs. The first scans each file once, a large one by many tasks (ranges), skipping a block's rows by
counting line ends in large buffers, and finds the byte range of each block and of the pieces that a large one falls into: a small
table, which can be filtered by step before anything is parsed and kept as Parquet for later reads. The second parses the pieces that are left column by
column, a task per few pieces, wherever they are."""

from __future__ import annotations

import hashlib
import io
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv, fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.errors import AnalysisError, require
from ..functions.names import header_names
from . import ranges

INDEX = "path string, step_index int, timestep double, num_chunks int, total_count double, data_start bigint, data_end bigint, pieces array<struct<start:bigint,end:bigint,before:int,n:int>>"
INDEX_SCHEMA = pa.schema([("path", pa.string()), ("step_index", pa.int32()), ("timestep", pa.float64()), ("num_chunks", pa.int32()), ("total_count", pa.float64()), ("data_start", pa.int64()), ("data_end", pa.int64()), ("pieces", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("before", pa.int32()), ("n", pa.int32())])))])
#: Bytes of a block that one task parses at once, about.
PIECE = 32 << 20
#: Bytes of small pieces that one task parses, and the gap up to which two are read at once.
BATCH, NEAR = 4 << 20, 1 << 16
META = T.StructType().add("path", "string").add("step_index", "integer").add("timestep", "double").add("num_chunks", "integer").add("total_count", "double").add("row_id", "integer")
#: Columns that an empty cell keeps.
KEPT = ("Chunk", "Ncount")


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI, and the place in it."""
    return fs.FileSystem.from_uri(path if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path) else f"file://{path}")


def _open(path: str) -> pa.NativeFile:
    store, place = store_of(path)
    return store.open_input_file(place)


class _Lines:
    """The lines of a file from a place on, one by one, or skipped by the thousand."""

    def __init__(self, source: pa.NativeFile, at: int = 0, step: int = 8 << 20):
        source.seek(at)
        self.source, self.step, self.base, self.data, self.pos = source, step, at, b"", 0

    @property
    def at(self) -> int:
        return self.base + self.pos

    def _more(self) -> bool:
        """Reads on, keeping what isn't used yet; False at the file's end."""
        new = self.source.read(self.step)
        self.base, self.data, self.pos = self.at, self.data[self.pos :] + new, 0
        return bool(new)

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        while (found := self.next()) is not None:
            yield found

    def next(self) -> tuple[int, bytes] | None:
        """The byte at which the next line starts, and the line."""
        while (end := self.data.find(b"\n", self.pos)) < 0:
            if not self._more():
                if self.pos == len(self.data):
                    return None
                end = len(self.data)
                break
        at, line = self.at, self.data[self.pos : end]
        self.pos = min(end + 1, len(self.data))
        return at, line

    def skip(self, n: int) -> Iterator[tuple[int, int]]:
        """Skips n lines; gives the place and the lines passed after each buffer, the last time when all are, or at the file's end."""
        left = n
        while left:
            ends = np.flatnonzero(np.frombuffer(self.data, np.uint8, offset=self.pos) == 10) if self.pos < len(self.data) else ()
            if len(ends):
                k = min(left, len(ends))
                self.pos += int(ends[k - 1]) + 1
                left -= k
                yield self.at, n - left
            if left and not self._more():
                if self.pos < len(self.data):
                    self.pos, left = len(self.data), left - 1
                    yield self.at, n - left
                return


def _lines(source: pa.NativeFile, at: int = 0, step: int = 8 << 20) -> Iterator[tuple[int, bytes]]:
    """Lines with the byte at which each starts."""
    return iter(_Lines(source, at, step))


def _numbers(line: bytes) -> list[float] | None:
    """The numbers at the start of a line; None if there are none."""
    found = []
    for word in line.split():
        try:
            found.append(float(word))
        except ValueError:
            break
    return found or None


def columns_of(path: str) -> list[str]:
    """The column names in a file's third line."""
    with _open(path) as source:
        head = [line for _, line in zip(range(3), _lines(source, step=1 << 16), strict=False)]
    require(len(head) == 3, "HeaderTooShort", path)
    return header_names(head[2][1].decode())


def scan_blocks(path: str, strict: bool = False, piece: int = PIECE) -> Iterator[tuple]:
    """Rows of the index of one file. Lenient: lines that don't start a block are skipped and a block takes its rows as raw
    lines. Strict: they are errors, and blank lines inside a block don't count as rows."""

    def passed(lines: _Lines, n: int) -> Iterator[tuple[int, int]]:
        if not strict:
            yield from lines.skip(n)
            return
        done = 0
        while done < n and (found := lines.next()) is not None:
            done += bool(found[1].strip())
            yield lines.at, done

    number = 0
    with _open(path) as source:
        lines = _Lines(source)
        for _ in range(3):
            require(lines.next() is not None, "HeaderTooShort", path)
        while (found := lines.next()) is not None:
            line = found[1]
            head = _numbers(line)
            if not head or len(head) < 3:
                require(not strict or not line.strip(), "BadBlockHeader", line.decode(errors="replace"))
                continue
            if strict:
                require(head[1] >= 0 and head[1] == int(head[1]), "BadChunkCount", line.decode(errors="replace"))
            number, n, start = number + 1, int(head[1]), lines.at
            pieces, begun, before, end, done = [], start, 0, start, 0
            for end, done in passed(lines, n):
                if end - begun >= piece or done == n:
                    pieces.append({"start": begun, "end": end, "before": before, "n": done - before})
                    begun, before = end, done
            require(done == n, "UnexpectedEOF", path)
            yield path, number, head[0], n, head[2], start, end, pieces


def _size(path: str) -> int:
    store, place = store_of(path)
    info = store.get_file_info(place)
    require(info.type == fs.FileType.File, "FileNotFound", path)
    return info.size


def _head(path: str) -> tuple[str, int, int, int]:
    """A file's path, the byte after its header lines, its bytes and columns."""
    with _open(path) as source:
        lines = _Lines(source, step=1 << 16)
        head = [lines.next() for _ in range(3)]
        require(head[2] is not None, "HeaderTooShort", path)
        return path, lines.at, source.size(), len(header_names(head[2][1].decode()))


def block_index(spark: SparkSession, paths: list[str], strict: bool = False, size: int = ranges.RANGE) -> DataFrame:
    """One row per block of the files: path, step_index (from 1 in file order), timestep, num_chunks, total_count and its bytes.

    A file of more than `size` bytes, and every file if strict, is scanned by a task per `size` bytes when this is called."""
    large = [p for p in paths if strict or _size(p) > size]
    small = _whole(spark, [p for p in paths if p not in set(large)], strict)
    if not large:
        return small
    found = ranges.index(spark, [_head(p) for p in large], strict, _open, lambda alone: _whole(spark, alone, strict), size)
    return found.unionByName(small) if len(large) < len(paths) else found


def _whole(spark: SparkSession, paths: list[str], strict: bool) -> DataFrame:
    """The index of files that a task each scans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = INDEX_SCHEMA
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for row in scan_blocks(path, strict):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)), "path")
    return files.mapInArrow(run, INDEX)


def signature(path: str) -> str:
    """Changes when a file's size, its time of change, or its first or last kilobyte does."""
    store, place = store_of(path)
    info = store.get_file_info(place)
    require(info.type == fs.FileType.File, "FileNotFound", path)
    with store.open_input_file(place) as source:
        head = source.read(1024)
        source.seek(max(0, info.size - 1024))
        tail = source.read(1024)
    return hashlib.sha256(f"{path}|{info.size}|{info.mtime_ns}|".encode() + head + b"|" + tail).hexdigest()


def cached_index(spark: SparkSession, paths: list[str], cache: str, strict: bool = False) -> DataFrame:
    """block_index, kept in the folder `cache` under the files' signatures and read from there the next time."""
    key = hashlib.sha256("".join(sorted(map(signature, paths))).encode() + bytes([strict])).hexdigest()
    place = f"{cache.rstrip('/')}/{key}"
    try:
        return spark.read.schema(INDEX).parquet(place)
    except AnalysisException:
        block_index(spark, paths, strict).write.mode("overwrite").parquet(place)
        return spark.read.schema(INDEX).parquet(place)


def spacing(index: DataFrame) -> DataFrame:
    """Per file: dt, the distance of its first two timesteps, and is_uniform, whether all others equal it nearly."""
    gap = F.col("timestep") - F.lag("timestep").over(W.partitionBy("path").orderBy("step_index"))
    gaps = index.select("path", "step_index", gap.alias("gap")).groupBy("path").agg(F.min_by("gap", F.when(F.col("gap").isNotNull(), F.col("step_index"))).alias("dt"), F.min("gap").alias("a"), F.max("gap").alias("b"))
    slack = F.greatest(F.lit(1e-12), 1e-9 * F.greatest(F.abs("dt"), F.lit(1.0)))
    return gaps.select("path", "dt", F.coalesce((F.abs(F.col("a") - F.col("dt")) <= slack) & (F.abs(F.col("b") - F.col("dt")) <= slack), F.lit(False)).alias("is_uniform"))


def _row_by_row(data: bytes, n: int, columns: int, path: str) -> list[pa.Array]:
    rows = [line.split()[:columns] for line in data.split(b"\n") if line.strip()]
    require(len(rows) >= n, "UnexpectedEOF", path)
    bad = next((r for r in rows[:n] if len(r) < columns), None)
    require(bad is None, "BadDataRow", f"{path}: {bad}")
    try:
        values = np.array(rows[:n], dtype="S").astype(np.float64).reshape(n, columns)
    except ValueError:
        raise AnalysisError("BadDataRow", path) from None
    return [pa.array(values[:, i], mask=np.isnan(values[:, i])) for i in range(columns)]


def _read_even(data: bytes, columns: int) -> pa.Table:
    """A table of at least so many columns from lines of one length."""
    even = re.sub(rb"(?m)^ +| +$", b"", re.sub(rb"[ \t\r\f\v]+", b" ", data))
    first = even.lstrip(b"\n").split(b"\n", 1)[0].split(b" ")
    require(len(first) >= columns, "BadDataRow")
    names = [str(i) for i in range(len(first))]
    how = csv.ConvertOptions(column_types=dict.fromkeys(names, pa.float64()), include_columns=names[:columns], null_values=["nan", "NaN", "NAN", "-nan", "-NaN"])
    return csv.read_csv(io.BytesIO(even), csv.ReadOptions(column_names=names, use_threads=False), csv.ParseOptions(delimiter=" ", quote_char=False), how).combine_chunks()


def _columns_of(found: pa.Table, n: int, columns: int) -> list[pa.Array]:
    return [pc.if_else(pc.is_nan(c), None, c) for c in (found.column(i).slice(0, n).combine_chunks() for i in range(columns))]


def _parse_even(pieces: list[bytes], n: int, columns: int) -> list[pa.Array] | None:
    """The columns of several pieces, n rows together; None unless each gives all its rows: no piece has more lines than rows."""
    try:
        found = _read_even(b"".join(pieces), columns)
    except (pa.ArrowInvalid, AnalysisError):
        return None
    return [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in _columns_of(found, n, columns)] if found.num_rows == n else None


def parse_rows(data: bytes, n: int, columns: int, path: str) -> list[pa.Array]:
    """The columns of a piece; rows of uneven lengths are read one by one."""
    try:
        found = _read_even(data, columns)
        require(found.num_rows >= n, "UnexpectedEOF")
        return _columns_of(found, n, columns)
    except (pa.ArrowInvalid, AnalysisError):
        return _row_by_row(data, n, columns, path)


def row_schema(columns: list[str]) -> T.StructType:
    return T.StructType([*META.fields, *(T.StructField(c, T.DoubleType()) for c in columns)])


def _kinds(columns: list[str]) -> pa.Schema:
    return pa.schema([("path", pa.string()), ("step_index", pa.int32()), ("timestep", pa.float64()), ("num_chunks", pa.int32()), ("total_count", pa.float64()), ("row_id", pa.int32()), *((c, pa.float64()) for c in columns)])


def _bytes_of(source: pa.NativeFile, pieces: list[dict]) -> list[bytes]:
    """The bytes of pieces in file order; those that lie close are read at once, others between them aren't read."""
    out, k = [], 0
    while k < len(pieces):
        start, z = pieces[k]["start"], k + 1
        while z < len(pieces) and 0 <= pieces[z]["start"] - pieces[z - 1]["end"] <= NEAR:
            z += 1
        source.seek(start)
        data = source.read(pieces[z - 1]["end"] - start)
        out += [data[p["start"] - start : p["end"] - start] for p in pieces[k:z]]
        k = z
    return out


def read_pieces(pieces: list[dict], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of pieces (path, step_index, timestep, num_chunks, total_count, start, end, before, n), a file opened once for those that follow
    one another. Pieces whose rows are even are parsed together, others one by one."""
    kinds = _kinds(columns)
    for path, of in groupby(pieces, lambda p: p["path"]):
        part = list(of)
        with _open(path) as source:
            data = _bytes_of(source, part)
        sizes = np.array([p["n"] for p in part])
        cells = _parse_even([d if d.endswith(b"\n") else d + b"\n" for d in data], int(sizes.sum()), len(columns)) if len(part) > 1 else None
        if cells is None:
            each = [parse_rows(d, p["n"], len(columns), path) for d, p in zip(data, part, strict=True)]
            cells = [pa.concat_arrays([y for x in c for y in (x.chunks if isinstance(x, pa.ChunkedArray) else [x])]) for c in zip(*each, strict=True)]
        which = pa.array(np.repeat(np.arange(len(part)), sizes))
        meta = [pa.array([p[f.name] for p in part], f.type).take(which) for f in list(kinds)[:5]]
        first = np.repeat(np.array([p["before"] + 1 for p in part]) - (np.cumsum(sizes) - sizes), sizes)
        ids = pa.array(first + np.arange(len(which)), pa.int32())
        yield pa.RecordBatch.from_arrays([*meta, ids, *cells], schema=kinds)


def small_batches(pieces: list[dict]) -> Iterator[list[dict]]:
    """Pieces in order, so many together as have BATCH bytes, about."""
    out, held = [], 0
    for p in pieces:
        out.append(p)
        held += p["end"] - p["start"]
        if held >= BATCH:
            yield out
            out, held = [], 0
    if out:
        yield out


def read_piece(piece: dict, columns: list[str]) -> pa.RecordBatch:
    """The rows of one piece; only its bytes are read."""
    return next(read_pieces([piece], columns))


def read_blocks(index: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of the blocks of an index: its columns but the bytes, row_id from 1 in file order, and the named columns as doubles
    (more values in a row than columns are dropped, fewer are an error). Empty cells aren't masked here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(batch.to_pylist()):
                yield from read_pieces(part, columns)

    pieces = index.select(*(f.name for f in META.fields if f.name != "row_id"), F.explode("pieces").alias("piece")).select("*", "piece.*").drop("piece").where("n > 0")
    return pieces.repartition("path", "step_index", "before").mapInArrow(run, row_schema(columns))


def whole_blocks(path: str, at: int = 0, number: int = 0) -> Iterator[tuple]:
    """Rows of the index, each with the byte behind its block, of the blocks of a growing file from byte `at` on (0: from its head on),
    after `number` others: only those that are whole, down to the last row's line end."""
    with _open(path) as source:
        size, lines = source.size(), _Lines(source, at)
        if at == 0:
            head = [lines.next() for _ in range(3)]
            if head[2] is None or lines.at >= size:
                return
        while (found := lines.next()) is not None and lines.at < size:
            head = _numbers(found[1])
            if not head or len(head) < 3:
                continue
            require(head[1] >= 0, "BadChunkCount", path)
            n, start, end, done = int(head[1]), lines.at, lines.at, 0
            for end, done in lines.skip(n):
                pass
            if done < n or end == size and n and not _ends_line(path, end):
                return
            number += 1
            yield (path, number, head[0], n, head[2], start, end, [{"start": start, "end": end, "before": 0, "n": n}] if n else []), end


def _ends_line(path: str, end: int) -> bool:
    with _open(path) as source:
        source.seek(end - 1)
        return source.read(1) == b"\n"


def mask_empty(df: DataFrame) -> DataFrame:
    """Where Ncount is 0, all columns but the number, the count and the coordinates are null. Needs Ncount and Coord1."""
    if "Ncount" not in df.columns or "Coord1" not in df.columns:
        return df
    keep = {*META.fieldNames(), *KEPT}
    masked = {c: F.when(F.col("Ncount") != 0, F.col(f"`{c}`")) for c in df.columns if c not in keep and not c.startswith("Coord")}
    return df.withColumns(masked)


def read(spark: SparkSession, paths: list[str] | str, steps: DataFrame | None = None, strict: bool = False, cache: str | None = None) -> DataFrame:
    """All rows of block files of the same columns; steps: a table of (step_index) to which the blocks are cut before parsing."""
    paths = [paths] if isinstance(paths, str) else paths
    names = columns_of(paths[0])
    index = cached_index(spark, paths, cache, strict) if cache else block_index(spark, paths, strict)
    if steps is not None:
        index = index.join(steps.select("step_index").distinct(), "step_index", "left_semi").select(*index.columns)
    return mask_empty(read_blocks(index, names))


def lines(df: DataFrame, columns: list[str], comments: tuple[str, str] = ("# blocks", "# timestep rows total")) -> DataFrame:
    """The text of a block file of rows (step_index, timestep, row_id, columns): (step_index, row_id, value), in any order."""
    head = df.sparkSession.createDataFrame([(-1, i, x) for i, x in enumerate((*comments, "# " + " ".join(columns)))], "step_index int, row_id int, value string")
    blocks = df.groupBy("step_index").agg(F.first("timestep").alias("t"), F.count("*").alias("n"), F.sum("Ncount" if "Ncount" in columns else F.lit(1)).alias("total"))
    starts = blocks.select("step_index", F.lit(0).alias("row_id"), F.concat_ws(" ", F.format_string("%.17g", F.col("t").cast("double")), "n", F.format_string("%.17g", F.col("total").cast("double"))).alias("value"))
    number = lambda c: F.coalesce(F.format_string("%.17g", F.col(f"`{c}`").cast("double")), F.lit("NaN"))
    rows = df.select("step_index", "row_id", F.concat_ws(" ", *map(number, columns)).alias("value"))
    return head.unionByName(starts).unionByName(rows)


def write(df: DataFrame, folder: str, columns: list[str]) -> None:
    """Writes a block file as text parts that follow one another in the order of their names."""
    lines(df, columns).repartitionByRange("step_index", "row_id").sortWithinPartitions("step_index", "row_id").select("value").write.text(folder)


def text_of(df: DataFrame, columns: list[str]) -> str:
    """The whole text, for small files."""
    out = io.StringIO()
    for r in lines(df, columns).orderBy("step_index", "row_id").toLocalIterator():
        out.write(r["value"] + "\n")
    return out.getvalue()
