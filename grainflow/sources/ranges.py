"""Block files scanned in parallel, one file by many tasks.

A block says how many rows it has, so that where the next one starts follows from the one before. Each byte range is scanned as if
a likely first block were known: its lines are counted, and blocks are followed from there on. A pass over one row per range then
carries the true place from range to range; since blocks that are followed from any true start are the true ones, all that is
left to check is that the true place is on the way that was followed. Ranges where it isn't are scanned again from there."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.errors import AnalysisError, require
from ..functions.tables import discard, materialize

#: Bytes of a range; also what one task parses of a block.
RANGE = 32 << 20
#: Rounds of scanning ranges again; beyond, a file is scanned from the doubtful place on by one task.
ROUNDS = 6
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\r\n\f\v")] = True

#: What a task finds: blocks (kind 1), the first error on the way (2), and of the range as a whole (0) its lines (line), the lines
#: that its last block lacks (n), where its blocks end (search) and the bytes where its lines start and end.
FOUND = "path string, part bigint, kind int, line bigint, search bigint, search_end bigint, data_start bigint, data_end bigint, timestep double, n bigint, total double, code string"
_NAMES = [x.split()[0] for x in FOUND.split(", ")]
_KINDS = [pa.string(), pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.float64(), pa.int64(), pa.float64(), pa.string()]


@dataclass
class Lines:
    """The lines that start in a byte range; strict: those that aren't blank."""

    data: bytes
    base: int
    starts: np.ndarray
    ends: np.ndarray
    words: np.ndarray

    @staticmethod
    def of(source: pa.NativeFile, a: int, b: int, first: bool, strict: bool) -> Lines:
        """first: whether a line starts at a for sure; else it does after the line end at or behind the byte before."""
        source.seek(a if first else a - 1)
        data, base = source.read(b - source.tell()), a if first else a - 1
        while data and not data.endswith(b"\n") and (more := source.read(1 << 16)):
            end = more.find(b"\n")
            data += more if end < 0 else more[: end + 1]
        if not first:
            skip = data.find(b"\n") + 1
            data, base = (data[skip:], base + skip) if skip else (b"", b)
        raw = np.frombuffer(data, np.uint8)
        ends = np.flatnonzero(raw == 10) + 1
        if len(data) and (not len(ends) or ends[-1] < len(data)):
            ends = np.append(ends, len(data))
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)]
        solid = ~_SPACE[raw]
        begins = solid & np.concatenate([[True], ~solid[:-1]])[: len(solid)]
        upto = np.concatenate([[0], np.cumsum(begins)])
        words = upto[ends] - upto[starts] if len(ends) else np.zeros(0, int)
        keep = words > 0 if strict else np.ones(len(ends), bool)
        # a range without a line of its own ends where it would start
        return Lines(data, base, starts[keep], ends[keep], words[keep])

    def __len__(self) -> int:
        return len(self.starts)

    def numbers(self, k: int) -> list[float] | None:
        found = []
        for word in self.data[self.starts[k] : self.ends[k]].split():
            try:
                found.append(float(word))
            except ValueError:
                break
        return found if len(found) > 2 else None


def likely(lines: Lines, columns: int, tries: int = 5000, hops: int = 4) -> int | None:
    """A line that probably starts a block: three numbers, the second a whole one, and more such lines where it leads. Where rows have
    three numbers too, the start that leads furthest."""
    at = np.flatnonzero(lines.words == 3) if columns != 3 else np.arange(len(lines))
    best, far = None, -1

    def starts(k: int) -> int | None:
        """The rows of a block that may start at a line."""
        head = lines.numbers(k)
        ok = head is not None and (columns == 3 or lines.words[k] == 3) and head[1] >= (columns == 3) and head[1] == int(head[1])
        return int(head[1]) if ok else None

    for k in at[:tries].tolist():
        here, n, rows = k, 0, starts(k)
        while rows is not None and n < hops:
            here, n = here + 1 + rows, n + 1
            while here < len(lines) and lines.numbers(here) is None:  # what starts no block
                here += 1
            if here >= len(lines):
                break
            rows = starts(here)
        if n and rows is not None and columns != 3:
            return k
        if n and here > far and (rows is not None or n > 1):
            best, far = k, here
    return best


def follow(lines: Lines, k: int, strict: bool) -> Iterator[tuple]:
    """Blocks from line k on, as rows of FOUND without path and part: those wholly known, and at last where the way leads."""
    search = k
    while k < len(lines):
        head = lines.numbers(k)
        code = None
        if head is None:
            code = "BadBlockHeader" if strict else None
        elif head[1] != head[1] or head[1] < 0 or strict and head[1] != int(head[1]):
            code = "BadChunkCount"
        if code:
            yield 2, k, search, None, None, None, None, None, None, code
            break
        if head is None:
            k += 1
            continue
        n = int(head[1])
        last = k + n
        end = None if last >= len(lines) else lines.base + int(lines.ends[last])
        before = lines.base + int(lines.ends[search - 1]) if search else None
        yield 1, k, search, before, lines.base + int(lines.ends[k]), end, head[0], n, head[2], None
        search = k = last + 1
    yield 0, len(lines), search, None, lines.base, lines.base + int(lines.ends[-1]) if len(lines) else None, None, max(0, search - len(lines)), None, None


def _scan(jobs: DataFrame, strict: bool, open_) -> DataFrame:
    """jobs: path, part, a, b, first, columns, entry (the line to follow from; null: a likely one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with open_(r["path"]) as source:
                    lines = Lines.of(source, r["a"], r["b"], r["first"], strict)
                k = r["entry"] if r["entry"] is not None else likely(lines, r["columns"])
                rows = []
                for x in follow(lines, len(lines) if k is None else k, strict):
                    rows.append((r["path"], r["part"], *x))
                    if len(rows) == 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)
                        rows = []
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)

    return jobs.repartition(max(1, jobs.count()), "path", "part").mapInArrow(run, FOUND)


@dataclass
class Part:
    """A range of a file, and the true place in it."""

    a: int
    b: int
    first: bool
    lines: int = 0
    search: int = 0
    lacks: int = 0
    end: int | None = None
    entry: int = 0


def _walk(parts: list[Part]) -> None:
    """Carries the true place over the ranges of a file, as far as what was followed is true."""
    entry = 0
    for p in parts:
        p.entry = entry
        entry = entry - p.lines if entry >= p.lines else p.lacks


def index(spark: SparkSession, files: list[tuple[str, int, int, int]], strict: bool, open_, scan_from, size: int = RANGE) -> DataFrame:
    """The index of block files (path, byte after the header lines, bytes, columns), as blocks.block_index gives it.

    The driver holds a row per range of the files. A range's own blocks stay with Spark."""
    parts: dict[tuple[str, int], Part] = {}
    by_file: dict[str, list[int]] = {}
    for path, start, end, _ in files:
        cuts = [start, *range((start // size + 1) * size, end, size), end]
        by_file[path] = list(range(len(cuts) - 1))
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            parts[path, i] = Part(a, b, i == 0)
    columns = {path: n for path, _, _, n in files}
    kind = "path string, part bigint, a bigint, b bigint, first boolean, columns int, entry bigint"
    jobs = lambda keys, entry: spark.createDataFrame([(p, i, parts[p, i].a, parts[p, i].b, parts[p, i].first, columns[p], entry(p, i)) for p, i in keys], kind)
    found = materialize(_scan(jobs(parts, lambda p, i: 0 if i == 0 else None), strict, open_), "block-ranges")
    alone: set[str] = set()  # files that one task scans, as their ways can't be told

    for again in range(ROUNDS + 1):
        broken = {(r["path"], r["part"]) for r in found.where("kind = 2").select("path", "part").collect()}
        for r in found.where("kind = 0").collect():
            p = parts[r["path"], r["part"]]
            p.lines, p.search, p.lacks, p.end = r["line"], r["search"], r["n"], r["data_end"]
        for path, ids in by_file.items():
            _walk([parts[path, i] for i in ids])
        entries = spark.createDataFrame([(p, i, x.entry) for (p, i), x in parts.items()], "path string, part bigint, entry bigint")
        with_entry = found.join(entries, ["path", "part"])
        on = with_entry.where("kind > 0 AND entry <= line").groupBy("path", "part").agg(F.min(F.struct("line", "search", "search_end", "entry")).alias("s")).select("path", "part", "s.*")
        state = {(r["path"], r["part"]): r for r in on.collect()}
        wrong: list[tuple[str, int]] = []
        for (path, i), p in parts.items():
            if p.entry >= p.lines:
                continue
            s = state.get((path, i))
            # on the way: behind the last block, or in the gap of the first block that is left
            if not (s["search"] <= p.entry if s else p.search <= p.entry and (path, i) not in broken):
                wrong.append((path, i))
        if not wrong:
            break
        if again == ROUNDS:
            alone = {path for path, _ in wrong}
            break
        fixed = _scan(jobs(wrong, lambda p, i: parts[p, i].entry), strict, open_)
        bad = spark.createDataFrame(wrong, "path string, part bigint")
        later = materialize(found.join(F.broadcast(bad), ["path", "part"], "left_anti").select(*_NAMES).unionByName(fixed), "block-ranges")
        discard(found)
        found = later

    # bytes after a block's last row, where that is in a later range
    unknown = []
    for key, p in parts.items():
        s = state.get(key)
        if key[0] not in alone and 0 < p.entry < p.lines and not (s and s["search"] == p.entry and s["search_end"] is not None):
            unknown.append(key)
    ends = {k: s["search_end"] for k, s in state.items() if s["search_end"] is not None and s["search"] == parts[k].entry}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with open_(r["path"]) as source:
                    lines = Lines.of(source, r["a"], r["b"], r["first"], strict)
                yield pa.RecordBatch.from_pydict({"path": [r["path"]], "part": [r["part"]], "end": [lines.base + int(lines.ends[r["entry"] - 1])]})

    if unknown:
        asked = jobs(unknown, lambda p, i: parts[p, i].entry).repartition(len(unknown), "path", "part")
        ends |= {(r["path"], r["part"]): r["end"] for r in asked.mapInArrow(look, "path string, part bigint, end bigint").collect()}

    true = with_entry.where("kind > 0 AND entry <= line")
    if alone:
        true = true.where(~F.col("path").isin(list(alone)))
    for r in true.where("kind = 2").groupBy("path").agg(F.min(F.struct("part", "line", "code")).alias("e")).collect():
        raise AnalysisError(r["e"]["code"], r["path"])
    long: list[tuple[str, int, list]] = []  # blocks that go on behind their range, with their later pieces
    for path, ids in by_file.items():
        if path in alone:
            continue
        left, at = 0, 0
        for i in ids:
            p = parts[path, i]
            if left and p.lines:
                n = min(left, p.lines)
                end = p.end if n == p.lines else ends[path, i]
                pieces = long[-1][2]
                pieces.append((at, end, sum(x[3] for x in pieces), n))
                left, at = left - n, end
            if p.entry < p.lines and p.lacks:
                left, at = p.lacks, p.end
                long.append((path, i, []))
        require(not left, "UnexpectedEOF", path)
    piece = "array<struct<start: bigint, end: bigint, before: bigint, n: bigint>>"
    more = [(path, i, pieces, pieces[-1][1]) for path, i, pieces in long]
    spans = spark.createDataFrame(more, f"path string, part bigint, later {piece}, last_end bigint")
    order = W.partitionBy("path", "part").orderBy("line")
    sums = true.groupBy("path", "part").agg(F.count("*").alias("blocks"))
    # a row per range
    earlier = F.coalesce(F.sum("blocks").over(W.partitionBy("path").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = true.withColumn("k", F.row_number().over(order)).join(sums.select("path", "part", earlier.alias("earlier")), ["path", "part"])
    tops = {(path, i): parts[path, i] for path, i, _ in long}
    own = spark.createDataFrame([(path, i, p.end, p.lines) for (path, i), p in tops.items()], "path string, part bigint, part_end bigint, part_lines bigint")
    whole = numbered.join(own, ["path", "part"], "left").join(spans, ["path", "part"], "left")
    whole = whole.withColumn("open_end", F.col("data_end").isNull() & (F.col("n") > 0))
    whole = whole.withColumn("here", F.when(F.col("open_end"), F.col("part_lines") - F.col("line") - 1).otherwise(F.col("n")))
    open_end, here = F.col("open_end"), F.col("here")
    head = F.struct(F.col("data_start").alias("start"), F.when(open_end, F.col("part_end")).otherwise(F.col("data_end")).alias("end"), F.lit(0).cast("bigint").alias("before"), here.alias("n"))
    shifted = F.transform("later", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), (x["before"] + here).alias("before"), x["n"].alias("n")))
    pieces = F.when(F.col("n") == 0, F.array().cast(piece)).when(open_end, F.filter(F.concat(F.array(head), shifted), lambda x: x["n"] > 0)).otherwise(F.array(head))
    end = F.when(F.col("n") == 0, F.col("data_start")).when(open_end, F.col("last_end")).otherwise(F.col("data_end"))
    out = whole.select(
        "path",
        (F.col("earlier") + F.col("k")).cast("int").alias("step_index"),
        "timestep",
        F.col("n").cast("int").alias("num_chunks"),
        F.col("total").alias("total_count"),
        "data_start",
        end.alias("data_end"),
        pieces.cast("array<struct<start:bigint,end:bigint,before:int,n:int>>").alias("pieces"),
    )
    return out.unionByName(scan_from(list(alone))) if alone else out

