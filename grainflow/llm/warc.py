"""WARC archives: a writer with revisit records, and a salvage reader that recovers what follows damage."""

from __future__ import annotations

import base64
import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, scratch, spread_join, text_of

# Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2026-01-01T00:00:00Z"
ID = "urn:x-page:"
GZIP = b"\x1f\x8b\x08"
#: A field of this library's own, the last one of a record: the digest of all its header lines above.
HEADER_DIGEST = "X-Header-Digest"
#: A file is ended once it has this many bytes; a larger record gets a file of its own.
FILE_BYTES = 32 << 20


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header value on one line: control characters and spaces are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None) -> bytes:
    """One record: a response with its payload, or a revisit that holds only the response's HTTP header."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{ID}{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{digest_of(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        head.insert(2, ("WARC-Target-URI", _clean(url)))
    if refers_to is not None:
        head[-2:-2] = [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<{ID}{refers_to}>")]
    lines = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode()
    return lines + f"{HEADER_DIGEST}: sha1:{digest_of(lines)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def packed(data: bytes, level: int = 1) -> bytes:
    """A gzip member."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@dataclass(frozen=True)
class Gap:
    """Bytes of a file that no valid record covers, and why."""

    start: int
    end: int
    reason: str


@dataclass(frozen=True)
class Record:
    start: int
    end: int
    headers: dict[str, str]
    block: bytes


#: A version line, and where a record or a gzip member may start.
FIRST_LINE = re.compile(rb"WARC/\d{1,4}\.\d{1,4}\r\n")
FIRST_BYTES = 16
START = re.compile(rb"WARC/\d|\x1f\x8b\x08")


class _More(Exception):
    """More content is needed to tell."""


def _head(data: bytes | bytearray, at: int) -> tuple[dict[str, str], int, int, bool]:
    """The headers of the record at a place, its Content-Length, where its block starts, and whether a digest proves the headers.

    ValueError at the first line that no record has, so that of a false start no more is looked at than up to the next one."""
    if not FIRST_LINE.match(data, at):
        if len(data) - at >= FIRST_BYTES or not b"WARC/".startswith(bytes(data[at : at + 5])) or data.find(b"\n", at) >= 0:
            raise ValueError("no version line")
        raise _More
    headers, proven = {}, False
    p = data.find(b"\r\n", at) + 2
    while True:
        end = data.find(b"\r\n", p)
        if end < 0:
            raise _More
        if end == p:
            break
        if proven:
            raise ValueError("a header below the headers' digest")
        k, sep, v = bytes(data[p:end]).decode("utf-8", "replace").partition(":")
        if not sep:
            raise ValueError("a header line without a colon")
        key = k.strip().lower()
        if key == HEADER_DIGEST.lower():
            proven = v.strip() == f"sha1:{digest_of(bytes(data[at:p]))}"
            if not proven:
                raise ValueError("the headers' digest differs")
        headers[key], p = v.strip(), end + 2
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        raise ValueError("no Content-Length")
    return headers, int(size), p + 2, proven


def _proven(headers: dict[str, str], block: bytes) -> bool:
    """Whether the headers have a digest of the block; ValueError if it differs."""
    want = headers.get("warc-block-digest", "")
    if not want.startswith("sha1:"):
        return False
    if want[5:] != digest_of(block):
        raise ValueError("the block's digest differs")
    return True


_NO_END = "no end of record where Content-Length puts it"


class Content:
    """Records of the content of a gzip member, which arrives in parts. Of it no more is kept than a record's stated length;
    `proven` says whether digests cover all of the last record, its headers and its block."""

    def __init__(self):
        self.data, self.base, self.at, self.need = bytearray(), 0, 0, 0
        self.bad, self.why, self.proven = -1, "", False

    def feed(self, data: bytes, final: bool = False) -> Iterator[Record | Gap]:
        """The records and gaps that are whole with this part; places are those of the content."""
        self.data += data
        stop = self.base + len(self.data)
        while self.at < stop and (final or stop >= self.need):
            try:
                found = self._record(stop)
            except _More:
                if not final:
                    # twice as much, so that what is looked at again stays in proportion
                    self.need = max(self.need, stop + max(1, stop - self.at))
                    break
                self._skip(stop, "headers are cut off", final)
                continue
            except ValueError as e:
                self._skip(stop, str(e), final)
                continue
            if found is None:
                if not final:
                    break
                self._skip(stop, _NO_END, final)
                continue
            if self.bad >= 0:
                yield Gap(self.bad, found.start, self.why)
                self.bad = -1
            self.at, self.need = found.end, 0
            yield found
            self._drop()
        if final and self.bad >= 0:
            yield Gap(self.bad, stop, self.why)
            self.bad = -1

    def _skip(self, stop: int, why: str, final: bool) -> None:
        """Goes on to the next version line after a failed check."""
        if self.bad < 0:
            self.bad, self.why = self.at, why
        i = self.data.find(b"WARC/", self.at + 1 - self.base)
        self.at, self.need = (self.base + i, 0) if i >= 0 else (stop if final else max(self.at + 1, stop - 4), stop + 1)
        self._drop()

    def _drop(self) -> None:
        if self.at - self.base > 1 << 20:
            del self.data[: self.at - self.base]
            self.base = self.at

    def _record(self, stop: int) -> Record | None:
        """The record here; None if its end isn't there yet."""
        headers, size, start, proven = _head(self.data, self.at - self.base)
        end = start + size
        if self.base + end + 4 > stop:
            self.need = self.base + end + 4
            return None
        if self.data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(_NO_END)
        block = bytes(self.data[start:end])
        self.proven = _proven(headers, block) and proven
        return Record(self.at, self.base + end + 4, headers, block)


class File:
    """A file that can seek, read in parts of a megabyte; what is asked for round one place is read once."""

    PART = 1 << 20

    def __init__(self, source: BinaryIO):
        self.source, self.size, self.base, self.data = source, source.seek(0, io.SEEK_END), 0, b""

    def get(self, at: int, n: int) -> bytes:
        """Up to n bytes from a place on; of a place far off no more is read than these."""
        i = at - self.base
        if n < 64 and not 0 <= i <= len(self.data) - n and at < self.size:
            self.source.seek(at)
            return self.source.read(n)
        if n > self.PART:
            self.source.seek(at)
            return b"".join(iter(lambda left=[n]: self._part(left), b""))
        i = self._hold(at, n)
        return self.data[i : i + n]

    def _hold(self, at: int, n: int) -> int:
        """Where a place is in data, which holds n bytes from there on, or all that are left."""
        i = at - self.base
        if i < 0 or i + n > len(self.data) and self.base + len(self.data) < self.size:
            self.source.seek(at)
            self.base, self.data, i = at, self.source.read(self.PART), 0
        return i

    def _part(self, left: list[int]) -> bytes:
        data = self.source.read(min(self.PART, left[0]))
        left[0] -= len(data)
        return data

    def next(self, at: int) -> int:
        """The next place from at on where a record or member may start; -1 if there is none."""
        while at < self.size:
            i = self._hold(at, 64)
            if m := START.search(self.data, i):
                return self.base + m.start()
            at = max(at + 1, self.base + len(self.data) - 5)
            if self.base + len(self.data) == self.size:
                return -1
        return -1


def _plain(file: File, at: int) -> Record:
    """The uncompressed record at a place of a file; ValueError if it fails its checks."""
    n = 4096
    while True:
        head = file.get(at, n)
        try:
            headers, size, start, _ = _head(head, 0)
            break
        except _More:
            if at + n >= file.size:
                raise ValueError("headers are cut off") from None
            n *= 4
    end = at + start + size
    if end + 4 > file.size or file.get(end, 4) != b"\r\n\r\n":
        raise ValueError(_NO_END)
    block = file.get(at + start, size)
    _proven(headers, block)
    return Record(at, end + 4, headers, block)


def _inflated(file: File, at: int, step: int, fine: bool = True) -> Iterator[tuple[bytes, int, int, str | None, object]]:
    """Content of the gzip member at a place, with the file's place before and after each part and the state before it; the last
    part says why the member failed, or is an empty reason if it is sound. fine: up to the very byte of the damage."""
    z, fed, n = zlib.decompressobj(31), at, min(512, step)
    while True:
        data = file.get(fed, n)
        before, known = fed, z.copy()
        if not data:
            yield b"", fed, fed, "gzip: cut off", known
            return
        try:
            out = z.decompress(data)
        except zlib.error as e:
            out, why, z = b"", f"gzip: {e}", known.copy()
            if not fine:
                yield out, before, before, why, known
                return
            for i in range(len(data)):  # what comes before the damage
                try:
                    out += z.decompress(data[i : i + 1])
                except zlib.error:
                    yield out, before, before + i, why, known
                    return
        fed += len(data) - len(z.unused_data)
        yield out, before, fed, "" if z.eof else None, known
        if z.eof:
            return
        n = min(2 * n, step)


#: Content up to here is kept from the check of a member to the reading of its records; longer content is decompressed again.
KEPT = 4 << 20


def _sound(file: File, at: int) -> tuple[str, int, list[bytes] | None]:
    """Why a member fails its own checks (empty: it doesn't), the place where it ends, and its content if that is short."""
    kept, held = [], 0
    for out, _, end, why, _ in _inflated(file, at, 1 << 16, fine=False):
        held += len(out)
        if held <= KEPT:
            kept.append(out)
        if why is not None:
            return why, end, kept if held <= KEPT else None
    raise AssertionError


def _records(file: File, at: int, end: int, kept: list[bytes] | None) -> Iterator[Record | Gap]:
    """What a sound member holds; its own checks cover headers and blocks without a digest."""
    content = Content()
    some = False
    for x in _fed(content, kept if kept is not None else (out for out, *_ in _inflated(file, at, 1 << 16, fine=False))):
        some = True
        yield Gap(at, end, f"{x.reason} (bytes {x.start} to {x.end} of the member's content)") if isinstance(x, Gap) else Record(at, end, x.headers, x.block)
    if not some:
        yield Gap(at, end, "a member without content")


def _fed(content: Content, parts) -> Iterator[Record | Gap]:
    for part in parts:
        yield from content.feed(part)
    yield from content.feed(b"", final=True)


def _member_within(file: File, a: int, b: int) -> bool:
    """Whether a sound gzip member starts from a on, before b."""
    while 0 <= (a := file.next(a)) < b:
        if file.get(a, 3) == GZIP and not _sound(file, a)[0]:
            return True
        a += 1
    return False


def _rescued(file: File, at: int, why: str, step: int = 4096) -> Iterator[Record | Gap]:
    """What of a failed member is proven, record by record: digests cover headers and block, and more content follows.

    Whatever lies between is a gap, from the place where the last one was whole to that at which the next one had begun. Returns the
    place where the last one was whole, or the member's start: what follows is searched again from there, since the content that
    was read on for may belong to the next members."""
    content = Content()
    last, covered, total = at, 0, 0  # place and content up to which records were given, and content in all
    held: tuple[list[Record | Gap], int, int] | None = None  # a record that nothing follows yet, with its gap, place and end
    marks: list[tuple[int, int]] = []  # places by content, since the last record
    for out, before, after, failed, state in _inflated(file, at, step):
        seen, total = total, total + len(out)
        marks.append((total, after))
        found = [x for x in content.feed(out, final=failed is not None) if isinstance(x, Record) and content.proven]
        data, n = file.get(before, after - before) if found else b"", seen
        i = 0
        for x in found:
            while n < x.end and i < len(data):
                n, i = n + len(state.decompress(data[i : i + 1])), i + 1
            if held is not None:
                yield from held[0]
                _, last, covered = held
            begun = next((place for upto, place in marks if upto > x.start), after)
            if x.start > covered and _member_within(file, max(at + 1, last), begun):
                return last  # the stream has run into members that are sound by themselves
            gap = [Gap(last, begun, why)] if x.start > covered else []
            held = ([*gap, Record(at, before + i if i else after, x.headers, x.block)], before + i if i else after, x.end)
        if held is not None and total > held[2]:
            yield from held[0]
            _, last, covered = held
            held = None
        if found:
            marks = [m for m in marks if m[0] > found[-1].end]
    return last


def salvage(source: bytes | BinaryIO) -> Iterator[Record | Gap]:
    """The valid records of an archive, a file that can seek, compressed by member or as a whole or plain, and the gaps between them.

    After a failed check the next place is searched where a member or a version line starts and is valid; what lies between
    is one gap. A member may hold any number of records. One that passes its own checks gives all that are well-formed; what of its
    content no valid record covers is a gap at its place. Of one that fails only records count whose digests cover headers and
    block; every other byte of it is in a gap, and the search goes on from the last of them, so that members which the damaged
    stream ran into are found. The file is read in parts, a member twice if it is long: a task holds a record, not a file."""
    file = File(io.BytesIO(source) if isinstance(source, bytes) else source)
    at, bad, why = 0, -1, ""

    def found(start: int) -> Iterator[Gap]:
        nonlocal bad
        if bad >= 0:
            yield Gap(bad, start, why)
            bad = -1

    while 0 <= at < file.size:
        head = file.get(at, 5)
        try:
            if head[:3] == GZIP:
                failed, end, kept = _sound(file, at)
                if not failed:
                    yield from found(at)
                    yield from _records(file, at, end, kept)
                    at = end
                    continue
                if kept is not None and not any(b"WARC/" in x for x in kept) and sum(map(len, kept)) < FIRST_BYTES:
                    raise ValueError(failed)  # as most false starts
                rescue, some = _rescued(file, at, failed), False
                while True:
                    try:
                        x = next(rescue)
                    except StopIteration as e:
                        last = e.value
                        break
                    if not some:
                        yield from found(at)
                    some = True
                    yield x
                if bad < 0:
                    bad, why = last, failed
                at = file.next(max(at + 1, last))
                continue
            if head != b"WARC/":
                raise ValueError("no version line or gzip member")
            x = _plain(file, at)
        except ValueError as e:
            if bad < 0:
                bad, why = at, str(e)
            at = file.next(at + 1)
            continue
        yield from found(at)
        yield x
        at = x.end
    yield from found(file.size)


def payload_of(r: Record) -> bytes:
    return r.block.partition(b"\r\n\r\n")[2]


#: Repeated digests up to which their table is broadcast; beyond, pages are dealt by digest and salt, so that a common one is no hot key.
BROADCAST_ROWS = 200_000
SALTS = 64


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, level: int = 1) -> DataFrame:
    """Writes a record per row of pages, a gzip member each, into files below folder, a URI in a store that all executors
    reach; returns the manifest (path, bytes, records), a row per file. The payload is the html in UTF-8 (null: empty).

    Of rows with equal payloads of at least `least` bytes those with the smallest id hold the response and the others
    revisit it; smaller payloads are all responses. Repeated rows are all what the first of them is. Only digests and ids
    are grouped, and pages meet just the digests that repeat: while those are few, no page is moved. A task that is run
    again, or twice at once, leaves the same files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = fs.FileSystem.from_uri(folder)
        store.create_dir(place, recursive=True)
        task, files, out, size, n, aside = TaskContext.get(), [], None, 0, 0, ""

        def end() -> None:
            out.close()
            name = f"part-{task.partitionId():06d}-{len(files):05d}.warc.gz"
            store.move(aside, f"{place}/{name}")
            files.append((f"{folder}/{name}", size, n))

        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                for page_id, url, page, first in zip(*(c.to_pylist() for c in batch.slice(i, 64).columns), strict=True):
                    payload = (page or "").encode("utf-8", "surrogatepass")
                    revisits = first is not None and first != page_id and len(payload) >= least
                    data = packed(record(page_id, url, payload, digest_of(payload), first if revisits else None), level)
                    if out is not None and size + len(data) > FILE_BYTES:
                        end()
                        out = None
                    if out is None:
                        aside, size, n = f"{place}/{task.partitionId():06d}-{task.taskAttemptId()}-{len(files):05d}.tmp", 0, 0
                        out = store.open_output_stream(aside)
                    out.write(data)
                    size, n = size + len(data), n + 1
        if out is not None:
            end()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in files], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "bytes", "records"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    digest = F.unhex(F.sha1(F.encode(text_of("html"), "UTF-8")))
    repeated = rows.select(digest.alias("digest"), "id").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    repeated = materialize(repeated.where("n > 1").select("digest", "first"), "repeated-digests")
    few = repeated.count() <= BROADCAST_ROWS
    dealt = rows.withColumn("digest", digest)
    dealt = dealt.join(F.broadcast(repeated), "digest", "left") if few else spread_join(dealt, repeated, ["digest"], F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)), "left")
    dealt = dealt.select("id", "url", "html", "first")
    files = materialize(dealt.mapInArrow(run, "path string, bytes bigint, records bigint"), "archives")
    discard(repeated)
    return files


RECORDS = "path string, start bigint, end bigint, gap string, type string, id string, url string, payload_digest string, payload_bytes bigint, refers_to string, payload binary"
#: Bytes of archives that one task reads, about; more where a file is larger.
TASK_BYTES = 1 << 30


def read(spark: SparkSession, files: DataFrame | list[str], payloads: bool = True) -> DataFrame:
    """The records and quarantined gaps of archive files (a table with path and, if known, bytes; or a list of paths); gap holds the
    reason and is null for records. Files are dealt to a task per gigabyte, or to as many as run at once, and read in parts.

    A revisit's payload_bytes is the Content-Length of its HTTP header, a response's the bytes that are there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.binary()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        rows, held = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_file(place) as raw:
                    for x in salvage(raw):
                        if isinstance(x, Gap):
                            rows.append((path, x.start, x.end, x.reason, *[None] * 7))
                            continue
                        h, payload = x.headers, payload_of(x)
                        length = re.search(rb"(?im)^content-length:\s*(\d+)", x.block.partition(b"\r\n\r\n")[0])
                        digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
                        full = h.get("warc-type") != "revisit"
                        if full and digest and digest != digest_of(payload):
                            rows.append((path, x.start, x.end, "the payload's digest differs", *[None] * 7))
                            continue
                        size = len(payload) if full or not length else int(length[1])
                        rows.append((path, x.start, x.end, None, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), digest, size, h.get("warc-refers-to"), payload if payloads and full else None))
                        held += len(payload) if payloads else 0
                        if len(rows) >= 2000 or held > 16 << 20:
                            yield out(rows)
                            rows, held = [], 0
        if rows:
            yield out(rows)

    if isinstance(files, list):
        files = spark.createDataFrame([(p,) for p in files], "path string")
    n, total = files.agg(F.count("*"), F.sum("bytes") if "bytes" in files.columns else F.lit(0)).first()
    tasks = max(1, min(n, max(4 * spark.sparkContext.defaultParallelism, -(-(total or 0) // TASK_BYTES))))
    return files.select("path").repartition(tasks).mapInArrow(run, RECORDS)


def page_of(urn: str) -> Column:
    return F.regexp_extract(urn, rf"^<{ID}(-?\d+)>$", 1).try_cast("bigint")


def round_trip(pages: DataFrame, least: int = 0, **cols: str) -> DataFrame:
    """Writes pages as archives in the shared folder and reads them back: page_id, payload_bytes, payload_digest, record_type,
    refers_to per record. Null html is an empty payload; an empty table gives an empty one; other columns are not read."""
    spark = pages.sparkSession
    files = write(pages, scratch(spark, "warc"), least=least, **cols)
    found = read(spark, files, payloads=False).where("gap is null")
    return found.select(
        page_of("id").alias(cols.get("id_col", "page_id")), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page_of("refers_to").alias("refers_to")
    )
