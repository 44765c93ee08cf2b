"""Token-id files: fixed-size blocks of ids, transposed into byte or bit planes, each plane compressed, with a chunk index.

A file: MAGIC; the planes of each block, one after the other; a footer (a zstandard frame of JSON: kind of planes, ids per
block, for each block its number of ids and the place and size of each plane, and the place and size of the table of
documents, an Arrow stream of ids and token counts in a zstandard frame); the footer's size in 8 bytes; MAGIC."""

from __future__ import annotations

import itertools
import json
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainflow.functions.ranks import running_sum

from .common import materialize, scratch, slices

MAGIC = b"GFIDS001"
#: ASCII marks that part from a letter before them (an apostrophe may not).
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
MARK_BYTES = bytes(MARKS, "ascii")


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """The planes of a block of ids, the lowest byte or bit first."""
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [octets[:, i].tobytes() for i in range(4)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, i]).tobytes() for i in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    if kind == "byte":
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(-1).view("<u4") if n else np.empty(0, "<u4")
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4") if n else np.empty(0, "<u4")


class Writer:
    """Writes one file; holds a block of ids and the documents' counts."""

    def __init__(self, out: BinaryIO, kind: str = "byte", block: int = 1 << 16, level: int = 1):
        self.out, self.kind, self.block, self.zip = out, kind, block, zstandard.ZstdCompressor(level=level)
        self.at, self.chunks, self.rest, self.pending, self.total = 0, [], [], 0, 0
        self.docs: list[pa.RecordBatch] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> list[int]:
        self.out.write(data)
        self.at += len(data)
        return [self.at - len(data), len(data)]

    def _flush(self, last: bool = False) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.empty(0, "<u4")
        a = 0
        while len(ids) - a >= self.block or last and a < len(ids):
            part = ids[a : a + self.block]
            self.chunks.append([len(part), [self._put(self.zip.compress(p)) for p in to_planes(part, self.kind)]])
            a += len(part)
        self.rest, self.pending = [ids[a:]], len(ids) - a

    def add(self, keys: pa.Array, ids: list[bytes]) -> None:
        """Documents in order: their keys, and their ids as little-endian unsigned 32-bit integers."""
        sizes = [len(x) // 4 for x in ids]
        self.docs.append(pa.RecordBatch.from_arrays([keys, pa.array(sizes, pa.int64())], names=["key", "n"]))
        self.rest.append(np.frombuffer(b"".join(ids), "<u4"))
        self.pending += sum(sizes)
        self.total += sum(sizes)
        if self.pending >= self.block:
            self._flush()

    def close(self) -> None:
        self._flush(last=True)
        table = b""
        if self.docs:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, self.docs[0].schema) as s:
                for b in self.docs:
                    s.write_batch(b)
            table = sink.getvalue().to_pybytes()
        docs = self._put(self.zip.compress(table))
        foot = self.zip.compress(json.dumps({"planes": self.kind, "block": self.block, "chunks": self.chunks, "docs": docs, "empty": not table}).encode())
        self._put(foot)
        self._put(len(foot).to_bytes(8, "little") + MAGIC)


class Reader:
    """Reads one file by its chunk index; a block is read only when its ids are asked for."""

    def __init__(self, source: pa.NativeFile):
        self.source, self.zip = source, zstandard.ZstdDecompressor()
        size = source.size()
        tail = self._at(size - 16, 16)
        if tail[8:] != MAGIC or self._at(0, 8) != MAGIC:
            raise ValueError("not a token-id file, or one that was cut off")
        n = int.from_bytes(tail[:8], "little")
        self.index = json.loads(self.zip.decompress(self._at(size - 16 - n, n)))

    def _at(self, place: int, n: int) -> bytes:
        self.source.seek(place)
        return self.source.read(n)

    def docs(self) -> Iterator[pa.RecordBatch]:
        if not self.index["empty"]:
            yield from pa.ipc.open_stream(self.zip.decompress(self._at(*self.index["docs"])))

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids at places start to stop of the file."""
        block, out = self.index["block"], []
        for k in range(start // block, -(-stop // block) if stop > start else start // block):
            n, planes = self.index["chunks"][k]
            if getattr(self, "_last", (None,))[0] != k:
                self._last = (k, from_planes([self.zip.decompress(self._at(*p)) for p in planes], n, self.index["planes"]))
            out.append(self._last[1][max(0, start - k * block) : stop - k * block])
        return np.concatenate(out) if out else np.empty(0, "<u4")


def strung(codes: np.ndarray, ids: np.ndarray, sizes: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """The ids of items one after another, given by their numbers, and the place where each ends; ids and sizes: those of the items in
    order of their numbers. Places are made for `most` items at a time."""
    first, stops, out = np.cumsum(sizes) - sizes, np.cumsum(sizes[codes]), [np.empty(0, "<u4")]
    for a in range(0, len(codes), most):
        part = codes[a : a + most]
        n = sizes[part]
        out.append(ids[np.repeat(first[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
    return np.concatenate(out), stops


def byte_strings(array: pa.Array) -> list[bytes]:
    """The values of a large string or binary array, without nulls."""
    offsets, data = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1].tolist(), array.buffers()[2]
    values = data.to_pybytes() if data else b""
    return [values[i:j] for i, j in itertools.pairwise(offsets)]


class WordIds:
    """Ids of a tokenizers file whose tokens hold no white space: a text's ids are those of its words, one after another.

    Words are split at ASCII white space, which the file's pre-tokenizer drops, and numbered by Arrow, so that what is done in Python is
    done once for each word of a batch. A new word is encoded by the library, and a word's ids stay in a memo of at most `memo` bytes,
    about. It has two halves: a full one takes the place of the older one, whose words are dropped unless they have come again since, so
    that frequent words stay."""

    def __init__(self, path: str, memo: int = 96 << 20):
        from tokenizers import Tokenizer

        self.lib, self.memo, self.older, self.most, self.held = Tokenizer.from_file(path), {b"": b""}, {}, memo, 0
        #: Letters beyond ASCII, by whether they part marks.
        self.parting: dict[str, bool] = {}
        ids = lambda t: self.lib.encode(t, add_special_tokens=False).ids
        probe = ["Ab", "c,", "d's", "É9"]
        self.by_word = ids(" \n".join(probe)) == [i for w in probe for i in ids(w)] and ids(" \t\n\x0b\x0c\r") == []
        vocabulary, suffix = self.lib.get_vocab(), getattr(self.lib.model, "end_of_word_suffix", None) or ""
        #: By id, whether a token ends a word.
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        #: Whether capital ASCII letters count as small ones, and marks after a letter at a word's end are tokens of their own.
        self.fold = self.by_word and ids("ABC") == ids("abc") and all(ids(f"é{m}") == ids("é") + ids(m) for m in (*MARKS, MARKS, "$$$"))
        self.small = self._small(vocabulary, suffix) if self.fold else None

    def _small(self, vocabulary: dict[str, int], suffix: str):
        """The file's model behind a split at white space, for words of small ASCII letters, where the file's normalizer and pre-tokenizer
        leave these as they are, tried on every three letters and some words of the vocabulary; else none."""
        from tokenizers import Tokenizer, pre_tokenizers

        lib, letters = Tokenizer(self.lib.model), "abcdefghijklmnopqrstuvwxyz"
        lib.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        words = [w for w in sorted(t.removesuffix(suffix) for t in vocabulary) if w.isascii() and w.isalpha() and w.islower()]
        text = " ".join([letters, *map("".join, itertools.product(letters, repeat=3)), *words[:: max(1, len(words) // 2000)]])
        norm, parts = self.lib.normalizer, self.lib.pre_tokenizer
        same = (norm is None or norm.normalize_str(text) == text) and (parts is None or parts.pre_tokenize_str(letters) == [(letters, (0, len(letters)))])
        return lib if same and lib.encode(text).ids == self.lib.encode(text, add_special_tokens=False).ids else None

    def _put(self, words: Iterable[bytes], ids: Iterable[bytes]) -> None:
        """Puts words with their ids into the memo."""
        words, ids = list(words), list(ids)
        self.memo.update(zip(words, ids, strict=True))
        # two objects of bytes and a place in a table
        self.held += sum(map(len, words)) + sum(map(len, ids)) + 180 * len(words)

    def _joined(self, lib, words: list[bytes]) -> list[bytes]:
        """Puts the ids of words of letters only into the memo: one call for many, cut where a token ends a word. Returns the words for
        which that fails."""
        failed = []
        for a in range(0, len(words), 200):
            part = words[a : a + 200]
            ids = np.array(lib.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) * 4 + 4).tolist()
            if len(stops) == len(part):
                data = ids.tobytes()
                self._put(part, [data[i:j] for i, j in zip([0, *stops[:-1]], stops, strict=True)])
            else:
                failed += part
        return failed

    def _encode(self, words: list[bytes]) -> None:
        """Puts the ids of words that the library encodes into the memo."""
        small, plain, rest = [], [], []
        for w in words:
            (small if self.small and w.isalpha() and w.islower() else plain if self.by_word and w.decode().isalpha() else rest).append(w)
        words = [*rest, *self._joined(self.small, small), *self._joined(self.lib, plain)]
        for a in range(0, len(words), 10_000):
            part = words[a : a + 10_000]
            self._put(part, (struct.pack(f"<{len(e)}I", *e.ids) for e in self.lib.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)))

    def _parts(self, c: str) -> bool:
        """Whether c is a letter after which marks are tokens of their own; not so after one whose small form ends in a combining mark."""
        if c not in self.parting:
            ids = lambda t: self.lib.encode(t, add_special_tokens=False).ids
            self.parting[c] = c.isalpha() and all(ids(c + m) == ids(c) + ids(m) for m in MARKS)
        return self.parting[c]

    def _learn(self, new: list[bytes]) -> None:
        """Puts new words into the memo: from its older half, or by what ends them and the word before that, where a letter beyond ASCII
        parts the two."""
        older = self.older
        known = [w for w in new if w in older]
        self._put(known, map(older.__getitem__, known))
        fresh = [w for w in new if w not in older] if known else new
        marked = []
        for w in [w for w in fresh if w[-1] in MARK_BYTES and b"<|" not in w] if self.fold else []:
            stem = w.rstrip(MARK_BYTES)
            if stem and stem[-1] > 127 and self._parts(stem.decode()[-1]):
                marked.append((w, stem, w[len(stem) :]))
        if marked:
            parted = {w for w, _, _ in marked}
            lone = {x for _, *parts in marked for x in parts}.difference(self.memo, new)
            again = lone & older.keys()
            self._put(again, map(older.__getitem__, again))
            fresh = [*(w for w in fresh if w not in parted), *(lone - again)]
        if fresh:
            self._encode(fresh)
        look = self.memo.__getitem__
        self._put((w for w, _, _ in marked), (look(s) + look(e) for _, s, e in marked))

    def _pieces(self, words: pa.Array) -> pa.Array:
        """Two for each word: what stands before marks at its end that are tokens of their own, after an ASCII letter, and these marks; or
        the word and nothing."""
        bounds = np.repeat(np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1], 2)[1:]
        data = words.buffers()[2]
        if self.fold and data and data.size:
            stems = pc.binary_length(pc.ascii_rtrim(words, MARKS)).to_numpy()
            cuts = bounds[:-1:2] + stems
            last = np.frombuffer(data, np.uint8)[np.maximum(cuts - 1, 0)] | 32
            special = pc.match_substring(words, "<|").to_numpy(zero_copy_only=False)
            bounds[1::2] = np.where((stems > 0) & (last >= ord("a")) & (last <= ord("z")) & ~special, cuts, bounds[2::2])
        return pa.Array.from_buffers(pa.large_binary(), 2 * len(words), [None, pa.py_buffer(bounds), data])

    def encode_batch(self, texts: list[str], end: int | None = 1) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers, with the end id."""
        if not self.by_word:
            tail = np.array([] if end is None else [end], "<u4").tobytes()
            return [struct.pack(f"<{len(e)}I", *e.ids) + tail for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]
        whole = pa.array(texts, pa.large_string())
        if self.fold:
            # capital letters count in names of special tokens
            whole = pc.if_else(pc.match_substring(whole, "<|"), whole, pc.ascii_lower(whole))
        if self.held > self.most // 2:
            self.memo, self.older, self.held = {b"": b""}, self.memo, 0
        split = pc.ascii_split_whitespace(whole)
        words = split.flatten().dictionary_encode()
        pieces = self._pieces(words.dictionary).dictionary_encode()
        keys = byte_strings(pieces.dictionary)
        found = list(map(self.memo.get, keys))
        if new := [w for w, i in zip(keys, found, strict=True) if i is None]:
            self._learn(new)
            look = self.memo.__getitem__
            found = [look(w) if i is None else i for w, i in zip(keys, found, strict=True)]
        # ids of pieces, then of words, the last of which is the end, then of texts
        ids, stops = strung(pieces.indices.to_numpy(), np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4)
        tail = [] if end is None else [end]
        ids, sizes = np.append(ids, np.array(tail, "<u4")), np.append(np.diff(stops[1::2], prepend=0), len(tail))
        counts = pc.list_value_length(split).to_numpy()
        codes = np.insert(words.indices.to_numpy(), np.cumsum(counts), len(sizes) - 1)
        ids, stops = strung(codes, ids, sizes)
        data, cuts = ids.tobytes(), [0, *(stops[np.cumsum(counts + 1) - 1] * 4).tolist()]
        return [data[i:j] for i, j in itertools.pairwise(cuts)]


_open: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One tokenizer per Python worker, so that its memo lasts from task to task."""
    if path not in _open:
        _open[path] = WordIds(path)
    return _open[path]


def write(docs: DataFrame, folder: str, tokenizer: str, end: int | None = 1, planes: str = "byte", block: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text and writes the ids in ascending order of id_col (null first; repeated ids by text), a file per range
    of ids. Returns the manifest, a row per file: part (its place in the order), path, n_docs, n_ids, base (ids before it). A null
    text is an empty one.

    A file is written under a name of its own attempt and then renamed, so that a task that is run again, or twice at
    once, leaves the same single file. folder: a URI in a store that all executors reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = fs.FileSystem.from_uri(folder)
        store.create_dir(place, recursive=True)
        task = TaskContext.get()
        name = f"{place}/part-{task.partitionId():06d}.ids"
        aside, out, writer, n = f"{name}.{task.taskAttemptId()}.tmp", None, None, 0
        for batch in batches:
            if writer is None:
                out = store.open_output_stream(aside)
                writer = Writer(out, planes, block)
            for part in slices(batch, 1, rows=10_000):
                writer.add(part.column(0), word_ids(tokenizer).encode_batch([t or "" for t in part.column(1).to_pylist()], end))
                n += part.num_rows
        if writer is not None:
            writer.close()
            out.close()
            store.move(aside, name)
            uri = f"{folder}/part-{task.partitionId():06d}.ids"
            yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int32()), "path": [uri], "n_docs": pa.array([n], pa.int64()), "n_ids": pa.array([writer.total], pa.int64())})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartitionByRange("id").sortWithinPartitions("id", "text")
    written = materialize(rows.mapInArrow(run, "part int, path string, n_docs bigint, n_ids bigint"), "id-files")
    return running_sum(written, [], [F.col("part")], F.col("n_ids"), "base").withColumn("base", F.col("base") - F.col("n_ids"))


#: Ids that one task reads, about; more where a file holds more.
TASK_IDS = 1 << 28


def read(spark: SparkSession, manifest: DataFrame, id_type: str = "bigint", digest: Callable[[bytes], int] = zlib.crc32) -> DataFrame:
    """Documents of the files of a manifest: key, start (ids of all documents before), n_tokens, ids_crc32. Files are dealt to as many
    tasks as run at once, or more where they are many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_file(place) as source:
                    reader, at = Reader(source), 0
                    for docs in reader.docs():
                        sizes = docs.column(1).to_numpy()
                        stops = at + np.cumsum(sizes)
                        starts = stops - sizes
                        ids = reader.ids(at, int(stops[-1])).astype("<u4")
                        sums = [digest(ids[a - at : b - at].tobytes()) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
                        at = int(stops[-1])
                        yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(starts + base, pa.int64()), docs.column(1), pa.array(sums, pa.int64())], names=["key", "start", "n_tokens", "ids_crc32"])

    n, total = manifest.agg(F.count("*"), F.sum("n_ids")).first()
    tasks = max(1, min(n, max(4 * spark.sparkContext.defaultParallelism, -(-(total or 0) // TASK_IDS))))
    return manifest.select("path", "base").repartition(tasks).mapInArrow(run, f"key {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Writes docs as token-id files in the shared folder and reads them back: id_col, start, n_tokens, ids_crc32 per document.

    Null texts count as empty (the end id alone); repeated rows are documents of their own; other columns are not read; an
    empty table gives an empty one."""
    manifest = write(docs, scratch(docs.sparkSession, "ids"), tokenizer, id_col=id_col, text_col=text_col, **how)
    return read(docs.sparkSession, manifest, docs.schema[id_col].dataType.simpleString()).withColumnRenamed("key", id_col)
