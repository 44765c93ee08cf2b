"""SentencePiece encoding and decoding for merge-type vocabularies: a score-ordered agenda of adjacent symbol pairs."""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

SPACE = "▁"
#: The rank of a pair that doesn't join: after all others.
NONE = 1 << 40


class Pieces:
    """A merge-type vocabulary, read from a model file through the library, with its own encoder.

    A text is encoded unit by unit, a unit being a run of spaces and what follows it: no piece of such a vocabulary holds a
    space after another character (checked when it is read), so that no merge crosses the start of a unit. Ids of units are kept in a
    memo of at most `memo` bytes, about. Each batch's new units are encoded by the library too, and its ids are taken where they
    differ; `differing` counts these."""

    #: Units of up to so many characters are merged many at a time.
    WIDTH = 32

    def __init__(self, path: str, memo: int = 96 << 20):
        import sentencepiece

        self.lib = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        plain = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        order = {x: k for k, x in enumerate(sorted({-sp.get_score(i) for i in plain}))}
        #: A piece's place by score; equal scores share one.
        self.rank = {sp.id_to_piece(i): order[-sp.get_score(i)] for i in plain}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece holds a space after another character; units can't be told apart")
        if sp.encode("  aä \n", out_type=str)[0][:1] != SPACE:
            raise ValueError("the vocabulary doesn't keep white space or has no dummy prefix")
        self.most, self.memo, self.held, self.differing = memo, {}, 0, 0
        # symbols: pieces, and characters that pieces hold; 0 is none. Which two join, to which symbol, at which rank
        symbols = sorted({*self.ids, *(c for p in self.ids for c in p)})
        number = {x: k for k, x in enumerate(symbols, 1)}
        self.letter = {x: k for x, k in number.items() if len(x) == 1}
        self.id_of = np.array([-1, *(self.ids.get(x, -1) for x in symbols)], np.int64)
        self.base = len(symbols) + 1
        joins = sorted((number[p[:i]] * self.base + number[p[i:]], r, number[p]) for p, r in self.rank.items() for i in range(1, len(p)) if p[:i] in number and p[i:] in number)
        self.keys, self.ranks, self.joined = (np.array(x, np.int64) for x in zip(*joins, strict=True))

    def _join(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and symbols of joined pairs; the rank NONE where two don't join."""
        key = a * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        there = self.keys[at] == key
        return np.where(there, self.ranks[at], NONE), self.joined[at]

    def merge_many(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As merge, for many units of up to WIDTH characters: their ids end to end and their numbers, -1 where a symbol has no id.

        A unit's agenda is the row of the ranks of its adjacent pairs; each round takes the best of every unit's."""
        sizes, letter = [len(u) for u in units], self.letter.get
        width = max(sizes) + 1
        flat = np.fromiter((letter(c, 0) for u in units for c in u), np.int64, sum(sizes))
        s = np.zeros((len(units), width), np.int64)
        s[np.arange(width) < np.array(sizes)[:, None]] = flat
        unknown = (s == 0).sum(1) != width - np.array(sizes)
        rank, symbol = self._join(s[:, :-1], s[:, 1:])
        rank[unknown] = NONE
        done = s.copy()
        rows, cols = np.arange(len(units)), np.arange(width)
        while len(rows):
            at = rank.argmin(1)
            line = np.arange(len(rows))
            going = rank[line, at] < NONE
            if not going.all():
                done[rows[~going]] = s[~going]
                rows, s, rank, symbol, at = rows[going], s[going], rank[going], symbol[going], at[going]
                line = np.arange(len(rows))
                if not len(rows):
                    break
            s[line, at] = symbol[line, at]
            # close the gap: what stands after the pair moves up by one
            later = cols[:-1] > at[:, None]
            s[:, :-1] = np.where(later, s[:, 1:], s[:, :-1])
            s[:, -1] = 0
            rank[:, :-1] = np.where(later[:, :-1], rank[:, 1:], rank[:, :-1])
            symbol[:, :-1] = np.where(later[:, :-1], symbol[:, 1:], symbol[:, :-1])
            rank[:, -1] = NONE
            for place in (at, at - 1):
                ok = np.flatnonzero((place >= 0) & (place < width - 1))
                i = place[ok]
                rank[ok, i], symbol[ok, i] = self._join(s[ok, i], s[ok, i + 1])
        ids = self.id_of[done]
        there = done > 0
        counts = there.sum(1)
        counts[unknown | (there & (ids < 0)).any(1)] = -1
        return ids[there & (counts >= 0)[:, None]], counts

    def merge(self, part: str) -> list[int]:
        """The ids of one unit by the agenda: the adjacent pair whose joined piece has the highest score goes first, the leftmost
        of equals. An entry is a rank and a place; one whose pair there has another rank by now is skipped."""
        rank, symbols, n = self.rank.get, list(part), len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        now = [rank(a + b, -1) for a, b in zip(symbols, symbols[1:], strict=False)]
        now.append(-1)
        agenda = [r << 32 | i for i, r in enumerate(now) if r >= 0]
        heapq.heapify(agenda)
        while agenda:
            top = heapq.heappop(agenda)
            i = top & 0xFFFFFFFF
            if now[i] != top >> 32:
                continue
            j = after[i]
            p = symbols[i] = symbols[i] + symbols[j]
            symbols[j], now[j] = "", -1
            k = after[i] = after[j]
            r = -1
            if k < n:
                before[k] = i
                r = rank(p + symbols[k], -1)
                if r >= 0:
                    heapq.heappush(agenda, r << 32 | i)
            now[i] = r
            h = before[i]
            if h >= 0:
                r = now[h] = rank(symbols[h] + p, -1)
                if r >= 0:
                    heapq.heappush(agenda, r << 32 | h)
        ids = self.ids
        found = []
        for s in symbols:
            if s:
                if s in ids:
                    found.append(ids[s])
                else:
                    found += [self.bytes[b] for b in s.encode()]
        return found

    def _learn(self, new: list[str]) -> None:
        """Puts new units (without their first space) into the memo, checked against the library."""
        # the library adds the first space, also where a unit is nothing else
        lib = self.lib.encode([u.replace(SPACE, " ") if u else SPACE for u in new], num_threads=1)
        short = [i for i, u in enumerate(new) if len(u) < self.WIDTH]
        rest = [i for i, u in enumerate(new) if len(u) >= self.WIDTH]
        for a in range(0, len(short), 4000):
            block = short[a : a + 4000]
            ids, counts = self.merge_many([SPACE + new[i] for i in block])
            data, stops = ids.astype("<u4").tobytes(), (np.cumsum(np.maximum(counts, 0)) * 4).tolist()
            at = 0
            for i, stop, n in zip(block, stops, counts.tolist(), strict=True):
                if n < 0:
                    rest.append(i)
                    continue
                got, want = data[at:stop], lib[i]
                if new[i] and got != struct.pack(f"<{len(want)}I", *want):
                    rest.append(i)
                else:
                    self.memo[new[i]] = got
                at = stop
        for i in rest:
            got, want = self.merge(SPACE + new[i]), lib[i]
            if new[i] and got != want:
                self.differing += 1
                got = want
            self.memo[new[i]] = struct.pack(f"<{len(got)}I", *got)

    def units(self, text: str) -> list[str]:
        """Units without their first space: what the library encodes to the same ids."""
        if not text:
            return []
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            return [u[1:] for u in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))]
        return text.split(" ")

    def encode_batch(self, texts: list[str], begin: bool = True, end: bool = True) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        units = [self.units(t) for t in texts]
        memo = self.memo
        new = list({u for us in units for u in us if u not in memo})
        # a unit, its ids and what a dictionary needs for it
        self.held += sum(map(len, new)) * 6 + 180 * len(new)
        if self.held > self.most:
            memo.clear()
            new = list({u for us in units for u in us})
            self.held = sum(map(len, new)) * 6 + 180 * len(new)
        for a in range(0, len(new), 50_000):
            self._learn(new[a : a + 50_000])
        a = np.array([self.lib.bos_id()] * begin, "<u4").tobytes()
        z = np.array([self.lib.eos_id()] * end, "<u4").tobytes()
        look = memo.__getitem__
        return [a + b"".join(map(look, us)) + z for us in units]

    def check(self, texts: list[str], ids: list[bytes], every: int = 64) -> None:
        """Encodes a seeded share of whole texts by the library and takes its ids where they differ: a unit's ids are checked when
        it is new, this checks that a text's ids are those of its units."""
        for i, (t, x) in enumerate(zip(texts, ids, strict=True)):
            if zlib.crc32(x) % every == 0:
                want = np.array(self.lib.encode(t, add_bos=True, add_eos=True), "<u4").tobytes()
                if want != x:
                    self.differing += 1
                    ids[i] = want

    def decode(self, ids: bytes) -> str:
        return self.lib.decode(np.frombuffer(ids, "<u4").tolist())


_open: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One vocabulary per Python worker, so that its memo lasts from task to task."""
    if path not in _open:
        _open[path] = Pieces(path)
    return _open[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """One row per row of docs: id_col, n_tokens, ids_sha256, decoded_sha256, differing; with whole, also ids and decoded.

    path: the model file's place on every executor. A null text is an empty one, which gives the begin and end ids;
    repeated rows stay; other columns are not read; an empty table gives an empty one. differing: units, and whole
    texts of a seeded share of one in 64, of the batch for which the agenda and the library disagreed (the library's ids were taken)."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, differing bigint" + ", ids binary, decoded string" * whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for part in (x for batch in batches for x in slices(batch, 1, rows=1000)):
            before = p.differing
            texts = [t or "" for t in part.column(1).to_pylist()]
            ids = p.encode_batch(texts)
            p.check(texts, ids)
            decoded = [p.decode(x) for x in ids]
            digests = [[hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in decoded]]
            columns = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), *map(pa.array, digests), pa.array([p.differing - before] * len(ids), pa.int64())]
            if whole:
                columns += [pa.array(ids, pa.binary()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "differing", "ids", "decoded"][: len(columns)])

    return docs.select(id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)
