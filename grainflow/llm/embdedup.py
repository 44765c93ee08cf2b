"""Embedding near-duplicates: randomised-rotation binary codes, whose estimates decide which pairs are computed exactly.

A vector is rotated and coded once. Pairs of codes are compared first, by their differing bits; the few that may be close enough
get an unbiased estimate of their inner product with a confidence bound, and only those whose bounds reach the threshold are
computed from the vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .components import connected_components
from .vectors import meet, packs, usable


@dataclass(frozen=True)
class Codes:
    cosine: float = 0.93
    seed: int = 7
    #: Vectors of a block; a task keeps one block, past which others stream.
    block: int = 1024
    #: Width of the confidence bounds in standard deviations of the estimate.
    width: float = 5.0
    #: Chance that codes of a pair at the threshold differ in more bits than are looked at.
    miss: float = 1e-7


@lru_cache(maxsize=8)
def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same for a seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors: the rotated vectors, their sign codes as words of 64 bits, and each code's correction factor, the inner
    product of the vector with its code as a unit vector."""
    rotated = unit @ turn
    factor = np.abs(rotated).sum(1) / np.sqrt(turn.shape[0])
    bits = np.packbits(rotated > 0, axis=1)
    words = np.zeros((len(unit), -(-bits.shape[1] // 8) * 8), np.uint8)
    words[:, : bits.shape[1]] = bits
    return rotated, words.view(np.uint64), factor


@lru_cache(maxsize=64)
def most_bits(dim: int, cosine: float, miss: float) -> int:
    """Codes of vectors at the cosine differ in a bit with probability angle / pi; more bits than this differ with a chance below miss."""
    p = math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    chance, h = 0.0, dim
    while h > 0 and p > 0:
        chance += math.exp(math.lgamma(dim + 1) - math.lgamma(h + 1) - math.lgamma(dim - h + 1) + h * math.log(p) + (dim - h) * math.log1p(-p)) if p < 1 else 1.0
        if chance > miss:
            break
        h -= 1
    return h


def estimate(codes: np.ndarray, factor: np.ndarray, rotated: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of the inner products of coded vectors with rotated ones, pair by pair, and the half width of their
    bounds: the part of a vector that its code doesn't hold points anywhere, so that the error has the standard deviation
    sqrt((1 - factor^2) / factor^2 / (dim - 1))."""
    dim = rotated.shape[1]
    signs = np.unpackbits(codes.view(np.uint8), axis=1, count=dim).astype(np.float32) * 2 - 1
    raw = np.einsum("ij,ij->i", signs, rotated.astype(np.float32)) / np.sqrt(dim)
    half = width * np.sqrt(np.maximum(0.0, 1 - factor**2) / factor**2 / max(1, dim - 1)) + 1e-5
    return raw / factor, half


@dataclass
class Block:
    """What is stored of a block of vectors."""

    ids: np.ndarray
    copies: np.ndarray
    data: np.ndarray
    rotated: np.ndarray
    codes: np.ndarray
    factor: np.ndarray

    @staticmethod
    def of(row: dict) -> Block:
        ids = np.frombuffer(row["ids"], "<i8")
        n = len(ids)
        shaped = lambda k, kind: np.frombuffer(row[k], kind).reshape(n, -1)
        return Block(ids, np.frombuffer(row["copies"], "<i8"), shaped("data", "<f8"), shaped("rotated", "<f4"), shaped("codes", "<u8"), np.frombuffer(row["factor"], "<f8"))

    @staticmethod
    def stored(ids: list[int], copies: list[int], vectors: list[list[float]], seed: int) -> dict:
        x = np.array(vectors, np.float64)
        rotated, codes, factor = encode(x / np.linalg.norm(x, axis=1)[:, None] if np.isfinite(x * x).all() and (x * x).sum(1).all() else _unit(x), rotation(x.shape[1], seed))
        made = {"ids": np.array(ids, "<i8"), "copies": np.array(copies, "<i8"), "data": x, "rotated": rotated.astype("<f4"), "codes": codes, "factor": factor}
        return {k: v.tobytes() for k, v in made.items()}


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors, of very large and very small ones too."""
    x = x / np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def compare(a: Block, b: Block, how: Codes) -> tuple[np.ndarray, np.ndarray, int]:
    """Index pairs of two blocks with cosine >= how.cosine, of one block with itself each pair once, and how many were computed
    exactly. Pairs whose codes differ in too many bits, or whose upper bound by either vector's code is below the threshold, are
    passed over; the others are computed in double precision."""
    dim, most = a.data.shape[1], most_bits(a.data.shape[1], how.cosine, how.miss)
    keep_i, keep_j, exact = [], [], 0
    for s in range(0, len(a.ids), 256):
        differ = np.bitwise_count(a.codes[s : s + 256, None, 0] ^ b.codes[None, :, 0])
        if a.codes.shape[1] > 1:
            differ = differ.astype(np.uint16)
            for w in range(1, a.codes.shape[1]):
                differ += np.bitwise_count(a.codes[s : s + 256, None, w] ^ b.codes[None, :, w])
        i, j = np.nonzero(differ <= most) if most < dim else (np.repeat(np.arange(len(differ)), len(b.ids)), np.tile(np.arange(len(b.ids)), len(differ)))
        i = i + s
        if a is b:
            i, j = i[i < j], j[i < j]
        for t in range(0, len(i), 1 << 15):
            p, q = i[t : t + (1 << 15)], j[t : t + (1 << 15)]
            for codes, factor, rotated, left, right in ((a.codes, a.factor, b.rotated, 0, 1), (b.codes, b.factor, a.rotated, 1, 0)):
                pair = (p, q)
                e, h = estimate(codes[pair[left]], factor[pair[left]], rotated[pair[right]], how.width)
                maybe = e + h >= how.cosine
                p, q = p[maybe], q[maybe]
            x, y = a.data[p], b.data[q]
            with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                cos = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
            odd = ~np.isfinite(cos)
            if odd.any():  # squares past the range of doubles
                cos[odd] = (_unit(x[odd]) * _unit(y[odd])).sum(1)
            exact += len(p)
            keep_i.append(p[cos >= how.cosine])
            keep_j.append(q[cos >= how.cosine])
    none = np.zeros(0, np.int64)
    return np.concatenate([*keep_i, none]), np.concatenate([*keep_j, none]), exact


class Forest:
    """Links that join two classes: of all links that pass, at most one per vector is kept."""

    def __init__(self):
        self.top: dict[int, int] = {}
        self.kept: list[tuple[int, int]] = []

    def _find(self, x: int) -> int:
        top = self.top
        while (up := top.setdefault(x, x)) != x:
            top[x] = top.get(up, up)
            x = up
        return x

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            p, q = self._find(x), self._find(y)
            if p != q:
                self.top[max(p, q)] = min(p, q)
                self.kept.append((x, y))


def near_duplicates(vectors: DataFrame, how: Codes = Codes(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of vectors: id_col, n_links (other rows linked directly), component (smallest id reachable, itself included).

    Rows are compared only within a label. Equal vectors of a label are one class, compared once; classes are packed into
    blocks with their codes and correction factors. A block meets itself and half of its label's other blocks in a ring, so that
    each pair of blocks meets once and a label's work is spread evenly over as many tasks as it has blocks; a task returns
    counts and one spanning forest of the links that it found, never the pairs. A row with a null label or id, or with a
    vector that is null, empty, zero or holds a null or non-finite component, links with nothing: 0 links, itself its component.
    Vectors of different lengths don't link. Repeated rows are rows of their own, linked with each other; an empty table gives
    an empty one."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    good = F.coalesce(usable(v) & F.exists(v, lambda x: x != 0) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull(), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v"), good.alias("good"))
    # -0.0 and 0.0 are equal components
    rows = rows.withColumn("v", F.when(F.col("good"), F.transform("v", lambda x: x + F.lit(0.0))))
    classes = rows.where("good").groupBy("label", "v").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    # a class has a number of its own, as ids may repeat
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()).withColumn("d", F.size("v")), "vector-classes")
    sizes = classes.groupBy("label", "d").agg(F.ceil(F.count("*") / how.block).cast("int").alias("parts"))
    dealt = classes.join(sizes, ["label", "d"]).withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"))
    seed = how.seed

    def make(key: dict, got: list[dict]) -> dict:
        return Block.stored([r["cls"] for r in got], [r["copies"] for r in got], [r["v"] for r in got], seed) | {"parts": pa.array([got[0]["parts"]], pa.int32())}

    load = ["ids", "copies", "data", "rotated", "codes", "factor"]
    packed = packs(dealt, ["label", "d", "part"], ["cls", "copies", "v", "parts"], make, ", ".join(f"{c} binary" for c in load) + ", parts int")
    blocks = materialize(packed, "vector-blocks")
    # block j meets blocks j - 1, j - 2, ... halfway round its label's ring; of the two halfway points of an even ring one does
    back = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.col("parts") / 2).cast("int"))), lambda k: (F.col("parts") > 1) & ((2 * k < F.col("parts")) | (F.pmod(F.col("part") - k, F.col("parts")) < F.col("part"))))
    sent = blocks.withColumn("k", F.explode(back)).withColumn("part", F.pmod(F.col("part") - F.col("k"), F.col("parts")).cast("int")).select("label", "d", "part", *load)

    def work(fixed: dict, moving: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        here, forest = Block.of(fixed), Forest()
        total = np.zeros(len(here.ids), np.int64)

        def batch(p: np.ndarray, q: np.ndarray | None, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.nulls(len(p), pa.int64()) if q is None else pa.array(q, pa.int64()), pa.array(n, pa.int64())], names=["p", "q", "n"])

        def met(b: Block) -> np.ndarray:
            i, j, _ = compare(here, b, how)
            forest.add(here.ids[i], b.ids[j])
            np.add.at(total, i, b.copies[j])
            n = np.zeros(len(b.ids), np.int64)
            np.add.at(n, j, here.copies[i])
            return n

        total += met(here)
        for r in moving:
            b = Block.of(r)
            n = met(b)
            if n.any():
                yield batch(b.ids[n > 0], None, n[n > 0])
        yield batch(here.ids[total > 0], None, total[total > 0])
        links = np.array(forest.kept, np.int64).reshape(-1, 2)
        yield batch(links[:, 0], links[:, 1], np.zeros(len(links), np.int64))

    found = meet(blocks.select("label", "d", "part", *load), sent, ["label", "d", "part"], work, "p bigint, q bigint, n bigint")
    found = materialize(found, "vector-links")
    discard(blocks)
    counts = found.where("q is null").groupBy(F.col("p").alias("cls")).agg(F.sum("n").alias("others"))
    roots = connected_components(found.where("q is not null").select("p", "q"))
    named = classes.join(counts, "cls", "left").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    named = materialize(named.select("label", "v", "first", F.coalesce("component", "cls").alias("root"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vector-roots")
    discard(classes, found)
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    named = named.join(least, "root").select("label", "v", "n_links", "component")
    linked = rows.where("good").join(named, ["label", "v"]).select(F.col("id").alias(id_col), "n_links", "component")
    alone = rows.where("not good").select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.unionByName(alone)
