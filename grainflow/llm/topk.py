"""Exact top-k search by inner product with a pivot table."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import discard, materialize
from .vectors import arrays, meet, packs, usable


@dataclass(frozen=True)
class Search:
    k: int = 20
    #: Pivots: the first rows by a hash of their ids; their number doesn't depend on the data.
    pivots: int = 64
    #: Queries and candidates of one block at most, about; with few rows candidates are dealt into `spread` blocks at least.
    queries: int = 512
    candidates: int = 32_768
    spread: int = 16
    #: Candidates that a query evaluates first, in the order of their bounds; then twice as many each time.
    step: int = 256


#: Products of vectors up to here sum exactly in float64, and in int64.
EXACT, LONGEST = float(1 << 53), float(1 << 62)
MOST = float(np.finfo(np.float64).max)
#: Stand for scores that don't fit a long.
LEAST_LONG, MOST_LONG = -(1 << 63), (1 << 63) - 1


def distances(z: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of vectors (rows) to pivots (columns)."""
    z, p = z.astype(np.float64), pivots.astype(np.float64)
    return np.sqrt(np.maximum(0.0, (z * z).sum(1)[:, None] + (p * p).sum(1) - 2 * z @ p.T)).astype(np.float32)


def slack(d: int, *norms: np.ndarray, far: float) -> float:
    """What rounding can add to the difference of two distances: of the stored float32 values, and of the differences of squares."""
    top = max((float(n.max(initial=0.0)) for n in norms), default=0.0)
    return 4e-7 * far + 2 * float(np.sqrt((d + 8) * 2.3e-16 * 4 * top)) * (top > EXACT / 64)


@dataclass
class Block:
    """Vectors with their ids, squared lengths and distances to the pivots, as they are stored."""

    ids: np.ndarray
    data: np.ndarray
    norms: np.ndarray
    table: np.ndarray  # by pivot and vector

    @staticmethod
    def of(row: dict, dtype: str) -> Block:
        ids = np.frombuffer(row["ids"], "<i8")
        n = len(ids)
        return Block(ids, np.frombuffer(row["data"], dtype).reshape(n, row["d"]), np.frombuffer(row["norms"], "<f8"), np.frombuffer(row["dists"], "<f4").reshape(-1, n))


def best(q: Block, x: Block, least: np.ndarray, how: Search) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For each query the ids and scores of its best candidates, by score and then smaller id, and how many were evaluated.

    |d(q, p) - d(x, p)| is a lower bound of d(q, x), the largest over the pivots counts, and (|q|^2 + |x|^2 - bound^2) / 2 is an
    upper bound of the score. Candidates whose bound is below `least` (a score that k others reach) are eliminated; the rest are
    evaluated in the order of their bounds until the k-th best score is above the next bound: no other can reach it."""
    most = float(q.norms.max(initial=0.0)) ** 0.5 * float(x.norms.max(initial=0.0)) ** 0.5
    if not most < LONGEST:
        yield from best_of_long(q, x, least, how)
        return
    exact = most < EXACT
    qe, xe = (q.data.astype(np.float64), x.data.astype(np.float64)) if exact else (q.data.astype(np.int64), x.data.astype(np.int64))
    far = float(max(q.table.max(initial=0), x.table.max(initial=0)))
    give = slack(q.data.shape[1], q.norms, x.norms, far=far)
    low, wide = np.zeros(len(x.ids), np.float32), 2048
    gap = np.empty((len(x.table), min(wide, len(x.ids))), np.float32)
    for i in range(len(q.ids)):
        for s in range(0, len(low) if len(x.table) else 0, wide):
            part = x.table[:, s : s + wide]
            now = gap[:, : part.shape[1]]
            np.abs(np.subtract(part, q.table[:, i, None], out=now), out=now).max(0, out=low[s : s + wide])
        far_ = np.maximum(0.0, np.nan_to_num(low.astype(np.float64) - give, nan=0.0, posinf=0.0))
        bound = (q.norms[i] + x.norms - far_ * far_) / 2 + 1e-9 * (q.norms[i] + x.norms) + 0.5
        left, take, seen = np.flatnonzero((x.ids != q.ids[i]) & (bound >= least[i])), how.step, 0
        ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        while len(left):
            if take < len(left):
                order = np.argpartition(-bound[left], take - 1)
                now, left = left[order[:take]], left[order[take:]]
            else:
                now, left = left, left[:0]
            got = (xe[now] @ qe[i]).astype(np.int64)
            seen += len(now)
            ids, scores = np.concatenate([ids, x.ids[now]]), np.concatenate([scores, got])
            if len(ids) > how.k:
                high = scores >= np.partition(scores, -how.k)[-how.k]
                ids, scores = ids[high], scores[high]
            if len(ids) >= how.k:
                left = left[bound[left] >= scores.min()]
            take *= 2
        good = scores >= least[i]
        ids, scores = ids[good], scores[good]
        top = np.lexsort((ids, -scores))[: how.k]
        yield ids[top], scores[top], seen


def best_of_long(q: Block, x: Block, least: np.ndarray, how: Search) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """The same where products pass int64: sums in float64 with a bound of their rounding choose what is summed in whole numbers."""
    qf, xf = q.data.astype(np.float64), x.data.astype(np.float64)
    d = qf.shape[1]
    for i in range(len(q.ids)):
        with np.errstate(over="ignore", invalid="ignore"):
            sums = xf @ qf[i]
            off = (d + 2) * 2.3e-16 * (np.abs(xf) @ np.abs(qf[i]))
            low, high = np.nan_to_num(sums - off, nan=-np.inf), np.nan_to_num(sums + off, nan=np.inf, posinf=np.inf)
        left = np.flatnonzero((x.ids != q.ids[i]) & (high >= least[i]))
        seen = len(left)
        if len(left) > how.k and float(np.abs(high[left]).max()) < LONGEST:  # else ends stand for scores, and ids tell them apart
            left = left[high[left] >= np.partition(low[left], -how.k)[-how.k]]
        whole = [int(v) for v in qf[i]]
        scores = [min(max(sum(int(a) * b for a, b in zip(xf[j], whole, strict=True)), LEAST_LONG), MOST_LONG) for j in left]
        top = sorted((-s, int(x.ids[j])) for s, j in zip(scores, left, strict=True) if s >= float(least[i]))[: how.k]
        yield np.array([j for _, j in top], np.int64), np.array([-s for s, _ in top], np.int64), seen


def reached(score: int) -> float:
    """A score as a float that isn't above it."""
    return float(score) if abs(int(score)) <= EXACT else float(np.nextafter(float(score), -np.inf))


FOUND = "d int, qb int, least binary, floor double, q_ids binary, ids binary, scores binary, evaluated bigint, met bigint"


def top_k(vectors: DataFrame, is_query: Column, how: Search = Search(), id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0, report: bool = False) -> DataFrame:
    """query_id, rank (from 1), id, score: each query's k candidates of the highest inner product of floor(scale * x), exactly;
    with report instead evaluated and met, the sums of candidates evaluated and of candidates in all, per query block.

    is_query: a condition on the id column. A null id, and a vector that is null, empty or holds a null or non-finite
    component, takes no part; all others do, however long. A score that doesn't fit a long is given as the
    nearest long, and ranks as that (a scaled component that no double holds counts as the largest one). All other rows are
    candidates of every query of another id, rows that repeat an id too; rows that repeat a query's id are one query whose
    candidates count once for each. Vectors of different lengths don't meet; a query with fewer candidates gets all; an empty
    table gives an empty one.

    Distances to the pivots are computed once and stored with the rows, which are packed into blocks by their nearest pivot. Each
    query first meets the block of its own pivot, which gives a score that k candidates reach. Blocks whose bound, from
    the ranges of their pivot distances, is below that for all queries of a block are passed over whole; in the others candidates
    are eliminated one by one. A candidate block is sent to one task, past which the query blocks stream."""
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()

    def whole(x: Column) -> Column:
        y = F.greatest(F.least(x.cast("double") * scale, F.lit(MOST)), F.lit(-MOST))
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)  # larger ones are whole numbers

    v = F.transform(F.col(vector_col), whole)
    rows = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))
    rows = materialize(rows.withColumn("d", F.size("v")), "search-rows")
    low, high, n, n_queries = rows.agg(F.min(F.array_min("v")), F.max(F.array_max("v")), F.count("*"), F.count_if("q")).first()
    if not n_queries:
        return spark.createDataFrame([], f"query_id {kind}, rank int, id {kind}, score bigint")
    dtype = "<i2" if max(-low, high) < 1 << 15 else "<f8"
    size = min(how.candidates, max(1, -(-n // how.spread)))
    pivots: dict[int, list] = {}
    for r in rows.where(F.col("norm") < LONGEST).orderBy(F.xxhash64(F.lit(3), "id"), "id", "v").limit(how.pivots).select("d", "v").collect():  # bounded
        pivots.setdefault(r["d"], []).append(r["v"])
    tables = spark.sparkContext.broadcast({d: np.array(p) for d, p in pivots.items()})
    cells = max(1, min(how.pivots, -(-n // size)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() * 7919
        for batch in batches:
            vectors_ = arrays(batch.column("v"), "<f8")
            d = np.array(batch.column("d").to_pylist())
            for one in np.unique(d):
                here = np.flatnonzero(d == one)
                z, p = np.array([vectors_[i] for i in here]), tables.value.get(int(one))
                table = distances(z, p) if p is not None else np.zeros((len(z), 0), np.float32)
                cell = table[:, :cells].argmin(1) if table.shape[1] else np.zeros(len(z), int)
                part = batch.take(pa.array(here))
                yield pa.RecordBatch.from_pydict(
                    {"d": part.column("d"), "cell": pa.array(cell, pa.int32()), "turn": pa.array(at + np.arange(len(z)), pa.int64()), "id": part.column("id"), "q": part.column("q"), "norm": part.column("norm")}
                    | {"data": pa.array([x.astype(dtype).tobytes() for x in z], pa.binary()), "dists": pa.array([x.tobytes() for x in table], pa.binary())}
                )
                at += len(z)

    table = materialize(rows.mapInArrow(placed, "d int, cell int, turn bigint, id bigint, q boolean, norm double, data binary, dists binary"), "search-placed")
    discard(rows)

    def blocks(which: DataFrame, most: int, name: str) -> tuple[DataFrame, DataFrame]:
        """Blocks (d, name, ...) of about `most` rows, and where each cell's begin: (d, cell, first, parts). A row per cell is few."""
        sizes = which.groupBy("d", "cell").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
        first = F.coalesce(F.sum("parts").over(W.partitionBy("d").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int")
        sizes = sizes.select("d", "cell", "parts", first.alias("first"))
        dealt = which.join(sizes, ["d", "cell"]).withColumn(name, F.col("first") + F.pmod("turn", "parts").cast("int"))

        def make(key: dict, got: list[dict]) -> dict:
            dists = np.array([np.frombuffer(r["dists"], "<f4") for r in got], np.float32).reshape(len(got), -1).T
            norms = np.array([r["norm"] for r in got])
            ends = {"lo": dists.min(1), "hi": dists.max(1)}
            packed = {"ids": np.array([r["id"] for r in got], "<i8").tobytes(), "data": b"".join(r["data"] for r in got), "norms": norms.tobytes(), "dists": np.ascontiguousarray(dists).tobytes()}
            return packed | {"cell": pa.array([got[0]["cell"]], pa.int32()), "top": float(norms.max())} | {k: pa.array([x.tolist()], pa.list_(pa.float64())) for k, x in ends.items()}

        made = packs(dealt, ["d", name], ["id", "norm", "data", "dists", "cell"], make, "ids binary, data binary, norms binary, dists binary, cell int, top double, lo array<double>, hi array<double>")
        return materialize(made, f"search-{name}"), sizes

    x, x_cells = blocks(table, size, "xb")
    q, _ = blocks(table.where("q"), how.queries, "qb")
    x_cells = materialize(x_cells, "search-cells")
    load = ["ids", "data", "norms", "dists"]

    def work(fixed: dict, moving: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        here = Block.of(fixed, dtype)
        for r in moving:
            ask = Block.of(r, dtype)
            least = np.full(len(ask.ids), -np.inf) if r["least"] is None else np.frombuffer(r["least"], "<f8")
            found = list(best(ask, here, least, how))
            least_now = np.array([reached(s[-1]) if len(s) == how.k else -np.inf for _, s, _ in found])
            ids, scores = np.concatenate([i for i, _, _ in found]), np.concatenate([s for _, s, _ in found])
            owners = np.repeat(ask.ids, [len(i) for i, _, _ in found])
            yield pa.RecordBatch.from_pydict(
                {"d": pa.array([r["d"]], pa.int32()), "qb": pa.array([r["qb"]], pa.int32()), "least": [np.maximum(least, least_now).tobytes()], "floor": [float(np.maximum(least, least_now).min())]}
                | {"q_ids": [owners.astype("<i8").tobytes()], "ids": [ids.astype("<i8").tobytes()], "scores": [scores.astype("<i8").tobytes()]}
                | {"evaluated": [sum(e for _, _, e in found)], "met": [len(ask.ids) * len(here.ids)]}
            )

    home = q.join(x_cells.select("d", "cell", F.col("first").alias("xb")), ["d", "cell"])
    fixed = x.select("d", "xb", *load)
    begun = materialize(meet(fixed, home.select("d", "xb", "qb", *load, F.lit(None).cast("binary").alias("least")), ["d", "xb"], work, FOUND), "search-first")

    # which blocks may hold more: bounds of whole blocks, on their small descriptions
    count = x_cells.groupBy("d").agg(F.sum("parts").cast("int").alias("count"))
    asked = home.select("d", "qb", F.col("xb").alias("home"), F.col("top").alias("q_top"), F.col("lo").alias("q_lo"), F.col("hi").alias("q_hi")).join(begun.select("d", "qb", "floor"), ["d", "qb"])
    asked = asked.join(count, "d").withColumn("xb", F.explode(F.sequence(F.lit(0), F.col("count") - 1))).where("xb <> home")
    near = asked.join(x.select("d", "xb", "top", "lo", "hi"), ["d", "xb"])
    apart = F.zip_with(F.zip_with("lo", "q_hi", lambda a, b: a - b), F.zip_with("q_lo", "hi", lambda a, b: a - b), lambda a, b: F.greatest(a, b))
    apart = F.greatest(F.lit(0.0), F.coalesce(F.array_max(apart), F.lit(0.0)) - 1e-6 * F.sqrt(F.col("q_top") + F.col("top")) * 2)
    bound = (F.col("q_top") + F.col("top") - F.when(F.col("q_top") + F.col("top") < EXACT / 64, apart * apart).otherwise(0.0)) / 2 + 1e-9 * (F.col("q_top") + F.col("top")) + 0.5
    pairs = materialize(near.where(bound >= F.col("floor")).select("d", "qb", "xb"), "search-pairs")
    sent = pairs.join(q.select("d", "qb", *load), ["d", "qb"]).join(begun.select("d", "qb", "least"), ["d", "qb"])
    later = meet(fixed, sent.select("d", "xb", "qb", *load, "least"), ["d", "xb"], work, FOUND)
    if report:
        every = begun.unionByName(later).groupBy("d", "qb").agg(F.sum("evaluated").alias("evaluated"), F.sum("met").alias("met"))
        return every.join(q.select("d", "qb", (F.octet_length("ids") / 8 * n).alias("candidates")), ["d", "qb"])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("q_ids", "ids", "scores")), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b, "<i8")) for b in row], names=["query_id", "id", "score"])

    found = begun.unionByName(later).select("q_ids", "ids", "scores").mapInArrow(opened, T.StructType().add("query_id", "long").add("id", "long").add("score", "long"))
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= how.k).select(F.col("query_id").cast(kind).alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").cast(kind).alias("id"), "score")
