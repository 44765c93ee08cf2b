"""Skeleton and thickness of a phase. Thinning works on tiles with a rim of neighbours, distances on single grid lines, so that a
task never holds a whole grid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.ranks import quantiles
from ..functions.scalars import safe_div
from ..functions.tables import discard, materialize
from . import graph
from .grid import STEP, TILE, Boundary, neighbours, numbered, roots, whole_tiles, with_rim

#: The eight neighbours in a ring, starting above and going round.
RING = ((0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1))


def _removable() -> np.ndarray:
    """By the eight neighbours as bits in the ring's order: whether a cell can go without a change of topology, and ends no line.

    A cell is simple if its neighbours hang together without it in one piece and it has an empty side: of the four sides, one and only
    one is empty and not led on by two empty places going round (components of eight neighbours, holes of four)."""
    out = np.zeros(256, bool)
    for code in range(256):
        empty = [not code >> k & 1 for k in range(8)]
        pieces = sum(empty[k] and not (empty[k + 1] and empty[(k + 2) % 8]) for k in range(0, 8, 2))
        out[code] = pieces == 1 and code.bit_count() > 1
    return out


REMOVABLE = _removable()


def fields(i: np.ndarray, n: int, periodic: bool) -> np.ndarray:
    """The field of each line of an axis: even or odd, and on a periodic axis of odd length the last one alone, so that
    no two neighbours are in one field."""
    at = i % n if periodic else i
    return np.where(periodic & (n % 2 == 1) & (at == n - 1), 2, at % 2)


def thin(mask: np.ndarray, rounds: int, fx: np.ndarray, fy: np.ndarray) -> np.ndarray:
    """thin_fields of one grid, by the fields of its lines."""
    return thin_fields(mask, rounds, 3 * fx[:, None] + fy[None, :])


def thin_fields(mask: np.ndarray, rounds: int, field: np.ndarray) -> np.ndarray:
    """Rounds of thinning that keep components and holes: of the cells with an empty side at the start of a round, those that are
    simple and end no line go, field by field. Cells of one field aren't neighbours, so that they can go together."""
    p = np.pad(mask, 1)
    now = p[1:-1, 1:-1]
    for _ in range(rounds):
        x, y = np.nonzero(now & ~(p[1:-1, :-2] & p[1:-1, 2:] & p[:-2, 1:-1] & p[2:, 1:-1]))
        of = field[x, y]
        gone = False
        for f in range(9):
            fx, fy = x[of == f], y[of == f]
            code = np.zeros(len(fx), np.int64)
            for k, (dx, dy) in enumerate(RING):
                code |= p[fx + 1 + dx, fy + 1 + dy].astype(np.int64) << k
            go = REMOVABLE[code]
            now[fx[go], fy[go]] = False
            gone |= bool(go.any())
        if not gone:
            break
    return now.copy()


def skeleton(cells: DataFrame, b: Boundary, phase: str, tile: int = 256, rounds: int = 0) -> DataFrame:
    """The cells (step_index, ix, iy, nx, ny) of a phase that thinning leaves, on the wrapped grid along periodic axes. They have the
    components (of eight neighbours) and holes of the phase.

    Each pass hands every open tile its cells with a rim, and thins it by `rounds` (0: as many as a rim of 60 cells allows; a round
    sees one cell further for the border and for each field); passes go on until none removes a cell. A tile is open as long as the
    last pass changed it or one whose cells it sees; settled ones are carried on as they are."""
    sees = 1 + (3 if b.x else 2) * (3 if b.y else 2)
    rounds = rounds or 60 // sees
    rim = sees * rounds
    now = cells.where(F.col("phase") == phase).select(F.col(STEP).cast("int").alias(STEP), F.col("ix").cast("int").alias("ix"), F.col("iy").cast("int").alias("iy"), "nx", "ny")
    now = materialize(now, "skeleton")
    schema = f"{STEP} int, ix int, iy int, nx int, ny int"

    def copies(i: str, n: str, periodic: bool):
        """Places at which a cell is seen: its own, and one or more periods away within the rim of the grid's ends."""
        if not periodic:
            return F.array(F.col(i))
        k = F.ceil(F.lit(rim) / F.col(n)).cast("int")
        return F.filter(F.transform(F.sequence(-k, k), lambda j: F.col(i) + j * F.col(n)), lambda x: (x >= -rim) & (x < F.col(n) + rim))

    def tiles(x: str):
        return F.sequence(F.floor((F.col(x) - rim) / tile).cast("int"), F.floor((F.col(x) + rim) / tile).cast("int"))

    def seen(df: DataFrame) -> DataFrame:
        """Cells by each tile that sees them."""
        placed = df.withColumn("vx", F.explode(copies("ix", "nx", b.x))).withColumn("vy", F.explode(copies("iy", "ny", b.y)))
        dealt = placed.withColumn("tx", F.explode(tiles("vx"))).withColumn("ty", F.explode(tiles("vy")))
        return dealt.where((F.col("tx") >= 0) & (F.col("ty") >= 0) & (F.col("tx") * tile < F.col("nx")) & (F.col("ty") * tile < F.col("ny")))

    def run(t: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Thins tiles next to one another, each no larger than its cells reach, with an empty line between."""
        vx, vy, nx, ny = (t[c].astype(np.int64) for c in ("vx", "vy", "nx", "ny"))
        number = numbered([t[STEP], t["tx"], t["ty"]])
        starts = np.flatnonzero(np.diff(number, prepend=-1))
        x0, x1, y0 = (f.reduceat(v, starts) for f, v in ((np.minimum, vx), (np.maximum, vx), (np.minimum, vy)))
        width = x1 - x0 + 2
        x, y = (np.cumsum(width) - width - x0)[number] + vx, vy - y0[number]
        mask, field = np.zeros((int(width.sum()), int(y.max()) + 1), bool), np.zeros((int(width.sum()), int(y.max()) + 1), np.int8)
        mask[x, y] = True
        field[x, y] = 3 * fields(vx, nx, b.x) + fields(vy, ny, b.y)
        left = thin_fields(mask, rounds, field)[x, y]
        own = left & (vx // tile == t["tx"]) & (vy // tile == t["ty"]) & (vx >= 0) & (vx < nx) & (vy >= 0) & (vy < ny)
        yield pa.RecordBatch.from_arrays([pa.array(v[own].astype(np.int32)) for v in (t[STEP], vx, vy, nx, ny)], names=[STEP, "ix", "iy", "nx", "ny"])

    place = [STEP, "tx", "ty"]
    own = {"tx": F.floor(F.col("ix") / tile).cast("int"), "ty": F.floor(F.col("iy") / tile).cast("int")}
    open_ = None  # every tile at first
    while True:
        dealt, rest = seen(now), None
        if open_ is not None:
            dealt = dealt.join(open_, place, "left_semi")
            rest = now.withColumns(own).join(open_, place, "left_anti").select(*now.columns)
        later = whole_tiles(dealt.select(STEP, "vx", "vy", "tx", "ty", "nx", "ny"), place, ["vx", "vy"], run, schema)
        later = materialize(later if rest is None else later.unionByName(rest), "skeleton")
        gone = materialize(now.join(later, [STEP, "ix", "iy"], "left_anti"), "thinned")
        if open_ is not None:
            discard(open_)
        if gone.isEmpty():
            discard(gone, now)
            return later
        open_ = materialize(seen(gone).select(*place).distinct(), "open-tiles")
        discard(gone, now)
        now = later


def closed_topology(cells: DataFrame, b: Boundary, tile: int = TILE) -> DataFrame:
    """Per step, of cells as closed squares, which hang together over corners too: cells, components, and holes (independent loops; the
    components less the Euler number, sides and corners counted once each; on a torus that is wholly covered one more).

    One pass over tiles, each with the cells round it, counts; only cells with a neighbour in another tile or over a seam are joined as a graph."""

    def run(t: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        step, own, vx, vy = (t[c] for c in (STEP, "own", "vx", "vy"))
        code, there, at = neighbours(t, tile, RING)
        forward = [d for d in RING if d > (0, 0)]
        pairs = [(np.flatnonzero(k), at[d][k]) for d in forward for k in [there[d] & own & own[at[d]]]]
        top = roots(len(code), *(np.concatenate(c) for c in zip(*pairs, strict=True)))
        no = {d: ~there[d] for d in RING}
        # a side or corner belongs to the first cell at it: right of or above it, then left of it, then below
        sides = 2 + no[1, 0].astype(int) + no[0, 1]
        corners = 1 + no[1, 0].astype(int) + (no[0, 1] & no[-1, 1]) + (no[1, 1] & no[0, 1] & no[1, 0])
        mine = np.flatnonzero(own)
        steps, of = np.unique(step[mine], return_inverse=True)
        total = lambda v: np.bincount(of, v[mine], len(steps)).astype(np.int64)
        counts = [np.zeros(len(steps)), steps, total(np.ones(len(code))), total(top == np.arange(len(code))), total(sides), total(corners)]
        yield rows(counts, 0)
        k = np.flatnonzero(own & np.logical_or.reduce([there[d] & ~own[at[d]] for d in RING]))
        yield rows([np.ones(len(k)), step[k], vx[top[k]].astype(np.int64) * t["ny"][k] + vy[top[k]], vx[k], vy[k], t["nx"][k], t["ny"][k]], 1)

    def rows(values: list[np.ndarray], kind: int) -> pa.RecordBatch:
        given = dict(zip(((*names[:2], *names[2:6]), (*names[:2], "node", "ix", "iy", "nx", "ny"))[kind], values, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(given[c].astype(np.int64)).cast(k) if c in given else pa.nulls(len(values[0]), k) for c, k in zip(names, [pa.int32()] * 2 + [pa.int64()] * 5 + [pa.int32()] * 4, strict=True)], names=names)

    names = ["kind", STEP, "cells", "pieces", "sides", "corners", "node", "ix", "iy", "nx", "ny"]
    schema = f"kind int, {STEP} int, cells bigint, pieces bigint, sides bigint, corners bigint, node bigint, ix int, iy int, nx int, ny int"
    found = materialize(whole_tiles(with_rim(cells, b, tile), [STEP, "tx", "ty"], ["vx", "vy"], run, schema), "closed-pieces")
    steps = cells.groupBy(F.col(STEP).cast("int").alias(STEP)).agg(F.max("nx").alias("nx"), F.max("ny").alias("ny"), F.max(F.col("nx").cast("long") * F.col("ny")).alias("places"))
    base = steps.select(STEP, (F.sum("places").over(W.orderBy(STEP)) - F.col("places")).alias("base"))
    rim = found.where("kind = 1").join(base, STEP).select(STEP, "ix", "iy", "nx", "ny", (F.col("node") + F.col("base")).alias("node"))
    rim = materialize(rim, "closed-rim")
    of = lambda x, y, n: rim.select(STEP, F.col("ix").alias(x), F.col("iy").alias(y), F.col("node").alias(n))
    links = _neighbours(rim, b).select(STEP, "ix", "iy", "jx", "jy").join(of("ix", "iy", "u"), [STEP, "ix", "iy"]).join(of("jx", "jy", "v"), [STEP, "jx", "jy"])
    moved = graph.components(links.where("u <> v").select("u", "v")).where("node <> component")
    fewer = rim.select(STEP, "node").distinct().join(moved, "node", "left_semi").groupBy(STEP).agg(F.count("*").alias("fewer"))
    out = found.where("kind = 0").groupBy(STEP).agg(*(F.sum(c).alias(c) for c in ("cells", "pieces", "sides", "corners"))).join(fewer, STEP, "left").join(steps, STEP)
    out = out.withColumn("components", F.col("pieces") - F.coalesce("fewer", F.lit(0)))
    full = F.when(F.lit(b.x and b.y) & (F.col("cells") == F.col("places")), 1).otherwise(0)
    return out.select(STEP, "cells", "components", (F.col("components") + full - F.col("cells") + F.col("sides") - F.col("corners")).alias("holes"))


def _neighbours(skel: DataFrame, b: Boundary) -> DataFrame:
    """Pairs of a skeleton cell and each of its eight neighbours that are in the skeleton too: place in the ring, over a seam or not."""
    steps = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for k, (dx, dy) in enumerate(RING)))).alias("s")
    near = skel.select(STEP, "ix", "iy", "nx", "ny", steps).select(STEP, "ix", "iy", "nx", "ny", "s.*")
    jx, jy = F.col("ix") + F.col("dx"), F.col("iy") + F.col("dy")
    out_x, out_y = ~jx.between(0, F.col("nx") - 1), ~jy.between(0, F.col("ny") - 1)
    near = near.where((F.lit(b.x) | ~out_x) & (F.lit(b.y) | ~out_y))
    near = near.select(STEP, "ix", "iy", "nx", "ny", "k", "dx", "dy", (out_x | out_y).alias("seam"), F.pmod(jx, "nx").alias("jx"), F.pmod(jy, "ny").alias("jy"))
    there = skel.select(STEP, F.col("ix").alias("jx"), F.col("iy").alias("jy"))
    return near.join(there, [STEP, "jx", "jy"])


def skeleton_stats(cells: DataFrame, skel: DataFrame, b: Boundary, phase: str, dx: float, dy: float) -> DataFrame:
    """Per step: length, branch points (three or more runs of neighbours round a cell), end points (one neighbour), and branch
    points per area of the phase. Links count once; those over a seam once from each side. A horizontal link counts dy and a
    vertical one dx, a diagonal one their hypotenuse."""
    near = _neighbours(skel, b)
    bits = near.groupBy(STEP, "ix", "iy").agg(F.sort_array(F.collect_set("k")).alias("ks"), F.count("*").alias("n"))
    has = lambda k: F.array_contains("ks", k)
    runs = sum((F.when(~has(k) & has((k + 1) % 8), 1).otherwise(0) for k in range(8)), F.lit(0))
    points = bits.groupBy(STEP).agg(F.count_if(runs >= 3).alias("branch_points"), F.count_if(F.col("n") == 1).alias("end_points"))
    key = lambda x, y: F.col(x).cast("long") * F.col("ny") + F.col(y)
    once = near.where(F.col("seam") | (key("jx", "jy") > key("ix", "iy")))
    size = F.when(F.col("dy") == 0, F.lit(float(dy))).when(F.col("dx") == 0, F.lit(float(dx))).otherwise(F.lit(float(np.hypot(dx, dy))))
    length = once.groupBy(STEP).agg(F.sum(size).alias("skeleton_length"))
    base = cells.groupBy(STEP).agg((F.count_if(F.col("phase") == phase) * dx * dy).alias("area"))
    out = base.join(points, STEP, "left").join(length, STEP, "left").na.fill(0, ["branch_points", "end_points"]).na.fill(0.0, ["skeleton_length"])
    density = F.when(F.col("area") == 0, F.lit(0.0)).otherwise(safe_div(F.col("branch_points"), F.col("area")))
    return out.select(STEP, "skeleton_length", "branch_points", "end_points", density.alias("branch_density"))


def _least_parabola(at: np.ndarray, height: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The least of height + (x - at)^2 at each x, for rising places: the lower envelope of the parabolas, built in one pass."""
    if not len(at):
        return np.full(len(x), np.inf)
    kept, starts = [], []
    for p, h in zip(at.tolist(), height.tolist(), strict=True):
        start = -np.inf
        while kept:
            q, f = kept[-1]
            start = (h + p * p - f - q * q) / (2 * (p - q))
            if start > starts[-1]:
                break
            kept.pop(), starts.pop()
            start = -np.inf
        kept.append((p, h))
        starts.append(start)
    p, h = np.array(kept).T[:, np.maximum(0, np.searchsorted(starts, x, side="right") - 1)]
    return h + (x - p) ** 2


def distances(cells: DataFrame, b: Boundary, phase: str) -> DataFrame:
    """Each cell of the phase with its distance in cells to the nearest place that isn't in the phase: other phase or missing; null if
    there is none. First along each line in x, by the ends of the run of cells that a cell is in; then the least over the
    line in y, where a task holds one grid line at a time."""
    mine = cells.where(F.col("phase") == phase).select(F.col(STEP).cast("int").alias(STEP), F.col("ix").cast("int").alias("ix"), F.col("iy").cast("int").alias("iy"), F.col("nx").cast("int").alias("nx"), F.col("ny").cast("int").alias("ny"))
    line = W.partitionBy(STEP, "iy")
    runs = mine.withColumn("run", F.col("ix") - F.row_number().over(line.orderBy("ix")))
    run = W.partitionBy(STEP, "iy", "run")
    runs = runs.withColumn("first", F.min("ix").over(run)).withColumn("last", F.max("ix").over(run))
    before, after = F.when(F.col("first") > 0, F.col("first") - 1), F.when(F.col("last") < F.col("nx") - 1, F.col("last") + 1)
    if b.x:  # over the seam: past the run that touches the other end
        far_first = F.min(F.when(F.col("last") == F.col("nx") - 1, F.col("first"))).over(line)
        far_last = F.max(F.when(F.col("first") == 0, F.col("last"))).over(line)
        whole = (F.col("first") == 0) & (F.col("last") == F.col("nx") - 1)
        before = F.when(~whole, F.coalesce(before, F.coalesce(far_first, F.col("nx")) - 1 - F.col("nx")))
        after = F.when(~whole, F.coalesce(after, F.col("nx") + F.coalesce(far_last, F.lit(-1)) + 1))
    along = runs.select(STEP, "ix", "iy", "ny", F.least(F.col("ix") - before, after - F.col("ix")).cast("double").alias("g"))

    def lines(step: np.ndarray, x: np.ndarray, y: np.ndarray, ny: np.ndarray, g: np.ndarray) -> Iterator[np.ndarray]:
        """The distances of whole lines, one after another."""
        ends = [*(np.flatnonzero((np.diff(step) != 0) | (np.diff(x) != 0)) + 1).tolist(), len(x)]
        for a, z in zip([0, *ends[:-1]], ends, strict=True):
            n, at = int(ny[a]), y[a:z]
            height = np.zeros(n)
            height[at] = g[a:z] ** 2
            all_h, places = (np.concatenate([height] * 3), np.arange(-n, 2 * n)) if b.y else (height, np.arange(n))
            there = np.isfinite(all_h)
            yield np.sqrt(_least_parabola(places[there], all_h[there], at))

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None

        def out(columns: list[np.ndarray]) -> pa.RecordBatch:
            d = np.concatenate(list(lines(*columns)))
            return pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in columns[:3]), pa.array(d, mask=~np.isfinite(d))], names=[STEP, "ix", "iy", "distance"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = [pc.fill_null(c, float("inf") if c.type == pa.float64() else 0).to_numpy(zero_copy_only=False) for c in batch.columns]
            new = new if kept is None else [np.concatenate(pair) for pair in zip(kept, new, strict=True)]
            # the last line may go on in the next batch
            whole = int(np.searchsorted((new[0] == new[0][-1]) & (new[1] == new[1][-1]), True)) if (new[0][-1], new[1][-1]) != (new[0][0], new[1][0]) else 0
            if whole:
                yield out([c[:whole] for c in new])
            kept = [c[whole:] for c in new]
        if kept is not None:
            yield out(kept)

    dealt = along.select(STEP, "ix", "iy", "ny", "g").repartition(STEP, "ix").sortWithinPartitions(STEP, "ix")
    return dealt.mapInArrow(down, f"{STEP} int, ix int, iy int, distance double")


def thickness(cells: DataFrame, b: Boundary, dx: float, dy: float, phase: str = "matrix", skel: DataFrame | None = None) -> DataFrame:
    """Per step: least, mean, first and fifth percentile of twice the distance at skeleton cells, in lengths of a cell of the same
    area, and their number. If a step has no skeleton, all cells of the phase count. Infinite distances don't."""
    skel = skeleton(cells, b, phase) if skel is None else skel
    d = distances(cells, b, phase).join(skel.select(STEP, "ix", "iy", F.lit(True).alias("on")), [STEP, "ix", "iy"], "left")
    any_ = skel.select(STEP).distinct().withColumn("has", F.lit(True))
    d = d.join(any_, STEP, "left").where("(on or has is null) and distance > 0").select(STEP, (2 * F.col("distance") * F.lit(float(np.sqrt(dx * dy)))).alias("t"))
    d = materialize(d, "thickness")
    out = d.groupBy(STEP).agg(F.min("t").alias("min"), F.avg("t").alias("mean"), F.count("*").alias("sample_count")).join(quantiles(d, [STEP], "t", (0.01, 0.05)), STEP, "left")
    out = cells.select(F.col(STEP).cast("int").alias(STEP)).distinct().join(out, STEP, "left").na.fill(0, ["sample_count"])
    return out.select(STEP, "min", "mean", F.element_at("q", 1).alias("p1"), F.element_at("q", 2).alias("p5"), "sample_count")
