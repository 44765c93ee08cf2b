"""Two-phase grids: sparse cells with indices, lattice edges, labels of connected components, and what is counted on them.

Cells are rows (step_index, ix, iy, x, y, ncount, phase, nx, ny); an absent cell is an absent row. Both phases and all steps
go through each query together."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.errors import positive, require
from ..functions.names import metadata
from ..functions.ranks import ranked
from ..functions.scalars import safe_div, safe_div_or_zero
from ..functions.tables import materialize
from . import graph

STEP = "step_index"
#: Side of the square tiles that are labelled on their own: a task holds one tile, however large the grid.
TILE = 128


@dataclass(frozen=True)
class Boundary:
    x: bool = False
    y: bool = False

    @staticmethod
    def of(name: str) -> Boundary:
        known = {"open": (False, False), "periodic-x": (True, False), "periodic-y": (False, True), "periodic-xy": (True, True)}
        require(str(name).lower() in known, "BadBoundary", str(name))
        return Boundary(*known[str(name).lower()])


def gridify(df: DataFrame, threshold: float, x: str = "x", y: str = "y", n: str = "ncount") -> DataFrame:
    """Cells with indices in the order of the distinct coordinates of their step, and their phase: pore below the threshold.

    Only the distinct coordinates of an axis, as many as the grid has lines, are ranked."""
    require(threshold is not None, "MissingThresholdN")
    df = df.select(STEP, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(n).cast("double").alias("ncount"))

    def axis(c: str, i: str, size: str) -> DataFrame:
        lines = df.select(STEP, c).distinct()
        return lines.select(STEP, c, (F.row_number().over(W.partitionBy(STEP).orderBy(c)) - 1).alias(i), F.count("*").over(W.partitionBy(STEP)).cast("int").alias(size))

    phase = F.when(F.col("ncount") < threshold, "pore").otherwise("matrix")
    return df.join(axis("x", "ix", "nx"), [STEP, "x"]).join(axis("y", "iy", "ny"), [STEP, "y"]).select(STEP, "ix", "iy", "x", "y", "ncount", phase.alias("phase"), "nx", "ny")


def check(df: DataFrame, x: str = "x", y: str = "y", n: str = "ncount") -> None:
    """Raises if a coordinate or count isn't finite, or if a place occurs twice in a step. Runs two small aggregates."""
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == F.lit(float("inf")))
    require(df.where(bad(x) | bad(y) | bad(n)).limit(1).count() == 0, "NonFiniteInput")
    require(df.groupBy(STEP, x, y).count().where("count > 1").limit(1).count() == 0, "DuplicateGridCell")


def spacing(df: DataFrame, axis: str, given: float | None = None, path: str | None = None, scale: float = 1.0) -> tuple[float, str]:
    """The distance of a grid's lines and where it is from: given (times scale), the file's name (times scale), or the median
    distance of the distinct (scaled) coordinates, from which none may differ by over a hundredth."""
    positive(given, "BadSpacing")
    if given is not None:
        return given * scale, "option"
    if path and (v := metadata(path).get(f"d{axis}")) is not None and v > 0:
        return v * scale, "filename"
    gaps = df.select(STEP, axis).distinct().select((F.col(axis) - F.lag(axis).over(W.partitionBy(STEP).orderBy(axis))).alias("gap")).where("gap is not null")
    gaps = materialize(gaps, "gaps")
    middle = gaps.agg(F.median("gap")).first()[0]
    require(middle is not None, "NeedSpacing", axis)
    slack = max(1e-9, 1e-2 * max(abs(middle), 1.0))
    require(gaps.where(F.abs(F.col("gap") - middle) > slack).limit(1).count() == 0, "IrregularGrid", axis)
    require(middle > 0, "BadCoordinateSpacing", axis)
    return float(middle), "coordinates"


def lattice(cells: DataFrame, b: Boundary, *carry: str) -> DataFrame:
    """Both ends of every edge of the grid: (step_index, dir, ax, ay, wrapped, end) with the cell's phase and carried columns.

    dir x joins a cell with the next in x, dir y with the next in y; the edge is named after its first cell (end 0). Edges over a
    periodic seam are wrapped; a cell may be both ends of one edge."""
    kinds = []
    for dir_, i, n, periodic in (("x", "ix", "nx", b.x), ("y", "iy", "ny", b.y)):
        at, size = F.col(i), F.col(n)
        first = F.struct(F.lit(dir_).alias("dir"), F.col("ix").alias("ax"), F.col("iy").alias("ay"), (at == size - 1).alias("wrapped"), F.lit(0).alias("end"))
        back = F.pmod(at - 1, size)
        second = F.struct(F.lit(dir_).alias("dir"), (back if dir_ == "x" else F.col("ix")).alias("ax"), (back if dir_ == "y" else F.col("iy")).alias("ay"), (at == 0).alias("wrapped"), F.lit(1).alias("end"))
        kinds += [F.when(F.lit(periodic) | (at < size - 1), first), F.when(F.lit(periodic) | (at > 0), second)]
    ends = F.explode(F.filter(F.array(*kinds), lambda e: e.isNotNull())).alias("e")
    return cells.select(STEP, "phase", *carry, ends).select(STEP, "phase", *carry, "e.dir", "e.ax", "e.ay", "e.wrapped", "e.end")


def edges(cells: DataFrame, b: Boundary) -> DataFrame:
    """Edges with both cells present: dir, wrapped, n_pore (2: inside the pores, 0: inside the matrix, 1: interface) and the midpoint."""
    ends = lattice(cells, b, "x", "y")
    out = ends.groupBy(STEP, "dir", "ax", "ay", "wrapped").agg(F.count("*").alias("n"), F.count_if(F.col("phase") == "pore").alias("n_pore"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    return out.where("n = 2").drop("n")


def _length(dx: float, dy: float) -> Column:
    """The side that two cells share: dy between neighbours in x, dx between neighbours in y."""
    return F.when(F.col("dir") == "x", F.lit(float(dy))).otherwise(F.lit(float(dx)))


def global_stats(parts: DataFrame, dx: float, dy: float) -> DataFrame:
    """Per step, of the pieces of its cells: cells and areas of the phases, porosity, interface length and its ratios to the areas."""
    area = dx * dy
    out = parts.where("kind = 0").groupBy(STEP).agg(
        F.sum("n").alias("valid_cells"), F.coalesce(F.sum(F.when(F.col("phase") == "pore", F.col("n"))), F.lit(0).cast("long")).alias("pore_cells"),
        # each line is a side of both its cells
        ((F.sum("other_x") * float(dy) + F.sum("other_y") * float(dx)) / 2).alias("interface_length"),
    )
    out = out.withColumn("matrix_cells", F.col("valid_cells") - F.col("pore_cells"))
    out = out.withColumns({f"{k}_area": F.col(f"{k}_cells") * area for k in ("valid", "pore", "matrix")})
    i = F.col("interface_length")
    return out.withColumns(
        {
            "porosity": safe_div(F.col("pore_area"), F.col("valid_area")),
            "matrix_fraction": safe_div(F.col("matrix_area"), F.col("valid_area")),
            "specific_interface": safe_div(i, F.col("valid_area")),
            "specific_interface_pore": safe_div(i, F.col("pore_area")),
            "specific_interface_matrix": safe_div(i, F.col("matrix_area")),
        }
    )


#: What a task finds of its tiles. kind 0: a piece, the cells of one component within one tile, with its box (ix, iy to x1, y1), the sums of
#: its coordinates, its sides by their neighbours (same: of its phase, other: of the other one; in x and in y) and the 2 x 2 squares wholly in the
#: phase that start in it; 1: a cell with a neighbour of its phase in another tile or over a seam; 2: another cell.
FOUND = f"kind int, {STEP} int, phase string, node bigint, ix int, iy int, x double, y double, nx int, ny int, n bigint, x1 int, y1 int, same_x bigint, same_y bigint, other_x bigint, other_y bigint, squares bigint"


def roots(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The least of n rows that each can reach over the pairs (p, q)."""
    top = np.arange(n)
    while True:  # each round hooks larger roots to smaller ones, then halves the paths
        rp, rq = top[p], top[q]
        apart = rp != rq
        if not apart.any():
            return top
        p, q, rp, rq = (c[apart] for c in (p, q, rp, rq))
        np.minimum.at(top, np.maximum(rp, rq), np.minimum(rp, rq))
        while True:
            up = top[top]
            if (up == top).all():
                break
            top = up


def numbered(keys: list[np.ndarray]) -> np.ndarray:
    """The number of each row's tile, of sorted rows."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def whole_tiles(df: DataFrame, place: list[str], order: list[str], run: Callable[[dict[str, np.ndarray]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Hands run the rows of whole tiles, sorted by place and order, many small ones together, a large one alone. No value is null."""
    names = df.columns
    at = [names.index(c) for c in place]

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                yield from run({c: v.to_numpy() for c, v in zip(names, pa.Table.from_batches(held).columns, strict=True)})

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in at]
            start = int(np.searchsorted(np.logical_and.reduce([k == k[-1] for k in keys]), True))  # where the last tile, which may go on, starts
            if start or held and any(held[-1].column(i)[-1].as_py() != k[0] for i, k in zip(at, keys, strict=True)):
                held += [batch.slice(0, start)] if start else []
                yield from done()
                held = []
            held.append(batch.slice(start))
        yield from done()

    return df.repartition(*place).sortWithinPartitions(*place, *order).mapInArrow(tasks, schema)


def _seen(i: str, n: str, periodic: bool, tile: int) -> Column:
    """Places and tiles of one axis at which a cell is seen: its own, and next to a tile that begins or ends beside it."""
    at, size, own = F.col(i), F.col(n), F.floor(F.col(i) / tile).cast("int")
    here = lambda v, t: F.struct(v.cast("int").alias("v"), t.cast("int").alias("t"))
    more = [F.when((at % tile == 0) & (at > 0), here(at, own - 1)), F.when((at % tile == tile - 1) & (at < size - 1), here(at, own + 1))]
    if periodic:
        more += [F.when(at == 0, here(size, F.floor((size - 1) / tile))), F.when(at == size - 1, here(F.lit(-1), F.lit(0)))]
    return F.explode(F.array_compact(F.array(here(at, own), *more)))


def with_rim(cells: DataFrame, b: Boundary, tile: int, *carry: str) -> DataFrame:
    """Cells by the tiles (tx, ty) that see them, at the place (vx, vy) seen from there; own: whether it is the cell's own tile and place."""
    i = lambda c: F.col(c).cast("int").alias(c)
    dealt = cells.select(i(STEP), i("ix"), i("iy"), i("nx"), i("ny"), *carry)
    dealt = dealt.select("*", _seen("ix", "nx", b.x, tile).alias("a")).select("*", _seen("iy", "ny", b.y, tile).alias("b"))
    own = lambda s, c: (F.col(f"{s}.v") == F.col(c)) & (F.col(f"{s}.t") == F.floor(F.col(c) / tile))
    return dealt.select(STEP, F.col("a.t").alias("tx"), F.col("b.t").alias("ty"), F.col("a.v").alias("vx"), F.col("b.v").alias("vy"), (own("a", "ix") & own("b", "iy")).alias("own"), "nx", "ny", *carry)


def neighbours(t: dict[str, np.ndarray], tile: int, steps: Iterable[tuple[int, int]]) -> tuple[np.ndarray, dict, dict]:
    """A rising number of each row of with_rim, sorted by tile and place, and by step (dx, dy) whether there is a cell there, and its row."""
    width = tile + 4
    code = (numbered([t[STEP], t["tx"], t["ty"]]) * width + (t["vx"] - t["tx"] * tile + 1)) * width + (t["vy"] - t["ty"] * tile + 1)
    there, at = {}, {}
    for dx, dy in steps:
        wanted = code + (dx * width + dy)
        at[dx, dy] = np.minimum(np.searchsorted(code, wanted), len(code) - 1)
        there[dx, dy] = code[at[dx, dy]] == wanted
    return code, there, at


def pieces(cells: DataFrame, b: Boundary, tile: int = TILE, each: bool = False) -> DataFrame:
    """Rows of FOUND: what one pass over square tiles, each with the cells round it, tells of the pieces that components fall into there.

    A piece is named after its first cell, y fastest within x; nodes of all steps are numbered on. each: the cells too."""

    def run(t: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        step, vx, vy, own, pore, nx, ny = (t[c] for c in (STEP, "vx", "vy", "own", "pore", "nx", "ny"))
        code, there, at = neighbours(t, tile, ((1, 0), (-1, 0), (0, 1), (0, -1), (1, 1)))
        sides = {d: (there[d], at[d]) for d in there}
        same = {d: there & (pore[at] == pore) for d, (there, at) in sides.items()}
        pairs = [(np.flatnonzero(k), at[k]) for d in ((1, 0), (0, 1)) for at in [sides[d][1]] for k in [same[d] & own & own[at]]]
        top = roots(len(code), *(np.concatenate(c) for c in zip(*pairs, strict=True)))
        node = vx.astype(np.int64) * ny + vy

        mine = np.flatnonzero(own)
        first, of = np.unique(top[mine], return_inverse=True)
        order, starts = np.argsort(of, kind="stable"), np.searchsorted(np.sort(of), np.arange(len(first)))
        least = lambda v: np.minimum.reduceat(v[mine][order], starts) if len(first) else v[:0]
        most = lambda v: np.maximum.reduceat(v[mine][order], starts) if len(first) else v[:0]
        total = lambda v: np.bincount(of, v[mine].astype(float), len(first))
        whole = lambda v: total(v).astype(np.int64)
        count = lambda kind, *ds: whole(sum((kind[d].astype(np.int64) for d in ds), np.zeros(len(code), np.int64)))
        other = {d: sides[d][0] & ~same[d] for d in sides}
        name = lambda k: pc.if_else(pa.array(pore[k]), "pore", "matrix")
        values = {
            "kind": np.zeros(len(first), int), STEP: step[first], "phase": name(first), "node": node[first], "ix": least(vx), "iy": least(vy), "x": total(t["x"]), "y": total(t["y"]), "nx": nx[first], "ny": ny[first],
            "n": np.bincount(of, minlength=len(first)), "x1": most(vx), "y1": most(vy), "same_x": count(same, (1, 0), (-1, 0)), "same_y": count(same, (0, 1), (0, -1)),
            "other_x": count(other, (1, 0), (-1, 0)), "other_y": count(other, (0, 1), (0, -1)), "squares": whole(same[1, 0] & same[0, 1] & same[1, 1]),
        }
        yield pa.RecordBatch.from_arrays([pa.array(values[f.name]).cast(f.type) for f in kinds], schema=kinds)
        rim = np.logical_or.reduce([same[d] & ~own[sides[d][1]] for d in ((1, 0), (-1, 0), (0, 1), (0, -1))]) & own
        k = mine if each else np.flatnonzero(rim)
        cell = {"kind": np.where(rim[k], 1, 2), STEP: step[k], "phase": name(k), "node": node[top[k]], "ix": vx[k], "iy": vy[k], "x": t["x"][k], "y": t["y"][k], "nx": nx[k], "ny": ny[k]}
        yield pa.RecordBatch.from_arrays([pa.array(cell[f.name]).cast(f.type) if f.name in cell else pa.nulls(len(k), f.type) for f in kinds], schema=kinds)

    types = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
    kinds = pa.schema([(n, types[k]) for n, k in (x.split() for x in FOUND.split(", "))])
    dealt = with_rim(cells.withColumn("pore", F.col("phase") == "pore"), b, tile, "pore", "x", "y")
    found = whole_tiles(dealt, [STEP, "tx", "ty"], ["vx", "vy"], run, FOUND)
    # what comes before a step is a row per step
    places = cells.groupBy(F.col(STEP).cast("int").alias(STEP)).agg(F.max(F.col("nx").cast("long") * F.col("ny")).alias("places"))
    bases = places.select(STEP, (F.sum("places").over(W.orderBy(STEP)) - F.col("places")).alias("base"))
    columns = [(F.col("node") + F.col("base")).alias("node") if c == "node" else F.col(c) for c in found.columns]
    return materialize(found.join(bases, STEP).select(*columns), "pieces")


def joined(parts: DataFrame, b: Boundary, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """The pieces that meet others, with their component (node, component), and of the components (component, wrap_x, wrap_y).

    Pieces of neighbouring tiles, and those that meet over a seam, are joined as a graph whose edges over a seam carry an offset of one
    period. A component wraps an axis if one of these edges doesn't fit the places that the others give its ends."""
    ends = lattice(parts.where("kind = 1"), b, "node")
    crossing = F.col("wrapped") | ((F.col("dir") == "x") & (F.col("ax") % tile == tile - 1)) | ((F.col("dir") == "y") & (F.col("ay") % tile == tile - 1))
    met = ends.where(crossing).groupBy(STEP, "phase", "dir", "ax", "ay", "wrapped").agg(F.max(F.when(F.col("end") == 0, F.col("node"))).alias("u"), F.max(F.when(F.col("end") == 1, F.col("node"))).alias("v"))
    period = lambda d: F.when((F.col("dir") == d) & F.col("wrapped"), 1).otherwise(0)
    met = met.where("u is not null and v is not null").select("u", "v", period("x").alias("ox"), period("y").alias("oy")).distinct()
    met = materialize(met, "meets")
    placed = materialize(graph.components(met), "places")

    at = lambda c, p: placed.select(F.col("node").alias(c), F.col("component").alias(f"{p}c"), F.col("ox").alias(f"{p}x"), F.col("oy").alias(f"{p}y"))
    fit = met.join(at("u", "p"), "u", "left").join(at("v", "q"), "v", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    wraps = fit.groupBy(F.coalesce("pc", "u").alias("component")).agg(F.bool_or(z("px") != F.col("ox") + z("qx")).alias("wrap_x"), F.bool_or(z("py") != F.col("oy") + z("qy")).alias("wrap_y"))
    return placed.select("node", "component"), materialize(wraps, "wraps")


def label(cells: DataFrame, b: Boundary, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Cells with the number of their component, and the components: (step_index, phase, component, label).

    Labels count components by their first cell, y fastest within x."""
    parts = pieces(cells, b, tile, each=True)
    placed, _ = joined(parts, b, tile)
    found = parts.where("kind > 0").join(placed, "node", "left")
    found = found.select(STEP, "ix", "iy", "x", "y", "phase", "nx", "ny", F.coalesce("component", "node").alias("component"))
    comps = parts.where("kind = 0").join(placed.where("node <> component"), "node", "left_anti")
    return found, ranked(comps.select(STEP, "phase", F.col("node").alias("component")), [STEP, "phase"], [F.col("component")], "label")


def component_stats(parts: DataFrame, placed: DataFrame, wraps: DataFrame, dx: float, dy: float) -> DataFrame:
    """One row per component: label, size, centroid, box, perimeters, shape factor, edges of the grid that it touches, whether
    it percolates or wraps, and its rank by area (ties by label).

    parts, placed, wraps: of pieces() and joined(). A component's open perimeter is all sides of its cells that none of its cells lies at;
    an interface side counts for both its components."""
    alone = parts.where("kind = 0").join(placed, "node", "left_anti").withColumn("component", F.col("node"))
    shared = parts.where("kind = 0").join(placed, "node")
    same = {"ix": F.min, "iy": F.min, "x1": F.max, "y1": F.max, "nx": F.max, "ny": F.max}
    values = ["ix", "iy", "x1", "y1", "nx", "ny", "x", "y", "n", "same_x", "same_y", "other_x", "other_y"]
    shared = shared.groupBy(STEP, "phase", "component").agg(*(same.get(c, F.sum)(c).alias(c) for c in values))
    each = alone.select(*shared.columns).unionByName(shared).join(wraps, "component", "left")
    n, open_ = F.col("n"), F.col("n") * (2 * dx + 2 * dy) - F.col("same_x") * F.lit(float(dy)) - F.col("same_y") * F.lit(float(dx))
    out = each.select(
        STEP, "phase", "component", n.alias("cell_count"), (F.col("x") / n).alias("centroid_x"), (F.col("y") / n).alias("centroid_y"),
        ((F.col("x1") - F.col("ix") + 1) * dx).alias("bbox_width"), ((F.col("y1") - F.col("iy") + 1) * dy).alias("bbox_height"),
        (F.col("ix") == 0).alias("touches_left"), (F.col("x1") == F.col("nx") - 1).alias("touches_right"),
        (F.col("iy") == 0).alias("touches_bottom"), (F.col("y1") == F.col("ny") - 1).alias("touches_top"),
        F.coalesce("wrap_x", F.lit(False)).alias("wrap_x"), F.coalesce("wrap_y", F.lit(False)).alias("wrap_y"),
        (F.col("other_x") * F.lit(float(dy)) + F.col("other_y") * F.lit(float(dx))).alias("interface_perimeter"), (n * F.lit(dx * dy)).alias("area"), open_.alias("perimeter_open"),
    )
    out = ranked(out, [STEP, "phase"], [F.col("component")], "label")
    out = ranked(out, [STEP, "phase"], [F.desc("area"), F.col("label")], "size_rank")
    out = out.withColumn("equiv_diameter", 2 * F.sqrt(F.col("area") / F.pi()))
    out = out.withColumn("shape_factor", F.when(F.col("perimeter_open") > 0, 4 * F.pi() * F.col("area") / (F.col("perimeter_open") * F.col("perimeter_open"))))
    out = out.withColumn("percolates_x", F.col("touches_left") & F.col("touches_right")).withColumn("percolates_y", F.col("touches_bottom") & F.col("touches_top"))
    return out.select(
        STEP, "phase", "component", "cell_count", "centroid_x", "centroid_y", "bbox_width", "bbox_height", "touches_left", "touches_right", "touches_bottom", "touches_top", "wrap_x", "wrap_y",
        "label", "interface_perimeter", "area", "equiv_diameter", "perimeter_open", "shape_factor", "percolates_x", "percolates_y", "size_rank",
    )


def labelled(cells: DataFrame, b: Boundary, tile: int = TILE) -> DataFrame:
    """Cells with their component's label."""
    found, comps = label(cells, b, tile)
    return found.join(comps.select("component", "label"), "component").select(STEP, "ix", "iy", "phase", "label")


def _both_phases(cells: DataFrame) -> DataFrame:
    """A row per step and phase, for phases without cells too."""
    n = cells.groupBy(STEP).agg(F.count_if(F.col("phase") == "pore").alias("p"), F.count_if(F.col("phase") == "matrix").alias("m"), F.max("nx").alias("nx"), F.max("ny").alias("ny"))
    return n.select(STEP, "nx", "ny", F.explode(F.array(F.struct(F.lit("pore").alias("phase"), F.col("p").alias("n0")), F.struct(F.lit("matrix").alias("phase"), F.col("m").alias("n0")))).alias("s")).select(STEP, "nx", "ny", "s.phase", "s.n0")


def topology(parts: DataFrame, placed: DataFrame, b: Boundary) -> DataFrame:
    """Per step and phase: beta0, beta1, beta2 and chi of the cell complex of cells, shared sides and full squares, all of them counted on the
    pieces (parts, placed: of pieces() and joined()); a piece that isn't its component's first adds none."""
    moved = placed.where("node <> component").select("node", F.lit(1).alias("moved"))
    of = parts.where("kind = 0").join(moved, "node", "left")
    sums = lambda p: F.struct(*(F.coalesce(F.sum(F.when(F.col("phase") == p, v)), F.lit(0)).cast("long").alias(c) for c, v in counted.items()), F.lit(p).alias("phase"))
    counted = {"n0": F.col("n"), "sides": F.col("same_x") + F.col("same_y"), "n2": F.col("squares"), "beta0": 1 - F.coalesce("moved", F.lit(0))}
    out = of.groupBy(STEP).agg(F.max("nx").alias("nx"), F.max("ny").alias("ny"), F.array(sums("pore"), sums("matrix")).alias("s")).select(STEP, "nx", "ny", F.explode("s").alias("s")).select(STEP, "nx", "ny", "s.*")
    out = out.withColumn("n1", (F.col("sides") / 2).cast("long"))
    beta2 = F.when(F.lit(b.x and b.y) & (F.col("n0") == F.col("nx") * F.col("ny")), 1).otherwise(0)
    chi = F.when(F.col("n0") > 0, F.col("n0") - F.col("n1") + F.col("n2")).otherwise(0)
    out = out.withColumn("beta2", beta2).withColumn("chi", chi)
    return out.select(STEP, "phase", "beta0", F.greatest(F.lit(0), F.col("beta0") + F.col("beta2") - F.col("chi")).alias("beta1"), "beta2", "chi", "n0", "n1", "n2")


def connects(axis: str, b: Boundary) -> Column:
    """Whether a component connects along an axis: it wraps a periodic one, or touches both ends of an open one."""
    return F.col(f"wrap_{axis}") if getattr(b, axis) else F.col(f"percolates_{axis}")


def connectivity(cells: DataFrame, b: Boundary, components: DataFrame, dx: float, dy: float) -> DataFrame:
    """Per step, phase and axis: the number and areas of the components that connect along it, whether any does, and the older
    flags: percolates (null on a periodic axis) and wraps (false on an open one). connected() has the components."""
    rows = []
    for axis in "xy":
        hit = connects(axis, b)
        rows.append(
            components.groupBy(STEP, "phase").agg(
                F.lit(axis).alias("axis"), F.count_if(hit).alias("component_count"),
                F.sum(F.when(hit, F.col("area")).otherwise(0.0)).alias("connected_area"), F.max(F.when(hit, F.col("area")).otherwise(0.0)).alias("largest_connected_area"),
                (F.lit(None).cast("boolean") if getattr(b, axis) else F.bool_or(f"percolates_{axis}")).alias("percolates"),
                (F.bool_or(f"wrap_{axis}") if getattr(b, axis) else F.lit(False)).alias("wraps"),
            )
        )
    axes = F.explode(F.array(F.lit("x"), F.lit("y"))).alias("axis")
    out = _both_phases(cells).select(STEP, "phase", "n0", axes).join(rows[0].unionByName(rows[1]), [STEP, "phase", "axis"], "left")
    out = out.na.fill(0, ["component_count"]).na.fill(0.0, ["connected_area", "largest_connected_area"])
    share = safe_div_or_zero(F.col("connected_area"), F.col("n0") * F.lit(dx * dy))
    periodic = (F.lit(b.x) & (F.col("axis") == "x")) | (F.lit(b.y) & (F.col("axis") == "y"))
    return out.select(
        STEP, "phase", "axis", "component_count", "connected_area", "largest_connected_area",
        share.alias("connected_fraction"), (F.col("component_count") > 0).alias("is_connected"),
        F.when(~periodic, F.coalesce("percolates", F.lit(False))).alias("percolates"), F.coalesce("wraps", F.lit(False)).alias("wraps"),
    )


def connected(components: DataFrame, b: Boundary) -> DataFrame:
    """The components that connect along an axis: a row (step_index, phase, axis, label) each, however many there are."""
    hits = F.array(*(F.when(connects(a, b), F.lit(a)) for a in "xy"))
    return components.select(STEP, "phase", F.explode(F.array_compact(hits)).alias("axis"), "label")


def size_rank_grid(cells: DataFrame, b: Boundary, components: DataFrame, phase: str = "pore", tile: int = TILE) -> DataFrame:
    """Each cell with the rank of its component by size, 0 in the other phase."""
    lab = labelled(cells, b, tile).join(components.select(STEP, "phase", "label", "size_rank"), [STEP, "phase", "label"])
    return lab.select(STEP, "ix", "iy", F.when(F.col("phase") == phase, F.col("size_rank")).otherwise(0).alias("rank"))


def connectivity_grid(cells: DataFrame, b: Boundary, components: DataFrame, axis: str, phase: str = "pore", tile: int = TILE) -> DataFrame:
    """Each cell's class: 0 in the other phase, 2 in a component that connects along the axis, else 1."""
    hit = components.select(STEP, "phase", "label", connects(axis, b).alias("hit"))
    lab = labelled(cells, b, tile).join(hit, [STEP, "phase", "label"])
    return lab.select(STEP, "ix", "iy", F.when(F.col("phase") != phase, 0).when(F.col("hit"), 2).otherwise(1).alias("class"))
