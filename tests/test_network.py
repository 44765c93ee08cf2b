"""Two-phase grids: the analytic cases, and random grids against brute force."""

import itertools
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainflow.functions.errors import AnalysisError
from grainflow.operators import grid, morphology, smoothing
from grainflow.operators.grid import Boundary
from grainflow.plans import api
from grainflow.plans.network import Network, Options, evolution

CASES = {
    "ring": "222/202/222", "diag": "02/20", "wrapx_merge": "020", "wrapy_merge": "0/2/0", "wrapx_true": "000", "wrapy_true": "0/0/0", "torus": "000/000/000",
    "all_matrix": "22/22", "profile_center": "002/002/002", "size_stats": "0022/2222/2220", "label_rank": "022/222/200",
    "branch": "22022/22022/00000/22022/22022", "neck": "2220222/2220222/2222222/2220222/2220222", "fragment": "202/000/202",
}
EVOLUTION = ("020/222/222", "000/222/222", "000/020/000", "020/000/020")


def rows_of(text, step=1):
    return [(step, float(x), float(y), float(c)) for y, line in enumerate(text.split("/")) for x, c in enumerate(line) if c != "."]


def frame(spark, rows):
    return spark.createDataFrame(rows, "step_index int, x double, y double, ncount double")


def net(spark, case, boundary="open", **o):
    return Network(frame(spark, rows_of(CASES.get(case, case))), Options(1.0, boundary, **o))


def by_phase(df, phase="pore"):
    return df.where(F.col("phase") == phase).first()


def test_ring(spark):
    n = net(spark, "ring", profile_bins=1, position_bins=1)
    g = n.globals.first()
    assert (g.porosity, g.interface_length, g.specific_interface) == (1 / 9, 4, 4 / 9)
    t = {r.phase: (r.beta0, r.beta1, r.chi) for r in n.topology.collect()}
    assert t == {"pore": (1, 0, 1), "matrix": (1, 1, 0)}
    c = {(r.phase, r.axis): r.is_connected for r in n.connectivity.collect()}
    assert c == {("pore", "x"): False, ("pore", "y"): False, ("matrix", "x"): True, ("matrix", "y"): True}
    p = n.profile("x").first()
    assert (p.porosity, p.specific_interface, p.is_connected, p.connected_fraction) == (1 / 9, 4 / 9, False, 0)
    assert math.isclose(by_phase(n.components).equiv_diameter, 2 * math.sqrt(1 / math.pi)) and by_phase(n.positions("x"))["count"] == 1


@pytest.mark.parametrize(
    "case, boundary, beta0, beta1, chi, wraps",
    [
        ("diag", "open", 2, 0, 2, ""), ("wrapx_merge", "open", 2, 0, 2, ""), ("wrapx_merge", "periodic-x", 1, 0, 1, ""), ("wrapy_merge", "periodic-y", 1, 0, 1, ""),
        ("wrapx_true", "periodic-x", 1, 1, 0, "x"), ("wrapy_true", "periodic-y", 1, 1, 0, "y"), ("torus", "periodic-xy", 1, 2, 0, "xy"), ("all_matrix", "open", 0, 0, 0, ""),
    ],
)
def test_topology_and_wraps(spark, case, boundary, beta0, beta1, chi, wraps):
    n = net(spark, case, boundary)
    t = by_phase(n.topology)
    assert (t.beta0, t.beta1, t.chi, t.beta2) == (beta0, beta1, chi, int(case == "torus"))
    hit = {r.axis for r in n.connectivity.where("phase = 'pore'").collect() if r.wraps}
    assert hit == set(wraps)
    flags = {(r.phase, r.axis): r.percolates for r in n.connectivity.collect()}
    b = Boundary.of(boundary)
    assert all((flags[p, a] is None) == getattr(b, a) for p in ("pore", "matrix") for a in "xy")


def test_profiles(spark):
    n = net(spark, "profile_center", profile_bins=3)
    p = n.profile("x").orderBy("bin_id").collect()
    assert [r.is_connected for r in p] == [False, True, False] and [r.connected_area for r in p] == [r.component_area for r in p] == [0, 6, 0]
    assert [r.connected_fraction for r in p] == [0, 1, 0]
    cut = net(spark, "ring", profile_bins=1, profile_range_x=(0.5, 1.5))
    r = cut.profile("x").first()
    assert (r.edge_lo, r.edge_hi, r.porosity, cut.globals.first().porosity) == (0.5, 1.5, 1 / 3, 1 / 9)
    seam = [net(spark, c, "periodic-x", profile_bins=1).profile("y").first() for c in ("wrapx_merge", "wrapx_true")]
    assert [(s.is_connected, s.connected_fraction) for s in seam] == [(False, 0), (True, 1)]
    pos = net(spark, "wrapx_merge", position_bins=2, position_range_x=(1.5, 2.5))
    assert pos.positions("x").where("phase = 'pore'").agg(F.sum("count")).first()[0] == 1 and pos.components.where("phase = 'pore'").count() == 2


def test_sizes(spark):
    n = net(spark, "size_stats", mean_m=2, mean_n=1)
    d1, d2 = 2 * math.sqrt(1 / math.pi), 2 * math.sqrt(2 / math.pi)
    s = by_phase(n.sizes)
    assert math.isclose(s.mean_diameter, (d1**2 + d2**2) / (d1 + d2)) and math.isclose(s.area_weighted_diameter, (2 * d2 + d1) / 3)
    assert n.histogram.where("phase = 'pore'").agg(F.sum("count")).first()[0] == 2
    ranks = {r.label: r.size_rank for r in net(spark, "label_rank").components.where("phase = 'pore'").collect()}
    assert ranks == {1: 2, 2: 1}
    f = net(spark, "fragment")
    assert by_phase(f.topology, "matrix").beta0 == 4 and by_phase(f.sizes, "matrix").largest_fraction == 0.25


def test_steps_of_any_number(spark):
    rows = rows_of("022/000", 8_388_608) + rows_of("00/20", 2_000_000_000)
    n = Network(frame(spark, rows), Options(1.0, "open", dx=1, dy=1))
    got = sorted((r.step_index, r.phase, r.label, r.cell_count) for r in n.components.collect())
    assert got == [(8_388_608, "matrix", 1, 2), (8_388_608, "pore", 1, 4), (2_000_000_000, "matrix", 1, 1), (2_000_000_000, "pore", 1, 3)]


def test_skeleton_and_thickness(spark):
    n = net(spark, "branch")
    s = n.skeleton_stats("pore").first()
    assert (s.branch_points, s.end_points) == (1, 4) and s.skeleton_length > 0
    e = net(spark, "all_matrix").skeleton_stats("pore").first()
    assert (e.skeleton_length, e.branch_points, e.branch_density) == (0, 0, 0)
    t = net(spark, "neck").thickness.first()
    assert t["min"] == 2 and t["mean"] > 2 and t.p5 >= 2
    assert net(spark, "torus").thickness.first().sample_count == 0


def test_evolution(spark):
    rows = [r for k, text in enumerate(EVOLUTION, 1) for r in rows_of(text, k)]
    out = evolution(frame(spark, rows), Options(1.0)).orderBy("step_index").collect()
    assert [r.pore_beta0 for r in out] == [2, 1, 1, 1] and [r.pore_beta1 for r in out] == [0, 0, 1, 0] and [r.matrix_beta0 for r in out] == [1, 1, 1, 2]
    assert [r.pore_largest_fraction for r in out] == [0.5, 1, 1, 1]
    assert [r.d_pore_beta0 for r in out] == [None, -1, 0, 0] and [r.d_matrix_beta0 for r in out] == [None, 0, 0, 1]


def test_facade_on_files(spark, tmp_path):
    text = "#\n#\n# Chunk Coord1 Coord2 Ncount\n" + "".join(
        f"{100 * k} 9 18\n" + "".join(f"{i} {x:g} {y:g} {n:g}\n" for i, (_, x, y, n) in enumerate(rows_of(t), 1)) for k, t in enumerate(EVOLUTION, 1)
    )
    (tmp_path / "bin2d_dx_1_dy_1_Lz_1.txt").write_text(text)
    out = api.analyze(spark, "network2d", str(tmp_path), threshold=1, timestep=300)
    s = out["stats"].first()
    assert (s.topology.pore.beta1, s.meta.nx, s.meta.missing_cells, s.size.pore.component_count) == (1, 3, 0, 1) and s.network.pore is not None
    out["stats"].transform(api.as_text).write.text(f"{tmp_path}/text")
    said = [r.value for r in spark.read.text(f"{tmp_path}/text").collect()]
    assert {"step_index = 3", "topology.pore.beta1 = 1", "meta.boundary = open"} <= set(said) and all(" = " in x for x in said if x)
    path = str(tmp_path / "bin2d_dx_1_dy_1_Lz_1.txt")
    assert [r.timestep for r in api.evolve(spark, path, "timestep", (100, 400), 2, threshold=1).orderBy("step_index").collect()] == [100, 300]
    with pytest.raises(AnalysisError, match="MissingThresholdN"):
        api.analyze(spark, "network2d", str(tmp_path), index=1)
    scaled = api.analyze(spark, "network2d", str(tmp_path), threshold=1, index=1, coord_scale=2.0)
    assert scaled["global"].first().valid_area == 36 and scaled["network"].o.dx == 2


def test_checks(spark):
    with pytest.raises(AnalysisError, match="DuplicateGridCell"):
        grid.check(frame(spark, rows_of("00") + rows_of("0")))
    with pytest.raises(AnalysisError, match="NonFiniteInput"):
        grid.check(frame(spark, [(1, float("nan"), 0.0, 1.0)]))
    with pytest.raises(AnalysisError, match="IrregularGrid"):
        grid.spacing(frame(spark, [(1, x, 0.0, 1.0) for x in (0.0, 1.0, 5.0, 6.0)]), "x")
    with pytest.raises(AnalysisError, match="NeedSpacing"):
        grid.spacing(frame(spark, rows_of("0")), "x")
    assert grid.spacing(frame(spark, rows_of("000")), "x", path="bin2d_dx_0.5.txt", scale=2) == (1.0, "filename")
    with pytest.raises(AnalysisError, match="BadBoundary"):
        Boundary.of("round")


def brute(text, b):
    """Components of a grid with winding, perimeters, and the counts of its complex, by walking it."""
    lines = text.split("/")
    ny, nx = len(lines), len(lines[0])
    at = {(x, y): int(lines[y][x] != "0") for y in range(ny) for x in range(nx) if lines[y][x] != "."}

    def step(x, y, dx, dy):
        x, y, ox, oy = x + dx, y + dy, 0, 0
        if not 0 <= x < nx:
            if not b.x:
                return None
            ox, x = (1 if x >= nx else -1), x % nx
        if not 0 <= y < ny:
            if not b.y:
                return None
            oy, y = (1 if y >= ny else -1), y % ny
        return x, y, ox, oy

    seen, comps = {}, []
    for x, y in sorted(at):
        if (x, y) in seen:
            continue
        seen[x, y] = (0, 0)
        cells, todo, wrap = [(x, y)], [(x, y)], [False, False]
        sides = face = 0
        while todo:
            cx, cy = todo.pop()
            for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)):
                s = step(cx, cy, dx, dy)
                if s is None or s[:2] not in at:
                    sides += 1
                elif at[s[:2]] != at[cx, cy]:
                    sides, face = sides + 1, face + 1
                else:
                    o = (seen[cx, cy][0] + s[2], seen[cx, cy][1] + s[3])
                    if s[:2] in seen:
                        wrap = [w or p != q for w, p, q in zip(wrap, o, seen[s[:2]], strict=True)]
                    else:
                        seen[s[:2]] = o
                        cells.append(s[:2])
                        todo.append(s[:2])
        comps.append((("pore", "matrix")[at[x, y]], len(cells), *wrap, float(sides), float(face)))
    return sorted(comps)


@pytest.mark.parametrize("boundary", ["open", "periodic-x", "periodic-y", "periodic-xy"])
def test_random_grids(spark, boundary):
    rng = np.random.default_rng(11)
    texts = ["/".join("".join(rng.choice(list("02."), nx, p=(0.55, 0.4, 0.05))) for _ in range(ny)) for nx, ny in ((9, 8), (7, 1), (1, 6), (2, 5), (11, 12))]
    texts = [t for t in texts if all(any(line[x] != "." for line in t.split("/")) for x in range(len(t.split("/")[0]))) and all(set(line) != {"."} for line in t.split("/"))]
    rows = [r for k, t in enumerate(texts, 1) for r in rows_of(t, k)]
    n = Network(frame(spark, rows), Options(1.0, boundary, tile=3))
    got = defaultdict(list)
    for r in n.components.collect():
        got[r.step_index].append((r.phase, r.cell_count, r.wrap_x, r.wrap_y, r.perimeter_open, r.interface_perimeter))
    assert len(texts) >= 3
    for k, t in enumerate(texts, 1):
        assert sorted(got[k]) == brute(t, n.b), (k, t)


@pytest.mark.parametrize("boundary", ["open", "periodic-xy"])
def test_distances_and_tiled_thinning(spark, boundary):
    rng = np.random.default_rng(3)
    mask = rng.random((23, 19)) < 0.8
    text = "/".join("".join("2" if mask[x, y] else "0" for x in range(23)) for y in range(19))
    n = net(spark, text, boundary)
    got = {(r.ix, r.iy): r.distance for r in morphology.distances(n.cells, n.b, "matrix").collect()}
    away = np.argwhere(~mask)
    for x, y in np.argwhere(mask):
        d = np.abs(away - (x, y))
        if boundary != "open":
            d = np.minimum(d, np.array(mask.shape) - d)
        assert math.isclose(got[x, y], math.sqrt((d**2).sum(1).min()))
    # the same as on the whole grid at once: where it wraps, on one that is repeated often enough for its ends not to matter
    times = 7 if boundary != "open" else 1
    whole = np.tile(mask, (times, times))
    fx, fy = (morphology.fields(np.arange(n * times), n, boundary != "open") for n in mask.shape)
    want = morphology.thin(whole, 8, fx, fy)[23 * (times // 2) :][:23, 19 * (times // 2) :][:, :19]
    tiled = morphology.skeleton(n.cells, n.b, "matrix", tile=8, rounds=2)
    assert {(r.ix, r.iy) for r in tiled.collect()} == {tuple(map(int, p)) for p in np.argwhere(want)}


def pieces(mask, wraps, steps):
    """The number of connected pieces."""
    left, n = {tuple(map(int, p)) for p in np.argwhere(mask)}, 0
    while left:
        n, todo = n + 1, [left.pop()]
        while todo:
            x, y = todo.pop()
            for dx, dy in steps:
                q = (x + dx, y + dy)
                q = (q[0] % mask.shape[0] if wraps[0] else q[0], q[1] % mask.shape[1] if wraps[1] else q[1])
                if q in left:
                    left.remove(q)
                    todo.append(q)
    return n


FOUR = ((0, 1), (1, 0), (0, -1), (-1, 0))


@pytest.mark.parametrize("boundary", ["open", "periodic-x", "periodic-y", "periodic-xy"])
def test_skeletons_keep_components_and_holes(spark, boundary):
    rng = np.random.default_rng(5)
    wraps = (boundary in ("periodic-x", "periodic-xy"), boundary in ("periodic-y", "periodic-xy"))
    masks = [rng.random((rng.integers(3, 14), rng.integers(3, 14))) < rng.choice([0.5, 0.7, 0.9]) for _ in range(12)]
    masks += [np.ones((2, 2), bool), np.ones((5, 6), bool), np.abs(np.subtract.outer(range(10), range(10))) < 2]
    rows = [r for k, m in enumerate(masks) for r in rows_of("/".join("".join("2" if c else "0" for c in m[:, y]) for y in range(m.shape[1])), k)]
    n = Network(frame(spark, rows), Options(1.0, boundary, dx=1, dy=1))
    left = [np.zeros_like(m) for m in masks]
    for r in n.skeleton("matrix").collect():
        left[r.step_index][r.ix, r.iy] = True
    counts = {r.step_index: (r.components, r.holes) for r in morphology.closed_topology(n.cells.where("phase = 'matrix'"), n.b).collect()}
    after = {r.step_index: (r.components, r.holes) for r in morphology.closed_topology(n.skeleton("matrix"), n.b).collect()}
    holes = lambda m: pieces(np.pad(~m, [(0 if w else 1,) * 2 for w in wraps], constant_values=True), wraps, FOUR)
    for k, (m, s) in enumerate(zip(masks, left, strict=True)):
        assert not (s & ~m).any()
        eight = pieces(m, wraps, morphology.RING)
        assert pieces(s, wraps, morphology.RING) == eight
        if m.any() and min(m.shape) > 2:
            assert holes(s) == holes(m)
            assert counts[k] == after[k] and counts[k][0] == eight
            assert boundary != "open" or counts[k][1] == holes(m) - 1
    assert boundary != "open" or left[12].sum() == 2 and left[14].sum() >= 8  # a square keeps a piece, a diagonal band its length
    # nothing that could go is left
    assert all((morphology.thin(s, 3, *(morphology.fields(np.arange(i), i, False) for i in s.shape)) == s).all() for s in left if boundary == "open")


def test_periodic_field(spark):
    a, b = (sorted(map(tuple, smoothing.periodic_field(spark, 28, 24).collect())) for _ in range(2))
    assert a == b and len(a) == 28 * 24 and {r[3] for r in a} == {0.0, 2.0}


def test_stream_of_cells(spark, tmp_path):
    from grainflow.streaming.phases import phase_counts

    rows = list(itertools.chain(rows_of("020"), rows_of("22", 2)))
    frame(spark, rows).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("step_index int, x double, y double, ncount double").parquet(str(tmp_path / "in"))
    q = phase_counts(stream, 1.0).writeStream.outputMode("complete").format("memory").queryName("phase_counts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.step_index, r.valid_cells, r.pore_cells) for r in spark.table("phase_counts").collect()) == [(1, 3, 2), (2, 2, 0)]


def test_evolution_of_a_stream(spark, tmp_path):
    from grainflow.streaming import evolution as streamed

    steps = [rows_of(text, k) for k, text in enumerate(EVOLUTION, 1)]
    # steps in another order, some in two parts
    parts = [steps[2][:4], steps[0] + steps[2][4:], steps[3][:1], steps[1] + steps[3][1:]]
    o, schema = Options(1.0, dx=1, dy=1), "step_index int, x double, y double, ncount double, num_chunks int"
    for i, rows in enumerate(parts):
        spark.createDataFrame([(*r, 9) for r in rows], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        q = streamed.follow(stream, f"{tmp_path}/out", o).option("checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).start()
        q.awaitTermination()  # each time it starts anew
        if i == 1:
            assert [r.step_index for r in streamed.series(spark, f"{tmp_path}/out").orderBy("step_index").collect()] == [1, 3]
    want = evolution(frame(spark, [r for s in steps for r in s]), o)
    assert sorted(map(tuple, streamed.series(spark, f"{tmp_path}/out").select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def random_steps(spark, seed=3):
    rng = np.random.default_rng(seed)
    return frame(spark, [(s, float(x), float(y), float(rng.integers(0, 3))) for s in range(1, 4) for x in range(11) for y in range(5) if rng.random() < 0.9])


@pytest.fixture
def joined_rows(monkeypatch):
    """The rows that are exploded to lattice ends, and the edges that a graph is made of."""
    seen = {"lattice": 0, "graph": 0}
    lattice, components = grid.lattice, grid.graph.components
    monkeypatch.setattr(grid, "lattice", lambda df, *a: (seen.update(lattice=seen["lattice"] + df.count()), lattice(df, *a))[1])
    monkeypatch.setattr(grid.graph, "components", lambda df: (seen.update(graph=seen["graph"] + df.count()), components(df))[1])
    return seen


def test_components_inside_a_tile_are_not_joined(spark, joined_rows):
    got = Network(random_steps(spark), Options(1.0)).components
    assert joined_rows == {"lattice": 0, "graph": 0}
    same = Network(random_steps(spark), Options(1.0, tile=3)).components.drop("component")
    assert joined_rows["graph"] > 0 and got.drop("component").exceptAll(same).count() == 0 == same.exceptAll(got.drop("component")).count()


def test_topology_is_counted_in_tiles(spark, joined_rows):
    n = Network(random_steps(spark), Options(1.0, "periodic-y"))
    got = n.topology.collect()
    # only cells at the seam, two lines of eleven in each step, may be sent on
    assert joined_rows["lattice"] <= 3 * 2 * 11
    want = Network(random_steps(spark), Options(1.0, "periodic-y", tile=2)).topology.collect()
    assert sorted(got) == sorted(want) and len(got) == 6


def test_interfaces_are_counted_in_tiles(spark, joined_rows):
    n = Network(random_steps(spark), Options(1.0, "periodic-x"))
    got = {r.step_index: r.interface_length for r in n.globals.collect()}
    assert joined_rows["lattice"] == 0
    assert got == {r.step_index: r.n for r in grid.edges(n.cells, n.b).where("n_pore = 1").groupBy("step_index").agg(F.count("*").alias("n")).collect()}


def test_closed_topology_inside_a_tile_makes_no_graph(spark, joined_rows):
    n = Network(random_steps(spark), Options(1.0))
    cells = n.cells.where("phase = 'matrix'")
    got = sorted(map(tuple, morphology.closed_topology(cells, n.b).collect()))
    assert joined_rows["graph"] == 0
    assert got == sorted(map(tuple, morphology.closed_topology(cells, n.b, tile=3).collect())) and joined_rows["graph"] > 0
