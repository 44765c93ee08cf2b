"""Clusters, velocity and scalar functions on small tables."""

import math
import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from grainflow.functions import binning, scalars
from grainflow.functions.errors import AnalysisError
from grainflow.functions.tables import materialize
from grainflow.operators import cluster, gridding, smoothing, velocity


@pytest.fixture
def five(spark):
    rows = [(1, i + 1, float(n), float(i), -float(i)) for i, n in enumerate((3, 5, 7, 2, 4))]
    return spark.createDataFrame(rows, "step_index int, row_id int, Ncount double, c_x double, vx double")


def test_diameters_and_statistics(five):
    o = cluster.Options(dx=0.5)
    d = cluster.diameters(five, o)
    x = [r.diameter for r in d.orderBy("row_id").collect()]
    assert np.allclose(x, [0.9772050238, 1.261566261, 1.4927053304, 0.7978845608, 1.1283791671])
    s, f = cluster.stats(d, o).first(), cluster.fits(d).first()
    assert np.allclose([s["mean"], s["std"], s["median"], f.mu, f.sigma, f.gamma_n], [1.131548, 0.265755, 1.128379, 0.100975, 0.239574, 18.129415], atol=1e-5)
    cut = cluster.Options(dx=0.5, diameter_range=(1.35, 0.95), mean_m=2, mean_n=1)
    assert abs(cluster.stats(cluster.diameters(five, cut), cut).first()["mean"] - 1.134407) < 1e-6
    three = [r.diameter for r in cluster.diameters(five, cluster.Options(dx=0.5, dim=3)).orderBy("row_id").collect()]
    assert np.allclose(three, [0.8947002289, 1.0607844179, 1.1866877983, 0.7815926418, 0.9847450218])
    assert cluster.diameters(five, cluster.Options(ranges={"c_x": (3, 1), "c_z": (9, 9)})).count() == 3


def test_histograms(five):
    d = cluster.diameters(five, cluster.Options(dx=0.5))
    h = cluster.histogram(d, ["step_index"], size=0.1).orderBy("bin_id").collect()
    assert all(abs(r.edge_hi - r.edge_lo - 0.1) < 1e-12 for r in h) and sum(r["count"] for r in h) == 5 and h[-1].cum_count == 5
    n = cluster.histogram(d, ["step_index"], bins=4).orderBy("bin_id").collect()
    x = [r.diameter for r in d.collect()]
    assert [r["count"] for r in n] == list(np.histogram(x, np.linspace(min(x), max(x), 5))[0])
    one = cluster.histogram(d.limit(1), ["step_index"], bins=3).collect()
    assert len(one) == 3 and sum(r["count"] for r in one) == 1
    assert cluster.histogram(d.where("false"), ["step_index"]).count() == 0
    m = cluster.binned_mean(d, "c_x", 2).orderBy("bin_id").collect()
    assert [r["count"] for r in m] == [2, 3]
    flat = cluster.binned_mean(d.withColumn("c_x", F.lit(1.0)), "c_x").collect()
    assert len(flat) == 1 and flat[0].edge_hi - flat[0].edge_lo == 1
    c = cluster.cdf(d.union(d.limit(1)), ["step_index"]).orderBy("rank").collect()
    assert [r["rank"] for r in c] == [1, 2, 3, 4, 5, 6] and c[0].cdf_down == 1.0 and c[-1].cdf == 1.0
    curve = cluster.fit_curves(d).orderBy("i").collect()
    assert len(curve) == 300 and all(r.lognormal > 0 and r.gamma > 0 for r in curve)
    assert all(r.lognormal == 0 and r.gamma == 0 for r in cluster.fit_curves(d.limit(1)).collect())


def test_options_are_checked():
    for bad, code in (({"dim": 4}, "BadDim"), ({"mean_m": 1, "mean_n": 1}, "BadMeanPower"), ({"bin_size": -1}, "BadHistogramBinSize"), ({"ranges": {"vx": (1, 2, 3)}}, "BadRange")):
        with pytest.raises(AnalysisError) as e:
            cluster.Options(**bad)
        assert e.value.code == code


def test_scalars(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 2.0), (0.0, 0.0), (1.0, float("inf")), (None, 1.0)], "a double, b double")
    a, b = F.col("a"), F.col("b")
    assert [r[0] for r in df.select(scalars.safe_div(a, b)).collect()] == [None, 0.5, None, None, None]
    assert [r[0] for r in df.select(scalars.safe_div_or_zero(a, b)).collect()] == [None, 0.5, 0.0, None, None]
    z = spark.createDataFrame([(x,) for x in (0.1, 0.5, 1.0, 2.5, 30.0, 171.0)], "z double")
    assert all(math.isclose(r.g, math.lgamma(r.z), rel_tol=1e-10, abs_tol=1e-10) for r in z.select("z", scalars.log_gamma(F.col("z")).alias("g")).collect())


def test_bins_are_closed_above_only_at_the_end(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.5, 1.0, 2.0, 2.0 + 1e-13, 2.1)], "x double")
    e = F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0))
    assert [r[0] for r in df.select(binning.assign(F.col("x"), e)).collect()] == [None, 1, 1, 2, 2, None, None]
    assert [r[0] for r in df.select(binning.assign(F.col("x"), e, tolerant=True)).collect()] == [None, 1, 1, 2, 2, 2, None]


def test_velocity(spark):
    rows = [(1, i + 1, float(i), m1, m2, 99.0) for i, (m1, m2) in enumerate(zip((0.4, 0.5, 0.6, 0.7, 0.8), (0.2, 0.3, 0.4, 0.5, 0.6), strict=True))]
    rows += [(2, i + 1, 0.0, 0.0, m2, 0.0) for i, m2 in enumerate((0.3, 0.4, 0.5))]
    df = spark.createDataFrame(rows, "step_index int, row_id int, Chunk double, mass1ArealDensity double, mass2ArealDensity double, massArealDensity double")
    c = velocity.cumulative(df)
    one = c.where("step_index = 1").orderBy("row_id").collect()
    assert np.allclose([r.mass1ArealDensity for r in one], [3.0, 2.6, 2.1, 1.5, 0.8]) and np.allclose([r.massArealDensity for r in one], [5.0, 4.4, 3.6, 2.6, 1.4])
    assert np.allclose([r.mass2ArealDensity for r in c.where("step_index = 2").orderBy("row_id").collect()], [1.2, 0.9, 0.5])
    shown = {r.step_index: r.plotted for r in velocity.plotted(c, c.columns[3:]).collect()}
    assert len(shown[1]) == 3 and shown[2] == ["massArealDensity"]
    assert velocity.density_columns(["Chunk", "aArealDensity"], ["nope"]) == []
    with pytest.raises(AnalysisError, match="NoDensityCols"):
        velocity.density_columns(["Chunk"])


def test_smoothing(spark):
    rows = [(1, i, v) for i, v in enumerate([1.0, None, 3.0, 10.0, None])]
    df = spark.createDataFrame(rows, "key int, x int, v double")
    w = dict(smoothing.weights(1.0))
    got = [r.smooth for r in smoothing.smooth_1d(df, "key", "x", "v", 1.0).orderBy("x").collect()]
    known = {0: 1.0, 2: 3.0, 3: 10.0}
    want = [sum(w.get(j - i, 0) * v for j, v in known.items()) / sum(w.get(j - i, 0) for j in known) if i in known else None for i in range(5)]
    assert all(g is None if x is None else math.isclose(g, x) for g, x in zip(got, want, strict=True))
    assert [r.smooth for r in smoothing.smooth_1d(df, "key", "x", "v", 0).orderBy("x").collect()] == [1, None, 3, 10, None]
    assert [r.filled for r in smoothing.fill(df, "key", "x", "v").orderBy("x").collect()] == [1, 2, 3, 10, 17]
    assert [r.filled for r in smoothing.fill(df, "key", "x", "v", "omit").orderBy("x").collect()] == [1, None, 3, 10, None]
    grid = spark.createDataFrame([(1, 0, 0, 1.0), (1, 1, 0, 5.0)], "key int, ix int, iy int, v double")
    two = [r.smooth for r in smoothing.smooth_2d(grid, "key", "ix", "iy", "v", 1.0).orderBy("ix").collect()]
    assert math.isclose(two[0], (w[0] * 1 + w[1] * 5) / (w[0] + w[1]))


def test_fixed_width_bins_hold_every_value(spark):
    rng = np.random.default_rng(1)
    triples = [(a / 10, b / 10, w / 10) for a in range(0, 12) for b in range(a + 1, 24, 2) for w in (1, 2, 3, 7)]
    triples += [(float(x), float(x + y), float(w)) for x, y, w in zip(rng.normal(size=60), rng.uniform(0.1, 3, 60), rng.uniform(0.05, 0.7, 60), strict=True)]
    for w in sorted({t[2] for t in triples[:-60]}):
        some = [(i, lo, hi) for i, (lo, hi, x) in enumerate(triples) if x == w]
        df = spark.createDataFrame(some, "i int, lo double, hi double").withColumn("edges", binning.width_edges(F.col("lo"), F.col("hi"), w))
        lost = df.where(binning.assign(F.col("hi"), F.col("edges")).isNull() | binning.assign(F.col("lo"), F.col("edges")).isNull())
        assert lost.count() == 0
        for r in df.collect():
            steps = np.diff(r.edges)
            assert np.allclose(steps, w) and r.edges[0] == r.lo and r.edges[-1] >= r.hi and r.edges[-2] < r.hi
    made = spark.range(1).select(*(binning.width_edges(F.lit(lo), F.lit(hi), w).alias(f"e{i}") for i, (lo, hi, w) in enumerate(triples[-60:]))).first()
    for e, (lo, hi, w) in zip(made, triples[-60:], strict=True):
        assert len(e) == math.ceil((hi - lo) / w - 1e-9) + 1 and e[-1] >= hi > e[-2]


def test_a_range_of_a_missing_column_is_told(five):
    with pytest.warns(UserWarning, match="c_z"):
        assert cluster.diameters(five, cluster.Options(ranges={"c_z": (9, 9)})).count() == 5


def test_cdf_of_many_ties(spark):
    rows = [(1, float(x)) for x in [3] * 10_000 + [1, 2, 2, 9]]
    c = cluster.cdf(spark.createDataFrame(rows, "step_index int, diameter double"), ["step_index"])
    assert [r["rank"] for r in c.orderBy("rank").select("rank").collect()] == list(range(1, len(rows) + 1))
    assert c.where("x = 3").agg(F.min("rank"), F.max("rank")).first()[:] == (4, 10_003)


def test_smoothing_of_a_grid_equals_the_double_sum(spark):
    rng = np.random.default_rng(4)
    cells = {(int(x), int(y)): (None if rng.random() < 0.3 else float(rng.normal())) for x in range(9) for y in range(7) if rng.random() < 0.8}
    df = spark.createDataFrame([(1, x, y, v) for (x, y), v in cells.items()], "key int, ix int, iy int, v double")
    w = dict(smoothing.weights(0.9))
    for r in smoothing.smooth_2d(df, "key", "ix", "iy", "v", 0.9, keep_null=False).collect():
        parts = [(w.get(x - r.ix, 0) * w.get(y - r.iy, 0), v) for (x, y), v in cells.items() if v is not None]
        assert math.isclose(r.smooth, sum(p * v for p, v in parts) / sum(p for p, _ in parts), rel_tol=1e-9)


def test_nearest_values_on_a_grid(spark):
    rng = np.random.default_rng(9)
    rows = [(k, float(x), float(y), float(z) if rng.random() > 0.1 else None) for k in (1, 2) for x, y, z in rng.normal(size=(60, 3)) * (1, 5, 1)]
    rows += [(1, 0.1, 0.1, 4.0), (1, 0.1, 0.1, 6.0), (1, float("nan"), 1.0, 1.0), (1, None, 1.0, 1.0), (2, 30.0, 100.0, 1.0)]
    df = gridding.with_coordinates(spark.createDataFrame(rows, "key int, x double, y double, z double"), "key", ["x", "y"])
    assert df.count() == len(rows) - 2
    got = gridding.nearest_grid(df, "key", "x", "y", "z", (12, 15)).collect()
    assert len(got) == 2 * 12 * 15
    for k in (1, 2):
        places = {}
        for key, x, y, z in rows:
            if key == k and z is not None and x is not None and math.isfinite(x):
                places.setdefault((x, y), []).append(z)
        p = {xy: sum(z) / len(z) for xy, z in places.items()}
        hull = gridding._outline(*map(np.array, zip(*p, strict=True)))
        for r in (r for r in got if r.key == k):
            turns = [(b[0] - a[0]) * (r.y - a[1]) - (b[1] - a[1]) * (r.x - a[0]) for a, b in zip(hull, np.roll(hull, -1, 0), strict=True)]
            if min(turns) < -1e-6:
                assert r.z is None
            elif min(turns) > 1e-6:
                assert r.z == p[min(p, key=lambda q: ((q[0] - r.x) ** 2 + (q[1] - r.y) ** 2, q))]
    assert sum(r.z is not None for r in got) > 100
    with pytest.raises(AnalysisError, match="TooFewFiniteZ"):
        gridding.nearest_grid(df.limit(2), "key", "x", "y", "z")
    with pytest.raises(AnalysisError, match="TooFewPoints"):
        gridding.with_coordinates(df.limit(2), "key", ["x", "y"])
    lines = {r.key: r.is_rectangular for r in gridding.rectangular(spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 1, 0), (1, 1, 1), (2, 0, 0), (2, 1, 1)], "key int, x int, y int"), "key", "x", "y").collect()}
    assert lines == {1: True, 2: False}
    filled = spark.createDataFrame([(1, 5, 0, 1.0), (1, 5, 0, 3.0), (1, 7, 0, 4.0), (1, 5, 2, None), (1, 7, 2, 6.0), (2, 0, 0, 1.0), (2, 1, 1, 1.0)], "key int, a int, b int, c double")
    got = [tuple(r) for r in gridding.as_grid(filled, "key", "a", "b", "c").orderBy("place").collect()]
    assert got == [(1, 1, 0, 0, 5, 0, 2.0), (1, 2, 1, 0, 7, 0, 4.0), (1, 3, 0, 1, 5, 2, None), (1, 4, 1, 1, 7, 2, 6.0)]


def test_means_of_clusters_dont_depend_on_how_the_table_is_split(spark, tmp_path):
    """Of values that average 0.03, sums in another order fall on the other side of the bound."""
    from grainflow.plans import views

    rng = np.random.default_rng(2)
    parts = [[float(v) for v in rng.permutation([0.02, 0.04, 0.01, 0.08, 0.0] * 6)] for _ in range(50)]
    rows = [(k, 25.0, v, v) for row in zip(*parts, strict=True) for k, v in enumerate(row)]
    names = ["l_partkey", "l_quantity", "l_discount", "l_tax"]
    os.makedirs(tmp_path / "lineitem.parquet")
    for i, some in enumerate((rows[:900], rows[900:])):  # two files of many row groups
        pq.write_table(pa.table(dict(zip(names, zip(*some, strict=True), strict=True))), tmp_path / f"lineitem.parquet/part-{i}.parquet", row_group_size=50)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    want = {}
    for k, values in enumerate(parts):
        total = 0.0
        for v in values:
            total += v
        want[k] = total / len(values)
    assert len({x >= 0.03 for x in want.values()}) == 2
    try:
        for size in ("4k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            c = views.clusters(spark, str(tmp_path)).collect()
            assert {r.row_id: r.vx for r in c} == {r.row_id: r.c_y for r in c} == want
            assert {(r.Ncount, r.c_x) for r in c} == {(30.0, 25.0)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_smoothing_of_grids_over_many_tiles(spark, monkeypatch):
    """Grids of any place and size, cells that are given twice, keys that are texts, and values that aren't finite."""
    monkeypatch.setattr(smoothing, "TILE", 8)
    rng = np.random.default_rng(6)
    rows = []
    for key, (x0, x1), (y0, y1), share in (("a", (-9, 30), (0, 21), 0.7), ("b", (0, 7), (0, 3), 0.9), ("c", (100, 101), (5, 60), 0.5), ("d", (0, 60), (0, 60), 0.02), ("e", (3, 4), (3, 4), 1)):
        rows += [(key, x, y, None if rng.random() < 0.3 else float(rng.normal())) for x in range(x0, x1) for y in range(y0, y1) if rng.random() < share]
    rows += [("f", i, 0, v) for i, v in enumerate([1.0, math.nan, *[2.0] * 20, math.inf, 3.0])] + [("g", 1, 1, 2.0), ("g", 1, 1, 4.0), ("g", 1, 2, None), (None, 1, 1, 5.0)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "key string, ix int, iy bigint, v double, i int").repartition(5)
    for sigma in (0.9, 3.0):
        w = dict(smoothing.weights(sigma))
        for keep_null in (False, True):
            got = smoothing.smooth_2d(df, "key", "ix", "iy", "v", sigma, keep_null)
            assert got.columns == [*df.columns, "smooth"]
            found = {r.i: r for r in got.collect()}
            assert len(found) == len(rows) == got.count()
            for i, (key, x, y, v) in enumerate(rows):
                near = [(w.get(a - x, 0) * w.get(b - y, 0), z) for k, a, b, z in rows if k == key and z is not None and abs(a - x) in w and abs(b - y) in w]
                want = None if key is None or not near or keep_null and v is None else sum(p * z for p, z in near) / sum(p for p, _ in near)
                r = found[i]
                assert (r.key, r.ix, r.iy) == (key, x, y)
                assert r.smooth is None if want is None else r.smooth == want or math.isnan(want) and math.isnan(r.smooth) or math.isclose(r.smooth, want, rel_tol=1e-9, abs_tol=1e-12)


def test_smoothing_of_a_grid_shuffles_a_cell_but_a_few_times(spark):
    n = 40_000
    cells = spark.range(n).select(F.lit(1).alias("key"), (F.col("id") % 200).cast("int").alias("ix"), F.floor(F.col("id") / 200).cast("int").alias("iy"), F.rand(3).alias("v")).repartition(4, F.rand(5))
    cells = materialize(cells, "test")
    sc = spark.sparkContext
    sc.setJobGroup("smooth", "smooth")
    try:
        smoothing.smooth_2d(cells, "key", "ix", "iy", "v", 0.8).write.format("noop").mode("overwrite").save()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("smooth") for s in tracker.getJobInfo(j).stageIds}
    shuffled = sum(sc._jsc.sc().statusStore().lastStageAttempt(s).shuffleWriteRecords() for s in stages)
    assert 2 * n < shuffled < 4 * n
