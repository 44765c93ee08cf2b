"""What must not grow with the square of a partition, and the folder for tables."""

import random
import subprocess
import sys
import time

from pyspark.sql import functions as F

from grainflow.functions.ranks import ranked, running_sum
from grainflow.functions.tables import discard, materialize
from grainflow.operators import graph, select, smoothing


def test_many_requests_in_one_partition(spark):
    requests = spark.range(200_000).select((F.col("id") * 0.01).alias("request"))
    blocks = spark.range(1, 31).select(F.col("id").cast("int").alias("step_index"), (F.col("id") * 100.0).alias("timestep"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        began = time.time()
        found = select.by_timestep(requests, blocks)
        assert found.where(F.abs(F.col("timestep") - F.col("request")) > F.greatest(F.lit(50.0), 100 - F.col("request"))).count() == 0
        assert found.count() == 200_000
        assert time.time() - began < 60  # a frame that shrinks takes half an hour
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ranks_equal_one_sort(spark):
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate((i % 3, (i * 37) % 11) for i in range(200))], "k int, v int, i int")
    got = {r.i: (r.n, r.s) for r in running_sum(ranked(df, ["k"], [F.desc("v"), F.col("i")], "n"), ["k"], [F.col("v"), F.col("i")], F.col("v"), "s").collect()}
    rows = df.collect()
    for r in rows:
        mine = [x for x in rows if x.k == r.k]
        assert got[r.i][0] == 1 + sum((-x.v, x.i) < (-r.v, r.i) for x in mine)
        assert got[r.i][1] == sum(x.v for x in mine if (x.v, x.i) <= (r.v, r.i))
    assert ranked(df.where("false"), ["k"], [F.col("i")], "n").count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.range(3000).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    found = graph.components(edges)
    assert found.count() == 3001 and found.select("component").distinct().collect()[0][0] == 0
    assert graph.components(edges.where("u < 0")).count() == 0


def test_discarded_tables_are_gone(spark):
    t = materialize(spark.range(5), "test")
    path = t._grainflow_path
    assert spark.read.parquet(path).count() == 5
    discard(t, spark.range(3))
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


ALONE = """
from pyspark.sql import SparkSession
from grainflow.functions.tables import materialize, shared_dir
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", "{folder}/warehouse").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
print(shared_dir(spark), materialize(spark.range(3), "x").count())
spark.sparkContext.setCheckpointDir("{folder}/points")
print(shared_dir(spark))
"""


def test_tables_without_a_named_folder(tmp_path):
    """Nothing static is set, and nothing goes to a local temporary folder."""
    import os

    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", ALONE.format(folder=tmp_path)], env=env, capture_output=True, text=True, timeout=120)
    lines = out.stdout.strip().splitlines()
    assert out.returncode == 0, out.stderr[-2000:]
    assert lines[0].endswith("/warehouse 3") and "/points/" in lines[1]


def test_components_with_hubs(spark, monkeypatch):
    """Stars whose middle is the least, the greatest and a middling node, joined in a row; hubs meet by a broadcast."""
    edges = []
    for base, middle in ((0, 0), (5000, 8999), (10_000, 12_000)):
        edges += [(base + i, middle) for i in range(4000) if base + i != middle]
    edges += [(3999, 5000), (20_000, 20_001), (20_001, 20_001)]
    df = spark.createDataFrame(edges, "u long, v long")
    monkeypatch.setattr(graph, "MANY", 100)
    found = {r.node: r.component for r in graph.components(df).collect()}
    assert set(found) == {x for e in edges for x in e}
    assert all(c == (0 if n < 10_000 else 10_000 if n < 20_000 else 20_000) for n, c in found.items())


def test_rounds_of_components_have_small_plans(spark, monkeypatch):
    """What a plan holds costs the driver memory: no round holds a step twice, and none without hubs broadcasts."""
    plans, write = [], graph.materialize
    monkeypatch.setattr(graph, "MANY", 100)
    monkeypatch.setattr(graph, "materialize", lambda df, *a: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, *a))[1])
    path = spark.range(600).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {r.component for r in graph.components(path).collect()} == {0}
        assert len(plans) > 4 and not any("Broadcast" in p for p in plans) and max(p.count("Exchange") for p in plans) <= 6
        plans.clear()
        star = path.unionByName(spark.range(2000, 4000).select(F.lit(7).cast("long").alias("u"), F.col("id").alias("v")))
        assert {r.component for r in graph.components(star).collect()} == {0}
        assert any("Broadcast" in p for p in plans) and max(p.count("Exchange") for p in plans) <= 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)


def test_quantiles_over_ranges(spark):
    from grainflow.functions.ranks import quantiles

    df = spark.range(20_000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 11 > 0, F.floor(F.rand(1) * 500) / 7).alias("v"))
    shares = (0.0, 0.05, 0.5, 0.77, 1.0)
    want = {r.k: r.q for r in df.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).collect()}
    got = {r.k: r.q for r in quantiles(df, ["k"], "v", shares).collect()}
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-9 for k in want for a, b in zip(got[k], want[k], strict=True))
    few = spark.createDataFrame([(7, 1.5), (8, None), (9, 2.0), (9, 3.0)], "k long, v double")
    assert {r.k: r.q for r in quantiles(few, ["k"], "v", (0.5, 0.25)).collect()} == {7: [1.5, 1.5], 9: [2.5, 2.25]}
    assert quantiles(few, [], "v", (0.5,)).first().q == [2.0]


def test_smoothing_of_one_long_series(spark):
    from grainflow.operators.smoothing import smooth_1d, weights

    n = 200_000
    df = spark.range(n).select(F.lit(1).alias("key"), (F.col("id") * 0.5).alias("x"), F.when(F.col("id") % 10 > 0, (F.col("id") % 97).cast("double")).alias("v"))
    out = smooth_1d(df, "key", "x", "v", 1.5)
    some = {r.x: r.smooth for r in out.where("x in (0.0, 5.5, 49999.5, 99999.5)").collect()}
    v = [None if i % 10 == 0 else float(i % 97) for i in range(n)]
    for x, got in some.items():
        near = [(w, v[int(2 * x) + k]) for k, w in weights(1.5) if 0 <= int(2 * x) + k < n and v[int(2 * x) + k] is not None]
        want = sum(w * y for w, y in near) / sum(w for w, _ in near) if v[int(2 * x)] is not None else None
        assert got == want or abs(got - want) < 1e-9
    assert len(some) == 4 and out.count() == n


def test_gaps_over_ranges(spark):
    from grainflow.operators.smoothing import fill

    r = random.Random(4)
    rows = [(k, float(i), r.random() if r.random() < share else None) for k, share in ((1, 0.3), (2, 0.02), (3, 0.0)) for i in range(150)] + [(4, 1.0, None), (4, 2.0, 5.0)]
    df = spark.createDataFrame(rows, "key int, x double, v double")
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for parts in ("1", "23"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = {(t.key, t.x): t.filled for t in fill(df, "key", "x", "v").collect()}
            for k in (1, 2, 3, 4):
                points = [(x, v) for j, x, v in rows if j == k and v is not None]
                for j, x, v in rows:
                    if j != k:
                        continue
                    before, after = [p for p in points if p[0] < x], [p for p in points if p[0] > x]
                    pair = (before[-1], after[0]) if before and after else before[-2:] if len(before) > 1 else after[:2] if len(after) > 1 else None
                    want = v if v is not None else pair and pair[0][1] + (x - pair[0][0]) * (pair[1][1] - pair[0][1]) / (pair[1][0] - pair[0][0])
                    assert want is None and got[k, x] is None or abs(got[k, x] - want) < 1e-9
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)


def test_smoothing_sends_no_table_through_the_driver(spark):
    """Spreading a cell over its kernel multiplies rows behind Spark's estimate, so that the planner would broadcast them all."""
    df = materialize(spark.range(60).select(F.lit(1).alias("k"), (F.col("id") % 8).alias("x"), F.floor(F.col("id") / 8).alias("y"), F.col("id").cast("double").alias("v")), "test")
    for out in (smoothing.smooth_2d(df, "k", "x", "y", "v", 0.8), smoothing.smooth_1d(df, "k", "v", "v", 0.8)):
        plan = out._jdf.queryExecution().sparkPlan().toString()
        last = next(line for line in plan.splitlines() if "Join" in line)
        assert "SortMergeJoin" in last
        assert out.count() == 60
