"""Readers, selection and fields on the bundled fixtures' values, written anew here."""

import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, LessThan

from grainflow.functions import names, physics
from grainflow.functions.errors import AnalysisError
from grainflow.operators import fields, select
from grainflow.plans import api
from grainflow.sources import blocks, datasource, ranges, resolve, runlog

BIN1D = """# one
# two
# Chunk Coord1 Ncount
100 3 6
1 0 0
2 1 2
3 2 4
200 2 3
1 0 1
2 1 2
junk line
300 1 1
1 5 7 99
"""
LOG = """words
 Step CPU Time Temp
 100 0.10 10 300
 not a row
 200 0.20 20 310
# step cpu Time
 5 1 2
 5 1 nan
"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "bin1d_dx_0.5_dy_0.5_Lz_1.txt").write_text(BIN1D)
    (tmp_path / "slurm_case.log").write_text(LOG)
    return tmp_path


def code_of(f, *args, **kw):
    with pytest.raises(AnalysisError) as e:
        f(*args, **kw)
    return e.value.code


def test_names():
    assert names.header_names("# Chunk c_virial[1] 2x") == ["Chunk", "c_virial_1_", "x2x"]
    assert code_of(names.header_names, " # ") == "NoVarNames"
    assert names.metadata("bin2d_dx_0.5_dy_0.5_Lz_1.txt") == {"dx": 0.5, "dy": 0.5, "Lz": 1.0}
    assert names.cell_volume("a/bin2d_dx_0.5_dy_0.5_Lz_2.txt") == 0.5
    assert code_of(names.cell_volume, "bin2d_dx_0.5_dy.txt") == "BadBinName"
    assert code_of(names.cell_volume, "bin2d_dx_0.5.txt") == "NotEnoughVars"


def test_blocks(spark, folder):
    path = str(folder / "bin1d_dx_0.5_dy_0.5_Lz_1.txt")
    index = blocks.block_index(spark, [path])
    assert [(r.step_index, r.timestep, r.num_chunks, r.total_count) for r in index.orderBy("step_index").collect()] == [(1, 100, 3, 6), (2, 200, 2, 3), (3, 300, 1, 1)]
    rows = blocks.read(spark, path).orderBy("step_index", "row_id").collect()
    assert [(r.step_index, r.row_id, r.Chunk, r.Coord1, r.Ncount) for r in rows] == [(1, 1, 1, 0, 0), (1, 2, 2, 1, 2), (1, 3, 3, 2, 4), (2, 1, 1, 0, 1), (2, 2, 2, 1, 2), (3, 1, 1, 5, 7)]
    one = blocks.read(spark, path, steps=index.where("step_index = 2"))
    assert one.count() == 2
    cache = str(folder / "cache")
    assert blocks.cached_index(spark, [path], cache).count() == 3 == blocks.cached_index(spark, [path], cache).count()
    uniform = blocks.spacing(index).first()
    assert (uniform.dt, uniform.is_uniform) == (100, True)
    with pytest.raises(Exception, match="BadBlockHeader"):
        blocks.block_index(spark, [path], strict=True).collect()


def test_broken_blocks(tmp_path):
    for name, text, code in (
        ("a", "#\n#\n", "HeaderTooShort"),
        ("b", "#\n#\n# A B C\n1 2 0\n1 2 3\n", "UnexpectedEOF"),
        ("c", "#\n#\n# A B C\n1 1.5 0\n1 2 3\n", "BadChunkCount"),
    ):
        (tmp_path / name).write_text(text)
        assert code_of(lambda p: list(blocks.scan_blocks(p, strict=True)), str(tmp_path / name)) == code
    (tmp_path / "d").write_text("#\n#\n# A B C\n")
    assert list(blocks.scan_blocks(str(tmp_path / "d"))) == []


def test_pieces_of_a_large_block(spark, tmp_path):
    """A block in many pieces, uneven and blank rows, NaN and text without an end of line."""
    path = tmp_path / "bin1d_a.txt"
    body = "".join(f"  {i}\t{i * 0.5}  {'nan' if i % 7 == 0 else i}{' 9 9' if i % 11 == 0 else ''} \n" for i in range(1, 5001))
    path.write_text("#\n#\n# Chunk Coord1 Ncount\n" + f"5 5000 1\n{body}" + "6 2 1\n1 2 3\n4 5 6")
    whole = list(blocks.scan_blocks(str(path)))
    parts = list(blocks.scan_blocks(str(path), piece=1))
    assert [r[:7] for r in whole] == [r[:7] for r in parts] and [len(r[7]) for r in whole] == [1, 1]
    strict = list(blocks.scan_blocks(str(path), strict=True, piece=1000))
    assert [r[:7] for r in strict] == [r[:7] for r in whole] and len(strict[0][7]) > 50
    assert all(a["end"] == b["start"] and a["before"] + a["n"] == b["before"] for a, b in zip(strict[0][7], strict[0][7][1:], strict=False))
    rows = blocks.read_blocks(spark.createDataFrame(strict, blocks.INDEX), blocks.columns_of(str(path))).orderBy("step_index", "row_id").collect()
    assert [(r.step_index, r.row_id, r.Chunk, r.Coord1, r.Ncount) for r in rows] == [(1, i, i, i * 0.5, None if i % 7 == 0 else i) for i in range(1, 5001)] + [(2, 1, 1, 2, 3), (2, 2, 4, 5, 6)]
    (tmp_path / "bad.txt").write_text("#\n#\n# A B\n1 2 0\n1 2\n1 x\n")
    with pytest.raises(Exception, match="BadDataRow"):
        blocks.read(spark, str(tmp_path / "bad.txt")).collect()


def chain(seed, columns, blocks_, junk, rows=40):
    """A file of blocks of uneven sizes, with lines between them that start none."""
    r = random.Random(seed)
    out = ["#", "#", "# " + " ".join(["Chunk", "Coord1", "Ncount", "v_mass", "c_rho"][:columns])]
    for t in range(blocks_):
        n = r.choice([0, 1, rows, 3 * rows])
        out.append(f"{t * 100} {n} {n * 2}")
        out += [" ".join(str(r.choice([i, 0, 1, 0.5, 2.25])) for i in range(k, k + columns)) for k in range(n)]
        if junk and r.random() < 0.4:
            out += r.choice([["junk"], ["", "  "], ["a 1 2", "# 4 5 6"], ["7 8"]])
    return "\n".join(out) + r.choice(["", "\n"])


@pytest.mark.parametrize("columns, junk, strict", [(5, True, False), (5, False, True), (3, True, False), (3, False, True), (4, True, False)])
def test_a_file_in_many_ranges(spark, tmp_path, columns, junk, strict):
    for seed, rows, size in ((1, 40, 500), (2, 400, 900), (3, 3, 150)):
        text = chain(seed, columns, 15, junk, rows)
        if strict:
            text = text.replace("00 ", "00  ").replace("\n1 ", "\n \n1 ")  # blank lines anywhere
        path = tmp_path / f"bin1d_{seed}_{columns}{junk}{strict}.txt"
        path.write_text(text)
        want = [r[1:7] for r in blocks.scan_blocks(str(path), strict)]
        index = blocks.block_index(spark, [str(path)], strict, size)
        got = index.orderBy("step_index").collect()
        assert [tuple(r)[1:7] for r in got] == want
        for r in got:
            assert sum(p["n"] for p in r.pieces) == r.num_chunks and all(a["end"] == b["start"] and a["before"] + a["n"] == b["before"] for a, b in zip(r.pieces, r.pieces[1:], strict=False))
            assert not r.pieces or (r.pieces[0]["start"], r.pieces[-1]["end"]) == (r.data_start, r.data_end)
        names_ = blocks.columns_of(str(path))
        key = lambda x: tuple(x)[1:]
        whole = blocks.read_blocks(blocks.block_index(spark, [str(path)], strict, 1 << 30), names_)
        assert sorted(map(key, blocks.read_blocks(index, names_).collect()), key=str) == sorted(map(key, whole.collect()), key=str)


def test_ranges_are_tasks(spark, tmp_path):
    path = tmp_path / "bin1d_a.txt"
    path.write_text(chain(5, 5, 200, True))
    size = path.stat().st_size // 12
    heads = [blocks._head(str(path))]
    calls = []

    def counting(files):
        calls.append(files)
        return blocks._whole(spark, files, False)

    found = ranges.index(spark, heads, False, blocks._open, counting, size)
    assert found.count() == 200 and calls == []  # no file was left to one task
    assert blocks.block_index(spark, [str(path)], size=size).count() == 200


def test_errors_in_ranges(spark, tmp_path):
    for text, code in (("#\n#\n# A B C\n1 2 0\n1 2 3\n", "UnexpectedEOF"), ("#\n#\n# A B C\n" + "1 1 0\n1 2 3\n" * 20 + "1 1.5 0\n1 2 3\n", "BadChunkCount"), ("#\n#\n# A B C D\n" + "1 1 0\n1 2 3 4\n" * 20 + "junk\n", "BadBlockHeader")):
        (tmp_path / "x.txt").write_text(text)
        with pytest.raises(Exception, match=code):
            blocks.block_index(spark, [str(tmp_path / "x.txt")], True, 32).collect()


def test_a_log_in_many_ranges(spark, tmp_path):
    r = random.Random(3)
    text = "words\n"
    for m in range(4):
        text += "# Step CPU Time\n" + "".join(f"{i} {i / 10} {m}\n" if r.random() < 0.8 else r.choice(["\n", "bad row\n", "1 2\n", "1 nan 3\n"]) for i in range(60))
    (tmp_path / "slurm_a.log").write_text(text)
    path = str(tmp_path / "slurm_a.log")
    want = sorted(map(tuple, runlog.read(spark, path).collect()), key=str)
    for size in (37, 200, 1000):
        assert sorted(map(tuple, runlog.read(spark, path, size).collect()), key=str) == want
    assert len(want) > 150


def test_short_row(spark, tmp_path):
    (tmp_path / "e.txt").write_text("#\n#\n# A B C\n1 1 0\n1 2\n")
    with pytest.raises(Exception, match="BadDataRow"):
        blocks.read(spark, str(tmp_path / "e.txt")).collect()


def test_write_and_read_back(spark, folder, tmp_path):
    rows = blocks.read(spark, str(folder / "bin1d_dx_0.5_dy_0.5_Lz_1.txt"))
    text = blocks.text_of(rows, ["Chunk", "Coord1", "Ncount"])
    (tmp_path / "again.txt").write_text(text)
    again = blocks.read(spark, str(tmp_path / "again.txt")).drop("path", "total_count")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows.drop("path", "total_count").collect()))
    blocks.write(rows, str(tmp_path / "out"), ["Chunk", "Coord1", "Ncount"])
    assert "\n".join(p.read_text().rstrip("\n") for p in sorted((tmp_path / "out").glob("part-*")) if p.stat().st_size) + "\n" == text


def test_empty_cells_lose_their_values(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0.0, 5.0), (2.0, 1.0, 3.0, 6.0)], "Chunk double, Coord1 double, Ncount double, c_rho double")
    assert [tuple(r) for r in blocks.mask_empty(df).collect()] == [(1, 0, 0, None), (2, 1, 3, 6)]
    assert blocks.mask_empty(df.drop("Coord1")).columns == ["Chunk", "Ncount", "c_rho"]


def test_log(spark, folder):
    log = runlog.read(spark, str(folder / "slurm_case.log"))
    assert [tuple(r)[1:] for r in runlog.counts(log).orderBy("module_index").collect()] == [(1, 2, 1), (2, 1, 1)]
    assert [(r.step, r.time) for r in runlog.steps(log).orderBy("row_id").collect()] == [(100, 10), (200, 20)]
    (folder / "none").write_text("no table\n")
    with pytest.raises(Exception, match="NoStepCpuBlock"):
        runlog.read(spark, str(folder / "none")).collect()


def test_selection(spark, folder):
    b = spark.createDataFrame([(1, 100.0), (2, 200.0), (3, 300.0)], "step_index int, timestep double")
    log = runlog.steps(runlog.read(spark, str(folder / "slurm_case.log")))
    pick = lambda **k: select.pick(b, log=log, **k).first().step_index
    assert pick(select_by="Index", index=1, time=999, timestep=999) == 1
    assert pick(index=2.5) == 3 and pick(timestep=150) == 1 and pick(timestep=1e9) == 3 and pick(time=10) == 1 and pick(time=20) == 2
    assert code_of(select.pick, b, index=4) == "BadIndex" and code_of(select.pick, b, "time") == "MissingTime"
    q = spark.createDataFrame([(x,) for x in (-5.0, 100.0, 150.0, 151.0, 250.0, 999.0, None, 150.0)], "request double")
    got = sorted((r.request if r.request is not None else math.inf, r.step_index) for r in select.by_timestep(q, b).collect())
    assert got == [(-5, 1), (100, 1), (150, 1), (150, 1), (151, 2), (250, 2), (999, 3), (math.inf, None)]
    assert [r.step_index for r in select.in_range(b, "timestep", (100, 300), 2).orderBy("step_index").collect()] == [1, 3]


def test_resolve(folder):
    assert resolve.resolve(str(folder), "1d").endswith("bin1d_dx_0.5_dy_0.5_Lz_1.txt") and resolve.resolve(str(folder), "log").endswith("slurm_case.log")
    assert code_of(resolve.resolve, str(folder), "1d", "x.dat") == "MissingTxtSuffix"
    assert code_of(resolve.resolve, str(folder), "1d", "x.txt") == "PreferredFileNotFound"
    assert code_of(resolve.resolve, str(folder), "vx") == "NoMatch"
    (folder / "bin1d_b.txt").write_text("")
    assert code_of(resolve.resolve, str(folder), "1d") == "MultipleMatches"


def test_chunk_task(spark, folder):
    out = api.analyze(spark, " Chunk ", str(folder), dim="1d", variable="Ncount", index=1, coord_scale=2.0, range_x=(1, 4.5))
    assert sorted((r.x, r.value) for r in out["field"].collect()) == [(2, 2), (4, 4)]
    assert code_of(api.analyze, spark, "x", str(folder)) == "BadTaskType"
    assert code_of(api.analyze, spark, "chunk", str(folder), progress="loud", variable="Ncount") == "BadMode"
    assert code_of(api.analyze, spark, "network2d", str(folder), dim="1d") == "BadNetworkChunkDim"


def test_results_are_made_when_asked_for(spark, folder, tmp_path):
    out = api.analyze(spark, "chunk", str(folder), dim="1d", variable="Ncount", index=1, cache=str(tmp_path / "index"))
    assert list(out) == ["selection", "field"] and not out.made
    out.write(str(tmp_path / "results"), "json")
    assert spark.read.json(str(tmp_path / "results" / "field")).count() == out["field"].count() == 3
    assert (tmp_path / "index").exists()


def test_volume_from_the_name(spark, tmp_path):
    text = "#\n#\n# Chunk Coord1 Ncount v_mass v_mvx v_mvy v_mvz c_ke\n100 2 6\n1 0 1 4 0 0 0 1\n2 1 2 6 0 0 0 1\n"
    (tmp_path / "bin1d_dx_0.5_dy_0.5_Lz_2.txt").write_text(text)
    pick = dict(dim="1d", variable="density", index=1)
    named = [r.value for r in api.analyze(spark, "chunk", str(tmp_path), **pick)["field"].orderBy("row_id").collect()]
    given = [r.value for r in api.analyze(spark, "chunk", str(tmp_path), dv=0.5, **pick)["field"].orderBy("row_id").collect()]
    assert named == given
    (tmp_path / "bin1d_dx_0.5_dy_0.5_Lz_2.txt").rename(tmp_path / "bin1d_case.txt")
    assert code_of(api.analyze, spark, "chunk", str(tmp_path), **pick) == "NeedDV"


def test_derived_fields_by_hand(spark):
    cols = ["Ncount", "v_mass", "v_mvx", "v_mvy", "v_mvz", "c_ke", *(f"v_mvv{a}" for a in physics.STRESSES), *(f"c_virial_{k}_" for k in range(1, 7))]
    row = (4.0, 4.0, 0.4, 0.2, 0.0, 2.4, 0.05, 0.02, 0.01, 0.01, 0.02, 0.03, 10.0, 20.0, 30.0, 4.0, 5.0, 6.0)
    df = spark.createDataFrame([row, (0.0, *[None] * 17)], ", ".join(f"{c} double" for c in cols))
    u = physics.Units()
    got = df.select(*(e.alias(k) for k, e in physics.fields(df.columns, 0.25).items())).collect()
    v, p = (0.1, 0.05, 0.0), (0.4, 0.2, 0.0)
    thermal = 2.4 + 0.5 * u.mvv2e * 4 * (0.01 + 0.0025) - u.mvv2e * (0.04 + 0.01)
    sigma = {}
    for k, a in enumerate(physics.STRESSES):
        i, j = ("xyz".index(c) for c in a)
        sigma[a] = (row[12 + k] - u.mvv2e * u.nktv2p * (row[6 + k] + 4 * v[i] * v[j] - v[i] * p[j] - v[j] * p[i])) / 0.25 * u.bar2gpa
    want = {"speed": math.hypot(*v), "density": 4 / 0.25 * u.mass2gcm3, "T": 2 * thermal / (3 * 4 * u.kb), "pressure": -(sigma["xx"] + sigma["yy"] + sigma["zz"]) / 3, **{f"sigma_{a}": x for a, x in sigma.items()}}
    for k, x in want.items():
        assert math.isclose(got[0][k], x, rel_tol=1e-12), k
    assert got[1]["T"] is None and got[1]["speed"] is None
    assert code_of(fields.field, df, "pressure", "1d") == "NeedDV" and code_of(fields.field, df, "nope", "1d") == "UnknownVariable"
    assert code_of(fields.field, df.drop("c_virial_1_"), "pressure", "1d", dv=1.0) == "MissingPressure"
    assert code_of(physics.fields, df.columns, 0) == "BadDV"
    assert df.select(physics.variable(df, "c_ke").alias("x")).first().x == 2.4


def test_coordinates():
    assert fields.coordinates(["c_x", "c_y"], "2d") == ["c_x", "c_y"] and fields.coordinates(["Chunk"], "1d") == ["Chunk"] and fields.coordinates(["Chunk"], "2d") is None
    assert F.lit(1) is not None


def grown(n, first=1):
    return "".join(f"{t * 100} 3 6\n" + "".join(f"{i} {i * 0.5} {t}\n" for i in range(3)) for t in range(first, first + n))


HEAD = "# a\n# b\n# Chunk Coord1 Ncount\n"


def test_format_prunes_blocks_before_parsing(spark, tmp_path, monkeypatch):
    path = tmp_path / "bin1d_a.txt"
    path.write_text(HEAD + grown(50))
    df = datasource.load(spark, str(path), f"file://{tmp_path}/cache")
    assert df.columns == [*blocks.META.fieldNames(), "Chunk", "Coord1", "Ncount"]
    key = lambda r: tuple(r)[1:]
    assert sorted(map(key, df.collect())) == sorted(map(key, blocks.read_blocks(blocks.block_index(spark, [str(path)]), ["Chunk", "Coord1", "Ncount"]).collect()))
    some = df.where("timestep >= 4600 and step_index <> 48 and row_id = 2")
    assert sorted(r.step_index for r in some.collect()) == [46, 47, 49, 50]
    # only the bytes of blocks that pass are read
    read = []
    real = blocks.parse_rows
    monkeypatch.setattr(blocks, "parse_rows", lambda data, *a: (read.append(len(data)), real(data, *a))[1])
    for index in (None, f"{tmp_path}/cache/{next((tmp_path / 'cache').iterdir()).name}"):
        read.clear()
        reader = datasource.Reader(str(path), ["Chunk", "Coord1", "Ncount"], index, False)
        left = list(reader.pushFilters([EqualTo(("step_index",), 7), LessThan(("timestep",), 1e9), EqualTo(("Ncount",), 7), EqualTo(("step_index",), None)]))
        assert [f.attribute for f in left] == [("Ncount",), ("step_index",)]
        rows = [b for p in reader.partitions() for b in reader.read(p)]
        assert sum(b.num_rows for b in rows) == 3 and read == [len(grown(1, 7)) - len("700 3 6\n")]
    assert df.where("step_index > 99").count() == 0


def test_format_writes_and_reads_back(spark, tmp_path):
    rows = spark.range(60).select((F.col("id") % 6 + 1).cast("int").alias("step_index"), ((F.col("id") % 6 + 1) * 10.0).alias("timestep"), (F.floor(F.col("id") / 6) + 1).cast("int").alias("row_id"), F.col("id").cast("double").alias("Chunk"), F.when(F.col("id") % 7 > 0, F.rand(3)).alias("Ncount"))
    datasource.register(spark)
    out = f"{tmp_path}/out"
    datasource.save(rows, out)
    names_ = ["step_index", "timestep", "row_id", "Chunk", "Ncount"]
    back = spark.read.format("blocks").load(out)
    assert sorted(map(tuple, back.select(names_).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert {r.num_chunks for r in back.select("num_chunks").collect()} == {10}
    assert all(p.name.startswith("part-") for p in (tmp_path / "out").iterdir() if not p.name.endswith(".crc"))
    # a task that fails leaves nothing behind
    bad = rows.withColumn("Chunk", F.when(F.col("id" if "id" in rows.columns else "Chunk") == 59, F.raise_error(F.lit("boom")).cast("double")).otherwise(F.col("Chunk")))
    before = sorted(p.name for p in (tmp_path / "out").iterdir())
    with pytest.raises(Exception, match="boom"):
        datasource.save(bad, out)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == before
    with pytest.raises(Exception, match="UnorderedRows"):
        rows.withColumn("num_chunks", F.lit(10)).withColumn("total_count", F.lit(1.0)).repartition(3, "row_id").write.format("blocks").mode("append").save(out)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == before


def test_format_follows_a_growing_file(spark, tmp_path):
    path, text = tmp_path / "bin1d_a.txt", HEAD + grown(9)
    datasource.register(spark)

    def upto(size):
        path.write_text(text[:size])
        q = spark.readStream.format("blocks").load(str(path)).writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).start()
        q.awaitTermination()

    def keep(df, n):
        seen.extend((r.step_index, r.timestep, r.row_id, r.Ncount) for r in df.collect())

    seen: list[tuple] = []
    want = [(t, t * 100.0, i, float(t)) for t in range(1, 10) for i in (1, 2, 3)]
    three = len(HEAD + grown(3))
    upto(three - 1)  # the third block lacks its last line end
    assert sorted(seen) == want[:6]
    upto(three + 5)  # a block's head that is cut off; each time the query starts anew
    assert sorted(seen) == want[:9]
    upto(three + len(grown(4, 4)) + 12)
    assert sorted(seen) == want[:21]
    upto(len(text))
    assert sorted(seen) == want


def test_small_blocks_share_a_task(spark, tmp_path):
    """The number of tasks follows the bytes that are read, not the number of blocks."""
    lines = ["# blocks", "# timestep rows total", "# Coord1 Ncount"]
    for step in range(1, 401):
        lines += [f"{step * 10} {step % 3} 1", *(f"{step} {r}" if step % 7 else f" {step}   NaN" for r in range(step % 3))]
    path = tmp_path / "many.txt"
    path.write_text("\n".join(lines))
    df = datasource.load(spark, str(path), str(tmp_path / "index")).where("timestep > 2000")
    assert df.rdd.getNumPartitions() < 5
    got = [(r.step_index, r.timestep, r.num_chunks, r.row_id, r.Coord1, r.Ncount) for r in df.orderBy("step_index", "row_id").collect()]
    assert got == [(s, s * 10.0, s % 3, r + 1, float(s), float(r) if s % 7 else None) for s in range(201, 401) for r in range(s % 3)]
