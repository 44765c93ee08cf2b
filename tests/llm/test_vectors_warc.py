"""Vector operators and archives against brute force, with awkward rows and damage."""

import gzip
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainflow.llm import embdedup, topk, warc

VECTORS = "vec_id bigint, embedding array<float>, label int"
BAD = [None, [], [0.0, 0.0, 0.0], [1.0, None, 0.0], [1.0, float("nan"), 0.0], [float("inf"), 1.0, 0.0]]


def some_vectors(spark, n=150, dim=3, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=dim)], int(i % 2)) for i in range(n)]
    rows += [(1000 + i, list(rows[i % 5][1]), rows[i % 5][2]) for i in range(20)]  # copies
    rows += [(2000 + i, v, 0) for i, v in enumerate(BAD)]
    rows += [(3000, [1.0, 0.0, 0.0], None), (3001, [1.0, 0.0, 0.0], None), (3002, [1.0, 0.0], 0), (3003, [2.0, 0.0], 0), (3004, [-0.0, 0.0, 1.0], 0), (3005, [0.0, 0.0, 1.0], 0), (7, list(rows[7][1]), 1)]
    return spark.createDataFrame(rows, VECTORS), rows


def slow_links(rows, cosine):
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) and y is not None for _, v, y in rows]
    n = len(rows)
    near = [[] for _ in range(n)]
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / (math.sqrt(a @ a) * math.sqrt(b @ b)) >= cosine:
                    near[i].append(j)
    comp = [None] * n
    for i in range(n):
        if comp[i] is None:
            seen, todo = {i}, [i]
            while todo:
                for j in near[todo.pop()]:
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            for j in seen:
                comp[j] = min(rows[k][0] for k in seen)
    return sorted((rows[i][0], len(near[i]), comp[i]) for i in range(n))


@pytest.mark.parametrize("block", [16, 512])
def test_links_equal_brute_force(spark, block):
    df, rows = some_vectors(spark)
    how = embdedup.Codes(block=block)
    got = sorted(map(tuple, embdedup.near_duplicates(df.withColumn("part", F.lit(1)).withColumn("v", F.lit("x")), how).collect()))
    assert got == slow_links(rows, how.cosine)
    assert embdedup.near_duplicates(df.where("false")).count() == 0


def test_links_in_many_dimensions(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 64))
    x = [b + rng.normal(size=64) * s for b in base for s in (0.0, 0.1, 0.3, 0.38, 0.42)]
    rows = [(i, [float(np.float32(c)) for c in v], 1) for i, v in enumerate(x)]
    got = sorted(map(tuple, embdedup.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()))
    assert got == slow_links(rows, 0.93) and any(n for _, n, _ in got)


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(6)
    u = rng.normal(size=(2000, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    rotated, codes, factor = embdedup.encode(u, embdedup.rotation(64, 1))
    i, j = (x.ravel() for x in np.meshgrid(np.arange(2000), np.arange(200), indexing="ij"))
    i, j = i[i != j], j[i != j]
    e, h = embdedup.estimate(codes[i], factor[i], rotated[j], 5.0)
    true = (u[i] * u[j]).sum(1)
    assert abs((e - true).mean()) < 2e-3 and (np.abs(e - true) <= h).all()


def test_few_pairs_are_computed_exactly_and_none_is_lost():
    rng = np.random.default_rng(7)
    base = rng.normal(size=(300, 64))
    x = np.concatenate([base, base + rng.normal(size=base.shape) * 0.39])  # cosines round the threshold
    blocks = [embdedup.Block.of(embdedup.Block.stored(list(range(len(part))), [1] * len(part), part.tolist(), 7)) for part in (x[:300], x[300:])]
    i, j, exact = embdedup.compare(*blocks, embdedup.Codes())
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = np.argwhere(u[:300] @ u[300:].T >= 0.93)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(map(tuple, want.tolist())) and 60 < len(want) < 240
    assert exact < 0.01 * 300 * 300
    assert embdedup.most_bits(3, 0.93, 1e-7) == 3 and 18 < embdedup.most_bits(64, 0.93, 1e-7) < 28


def test_vectors_of_extreme_sizes(spark):
    rows = [(1, [1e300, 1e300], 0), (2, [1e-300, 1e-300], 0), (3, [1.0, -1.0], 0), (4, [1e-308, 0.0], 0), (5, [1e308, 1e-308], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    assert {tuple(r) for r in embdedup.near_duplicates(df).collect()} == {(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 1, 4), (5, 1, 4)}
    # floor(64 * x) of each; scores that no long holds are its ends
    whole = {1: (64 * int(1e300),) * 2, 2: (0, 0), 3: (64, -64), 4: (0, 0), 5: (int(topk.MOST), 0)}
    score = lambda a, b: min(max(sum(x * y for x, y in zip(whole[a], whole[b], strict=True)), topk.LEAST_LONG), topk.MOST_LONG)
    top = {(r.query_id, r.id): r.score for r in topk.top_k(df, F.col("vec_id") > 0).collect()}
    assert top == {(a, b): score(a, b) for a in whole for b in whole if a != b}


@pytest.mark.parametrize("how", [topk.Search(), topk.Search(k=3, pivots=2, queries=4, candidates=16, step=2), topk.Search(k=5, pivots=8, queries=16, spread=40, step=4)])
def test_top_k_equals_brute_force(spark, how):
    df, rows = some_vectors(spark)
    rows = rows + [(1, [2.0, 2.0, 2.0], 0), (1, [2.0, 2.0, 2.0], 0), (7, [2.0, -2.0, 2.0], 1), (1, [5.0, 5.0], 0)]  # repeated ids, other vectors
    df = df.union(spark.createDataFrame(rows[-4:], VECTORS))
    got = {}
    for r in topk.top_k(df.withColumn("d", F.lit(1)).withColumn("q", F.lit(False)), F.col("vec_id") % 20 == 0, how).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.id, r.score)
    good = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    want = {}
    for q, z in good:
        if q % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(z, x, strict=True)), i) for i, x in good if i != q and len(x) == len(z))
            want[q] = {k: (i, -v) for k, (v, i) in enumerate(s[: how.k], 1)}
    assert got == {q: r for q, r in want.items() if r}
    assert topk.top_k(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_of_groups_passes_blocks_over(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 16)) * 20
    rows = [(i, [float(x) for x in centres[i % 8] + rng.normal(size=16) * 0.1], 0) for i in range(1600)]
    df = spark.createDataFrame(rows, VECTORS)
    r = topk.top_k(df, F.col("vec_id") % 20 == 0, topk.Search(k=5, queries=16), report=True).agg(F.sum("evaluated"), F.sum("met"), F.sum("candidates")).first()
    assert r[1] < 0.6 * r[2] and r[0] < 0.5 * r[2]


def test_long_vectors_take_part(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4) * 10.0 ** rng.integers(0, 4)], 0) for i in range(60)]
    # squared lengths beyond 2^62; one with a component that no long holds, across from zeros
    rows += [(100 + i, [float(v)] * 4, 0) for i, v in enumerate((2.0**25, -(2.0**25), 2.0**26))] + [(110, [0.0, 0.0, 0.0, 2.0**70], 0)]
    rows = [(i, [*e[:3], 0.0] if i < 100 else e, g) for i, e, g in rows]
    got = topk.top_k(spark.createDataFrame(rows, VECTORS), F.col("vec_id").isin(0, 20, 40, 7), topk.Search(k=5, queries=2, candidates=16, pivots=8)).collect()
    whole = {i: [math.floor(64 * x) for x in e] for i, e, _ in rows}
    for q in (0, 20, 40, 7):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:5]
        assert sorted((r["rank"], r["id"], r["score"]) for r in got if r["query_id"] == q) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]


PAGES = [(3, "http://a/é b", "<p>x</p>"), (1, None, "<p>x</p>"), (2, "u", None), (5, "u", ""), (4, "v", "y" * 100_000), (6, "w", "WARC/1.1\r\n\r\n \x1f\x8b\x08"), (None, "n", "null id"), (7, "z", "<p>x</p>")]
COLUMNS = "page_id bigint, url string, html string"


def test_archives_round_trip(spark):
    df = spark.createDataFrame(PAGES, COLUMNS).withColumn("digest", F.lit(1)).withColumn("first", F.lit(2))
    got = {r.page_id: tuple(r)[1:] for r in warc.round_trip(df).collect()}
    want = {}
    for i, _, h in PAGES:
        b = (h or "").encode()
        first = min((j for j, _, g in PAGES if (g or "") == (h or "") and j is not None), default=None)
        revisit = first is not None and first != i
        want[i] = (len(b), warc.digest_of(b), "revisit" if revisit else "response", first if revisit else None)
    assert got == want
    assert {r.record_type for r in warc.round_trip(df, least=10**6).collect()} == {"response"}
    assert warc.round_trip(df.where("false")).count() == 0


def archive(zipped):
    parts = [warc.record(i, "u", f"page {i} ".encode() * 50, warc.digest_of(f"page {i} ".encode() * 50)) for i in range(6)]
    return [warc.packed(p) for p in parts] if zipped else parts


def kinds(data):
    return [(x.start, x.end) if isinstance(x, warc.Gap) else x.headers["warc-record-id"] for x in warc.salvage(data)]


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage(zipped):
    parts = archive(zipped)
    ids = [f"<{warc.ID}{i}>" for i in range(6)]
    whole = b"".join(parts)
    starts = np.cumsum([0, *map(len, parts)]).tolist()
    assert kinds(whole) == ids and kinds(b"") == []
    if zipped:
        assert gzip.decompress(whole).count(b"WARC/1.1") == 6
    broken = bytearray(whole)
    broken[starts[2] + len(parts[2]) // 2] ^= 0xFF  # damage inside a record
    assert kinds(bytes(broken)) == [*ids[:2], (starts[2], starts[3]), *ids[3:]]
    assert kinds(whole[: starts[1]] + b"garbage" + whole[starts[1] :]) == [ids[0], (starts[1], starts[1] + 7), *ids[1:]]
    assert kinds(whole[:-9]) == [*ids[:5], (starts[5], len(whole) - 9)]
    assert kinds(b"xx" + whole) == [(0, 2), *ids]
    assert kinds(whole[: starts[3]] + whole[starts[3] + 20 :])[:3] == ids[:3] and kinds(whole[: starts[3]] + whole[starts[3] + 20 :])[-2:] == ids[4:]


def test_salvage_of_members_with_several_records():
    parts, ids = archive(False), [f"<{warc.ID}{i}>" for i in range(6)]
    whole = warc.packed(b"".join(parts))
    assert kinds(whole) == ids
    broken = bytearray(b"".join(parts[:3]))
    broken[len(parts[0]) + len(parts[1]) // 2] ^= 0xFF  # damage before compression: the member is valid, its second record isn't
    first, second = warc.packed(bytes(broken)), warc.packed(b"".join(parts[3:]) + b"rest")
    both = len(first) + len(second)
    assert kinds(first + second) == [ids[0], (0, len(first)), ids[2], *ids[3:], (len(first), both)]
    reasons = [x.reason for x in warc.salvage(first + second) if isinstance(x, warc.Gap)]
    assert f"bytes {len(parts[0])} to {len(parts[0]) + len(parts[1])} of" in reasons[0]


def test_salvage_of_a_whole_file_in_one_member():
    rng = np.random.default_rng(2)
    bodies = [rng.bytes(40_000 + 100 * i) for i in range(8)]
    parts = [warc.record(i, "u", b, warc.digest_of(b)) for i, b in enumerate(bodies)]
    ids = [f"<{warc.ID}{i}>" for i in range(8)]
    whole = warc.packed(b"".join(parts))
    assert kinds(whole) == ids
    broken = bytearray(whole)
    place = sum(map(len, parts[:4])) + 20_000  # random bodies hardly compress: inside the fifth record
    broken[place] ^= 0xFF
    got = kinds(bytes(broken) + warc.packed(parts[0]))
    # the damaged record is in a gap; those round it, whose digests hold, and the member after it are recovered
    found, gaps = [x for x in got if isinstance(x, str)], [x for x in got if isinstance(x, tuple)]
    assert found[:4] == ids[:4] and ids[4] not in found and got[-1] == ids[0] and gaps and max(e for _, e in gaps) == len(whole)
    cut = kinds(whole[: place])
    assert [x for x in cut if isinstance(x, str)] == ids[:4] and cut[-1][1] == place


def some_record(r, i):
    n = r.randrange(50, 4000)
    body = r.randbytes(n) if r.random() < 0.3 else bytes(r.choice(b"abcdefgh <p>\n") for _ in range(n))
    return warc.record(i, f"http://e/{i}", body, warc.digest_of(body))


def read_back(data):
    """The records by id, each once, and the gaps."""
    found = list(warc.salvage(data))
    records, gaps = [x for x in found if isinstance(x, warc.Record)], [x for x in found if isinstance(x, warc.Gap)]
    by_id = {x.headers["warc-record-id"]: x for x in records}
    assert len(by_id) == len(records)
    return by_id, gaps


def test_members_cut_off_lose_nothing_that_follows():
    r = random.Random(7)
    for _ in range(400):
        level = r.choice([0, 1, 6])
        first = warc.packed(b"".join(some_record(r, i) for i in range(5)), level)
        rest = [warc.packed(b"".join(some_record(r, 10 * j + k) for k in range(2)), level) for j in range(1, 4)]
        cut = r.randrange(1, len(first))
        got, gaps = read_back(first[:cut] + b"".join(rest))
        assert all(f"<{warc.ID}{10 * j + k}>" in got for j in range(1, 4) for k in range(2))
        if any(f"<{warc.ID}{i}>" not in got for i in range(5)):
            assert any(g.start < cut <= g.end for g in gaps)


def test_flipped_bits_give_no_wrong_record():
    r = random.Random(8)
    for _ in range(300):
        parts = [some_record(r, i) for i in range(4)]
        member = bytearray(warc.packed(b"".join(parts), r.choice([0, 1, 6])))
        member[r.randrange(len(member))] ^= 1 << r.randrange(8)
        got, gaps = read_back(bytes(member) + warc.packed(some_record(r, 9)))
        assert f"<{warc.ID}9>" in got
        for name, x in got.items():
            if name != f"<{warc.ID}9>":
                lines = {f"{k}: {v}" for k, v in x.headers.items()}
                part = parts[int(name.removesuffix(">").rpartition(":")[2])]
                written = {(k.lower(), v) for k, _, v in (y.partition(": ") for y in part.partition(b"\r\n\r\n")[0].decode().split("\r\n")[1:])}
                assert {f"{k}: {v}" for k, v in written} == lines and part.endswith(x.block + b"\r\n\r\n")
        if len(got) < 5:
            assert any(g.end > g.start for g in gaps)


def test_records_of_a_failed_member_need_digests_of_their_headers():
    parts = [re.sub(rb"X-Header-Digest: [^\r]*\r\n", b"", p) for p in archive(False)]
    member = warc.packed(b"".join(parts))
    assert len(kinds(member)) == 6  # the member's own checks cover them
    broken = bytearray(member)
    broken[-5] ^= 1
    assert kinds(bytes(broken)) == [(0, len(member))]


@pytest.mark.parametrize("start", [b"WARC/1.1\r\nContent-Length: 99999999\r\n\r\n", b"WARC/1.1\r\n", b"WARC/1.1 "])
def test_false_starts_take_one_pass(start):
    data = start * ((1 << 20) // len(start)) + archive(False)[0]
    began = time.process_time()
    assert f"<{warc.ID}0>" in kinds(data) and f"<{warc.ID}0>" in kinds(warc.packed(data))
    assert time.process_time() - began < 6  # about one second


def test_headers_of_any_length():
    long = warc.record(1, "u" * (17 << 20), b"x", warc.digest_of(b"x"))
    for data in (long, warc.packed(long)):
        assert kinds(data + warc.packed(archive(False)[2])) == [f"<{warc.ID}1>", f"<{warc.ID}2>"]


def test_salvage_reads_in_parts():
    class Counting(__import__("io").BytesIO):
        most = 0

        def read(self, n=-1):
            data = super().read(n)
            Counting.most = max(Counting.most, len(data))
            return data

    body = b"x" * 1000
    whole = warc.record(1, "u", body, warc.digest_of(body)) * 3000
    for data in (whole, warc.packed(whole, 0)):
        assert len([x for x in warc.salvage(Counting(data)) if isinstance(x, warc.Record)]) == 3000
    assert Counting.most <= 1 << 20 < len(whole)
    # a length that can't be right is no reason to read on
    wrong = whole.replace(b"Content-Length: 1", b"Content-Length: 99999999991", 1)
    assert [type(x).__name__ for x in warc.salvage(wrong)][:2] == ["Gap", "Record"]


def test_reader_logs_gaps(spark, tmp_path):
    parts = archive(True)
    (tmp_path / "a.warc.gz").write_bytes(parts[0] + b"?" * 10 + parts[1])
    rows = warc.read(spark, [f"file://{tmp_path}/a.warc.gz"]).orderBy("start").collect()
    assert [(r.gap is None, r.end - r.start) for r in rows] == [(True, len(parts[0])), (False, 10), (True, len(parts[1]))]
    assert rows[0].payload == b"page 0 " * 50
