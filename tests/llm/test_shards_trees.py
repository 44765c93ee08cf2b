"""Sharding, Merkle manifests and conversation tries against brute force."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainflow.llm import merkle, sharding, trie
from grainflow.llm.common import spread_join


def as_sets(a, b):
    key = lambda x: tuple(map(str, x))
    return sorted(map(tuple, a), key=key) == sorted(b, key=key)


# ---- sharding


def cut_by_hand(rows, shards):
    groups, k = defaultdict(list), shards.count
    for i, t in rows:
        groups[t or ""].append(i)
    size = lambda t: len(t.encode()) + shards.row_bytes
    whole = {t: size(t) * len(v) for t, v in groups.items()}
    total = sum(whole.values())
    big = int(shards.large * total / k)
    first = lambda t: min((x for x in groups[t] if x is not None), default=1 << 62)
    order = sorted(groups, key=lambda t: (-whole[t] if whole[t] >= big else 0, first(t), hashlib.sha256(t.encode()).digest()))
    sums = [0]
    for t in order:
        sums.append(sums[-1] + whole[t])

    def fits(capacity):
        at = 0
        for _ in range(k):
            at = max(p for p in sums if p <= at + capacity)
        return at >= total

    capacity = next(c for c in sorted({max(whole.values()), *(b - a for a in sums for b in sums if b - a >= max(whole.values()))}) if fits(c))
    early = [total]
    for _ in range(k - 1):
        early.append(min(p for p in sums if p >= early[-1] - capacity))
    early.reverse()
    cuts, at = [], 0
    for j in range(1, k):
        goal = at + (total - at) / (k - j + 1)
        best = min([p for p in sums if p > at] or [total], key=lambda p: (abs(p - goal), p))
        at = min(max(best, early[j]), max(p for p in sums if p <= at + capacity))
        cuts.append(at)
    out, slots = [], defaultdict(int)
    for t, upto in zip(order, sums[1:], strict=True):
        shard = sum(upto > c for c in cuts)
        for i in sorted(groups[t], key=lambda x: (x is not None, x or 0)):
            out.append((i, size(t), zlib.crc32(t.encode()), shard, slots[shard]))
            slots[shard] += 1
    return capacity, out


@pytest.mark.parametrize("shards", [sharding.Shards(6), sharding.Shards(5, points=6), sharding.Shards(3, large=9.0, points=4)])
def test_shards_are_the_smallest_that_fit(spark, shards):
    r = random.Random(3)
    rows = [(i, r.choice(["a", "", None, "é" * 40, "x" * r.randrange(900)])) for i in range(90)] + [(None, "n"), (None, "m"), (5, "a"), (5, "a")]
    capacity, want = cut_by_hand(rows, shards)
    docs = spark.createDataFrame([(i, t, 9, "z") for i, t in rows], "doc_id long, text string, shard int, digest string")
    got = sharding.assign(docs, shards).collect()
    assert as_sets(got, want)
    loads = defaultdict(int)
    for row in got:
        loads[row["shard"]] += row["size"]
    assert max(loads.values()) <= capacity


def test_shards_of_a_group_that_is_most_of_all_rows(spark):
    rows = [(i, "hot" * 99 if i % 3 == 0 else f"text {i} " * 5) for i in range(300)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), sharding.Shards(8)).collect()
    assert as_sets(got, cut_by_hand(rows, sharding.Shards(8))[1])
    assert len({r["shard"] for r in got if r["size"] > 200}) == 1
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_fewer_groups_than_shards_and_none(spark):
    few = sharding.assign(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")).collect()
    assert sorted((r["shard"], r["slot"]) for r in few) == [(0, 0), (1, 0)]
    assert sharding.assign(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shards_written(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i % 40}", None) for i in range(120)], "doc_id long, text string, note string")
    sharding.write(docs, f"file://{tmp_path}/out", sharding.Shards(4))
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted(map(tuple, back.select("doc_id", "text", "note").collect())) == sorted(map(tuple, docs.collect()))
    where = {(r["doc_id"], r["shard"]) for r in back.collect()}
    assert where == {(r["doc_id"], r["shard"]) for r in sharding.assign(docs, sharding.Shards(4)).collect()}


def test_spread_join(spark):
    many = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    one = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    got = spread_join(many, one, ["k"], F.col("id") % 8)
    assert got.groupBy("k").count().orderBy("k").collect() == [(0, 334), (1, 333)]
    assert spread_join(many, one, ["k"], F.col("id") % 8, "left").count() == 1000


# ---- Merkle


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def manifest_by_hand(rows, f):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha([enc(r[c]) for c in merkle.COLUMNS])
    by = defaultdict(list)
    for r in rows:
        by[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), r))

    def up(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([sha(levels[-1][i : i + f]) for i in range(0, len(levels[-1]), f)])
        return levels

    langs = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    ordered = {k: sorted(by[k], key=lambda t: t[:3]) for k in langs}
    trees = {k: up([x[2] for x in ordered[k]]) for k in langs}
    top, out = up([trees[k][-1][0] for k in langs]), []
    for n, k in enumerate(langs):
        for i, (_, _, own, r) in enumerate(ordered[k]):
            bad = r["doc_id"] is not None and r["n_chars"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            h, siblings = leaf({**r, "n_chars": r["n_chars"] + 1}) if bad else own, []
            for levels, j in ((trees[k], i), (top, n)):
                for level in levels[:-1]:
                    a = j - j % f
                    run = level[a : a + f]
                    siblings += run[: j - a] + run[j - a + 1 :]
                    run[j - a] = h
                    h, j = sha(run), j // f
            out.append((r["doc_id"], own, trees[k][-1][0], top[-1][0], sha(siblings), h, h == top[-1][0]))
    return out


TAMPERED = lambda: F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("tree", [merkle.Tree(2, 1), merkle.Tree(3, 1), merkle.Tree(2, 4), merkle.Tree()])
def test_manifest(spark, tree):
    r = random.Random(5)
    rows = [(i, "é" * r.randrange(9), r.choice(["a", "a", "a", "b", "", None]), r.choice(["s", None]), r.choice([1, None, 3])) for i in range(61)]
    rows += [(None, None, None, None, None), (3, "twice", "a", "s", 1), (3, "twice", "a", "s", 1), (700, "long" * 9000, "one", "s", 2)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("key", F.lit("k")).withColumn("leaf", F.lit(1))
    got = merkle.audit(docs, TAMPERED(), tree).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert as_sets(got, manifest_by_hand([x.asDict() for x in docs.collect()], tree.fanout))


def test_proofs_fold_to_the_root(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("lang"))
    tree = merkle.Tree(2, 2)
    got = merkle.proofs(merkle.build(docs, "lang", ["doc_id"], ["doc_id"], tree, {"doc_id": F.col("doc_id")}), tree, ["doc_id"])
    good = merkle.verified(got, F.col("leaf")).collect()
    assert len(good) == 50 and all(x["verified"] for x in good) and len({x["root"] for x in good}) == 1
    bad = merkle.verified(got, F.when(F.col("doc_id") == 7, F.sha2(F.lit("x"), 256)).otherwise(F.col("leaf"))).where("NOT verified").collect()
    assert [x["doc_id"] for x in bad] == [7]


def test_manifest_of_nothing(spark):
    assert merkle.audit(spark.createDataFrame([], DOCS), TAMPERED()).count() == 0


# ---- trie


def trie_by_hand(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((t is not None, t or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), text))
    own = {c: [(role, text) for _, _, role, _, text in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    built = {c: own.get(c - int(math.fmod(c, 100)), [])[: h[c]] + own[c][h[c] :] for c in own}
    nodes, kids, leaves, saved = defaultdict(list), defaultdict(list), {}, {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    for k in nodes:
        if k:
            kids[k[:-1]].append(k)
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[j] for j in kids[k]) or 1
        saved[k] = sum(saved[j] for j in kids[k]) + (len(k[-1][1]) * (len(nodes[k]) - 1) if k else 0)
    ends = lambda k, m: sha([",".join(map(str, sorted(c for c in m if len(built[c]) == len(k))))])
    return [(min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], ends(k, m)) for k, m in nodes.items()]


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("limits", [trie.Trie(), trie.Trie(subtree=9, shard=30, text_bytes=8)])
def test_trie(spark, limits):
    r = random.Random(1)
    rows = [(c + r.choice([0, 0, 1000]), t if r.random() < 0.9 else None, r.choice(["u", "a", None]), r.choice(["x", "y", "é" * 3, "", None])) for c in range(200) for t in range(r.randrange(0, 7))]
    rows += [(c, t, "u", f"deep {t}") for c in (500, 501, 502) for t in range(90)]  # long ways that several share
    rows += [(-c, 1, "u", "neg") for c in range(1, 130)] + [(None, 1, "u", "q"), (7, 3, "u", "twice"), (7, 3, "u", "twice"), (8, 0, "u", "long" * 9000)]
    df = spark.createDataFrame(rows, TURNS).withColumn("depth", F.lit(1)).withColumn("a", F.lit("x"))
    assert as_sets(trie.nodes(df, limits).collect(), trie_by_hand(rows))


def test_trie_of_nothing(spark):
    assert trie.nodes(spark.createDataFrame([], TURNS)).count() == 0
    assert trie.nodes(spark.createDataFrame([(None, 1, "a", "b")], TURNS)).count() == 0


def test_turnless_conversations_end_at_the_top(spark):
    rows = [(101, 0, "u", "a"), (102, 0, "u", "b")]  # their own first turns are replaced by those of an absent one
    assert as_sets(trie.nodes(spark.createDataFrame(rows, TURNS)).collect(), trie_by_hand(rows))


def test_slots_are_minimal_and_verified():
    r = np.random.default_rng(2)
    a, b = r.integers(0, 1 << 63, 5000).astype(np.uint64), r.integers(0, 40, 5000).astype(np.uint64)
    slots = trie.Slots(a, b)
    assert sorted(slots(a, b)) == list(range(5000))
    assert (slots(a, b + np.uint64(100)) == -1).all()
    assert len(trie.Slots(a[:0], b[:0])(a, b)) == 5000
