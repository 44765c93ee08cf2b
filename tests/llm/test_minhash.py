"""Near-duplicates by Jaccard similarity against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from grainflow.llm import minhash, simhash


def shingles(text, n=5):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def slow_classes(texts, share=0.8):
    sets, top = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= share:
                p, q = find(a), find(b)
                top[max(p, q)] = min(p, q)
    return [find(i) for i in range(len(texts))]


def copies(seed=8, bases=12, each=14):
    """Texts of 60 to 300 words and copies of them with some words changed, so that similarities lie on both sides of 0.8."""
    rng = np.random.default_rng(seed)
    texts = [None, "", "  ", "a b", "a b", "A  b", "a b c d e f g h", "a b c d e f g h i"]
    for b in range(bases):
        base = [f"w{x}" for x in rng.integers(0, 5000, 60 + 20 * b)]
        for _ in range(each):
            w = list(base)
            for i in rng.integers(0, len(w), rng.integers(0, 2 + len(w) // 30)):
                w[i] = f"x{rng.integers(0, 10**6)}"
            texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("most, few", [(2, 1000), (1000, 1000), (2, 3)])
def test_classes_equal_brute_force(spark, most, few):
    texts = copies()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("sid", F.lit(1)).withColumn("n", F.lit(2))
    got = {r.doc_id: r.component for r in minhash.near_duplicates(df, how=minhash.Bands(most=most, few=few)).collect()}
    assert [got[i] for i in range(len(texts))] == slow_classes(texts)
    assert minhash.near_duplicates(df.where("false")).count() == 0


def test_a_large_group_of_near_copies_is_not_squared(spark, monkeypatch):
    """Copies of one text with one to six words changed: similarities lie on both sides of 0.8."""
    rng = np.random.default_rng(3)
    base, texts = [f"w{i}" for i in range(150)], []
    for _ in range(400):
        w = list(base)
        for i in rng.integers(0, 150, rng.choice([1, 2, 3, 6])):
            w[i] = f"x{rng.integers(0, 10**6)}"
        texts.append(" ".join(w))
    made, verified = [], minhash._verified

    def counted(pairs, sets, share):
        made.append(pairs.distinct().count())
        return verified(pairs, sets, share)

    monkeypatch.setattr(minhash, "_verified", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component for r in minhash.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == slow_classes(texts)
    assert sum(made) < 0.25 * 400 * 399 / 2


def test_pipeline_drops_near_copies(spark):
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base), " ".join([*base[:100], "other", *base[101:]]), " ".join([*base[:100], *(f"y{i}" for i in range(100))])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()) == [0, 2]


def test_pipeline_links_by_fingerprints_and_by_sets(spark):
    """Texts whose repeated passage makes their fingerprints near, though their sets share little; near copies whose fingerprints aren't."""
    passage, texts = " ".join(f"p{i}" for i in range(40)), copies(bases=6, each=5)
    texts += [f"{passage} " * 100 + " ".join(f"{c}{i}" for i in range(60)) for c in "xyz"]
    fps, sets = [simhash.fingerprint(t) for t in texts], [shingles(t) for t in texts]
    ids = range(len(texts))
    near = [(b, a) for a in ids for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2]
    alike = [(b, a) for a in ids for b in range(a) if sets[a] == sets[b] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    assert set(near) - set(alike) and set(alike) - set(near)
    top = list(ids)
    for a, b in near + alike:
        top = [min(top[a], top[b]) if x in (top[a], top[b]) else x for x in top]
    df = spark.createDataFrame([*enumerate(texts), (3, texts[3])], "doc_id bigint, text string")
    got = {r.doc_id: r for r in simhash.near_duplicates(df, share=0.8).collect()}
    assert [(got[i].fp % 2**64, got[i].component) for i in ids] == [(fps[i], top[i]) for i in ids]
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()) == sorted(set(top))
    assert simhash.near_duplicates(df.where("false"), share=0.8).count() == 0
