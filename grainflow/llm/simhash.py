"""SimHash near-duplicates: pigeonhole blocks of the fingerprint, joined on blocks, verified by Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import minhash
from .common import materialize, slices

BITS = 64


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned SimHash of a text: a bit is 1 if it is set in over half of the shingles' XXH64 hashes.

    A-Z are lowered, words are runs of anything but ASCII white space, shingles are words joined by spaces, repeats
    included; fewer words than a shingle count as one shingle, no words give 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id_col, fp): fp is the fingerprint as a signed long. A null text counts as an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            fps = np.fromiter((fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, fp bigint").withColumnRenamed("id", id_col)


def block_masks(distance: int, parts: int) -> list[int]:
    """One mask for each choice of parts that `distance` flipped bits may leave whole: pairs that near agree under one of them."""
    width = -(-BITS // parts)
    part = [sum(1 << b for b in range(i * width, min(BITS, (i + 1) * width))) for i in range(parts)]
    return [sum(part[i] for i in kept) for kept in combinations(range(parts), parts - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, distance: int = 2, parts: int = 4, most: int = 24) -> DataFrame:
    """fps: distinct fingerprints (fp). Returns edges (a, b) that join exactly the classes of "at most `distance` bits apart".

    Fingerprints in a block of at most `most` are joined with one another and verified. In a larger block pairs aren't
    made: each fingerprint names the points one bit away from it (outside the bits that the block fixes), and those that
    name the same point are within two bits of each other, so that a link to the smallest of them loses no class. This exact
    way for large blocks is one for distance 2."""
    if distance != 2:
        raise ValueError("the exact way for large blocks is for distance 2")
    masks = block_masks(distance, parts)
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks))))
    dealt = fps.select("fp", keys.alias("k")).select("fp", "k.block", "k.key")
    sizes = dealt.groupBy("block", "key").agg(F.count("*").alias("n")).where("n > 1")
    dealt = materialize(dealt.join(sizes, ["block", "key"]), "blocks")
    small = dealt.where(F.col("n") <= most).select("block", "key", "fp")
    x, y = small.select("block", "key", F.col("fp").alias("a")), small.select("block", "key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    pairs = x.join(y, ["block", "key"]).where((F.col("a") < F.col("b")) & near).select("a", "b")

    free = F.element_at(F.array(*(F.array(*(F.lit(_signed(1 << b)) for b in range(BITS) if not m >> b & 1)) for m in masks)), F.col("block") + 1)
    steps = F.concat(F.array(F.lit(0).cast("long")), free)
    named = dealt.where(F.col("n") > most).select("block", "key", "fp", F.explode(steps).alias("step"))
    named = named.select("block", "key", F.col("fp").bitwiseXOR(F.col("step")).alias("point"), "fp")
    low = named.groupBy("block", "key", "point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = named.join(low, ["block", "key", "point"]).where("a <> fp").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2, shingle: int = 3, seed: int = 42, share: float | None = None, words: int = 5) -> DataFrame:
    """One row per document: id_col, fp (signed long), component (the smallest id reachable by links).

    Fingerprints at most `distance` bits apart are linked. With share, texts whose sets of shingles of that many words have this Jaccard
    similarity are linked too (minhash), most of which are more bits apart.

    Null or empty texts have fingerprint 0 and are linked like others; repeated rows stay, each with its class; a null id
    never names a class unless all its members' ids are null; other columns of docs are not read. An empty table gives an
    empty one."""
    if share is None:
        every = materialize(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
        classes = materialize(every.groupBy("fp").agg(F.min(id_col).alias("first")), "classes")
        return minhash.named(every, classes, "fp", links(classes.select("fp"), distance)).select(id_col, "fp", "component")
    how = minhash.Bands(seed=seed)
    signed = minhash.signatures(docs, id_col, text_col, words, how, lambda t: _signed(fingerprint(t, shingle, seed)))
    every = materialize(signed.withColumnRenamed("mark", "fp"), "fingerprints")
    classes = materialize(every.groupBy("sid").agg(F.min(id_col).alias("first")), "classes")
    # the sets of a fingerprint are one class, which its smallest set stands for
    held = materialize(every.select("fp", "sid").distinct(), "sets-of-fingerprints")
    stands = materialize(held.groupBy("fp").agg(F.min("sid").alias("u")), "stands")
    same = held.join(stands, "fp").where("sid <> u").select("u", F.col("sid").alias("v"))
    near = links(stands.select("fp"), distance).join(stands.withColumnRenamed("fp", "a"), "a")
    near = near.join(stands.select(F.col("fp").alias("b"), F.col("u").alias("v")), "b").select("u", "v")
    near = materialize(same.unionByName(near), "fingerprint-links")
    alike = minhash.found_links(docs, every, classes, id_col, text_col, share, words, how).toDF("u", "v")
    return minhash.named(every, classes, "sid", near.unionByName(alike)).select(id_col, "fp", "component")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
