"""Near-duplicates by the Jaccard similarity of shingle sets: MinHash bands give candidates, the sets decide exactly.

simhash.near_duplicates adds these links to its own for a similarity: at 0.8 two fingerprints differ in some ten of 64 bits, at which
blocks that a close pair must share hold a few bits each and part nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import discard, materialize, slices
from .components import connected_components


@dataclass(frozen=True)
class Bands:
    """Pairs of similarity s meet in a band with probability 1 - (1 - s**rows)**bands: all but 7 in a million at 0.8."""

    bands: int = 30
    rows: int = 5
    seed: int = 42
    #: Members of a block that are all compared at once.
    most: int = 12
    #: Members that an element of a difference from a group's core may bring together to be compared at once.
    few: int = 256


def shingle_set(text: str | None, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted distinct XXH64 hashes of a text's shingles; words and shingles are those of simhash.fingerprint."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(words) - shingle + 1) if words else 0
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), seed) for i in range(n)), np.uint64, n))


def band_keys(hashes: np.ndarray, how: Bands = Bands()) -> list[int]:
    """A signed key per band, the band's number hashed in; none for an empty set."""
    if not len(hashes):
        return []
    rng = np.random.default_rng(how.seed)
    a, b = rng.integers(0, 2**64, (2, how.bands * how.rows, 1), np.uint64)
    low = np.full(how.bands * how.rows, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 4096):
        low = np.minimum(low, (hashes[i : i + 4096] * (a | np.uint64(1)) + b).min(1))
    return [xxhash.xxh64_intdigest(x.tobytes(), i) - (1 << 63) for i, x in enumerate(low.reshape(how.bands, how.rows))]


def _sid(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), 1) - (1 << 63) if len(hashes) else 0


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int, how: Bands, mark: Callable[[str | None], int] = lambda _: 0) -> DataFrame:
    """(id_col, sid, n, keys, mark): sid is a digest of the set, 0 for the empty one, and n its size; mark is what the function of that
    name gives for the text, a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            texts = batch.column(1).to_pylist()
            rows = [(_sid(s), len(s), band_keys(s, how), mark(t)) for t, s in ((t, shingle_set(t, shingle, how.seed)) for t in texts)]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "sid", "n", "keys", "mark"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, sid bigint, n int, keys array<bigint>, mark bigint").withColumnRenamed("id", id_col)


def sets_of(texts: DataFrame, shingle: int, how: Bands) -> DataFrame:
    """(sid, hashes) of a column of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 0)):
            sets = [shingle_set(t, shingle, how.seed) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(_sid, sets), pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["sid", "hashes"])

    return texts.mapInArrow(run, "sid bigint, hashes array<bigint>")


def _verified(pairs: DataFrame, sets: Callable[[DataFrame], DataFrame], share: float) -> DataFrame:
    """The distinct pairs (a, b) whose sets have at least this Jaccard similarity; only the sets of pairs are made."""
    pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    made = materialize(sets(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()), "sets")
    side = lambda c: made.select(F.col("sid").alias(c), F.col("hashes").alias(f"{c}_set"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("a_set", "b_set"))
    return both.where(common / (F.size("a_set") + F.size("b_set") - common) >= share).select("a", "b")


def links(signed: DataFrame, sets: Callable[[DataFrame], DataFrame], share: float = 0.8, how: Bands = Bands()) -> DataFrame:
    """signed: distinct sets (sid, n, keys); sets: gives (sid, hashes) of a table of sids. Returns edges (a, b), all at least `share` similar, that join the classes of all
    such pairs that meet in a band.

    Members of a small block are all compared. Large blocks that share members are one group, whose pairs come from
    _within, so that a large group of near copies isn't squared and no class is lost."""
    dealt = signed.select("sid", "n", F.explode("keys").alias("key"))
    blocks = dealt.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    dealt = materialize(dealt.join(blocks, "key"), "bands")
    small, large = dealt.where(F.col("size") <= how.most), dealt.where(F.col("size") > how.most)
    pairs = _crossed(small.select("key", "sid", "n"), ["key"], F.lit(True), share)
    if not large.isEmpty():
        named = connected_components(large.select("sid", "key")).withColumnRenamed("node", "sid").withColumnRenamed("component", "gid")
        members = materialize(large.select("sid").distinct().join(named, "sid").select("gid", "sid"), "groups")
        stars, more = _within(members, sets, share, how)
        return _verified(pairs.unionByName(more), sets, share).unionByName(stars)
    return _verified(pairs, sets, share)


def _crossed(side: DataFrame, keys: list[str], more: Column, share: float) -> DataFrame:
    """Pairs (a, b) of rows of a key whose sizes allow the similarity and for which `more` holds of columns named _a and _b."""
    x, y = (side.select(*keys, *(F.col(c).alias(f"{c}_{k}") for c in side.columns if c not in keys)) for k in "ab")
    sized = F.least("n_a", "n_b") / F.greatest("n_a", "n_b") >= share
    return x.join(y, keys).where((F.col("sid_a") < F.col("sid_b")) & sized & more).select(F.col("sid_a").alias("a"), F.col("sid_b").alias("b"))


#: Members of a group from which its core is taken. Any core gives the same links; a good one gives few candidates.
SAMPLE = 64
#: Sizes of differences, as shares of a set's size, that are told apart.
STEP = 0.04


def _within(members: DataFrame, sets: Callable[[DataFrame], DataFrame], share: float, how: Bands) -> tuple[DataFrame, DataFrame]:
    """members: (gid, sid). Edges (a, b) that hold, and further candidates, which together join the classes of all pairs of a group
    that are `share` similar.

    Each set is written as its difference from the group's core. Two sets are similar if their difference is at most c = (1 - share) /
    (1 + share) of their sizes' sum; the differences from the core give |A ^ B| = |DA| + |DB| - 2 |DA & DB|. So with the slack
    s = |D| - c n two sets are similar exactly if DA and DB share at least (sA + sB) / 2 elements. A set that needs to share
    none with the set m of least slack is linked to m: that joins all pairs of which neither has to share any. For the others
    a prefix of the rarest elements of each difference, as long as the share that is needed leaves over, must meet; what is needed
    depends on the partner's size of difference, so that there is a prefix for each. Elements that still bring many together are
    groups of their own, with a core that holds or lacks them: then it starts again."""
    c = (1 - share) / (1 + share)
    made = materialize(sets(members.select("sid").distinct()), "group-sets")
    stars, candidates = [], []
    while True:
        rank = F.row_number().over(W.partitionBy("gid").orderBy(F.xxhash64("sid"), "sid"))
        sample = members.withColumn("rank", rank).where(F.col("rank") <= SAMPLE).select("gid", "sid")
        sized = sample.groupBy("gid").agg(F.count("*").alias("size"))
        held = sample.join(made, "sid").select("gid", F.explode("hashes").alias("t")).groupBy("gid", "t").agg(F.count("*").alias("f"))
        core = held.join(sized, "gid").where(2 * F.col("f") > F.col("size")).groupBy("gid").agg(F.collect_list("t").alias("core"))
        apart = F.concat(F.array_except("hashes", "core"), F.array_except("core", "hashes"))
        rows = members.join(made, "sid").join(core, "gid", "left").withColumn("core", F.coalesce("core", F.array().cast("array<bigint>")))
        rows = rows.select("gid", "sid", F.size("hashes").alias("n"), apart.alias("delta")).withColumn("d", F.size("delta"))
        rows = materialize(rows.withColumn("slack", F.col("d") - c * F.col("n")), "differences")
        least = rows.groupBy("gid").agg(F.min(F.struct("slack", "sid")).alias("m"))
        rows_ = rows.join(least, "gid").withColumn("linked", F.col("slack") + F.col("m.slack") <= 1e-9)
        stars.append(materialize(rows_.where(F.col("linked") & (F.col("sid") != F.col("m.sid"))).select(F.col("m.sid").alias("a"), F.col("sid").alias("b")), "stars"))

        # elements of differences by rarity; those that one set alone has bring nobody together
        each = rows.select("gid", "sid", F.explode("delta").alias("t"))
        often = each.groupBy("gid", "t").agg(F.count("*").alias("f"))
        ordered = each.join(often, ["gid", "t"]).groupBy("gid", "sid").agg(F.array_sort(F.collect_list(F.struct("f", "t"))).alias("delta"))
        ordered = ordered.join(rows_.select("gid", "sid", "n", "d", "slack", "linked", F.col("m.slack").alias("best")), ["gid", "sid"])
        own = F.floor(F.col("d") / (STEP * F.col("n"))).cast("int")
        # a partner's difference is within c of the sizes' sum of this one's, its size within the share
        reach = c * (1 + 1 / share)
        first = F.greatest(F.lit(0), F.floor((F.col("d") / F.col("n") - reach) * share / STEP).cast("int") - 1)
        last = F.floor((F.col("d") / F.col("n") + reach) / share / STEP).cast("int") + 1
        of = ordered.withColumn("own", own).withColumn("partner", F.explode(F.sequence(first, last)))
        low = (F.col("partner") * STEP - c) * F.when(F.col("partner") * STEP > c, share * F.col("n")).otherwise(F.col("n") / share)
        high = ((F.col("partner") + 1) * STEP - c) * F.when((F.col("partner") + 1) * STEP > c, F.col("n") / share).otherwise(share * F.col("n"))
        need = F.greatest(F.lit(1), F.ceil((F.col("slack") + low) / 2 - 1e-6).cast("int"))
        # two linked ones are in one class already
        of = of.withColumn("need", need).where((F.col("need") <= F.col("d")) & (~F.col("linked") | (high + F.col("best") > -1e-6)))
        prefix = F.filter(F.slice("delta", F.lit(1), F.col("d") - F.col("need") + 1), lambda x: x["f"] > 1)
        named = of.select("gid", F.least("own", "partner").alias("lo"), F.greatest("own", "partner").alias("hi"), "own", F.explode(F.transform(prefix, lambda x: x["t"])).alias("t"), "sid", "n", "linked")
        named = materialize(named, "prefixes")
        key = ["gid", "lo", "hi", "t"]
        marks = [F.count("*").alias("size"), F.bit_xor(F.xxhash64("sid")).alias("x"), F.sum(F.xxhash64("sid").cast("decimal(20,0)")).alias("s")]
        lists = named.groupBy(*key).agg(*marks, F.bool_and("linked").alias("done"), F.min("own").alias("low"), F.max("own").alias("high"))
        lists = materialize(lists.where(F.expr("size > 1 and not done and low = lo and high = hi")), "postings")
        few = named.join(lists.where(F.col("size") <= how.few).select(*key), key).select(*key, "sid", "n", "own", "linked")
        apart_ = ((F.col("own_a") != F.col("own_b")) | (F.col("lo") == F.col("hi"))) & ~(F.col("linked_a") & F.col("linked_b"))
        candidates.append(materialize(_crossed(few, key, apart_, share).distinct(), "candidates"))
        many = lists.where(F.col("size") > how.few).dropDuplicates(["size", "x", "s"]).select(*key, F.xxhash64(*key, "x").alias("next"))
        members = materialize(named.join(many, key).select(F.col("next").alias("gid"), "sid").distinct(), "groups")
        discard(rows, named, lists)
        if members.isEmpty():
            return reduce(DataFrame.unionByName, stars), reduce(DataFrame.unionByName, candidates)


def found_links(docs: DataFrame, every: DataFrame, classes: DataFrame, id_col: str, text_col: str, share: float, shingle: int, how: Bands) -> DataFrame:
    """links() of the sets of docs. every: their signatures; classes: (sid, first), an id by which a set's text is found again."""

    def sets(sids: DataFrame) -> DataFrame:
        ids = classes.join(sids, "sid", "left_semi").select(F.col("first").alias("_id")).distinct()
        texts = docs.join(ids, docs[id_col].eqNullSafe(ids["_id"]), "left_semi").select(text_col)
        return sets_of(texts, shingle, how).join(sids, "sid", "left_semi").dropDuplicates(["sid"])

    return links(every.select("sid", "n", "keys").dropDuplicates(["sid"]), sets, share, how)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = 0.8, shingle: int = 5, how: Bands = Bands()) -> DataFrame:
    """One row per document: id_col, sid (a digest of its shingle set), component (the smallest id reachable by links).

    Null and empty texts are one class; repeated rows stay, each with its class; a null id never names a class unless all its
    members' ids are null; other columns of docs are not read. An empty table gives an empty one."""
    every = materialize(signatures(docs, id_col, text_col, shingle, how), "signatures")
    classes = materialize(every.groupBy("sid").agg(F.min(id_col).alias("first")), "classes")
    return named(every, classes, "sid", found_links(docs, every, classes, id_col, text_col, share, shingle, how)).select(id_col, "sid", "component")


def named(every: DataFrame, classes: DataFrame, node: str, edges: DataFrame) -> DataFrame:
    """every with the component of its node: the smallest id reachable by edges. classes: (node, first), the smallest id of each node."""
    found = connected_components(edges)
    rooted = classes.join(found.withColumnRenamed("node", node), node, "left").select(node, "first", F.coalesce("component", node).alias("root"))
    rooted = materialize(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    return every.join(rooted.join(least, "root").select(node, "component"), node)
