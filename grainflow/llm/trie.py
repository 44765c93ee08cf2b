"""Prefix trie of conversations: nodes with their members, children and sums over subtrees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainflow.functions.ranks import ranked, running_sums

from .common import discard, materialize, spread_join, text_of

#: Salts that rows of a hot key are dealt by where they meet the one row of it.
SALTS = 64
PARTS = 4


@dataclass(frozen=True)
class Trie:
    """subtree: rows that a subtree has at most to be worked on as a whole in one shard; larger ones are cut at their tops, whose
    sums are doubled up. shard: nodes that a shard is meant to hold. text_bytes: ids' text that one row holds."""

    subtree: int = 1 << 12
    shard: int = 1 << 14
    text_bytes: int = 1 << 18


def prefix_length(conv: Column) -> Column:
    """The number of turns that a conversation takes from the one it branches off."""
    return F.crc32(conv.cast("string").cast("binary")) % 6


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """conv, pos (from 0), digest and points (code points of the text) of each turn: by turn, null first, ties by role and digest.
    Null role and text are empty; rows without a conv_id belong to no conversation."""
    role, text = text_of("role"), text_of("text")
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").alias("conv"),
        "turn",
        role.alias("role"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.length(text).cast("long").alias("points"),
    )
    found = ranked(rows, ["conv"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")], "rank")
    return found.select("conv", (F.col("rank").cast("long") - 1).alias("pos"), "digest", "points")


def rebuilt(turns: DataFrame, every: int = 100) -> tuple[DataFrame, DataFrame]:
    """Conversations that branch off: each takes the first turns of conversation conv - conv % every, then its own after as many.

    Returns their turns (conv, pos, digest, points, n_turns) and the conversations themselves (conv, n_turns), turnless ones too."""
    sizes = materialize(turns.groupBy("conv").agg(F.count("*").alias("own")), "trie-sizes")
    h, base = prefix_length(F.col("conv")), F.col("conv") - F.col("conv") % every
    bases = sizes.select(F.col("conv").alias("base"), F.col("own").alias("base_own"))
    convs = sizes.select("conv", "own", h.alias("h"), base.alias("base")).join(bases, "base", "left")
    shared = F.least("h", F.coalesce("base_own", F.lit(0)))
    convs = convs.select("conv", "base", "h", shared.alias("shared"), (shared + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("n_turns"))
    convs = materialize(convs, "trie-conversations")
    own = turns.where(F.col("pos") >= prefix_length(F.col("conv")))
    own = spread_join(own, convs.select("conv", "h", "shared", "n_turns"), ["conv"], F.col("pos") % SALTS)
    own = own.select("conv", (F.col("pos") - F.col("h") + F.col("shared")).alias("pos"), "digest", "points", "n_turns")
    first = turns.where(f"pos < 5 AND conv % {every} = 0").select(F.col("conv").alias("base"), "pos", "digest", "points")
    taken = convs.where("shared > 0").select("conv", "base", "shared", "n_turns").join(first, "base").where("pos < shared")
    discard(sizes)
    return own.unionByName(taken.select("conv", "pos", "digest", "points", "n_turns")), convs.select("conv", "n_turns")


def prefixes(rows: DataFrame) -> DataFrame:
    """conv, depth, a, b (the digest of the first depth turns), pa, pb (that of one turn less), points, n_turns.

    The digest is a sum over the turns of 128 bits each, which depend on the turn and on its place, in four parts modulo 2^32: sums
    go over ranges of a conversation of any length, where a digest of digests would go turn by turn."""
    word = lambda seed: F.xxhash64(F.lit(seed), F.col("digest"), F.col("pos"))
    low = F.lit(0xFFFFFFFF)
    slim = rows.select("conv", "pos", "points", "n_turns", word(1).alias("w0"), word(2).alias("w1"))
    own = {f"p{i}": (F.shiftrightunsigned(f"w{i // 2}", 32) if i % 2 else F.col(f"w{i // 2}")).bitwiseAND(low) for i in range(PARTS)}
    sums = running_sums(slim, ["conv"], [F.col("pos")], own)
    pair = lambda f, i: F.shiftleft(f(i + 1).bitwiseAND(low), 32).bitwiseOR(f(i).bitwiseAND(low))
    here, before = (lambda i: F.col(f"p{i}")), (lambda i: F.col(f"p{i}") - own[f"p{i}"])
    top = F.col("pos") == 0
    return sums.select(
        "conv",
        (F.col("pos") + 1).alias("depth"),
        pair(here, 0).alias("a"),
        pair(here, 2).alias("b"),
        F.when(top, F.lit(0)).otherwise(pair(before, 0)).alias("pa"),
        F.when(top, F.lit(0)).otherwise(pair(before, 2)).alias("pb"),
        "points",
        "n_turns",
    )


class Slots:
    """A minimal perfect hash of distinct pairs of 64-bit numbers: by levels, a pair that is alone in its place of a level's table
    takes it, others go on to the next; places are numbered over all levels. What sits in a slot is compared with what is asked for."""

    GAMMA = 2.0

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.n, self.levels = len(a), []
        self.a, self.b = np.empty(self.n, np.uint64), np.empty(self.n, np.uint64)
        left, base = np.arange(self.n), 0
        while len(left):
            size = max(2, int(self.GAMMA * len(left)))
            place = self._place(a[left], b[left], len(self.levels), size)
            alone = np.bincount(place, minlength=size) == 1
            rank = np.cumsum(alone) - 1 + base
            won = alone[place]
            slot = rank[place[won]]
            self.a[slot], self.b[slot] = a[left[won]], b[left[won]]
            self.levels.append((size, alone, rank))
            base, left = base + int(won.sum()), left[~won]

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        # a finalizer of multiplications and shifts over both halves and the level
        with np.errstate(over="ignore"):
            x = a ^ (b * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((level * 0xD1342543DE82EF95 + 1) % (1 << 64))
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slots of pairs; -1 for those that aren't in the table."""
        out, open_ = np.full(len(a), -1), np.arange(len(a))
        for level, (size, alone, rank) in enumerate(self.levels):
            place = self._place(a[open_], b[open_], level, size)
            hit = alone[place]
            out[open_[hit]] = rank[place[hit]]
            open_ = open_[~hit]
        found = out >= 0
        found[found] = (self.a[out[found]] == a[found]) & (self.b[out[found]] == b[found])
        return np.where(found, out, -1)


def accumulate(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, depth: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
    """Sums of values over the subtrees of nodes (a, b) with parents (pa_, pb): nodes take slots of a flat table, sums go from slot
    to parent's slot, deepest first. Parents that aren't among the nodes end the way up."""
    slots = Slots(a, b)
    at, parent = slots(a, b), np.empty(len(a), np.int64)
    parent[at] = slots(pa_, pb)
    flat = []
    for v in values:
        x = np.empty(len(a), np.int64)
        x[at] = v
        flat.append(x)
    depths = np.empty(len(a), np.int64)
    depths[at] = depth
    order = np.argsort(-depths, kind="stable")
    order = order[parent[order] >= 0]
    ends = np.flatnonzero(np.diff(depths[order])) + 1
    for level in np.split(order, ends):
        for x in flat:
            np.add.at(x, parent[level], x[level])
    return [x[at] for x in flat]


_KEY, _PARENT = ["a", "b"], ["pa", "pb"]
#: Columns of a node.
_NODE = ["conv_id", "depth", "a", "b", "pa", "pb", "n_convs", "n_children", "leaves", "saved"]


def _light(nodes: DataFrame, shards: int) -> DataFrame:
    """Subtrees of light shared nodes, summed shard by shard; ra, rb is the top of a node's subtree."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        as_u = lambda c: batch[c].to_numpy(np.int64).view(np.uint64)
        depth = batch["depth"].to_numpy(np.int64)
        values = [batch[c].to_numpy(np.int64) for c in ("leaves", "saved")]
        batch["leaves"], batch["saved"] = accumulate(as_u("a"), as_u("b"), as_u("pa"), as_u("pb"), depth, values)
        return batch[[*_NODE, "ra", "rb"]]

    schema = ", ".join(f"{c} bigint" for c in (*_NODE, "ra", "rb"))
    return nodes.withColumn("shard", F.pmod(F.xxhash64("ra", "rb"), F.lit(shards))).groupBy("shard").applyInPandas(run, schema)


def _heavy(nodes: DataFrame) -> DataFrame:
    """Sums over the trees of the heavy nodes by doubling: what lies less than 2^i levels below a node is known after round i."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    # the one node without turns is its own mark: nothing is above it
    here = nodes.withColumn("up", F.when(F.col("depth") > 0, F.struct(F.col("pa").alias("a"), F.col("pb").alias("b"))))
    span = 1
    while span <= deepest:
        here = materialize(here, "trie-heavy")
        add = here.where("up IS NOT NULL").groupBy("up.a", "up.b").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        next_up = here.select(F.col("a").alias("ua"), F.col("b").alias("ub"), F.col("up").alias("next_up"))
        later = here.join(add, _KEY, "left").join(next_up, (F.col("up.a") == F.col("ua")) & (F.col("up.b") == F.col("ub")), "left")
        sums = {c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "saved")}
        here = later.select(*(sums.get(c, F.col(c)).alias(c) for c in _NODE), F.col("next_up").alias("up"))
        span *= 2
    return here.select(*_NODE)


def _table(rows: list[tuple], *names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=list(names))


def _ends(rows: DataFrame, trie: Trie) -> DataFrame:
    """a, b and ends_sha256: of the conversations (conv, a, b) that end at a node, their ids in order and joined by commas.

    Ids are sorted over ranges; each range gives them as texts of bounded size, and only these meet at their node, where they go
    through the digest one after another: a task holds one text, however many conversations end at a node."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, size, out, held = None, [], 0, [], 0

        def flush() -> None:
            nonlocal ids, size, held
            if ids:
                out.append((*key, ids[0], ",".join(map(str, ids))))
                held += size + 64
                ids, size = [], 0

        for batch in batches:
            for conv, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, b) != key or size >= trie.text_bytes:
                    flush()
                    key = (a, b)
                    if held >= 8 * trie.text_bytes:
                        yield _table(out, "a", "b", "least", "ids")
                        out, held = [], 0
                ids.append(conv)
                size += 1 + len(str(conv))
        flush()
        if out:
            yield _table(out, "a", "b", "least", "ids")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for batch in batches:
            for a, b, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, b) == key:
                    state.update(b"," + ids.encode())
                else:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (a, b), hashlib.sha256(ids.encode())
            if len(out) > 5000:
                yield _table(out, "a", "b", "ends_sha256")
                out = []
        if key is not None:
            yield _table([*out, (*key, state.hexdigest())], "a", "b", "ends_sha256")

    texts = rows.select("conv", "a", "b").repartitionByRange("a", "b", "conv").sortWithinPartitions("a", "b", "conv")
    texts = texts.mapInArrow(join, "a bigint, b bigint, least bigint, ids string")
    return texts.repartition("a", "b").sortWithinPartitions("a", "b", "least").mapInArrow(fold, "a bigint, b bigint, ends_sha256 string")


def nodes(conversations: DataFrame, trie: Trie = Trie()) -> DataFrame:
    """The trie of rebuilt conversations (conv_id, turn, role, text; see rebuilt): a row per distinct sequence of first turns.

    conv_id (smallest member), depth, parent_conv_id (of the parent; null at the top), n_convs (members), n_children, n_leaves
    (childless nodes below or here), saved_tokens (over the subtree: members but one, times the code points of the node's last
    text), ends_sha256 (members that end here). Equal rows of a conversation are turns of their own. An empty table, or one
    without conv_ids, gives no node; other columns are not read.

    Nodes are told apart by 128-bit digests of prefixes. Of a node with one member nothing needs summing. Those with several make the
    tree that matters: its subtrees of at most trie.subtree rows go to shards, each a table of slots with flat arrays, and the tops
    of larger ones are summed by doubling. Rows of hot keys (a first turn that a third of all share, a conversation with a third
    of all turns) are counted before they move and salted where they meet."""
    turns = materialize(turns_in_order(conversations), "trie-turns")
    rows, convs = rebuilt(turns)
    rows, convs = materialize(prefixes(rows), "trie-prefixes"), materialize(convs, "trie-members")
    found = rows.groupBy(*_KEY).agg(
        F.min("conv").alias("conv_id"),
        F.min("depth").alias("depth"),
        F.min("pa").alias("pa"),
        F.min("pb").alias("pb"),
        F.count("*").alias("n_convs"),
        F.min("points").alias("points"),
        F.sum(F.col("n_turns") - F.col("depth") + 1).alias("weight"),
    )
    zero = F.lit(0).cast("long")
    top = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("n_turns") + 1).alias("weight")).where("n_convs > 0")
    top = top.select("*", *(zero.alias(c) for c in ("a", "b", "depth", "points")), *(F.lit(None).cast("long").alias(c) for c in _PARENT))
    found = materialize(found.unionByName(top), "trie-counts")

    # children are counted by parent, and the parent's member comes back to them, by salted pairs
    salted = found.where("depth > 0").groupBy(*_PARENT, (F.col("conv_id") % SALTS).alias("salt")).agg(F.count("*").alias("some"), F.count_if(F.col("n_convs") == 1).alias("single"))
    salted = materialize(salted.withColumnsRenamed({"pa": "a", "pb": "b"}), "trie-children")
    children = salted.groupBy(*_KEY).agg(F.sum("some").alias("n_children"), F.sum("single").alias("single"))
    parents = found.select(*_KEY, F.col("conv_id").alias("parent_conv_id"))
    back = salted.join(parents, _KEY).select(F.col("a").alias("pa"), F.col("b").alias("pb"), "salt", "parent_conv_id")
    full = found.join(children, _KEY, "left").withColumn("n_children", F.coalesce("n_children", zero)).withColumn("single", F.coalesce("single", zero))
    full = full.withColumn("leaves", F.col("single") + F.when(F.col("n_children") == 0, 1).otherwise(0)).withColumn("saved", (F.col("n_convs") - 1) * F.col("points"))
    full = full.withColumn("kind", F.expr(f"CASE WHEN depth = 0 OR n_convs > 1 AND weight > {trie.subtree} THEN 2 WHEN n_convs > 1 THEN 1 ELSE 0 END"))
    full = materialize(full.select(*_NODE, "kind"), "trie-nodes")

    # how far down a conversation's way is heavy; its next node is the top of a light subtree
    heavy = full.where("kind = 2")
    way = spread_join(rows.select("conv", "depth", *_KEY), heavy.where("depth > 0").select(*_KEY), _KEY, F.pmod("conv", F.lit(SALTS)))
    way = way.groupBy("conv").agg(F.max("depth").alias("heavy"))
    tops = rows.select("conv", "depth", *_KEY).join(way, "conv", "left").where("depth = coalesce(heavy, 0) + 1")
    tops = tops.select(F.col("conv").alias("conv_id"), F.col("a").alias("ra"), F.col("b").alias("rb"))
    light = spread_join(full.where("kind = 1"), tops, ["conv_id"], F.col("depth") % SALTS)
    shards = max(1, -(-full.where("kind = 1").count() // trie.shard))
    light = materialize(_light(light, shards), "trie-light")

    below = light.where("a = ra AND b = rb").groupBy(*_PARENT).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")).withColumnsRenamed({"pa": "a", "pb": "b"})
    heavy = heavy.join(below, _KEY, "left")
    sums = {c: F.col(c) + F.coalesce(f"more_{c}", zero) for c in ("leaves", "saved")}
    heavy = _heavy(heavy.select(*(sums.get(c, F.col(c)).alias(c) for c in _NODE)))

    single = full.where("kind = 0").select(*(F.when(F.lit(c == "leaves"), F.lit(1).cast("long")).otherwise(F.col(c)).alias(c) for c in _NODE))
    every = materialize(single.unionByName(light.select(*_NODE)).unionByName(heavy), "trie-sums").withColumn("salt", F.col("conv_id") % SALTS)
    ends = rows.where("depth = n_turns").select("conv", *_KEY).unionByName(convs.where("n_turns = 0").select("conv", zero.alias("a"), zero.alias("b")))
    out = every.join(back, [*_PARENT, "salt"], "left").join(_ends(ends, trie), _KEY, "left")
    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
