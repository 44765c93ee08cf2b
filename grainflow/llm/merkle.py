"""Merkle manifest of a dataset: a tree per key over ordered rows, a tree of their roots above, and a proof for every row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainflow.functions.ranks import ranked

from .common import discard, materialize, spread_join

# What stands for a null, and for a key that is null or not; a null key sorts first by them.
NULL, NO_KEY, KEY = "-", "-", "="


@dataclass(frozen=True)
class Tree:
    """fanout: consecutive nodes under one parent; chunk_levels: levels that one block of rows covers by itself, so that a block
    holds fanout ** chunk_levels rows, and no group of the exchange above more than fanout blocks."""

    fanout: int = 2
    chunk_levels: int = 9

    @property
    def chunk(self) -> int:
        return self.fanout**self.chunk_levels


def leaf_of(columns: Sequence[str | Column]) -> Column:
    """The digest of a row: lowercase hex SHA-256 over its values, each a dash if null, else its UTF-8 bytes' number, a colon and itself."""

    def one(c: str | Column) -> Column:
        s = (F.col(c) if isinstance(c, str) else c).cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit(NULL))

    return F.sha2(F.concat(*map(one, columns)), 256)


def parent_of(children: Sequence[bytes]) -> bytes:
    """The digest of a run of nodes, over their digests in hex."""
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def levels_of(n: int, fanout: int) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def subtree(leaves: list[bytes], levels: int, fanout: int) -> list[list[bytes]]:
    """The nodes of each level over aligned leaves, from the leaves on."""
    out = [leaves]
    for _ in range(levels):
        below = out[-1]
        out.append([parent_of(below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return out


def run_of(nodes: list[bytes], i: int, fanout: int) -> tuple[list[bytes], list[bytes]]:
    """A node's siblings before and after it."""
    a = i - i % fanout
    return nodes[a:i], nodes[i + 1 : a + fanout]


def fold(leaf: bytes, proof: Sequence[tuple[Sequence[bytes], Sequence[bytes]]]) -> bytes:
    """The root that a leaf gives with the siblings of each level (those before it, those after it)."""
    for before, after in proof:
        leaf = parent_of([*before, leaf, *after])
    return leaf


#: Salts that the blocks of a key are dealt by where they meet a row of it.
SALTS = 64
STEPS = "array<struct<before: array<binary>, after: array<binary>>>"


def _blocks(leaves: DataFrame, tree: Tree) -> DataFrame:
    """leaves: key, pos (from 0, without gaps), leaf and any others. Returns a row per aligned block of a key: its rows by position."""
    rows = F.sort_array(F.collect_list(F.struct("pos", *(c for c in leaves.columns if c not in ("key", "pos")))))
    return leaves.withColumn("block", F.expr(f"pos div {tree.chunk}")).groupBy("key", "block").agg(rows.alias("rows"))


def _nodes(block: int, leaves: list[bytes], tree: Tree) -> list[list[bytes]]:
    """The nodes of a block by level: of a first block that isn't full up to its single root, of others over all levels of a block."""
    return subtree(leaves, tree.chunk_levels if block else levels_of(len(leaves), tree.fanout), tree.fanout)


def _roots(blocks: DataFrame, tree: Tree) -> DataFrame:
    """Each block's own root: key, block, node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = [_nodes(b, rows.values.field("leaf").to_pylist(), tree)[-1][0] for b, rows in zip(batch.column(1).to_pylist(), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(roots, pa.binary())], names=["key", "block", "node"])

    return blocks.select("key", "block", F.transform("rows", lambda x: F.struct(x["leaf"].alias("leaf"))).alias("rows")).mapInArrow(run, "key string, block bigint, node binary")


def _exchange(roots: DataFrame, tree: Tree) -> DataFrame:
    """The butterfly over blocks (key, block, node): each acquires the siblings above it (proof, by level) and its key's root (node).

    In a round the blocks whose numbers differ in one digit to the base fanout swap the roots of the subtrees that they stand for so
    far, and each hashes the parent for itself, so that nothing has to come down again; a group never has more than fanout blocks,
    however large the subtrees are. Where the last subtree lacks a member for a group, its first block speaks there too."""
    f = tree.fanout
    roots = materialize(roots, "merkle-roots")
    counts = materialize(roots.groupBy("key").agg(F.count("*").alias("blocks")), "merkle-counts")
    most = counts.agg(F.max("blocks")).first()[0] or 0
    here = spread_join(roots, counts, ["key"], F.col("block") % SALTS).withColumn("proof", F.array().cast(STEPS))
    span, rounds = 1, 0
    while span < most:
        lane, sub, last = f"block % {span}", f"block div {span}", f"(blocks - 1) div {span}"
        has = f"(blocks - {last} * {span})"  # members of the last subtree
        absent = F.expr(f"block = {last} * {span} AND ({last}) % {f} > 0 AND {has} < {span}")
        lanes = F.concat(F.array(F.expr(lane)), F.when(absent, F.expr(f"sequence({has}, {span - 1}L)")).otherwise(F.array().cast("array<bigint>")))
        said = here.withColumn("sub", F.expr(sub)).withColumn("lane", F.explode(lanes))
        member = F.when(F.col("lane") == F.expr(lane), F.struct("block", "blocks", "proof", "sub"))
        met = said.groupBy("key", F.expr(f"sub div {f}").alias("top"), "lane").agg(
            F.sort_array(F.collect_list(F.struct("sub", "node"))).alias("nodes"), F.collect_list(member).alias("members")
        )
        each = met.select("key", "nodes", F.explode("members").alias("m")).select("key", "nodes", "m.*")
        part = lambda keep: F.transform(F.filter("nodes", keep), lambda x: x["node"])
        parent = F.unhex(F.sha2(F.array_join(F.transform("nodes", lambda x: F.lower(F.hex(x["node"]))), ""), 256))
        step = F.struct(part(lambda x: x["sub"] < F.col("sub")).alias("before"), part(lambda x: x["sub"] > F.col("sub")).alias("after"))
        on = F.expr(f"blocks > {span}")  # else the key's root is reached
        here = each.select(
            "key",
            "block",
            "blocks",
            F.when(on, parent).otherwise(F.element_at("nodes", 1)["node"]).alias("node"),
            F.when(on, F.concat("proof", F.array(step))).otherwise(F.col("proof")).alias("proof"),
        )
        span, rounds = span * f, rounds + 1
        if rounds % 6 == 0:
            here = materialize(here, "merkle-round")
    out = materialize(here.select("key", "block", "node", "proof"), "merkle-upper")
    discard(roots, counts)
    return out


def _places(rows: DataFrame, keys: list[str], order: list[Column], tree: Tree) -> tuple[DataFrame, DataFrame]:
    """The blocks of rows in their order (key, block, rows), and for each block the proof above it and the root of its key."""
    at = ranked(rows, keys, order, "pos").withColumn("pos", F.col("pos").cast("long") - 1)
    blocks = materialize(_blocks(at if keys else at.withColumn("key", F.lit("")), tree), "merkle-blocks")
    return blocks, _exchange(_roots(blocks, tree), tree)


def build(rows: DataFrame, key: str | Column, order: list[str | Column], columns: list[str | Column], tree: Tree = Tree(), carry: dict[str, Column] | None = None) -> DataFrame:
    """The manifest of rows as blocks; see proofs and digests.

    Rows with one key are a tree: leaves, the digests of columns, ascend by order (nulls first; ties by digest, so that rows that
    repeat are neighbours), and each run of fanout nodes becomes one until one is left; an odd node at the end is a run of its own. The
    roots, by key (null first, then by UTF-8 bytes), are the leaves of one more tree. carry: further columns to keep, by name, none of them
    one of key, pos, leaf, block.

    Returns a row per block of at most fanout ** chunk_levels leaves: rows, the siblings above (upper), subroot and root. An empty
    table gives none. A key, or all rows, may be of any size: ranks are counted over ranges, a task holds blocks, and the blocks
    of a key swap roots in groups of fanout."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    kept = {f"__{k}": v for k, v in (carry or {}).items()}
    name = as_col(key).cast("string")
    leaves = rows.select(
        F.coalesce(F.concat(F.lit(KEY), name), F.lit(NO_KEY)).alias("key"),
        F.unhex(leaf_of(columns)).alias("leaf"),
        *(as_col(c).alias(f"__order{i}") for i, c in enumerate(order)),
        *(v.alias(k) for k, v in kept.items()),
    )
    by = [F.col(f"__order{i}").asc_nulls_first() for i in range(len(order))]
    # rows that are the same but for what is carried
    rest = [F.col(k).asc_nulls_first() for k in kept]
    blocks, upper = _places(leaves, ["key"], [*by, F.col("leaf"), *rest], tree)
    tops, above = _places(upper.where("block = 0").select(F.col("key").alias("name"), F.col("node").alias("leaf")), [], [F.col("name")], tree)
    inner = _expanded(tops.join(above, ["key", "block"]).withColumnRenamed("proof", "upper"), tree, "name string")
    keys = inner.select(F.col("name").alias("key"), F.col("node").alias("root"), F.col("steps").alias("__top"))
    whole = spread_join(upper, keys, ["key"], F.col("block") % SALTS)
    whole = whole.select("key", "block", F.col("node").alias("subroot"), "root", F.concat("proof", "__top").alias("upper"))
    return blocks.join(whole, ["key", "block"])


def _run(nodes: list[list[bytes]], i: int, fanout: int) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """The siblings of leaf i in its block, by level."""
    for level in nodes[:-1]:
        a = i - i % fanout
        yield level[a:i], level[i + 1 : a + fanout]
        i //= fanout


def _expanded(blocks: DataFrame, tree: Tree, carried: str) -> DataFrame:
    """Blocks of few rows with their proofs as steps: the carried column, node and steps."""
    name = carried.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, nodes, steps = [], [], []
            for block, rows, node, upper in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                levels = _nodes(block, [r["leaf"] for r in rows], tree)
                for i, r in enumerate(rows):
                    names.append(r[name])
                    nodes.append(node)
                    steps.append([{"before": b, "after": a} for b, a in _run(levels, i, tree.fanout)] + upper)
            kind = pa.list_(pa.struct([("before", pa.list_(pa.binary())), ("after", pa.list_(pa.binary()))]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(nodes, pa.binary()), pa.array(steps, kind)], names=[name, "node", "steps"])

    return blocks.select("block", "rows", "node", "upper").mapInArrow(run, f"{carried}, node binary, steps {STEPS}")


def _per_leaf(built: DataFrame, tree: Tree, carried: list[str], kinds: dict[str, tuple[str, pa.DataType]], make) -> DataFrame:
    """A row per leaf: the carried columns, leaf, pos, subroot and root in hex, and what make gives for a block as lists by name."""
    kept = [f"__{k}" for k in carried]
    fields = {f.name: f.dataType.simpleString() for f in built.schema["rows"].dataType.elementType.fields}
    outer = built.select("block", "rows", "upper", "subroot", "root", "key")
    names = [*carried, "key", "pos", "leaf", "subroot", "root", *kinds]
    schema = ", ".join([*(f"`{k}` {fields[f'__{k}']}" for k in carried), "key string", "pos bigint", "leaf string", "subroot string", "root string", *(f"{k} {t}" for k, (t, _) in kinds.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                rows, n = one.column(1).flatten(), len(one.column(1)[0])
                block, upper, subroot, root, key = (one.column(j)[0].as_py() for j in (0, 2, 3, 4, 5))
                leaves = rows.field("leaf").to_pylist()
                made = make(_nodes(block, leaves, tree), rows, [(s["before"], s["after"]) for s in upper])
                same = [pa.array([v] * n, pa.string()) for v in (subroot.hex(), root.hex())]
                arrays = [*(rows.field(k) for k in kept), pa.array([None if key == NO_KEY else key[1:]] * n, pa.string()), rows.field("pos"), pa.array([x.hex() for x in leaves], pa.string())]
                yield pa.RecordBatch.from_arrays([*arrays, *same, *(pa.array(made[k], t) for k, (_, t) in kinds.items())], names=names)

    return outer.mapInArrow(run, schema)


def proofs(built: DataFrame, tree: Tree, carried: list[str]) -> DataFrame:
    """The manifest by row: the carried columns, key, pos, leaf, subroot, root (hex) and proof: of each level from the leaf up the
    siblings before and after it; see verified."""
    kind = pa.list_(pa.struct([("before", pa.list_(pa.binary())), ("after", pa.list_(pa.binary()))]))

    def make(nodes, rows, upper):
        above = [{"before": b, "after": a} for b, a in upper]
        return {"proof": [[{"before": b, "after": a} for b, a in _run(nodes, i, tree.fanout)] + above for i in range(len(nodes[0]))]}

    return _per_leaf(built, tree, carried, {"proof": (STEPS, kind)}, make)


def digests(built: DataFrame, tree: Tree, carried: list[str], claimed: str) -> DataFrame:
    """The manifest by row with a digest of its proof (proof_sha256: over all siblings, level by level, left to right) and the root
    that its claimed leaf (a carried binary column; null: the leaf itself) folds to (folded_root)."""

    def make(nodes, rows, upper):
        out = {"proof_sha256": [], "folded_root": []}
        for i, (leaf, other) in enumerate(zip(nodes[0], rows.field(f"__{claimed}").to_pylist(), strict=True)):
            steps = [*_run(nodes, i, tree.fanout), *upper]
            out["proof_sha256"].append(hashlib.sha256("".join(x.hex() for b, a in steps for x in (*b, *a)).encode()).hexdigest())
            out["folded_root"].append(fold(leaf if other is None else other, steps).hex())
        return out

    kinds = {"proof_sha256": ("string", pa.string()), "folded_root": ("string", pa.string())}
    return _per_leaf(built, tree, [c for c in carried if c != claimed], kinds, make)


def verified(manifest: DataFrame, leaf: Column) -> DataFrame:
    """A manifest of proofs with folded_root, the root that leaf (hex) gives with the row's proof, and verified: whether it is the root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                None if x is None else fold(bytes.fromhex(x), [(s["before"], s["after"]) for s in p]).hex()
                for x, p in zip(batch.column("__leaf").to_pylist(), batch.column("proof").to_pylist(), strict=True)
            ]
            kept = [c for c in batch.schema.names if c != "__leaf"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.string())], names=[*kept, "folded_root"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in manifest.schema.fields), "folded_root string"])
    return manifest.withColumn("__leaf", leaf).mapInArrow(run, schema).withColumn("verified", F.col("folded_root").eqNullSafe(F.col("root")))


#: Columns of a document's leaf, in their order.
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def audit(docs: DataFrame, tampered: Column, tree: Tree = Tree()) -> DataFrame:
    """Manifest of documents by lang and doc_id, checked against rows whose n_chars is one more where tampered holds: doc_id, leaf,
    subroot, root, proof_sha256, folded_root, verified. Rows that repeat are leaves of their own; nulls are as build states."""
    other = F.unhex(leaf_of([F.col(c) + 1 if c == "n_chars" else c for c in COLUMNS]))
    carry = {"doc_id": F.col("doc_id"), "claimed": F.when(tampered & F.col("n_chars").isNotNull(), other)}
    built = build(docs, "lang", ["doc_id"], COLUMNS, tree, carry)
    found = digests(built, tree, ["doc_id", "claimed"], "claimed")
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
