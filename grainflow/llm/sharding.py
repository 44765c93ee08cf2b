"""Shards of near equal bytes: groups of equal texts stay together and are cut, in one order, at the smallest capacity that does."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainflow.functions.ranks import running_sums

from .common import discard, materialize, spread_join, text_of

SALTS = 64


@dataclass(frozen=True)
class Shards:
    """count: shards. row_bytes: what a row weighs besides its text. large: groups of at least this share of a shard's mean come
    first in the order, so that what is cut last is fine. points: ranges of the groups' running sums that the driver holds
    at once, whatever the number of groups."""

    count: int = 40
    row_bytes: int = 16
    large: float = 0.125
    points: int = 1 << 16


def size_of(text: Column, shards: Shards = Shards()) -> Column:
    return F.octet_length(text_of(text)).cast("long") + shards.row_bytes


class Sums:
    """What the driver knows of ascending running sums that Spark holds: ranges with their smallest and largest sum and their number.

    A question whose answer lies inside a range gives bounds and marks the range; refine() looks into marked ranges, whole where
    these hold few sums, or else in finer ranges."""

    def __init__(self, table: DataFrame, total: int, points: int):
        self.table, self.total, self.points = table, total, points
        self.ranges = self._look([(1, total)], total // points + 1)
        self.marked: set[int] = set()
        self._index()

    def _look(self, spans: list[tuple[int, int]], width: int) -> list[tuple[int, int, int]]:
        inside = F.lit(False)
        start = F.lit(None).cast("long")
        for a, b in spans:
            inside = inside | F.col("upto").between(a, b)
            start = F.when(F.col("upto").between(a, b), a).otherwise(start)
        rows = self.table.where(inside).select("upto", start.alias("start"))
        found = rows.groupBy("start", F.expr(f"(upto - start) div {width}").alias("part")).agg(F.min("upto").alias("least"), F.max("upto").alias("most"), F.count("*").alias("n"))
        return sorted((r["least"], r["most"], r["n"]) for r in found.select("least", "most", "n").collect())  # about `points` rows

    def _index(self) -> None:
        self.least, self.most = [r[0] for r in self.ranges], [r[1] for r in self.ranges]

    def below(self, x: int) -> tuple[int, int]:
        """Bounds of the largest sum up to x; 0 if there is none."""
        j = bisect_right(self.least, x) - 1
        if j < 0:
            return 0, 0
        a, b, n = self.ranges[j]
        if x >= b or n <= 2:
            return (b, b) if x >= b else (a, a)
        self.marked.add(j)
        return a, min(x, b - 1)

    def above(self, x: int) -> tuple[int, int]:
        """Bounds of the smallest sum from x on; the total if there is none."""
        j = bisect_left(self.most, x)
        if j == len(self.ranges):
            return self.total, self.total
        a, b, n = self.ranges[j]
        if x <= a or n <= 2:
            return (a, a) if x <= a else (b, b)
        self.marked.add(j)
        return max(x, a + 1), b

    def mark(self, x: int, y: int) -> None:
        """Marks the ranges that hold unknown sums from x to y."""
        for j in range(bisect_left(self.most, x), bisect_right(self.least, y)):
            if self.ranges[j][2] > 2:
                self.marked.add(j)

    def refine(self) -> None:
        marked = sorted(self.marked)
        held = sum(self.ranges[j][2] for j in marked)
        spans: list[list[int]] = []
        for j in marked:
            a, b, _ = self.ranges[j]
            if spans and spans[-1][2] == j - 1:
                spans[-1][1:] = [b, j]
            else:
                spans.append([a, b, j])
        # finer than before in any case
        widest = max(self.ranges[j][1] - self.ranges[j][0] for j in marked)
        width = 1 if held <= self.points else min(sum(b - a for a, b, _ in spans) // self.points + 1, max(1, widest // 2))
        new = self._look([(a, b) for a, b, _ in spans], width)
        self.ranges = sorted([*(r for j, r in enumerate(self.ranges) if j not in self.marked), *new])
        self.marked = set()
        self._index()


def fits(sums: Sums, capacity: int, count: int, bound: int) -> list[int]:
    """The greedy cuts at a capacity, each as late as it allows; by the lower (0) or upper (1) bounds of what is known. All is
    placed if the last is the total."""
    cuts, at = [], 0
    for _ in range(count):
        at = sums.below(at + capacity)[bound]
        cuts.append(at)
        if at >= sums.total:
            break
    return cuts


def capacity_of(sums: Sums, largest: int, count: int) -> int:
    """The smallest capacity at which count shards hold all groups in their order: a binary search with greedy checks. Where what is
    known doesn't decide, the ranges that the cuts may fall into are looked into."""

    def smallest(bound: int, low: int, high: int) -> int:
        while low < high:
            mid = (low + high) // 2
            if fits(sums, mid, count, bound)[-1] >= sums.total:
                high = mid
            else:
                low = mid + 1
        return low

    least = max(largest, -(-sums.total // count))
    while True:
        low = smallest(1, least, sums.total)
        high = smallest(0, low, sums.total)
        sums.marked = set()
        if low == high:
            return low
        for a, b in zip(fits(sums, low, count, 0), fits(sums, high, count, 1), strict=False):
            sums.mark(a, b)
        sums.refine()


def cuts_of(sums: Sums, capacity: int, count: int) -> list[int]:
    """The count - 1 cuts: each is the bound of a group next to an equal share of what is left, as far as the capacity lets the rest
    fit in; the smaller of two as near."""
    total = sums.total
    while True:
        sums.marked = set()
        earliest = [total]  # from the back: where a shard may start at the earliest if the rest is to fit
        for _ in range(count - 1):
            earliest.append(sums.above(earliest[-1] - capacity)[0] if earliest[-1] > capacity else 0)
        earliest.reverse()
        cuts, at = [], 0
        for k in range(1, count):
            rest, left = count - k + 1, total - at
            near, far = sums.below(at + left // rest)[0], sums.above(at + left // rest + 1)[0]
            cut = far if near <= at or 2 * left > (near + far - 2 * at) * rest else near
            at = min(max(cut, earliest[k]), sums.below(at + capacity)[0])
            cuts.append(at)
        if not sums.marked:
            return cuts
        sums.refine()


def _groups(slim: DataFrame, shards: Shards) -> tuple[DataFrame, list[int]]:
    """The groups of equal texts (digest, upto, n, shard) and the rows before each shard."""
    groups = materialize(slim.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.sum("size").alias("bytes")), "shard-groups")
    total, largest = groups.agg(F.sum("bytes"), F.max("bytes")).first()
    if not total:
        return groups.select("digest", F.lit(0).cast("long").alias("upto"), F.lit(0).alias("shard")), [0] * shards.count
    large = F.when(F.col("bytes") >= int(shards.large * total / shards.count), -F.col("bytes")).otherwise(0)
    placed = running_sums(groups.withColumn("large", large), [], [F.col("large"), F.col("first").asc_nulls_last(), F.col("digest")], {"upto": F.col("bytes")})
    placed = materialize(placed.select("digest", "n", "upto"), "shard-sums")
    sums = Sums(placed.select("upto"), total, shards.points)
    cuts = cuts_of(sums, capacity_of(sums, largest, shards.count), shards.count)
    shard = sum(((F.col("upto") > c).cast("int") for c in cuts), F.lit(0))
    placed = placed.withColumn("shard", shard)
    rows = {r["shard"]: r["rows"] for r in placed.groupBy("shard").agg(F.sum("n").alias("rows")).collect()}  # a row per shard
    before = [sum(rows.get(j, 0) for j in range(k)) for k in range(shards.count)]
    discard(groups)
    return placed.select("digest", "upto", "shard"), before


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text_of(text), 256))


def assign(docs: DataFrame, shards: Shards = Shards(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Puts every row into a shard: id, size (UTF-8 bytes of the text, null none, and row_bytes), text_crc32 (null as empty), shard
    and slot, the row's place in its shard from 0.

    Rows with equal texts are one group and go together (null and empty texts are equal). Groups of an eighth of a shard's
    mean (`large`) or more come first, largest first, then the others by smallest id (null last; ties by digest). Of all ways to cut that order into count
    runs, the largest run is as small as it can be; within this capacity each shard takes what is next to an equal share of the rest.
    Fewer groups than shards leave shards empty; an empty table gives an empty one; other columns are not read. Slots follow the
    groups' order, then ids (null first); rows that repeat wholly take neighbouring slots.

    The driver holds at most about `points` ranges of running sums; groups and ranks are spread over ranges, rows of a large group by salt."""
    text = F.col(text_col)
    slim = docs.select(F.col(id_col).alias("id"), size_of(text, shards).alias("size"), F.crc32(text_of(text).cast("binary")).alias("text_crc32"), digest_of(text).alias("digest"))
    slim = materialize(slim, "shard-rows")
    groups, before = _groups(slim, shards)
    placed = spread_join(slim, groups, ["digest"], F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    out = running_sums(placed, [], [F.col("upto"), F.col("id").asc_nulls_first()], {"rank": F.lit(1)})
    start = F.element_at(F.lit(before).cast("array<bigint>"), F.col("shard") + 1)
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("rank") - 1 - start).alias("slot"))


def write(docs: DataFrame, folder: str, shards: Shards = Shards(), pieces: int = 16, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes docs below folder, a folder for each shard of assign (shard=0 and so on, or shard_=0 where docs
    have such a column) with about `pieces` files."""
    name = "shard"
    while name in docs.columns:
        name += "_"
    digest = digest_of(F.col(text_col))
    slim = materialize(docs.select(F.col(id_col).alias("id"), size_of(F.col(text_col), shards).alias("size"), digest.alias("digest")), "shard-rows")
    groups, _ = _groups(slim, shards)
    salt = F.pmod(F.xxhash64(*docs.columns), F.lit(SALTS))
    rows = docs.withColumn("__digest", digest).withColumn("__piece", F.pmod(salt, F.lit(pieces)))
    found = spread_join(rows, groups.select(F.col("digest").alias("__digest"), F.col("shard").alias("__shard")), ["__digest"], salt)
    found = found.repartition("__shard", "__piece").drop("__digest", "__piece")
    found.select(*docs.columns, F.col("__shard").alias(name)).write.partitionBy(name).parquet(folder)
