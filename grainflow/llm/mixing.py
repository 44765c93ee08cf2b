"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, materialize, text_of

#: Rows and bytes of source names up to which the table of sources is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 4_000_000


@dataclass(frozen=True)
class Mix:
    #: Weights of the sources by code point (null last), repeating.
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    #: Words of the mix as a share of all words.
    share: float = 1.5
    #: No source is taken more often than this.
    max_epochs: float = 2.0
    seed: int = 17


def word_count(text: str | Column) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds rank: 0, 1, ... by code point, null last. Sorted by range; only the partitions' row counts reach the driver."""
    ordered = sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id())
    ordered = materialize(ordered, "sources")
    part = F.shiftright("at", 33)
    before, starts = 0, []
    for p, n in sorted(tuple(r) for r in ordered.groupBy(part.alias("p")).count().collect()):
        starts.append((p, before))
        before += n
    if not starts:
        return ordered.select("source", "source_size", F.col("at").alias("rank"))
    first = F.create_map(*(F.lit(x) for pair in starts for x in pair))[part]
    return ordered.select("source", "source_size", (first + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank"))


def targets(sources: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """sources: (source, source_size), one row each. Adds target: words to take, by capped water-filling.

    Sources share share * (sum of sizes) by weight; one that would pass max_epochs times its size is clamped there and
    the excess is shared by weight among the others, round by round, until none is above. Each round is one aggregate;
    a source of size 0 gets 0. If share passes max_epochs, all are clamped."""
    weight = F.element_at(F.array(*map(F.lit, mix.weights)), (F.col("rank") % len(mix.weights) + 1).cast("int"))
    s = materialize(_ranked(sources).withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(mix.max_epochs))), "ranked")
    goal = mix.share * (s.agg(F.sum("source_size")).first()[0] or 0)
    level, done = 0.0, -1
    while True:
        capped = F.col("cap") <= F.col("weight") * level
        held, free, n = s.agg(F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("weight"))), F.count_if(capped)).first()
        if n == done or not free:
            level = level if free else math.inf
            break
        level, done = (goal - (held or 0.0)) / free, n
    share = F.col("cap") if math.isinf(level) else F.least(F.col("cap"), F.col("weight") * level)
    return s.select("source", "source_size", share.alias("target"))


def _boundary(sums: DataFrame, by: str) -> DataFrame:
    """sums: (source, by, words, extra). The row of each source in which the running sum passes extra, and what is left for it."""
    run = F.sum("words").over(W.partitionBy("source").orderBy(by).rowsBetween(W.unboundedPreceding, 0))
    return sums.withColumn("upto", run).where((F.col("upto") > F.col("extra")) & (F.col("upto") - F.col("words") <= F.col("extra"))).select("source", by, (F.col("extra") - F.col("upto") + F.col("words")).alias("extra"))


def _cut(df: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """An inner join in which a null source equals a null source."""
    right = small.select(*(F.col(c).alias(f"_{c}") for c in on), *(c for c in small.columns if c not in on))
    return df.join(right, [df[c].eqNullSafe(right[f"_{c}"]) for c in on]).drop(*(f"_{c}" for c in on))


def _order(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def taken(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: bool = False) -> DataFrame:
    """One row per row of docs: id_col, size, source_size, target, taken; with keep, the columns of docs and then whole, extra, taken.

    A source's documents are all taken floor(target / source_size) times; in the seeded order of their ids' MD5, documents
    are taken once more until the source's words equal its target (rounded to words), the last one in part. Rows that
    repeat an id and a size are cut evenly. A null text has size 0 and is taken 0 times; a null source is a source of its own,
    ranked last; an empty table gives an empty one. Columns of docs are not read but for those named."""
    own = {"size": word_count(F.col(text_col)), "source": F.col(source_col), "doc": F.col(id_col), "k": _order(F.col(id_col), mix.seed)}
    sized = materialize(docs.select(*(c.alias(n) for n, c in own.items())), "sizes")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), mix)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = sources.withColumn("whole", whole.cast("long"))
    sources = materialize(sources.withColumn("extra", F.round("target").cast("long") - F.col("whole") * F.col("source_size")), "targets")

    rows, names = sources.agg(F.count("*"), F.sum(F.coalesce(F.octet_length("source"), F.lit(0)))).first()
    few = rows <= BROADCAST_ROWS and (names or 0) <= BROADCAST_BYTES
    some = F.broadcast if few else lambda df: df

    # the document at which the extra words end: the bucket by the order's first byte, then its second, then the rows
    more = sources.where("extra > 0").select("source", "extra")
    one, two = F.substring("k", 1, 2), F.substring("k", 3, 2)
    first = _boundary(_cut(sized.groupBy("source", one.alias("b1")).agg(F.sum("size").alias("words")), some(more), ["source"]), "b1")
    in_first = _cut(sized.withColumn("b1", one), some(first), ["source", "b1"])
    second = _boundary(in_first.groupBy("source", two.alias("b2")).agg(F.sum("size").alias("words"), F.first("extra").alias("extra")), "b2")
    first2 = first.select("source", "b1").join(second.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    last = _cut(sized.withColumn("b1", one).withColumn("b2", two), some(first2), ["source", "b1", "b2"])
    last = last.groupBy("source", F.struct("k", "doc", "size").alias("row")).agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.first("extra").alias("extra"))
    cut = last.withColumn("upto", F.sum("words").over(W.partitionBy("source").orderBy("row").rowsBetween(W.unboundedPreceding, 0)))
    cut = cut.where((F.col("upto") > F.col("extra")) & (F.col("upto") - F.col("words") <= F.col("extra")))
    cut = cut.select(F.col("source").alias("_s"), F.col("row").alias("cut_row"), F.floor((F.col("extra") - F.col("upto") + F.col("words")) / F.col("n")).cast("long").alias("cut_extra"))
    params = materialize(sources.join(cut, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s", "extra"), "params")

    base = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc_row"), *(c.alias(n) for n, c in own.items())) if keep else sized
    p = params.withColumnRenamed("source", "_s")
    full = base.join(some(p), base["source"].eqNullSafe(p["_s"]))
    here = F.struct("k", "doc", "size")
    extra = F.when(F.col("cut_row").isNull() | (here > F.col("cut_row")), F.lit(0)).when(here < F.col("cut_row"), F.col("size")).otherwise(F.col("cut_extra"))
    # no boundary row although words are left over: all of the source is taken once more
    everything = F.col("cut_row").isNull() & (F.round("target").cast("long") - F.col("whole") * F.col("source_size") >= F.col("source_size")) & (F.col("source_size") > 0)
    extra = F.when(everything, F.col("size")).otherwise(extra).cast("long")
    full = full.withColumn("extra", extra).withColumn("taken", F.col("whole") * F.col("size") + F.col("extra"))
    if keep:
        return full.select("doc_row", "whole", "size", "extra", "taken")
    return full.select(F.col("doc").alias(id_col), "size", "source_size", "target", "taken")


def prefix_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    words, gaps = F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.split(text, WORD, -1)
    total = lambda a: F.aggregate(F.slice(a, 1, n.cast("int")), F.lit(0), lambda x, w: x + F.length(w))
    return F.substring(text, F.lit(1), total(words) + total(gaps))


def mixed(docs: DataFrame, mix: Mix = Mix(), **cols: str) -> DataFrame:
    """The mix itself, with the columns of docs: each document as often as it is taken whole, and the one that ends a source's
    fractional repetition once more up to its last word taken. n_chars, if there is one, follows the text."""
    text = cols.get("text_col", "text")
    t = taken(docs, mix, keep=True, **cols)
    part = (F.col("extra") > 0) & (F.col("extra") < F.col("size"))
    times = F.col("whole") + F.when((F.col("extra") > 0) & ~part, 1).otherwise(0)
    kinds = F.concat(F.array_repeat(F.lit(False), times.cast("int")), F.when(part, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
    t = t.where("size > 0").withColumn("in_part", F.explode(kinds))
    out = t.select("doc_row.*", F.col("in_part").alias("__in_part"), F.col("extra").alias("__extra"))
    out = out.withColumn(text, F.when(F.col("__in_part"), prefix_words(F.col(text), F.col("__extra"))).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__in_part"), F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*(f"`{c}`" for c in docs.columns))
