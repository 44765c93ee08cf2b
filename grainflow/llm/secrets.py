"""Secret scans, in DataFrame and SQL functions only: base patterns, and character Markov models that add spans."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of

#: The base patterns by kind, each with the group whose length counts and the least length.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: What comes before the sign in an assign match.
HEAD = r"""^[A-Za-z_]+["']?\x20*"""
KINDS = ("assign", "access", "hex", "markov")
#: A failing access or hex match can't hide a passing one (both take the whole run), so their least lengths are in the pattern.
ACCESS, HEX = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
LEAST_VALUE = 12

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Runs that the Markov models look at.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Runs that are taken for ordinary identifiers in training, once base spans are cut out.
IDENTIFIER = r"[A-Za-z0-9+/_=-]{6,}"

SPAN = "struct<s:int,k:int,e:int>"


@dataclass(frozen=True)
class Fit:
    """The models are fitted on a bounded sample of rows, the first by a hash of their ids; the scan covers all rows."""

    max_docs: int = 8000
    #: Added to the count of each character.
    smooth: float = 0.5
    #: Transitions from a character, as many as this, that are taken to go by the characters' shares alone.
    prior: float = 5.0
    #: Share of random strings in which all characters are alike, whatever the sample's are made of.
    even: float = 0.5
    #: Documents of the sample that hold a run before it counts as an ordinary identifier.
    common: int = 2
    #: A candidate is a secret if its log-likelihood ratio (nats) and the ratio per character reach these.
    total: float = 15.0
    each: float = 0.6


#: Elements that are folded at a time: a running fold costs each element a copy of its piece, not of all before it.
PIECE = 64


def _before(items: Column, value: Callable[[Column], Column], fold: Callable[[Column, Column], Column]) -> Column:
    """For each item the fold of the values before it, from 0, as an array of ints."""
    last = F.floor((F.size(items) - 1) / PIECE).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * PIECE + 1, PIECE))

    def running(part: Column, start: Column, of: Callable[[Column], Column]) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, zero, lambda acc, x: F.struct(fold(acc["at"], of(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    totals = F.transform(pieces, lambda p: F.aggregate(p, F.lit(0), lambda acc, x: fold(acc, value(x))))
    each = F.flatten(F.zip_with(pieces, running(totals, F.lit(0), lambda x: x), lambda p, start: running(p, start, value)))
    return F.when(F.size(items) > 0, each).otherwise(F.array().cast("array<int>"))


def _runs(text: Column, pattern: str, kind: int) -> Column:
    """Array of spans of the pattern's leftmost non-overlapping matches; the gaps between matches give their offsets."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    # the last gap has no match after it
    sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, f: F.struct(F.length(g).alias("g"), F.length(f).alias("f")))
    spans = lambda x: F.zip_with(x, _before(x, lambda y: y["g"] + y["f"], lambda p, q: p + q), lambda y, at: F.struct((at + y["g"]).alias("s"), F.lit(kind).alias("k"), (at + y["g"] + y["f"]).alias("e")))
    made = F.element_at(F.transform(F.array(sizes), spans), 1)  # sizes is made once
    return F.when(text.rlike(pattern), made).otherwise(F.array().cast(f"array<{SPAN}>"))


def _assigns(text: Column) -> Column:
    """As _runs for assign, with a cheap test first; the values are cut from the matches, not searched again."""
    tail = r"[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$"
    spans = F.filter(
        _runs(text, ASSIGN, 0),
        lambda x: F.length(F.regexp_extract(F.substring(text, x["s"] + 1, x["e"] - x["s"]), HEAD + tail, 1)) >= LEAST_VALUE,
    )
    return spans


def base_spans(text: Column) -> Column:
    """All base spans of a text as an array of (s, k, e), by start and then kind; code points, end exclusive."""
    return F.array_sort(F.concat(_assigns(text), _runs(text, ACCESS, 1), _runs(text, HEX, 2)))


def _beyond(spans: Column, base: Column) -> Column:
    """The spans that no base span covers alone."""
    return F.filter(spans, lambda x: ~F.exists(base, lambda b: (b["s"] <= x["s"]) & (x["e"] <= b["e"])))


def _outside(span: Column, base: Column) -> Column:
    """The parts of a span that lie in no base span; base is in order of starts."""
    zero = F.struct(span["s"].alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
    part = lambda s, e: F.array(F.struct(s.alias("s"), span["k"].alias("k"), e.alias("e")))

    def step(acc: Column, b: Column) -> Column:
        out = F.when(b["s"] > acc["at"], F.concat(acc["out"], part(acc["at"], b["s"]))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], b["e"]).alias("at"), out.alias("out"))

    end = lambda acc: F.when(acc["at"] < span["e"], F.concat(acc["out"], part(acc["at"], span["e"]))).otherwise(acc["out"])
    return F.aggregate(F.filter(base, lambda b: (b["s"] < span["e"]) & (span["s"] < b["e"])), zero, step, end)


def train(docs: DataFrame, fit: Fit = Fit(), id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """The table of log-likelihood ratios "random string : ordinary identifier" of each transition of ALPHABET.

    Labelled samples: base matches' values are random strings; runs like identifiers that touch no base span and that several
    documents share are ordinary ones, each counted once. Only the len(ALPHABET) squared counts reach the driver. Without any text the table is all zeros and
    nothing is added by it."""
    n = len(ALPHABET)
    chosen = docs.select(F.col(id_col).alias("k")).where("k is not null").distinct().orderBy(F.xxhash64(F.lit(11), "k"), "k").limit(fit.max_docs)
    sample = docs.select(F.col(id_col).alias("k"), text_of(text_col).alias("t")).join(F.broadcast(chosen), "k").select("t")  # bounded
    sample = materialize(sample.withColumn("base", base_spans(F.col("t"))), "secret-sample")
    cut = F.substring(F.col("t"), F.col("x.s") + 1, F.col("x.e") - F.col("x.s"))
    value = F.when(F.col("x.k") == 0, F.regexp_extract(cut, HEAD + r"[:=]\x20*[\"']?(.*)$", 1)).otherwise(cut)
    random = sample.select("t", F.explode("base").alias("x")).select(F.lit(1).alias("label"), value.alias("w"))
    rest = masked(F.col("t"), F.col("base"), mark=" ")
    runs = sample.select(F.explode(F.array_distinct(F.regexp_extract_all(rest, F.lit(IDENTIFIER), F.lit(0)))).alias("w")).groupBy("w").count()
    ordinary = runs.where(F.col("count") >= fit.common).select(F.lit(0).alias("label"), "w")
    pairs = random.unionByName(ordinary).where(F.length("w") > 1)
    pairs = pairs.select("label", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring(F.col("w"), i, F.lit(2)))).alias("ab"))
    counts = {(r["label"], r["ab"]): r["n"] for r in pairs.where(F.col("ab").rlike("^[A-Za-z0-9+/_=-]{2}$")).groupBy("label", "ab").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [0.0] * (n * n)
    def model(label: int) -> list[float]:
        to = {b: sum(counts.get((label, a + b), 0) for a in ALPHABET) + fit.smooth for b in ALPHABET}
        share, of = {b: x / sum(to.values()) for b, x in to.items()}, {a: sum(counts.get((label, a + b), 0) for b in ALPHABET) for a in ALPHABET}
        return [(counts.get((label, a + b), 0) + fit.prior * share[b]) / (of[a] + fit.prior) for a in ALPHABET for b in ALPHABET]

    return [math.log((fit.even / n + (1 - fit.even) * p) / q) for p, q in zip(model(1), model(0), strict=True)]


def _ratio(word: Column, table: list[float]) -> Column:
    """The log-likelihood ratio of a word of ALPHABET: the sum over its pairs of characters."""
    weights, n = F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>"), len(ALPHABET)
    places = F.transform(F.split(word, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    pairs = lambda p: F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), lambda a, b: F.element_at(weights, (a - 1) * n + b))
    return F.aggregate(F.element_at(F.transform(F.array(places), pairs), 1), F.lit(0.0), lambda acc, w: acc + w)


def scan(docs: DataFrame, table: list[float], fit: Fit = Fit(), id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """One row per row of docs: id_col, base and spans, arrays of (s, k, e): start and end in code points and the kind's place in
    KINDS; with keep, the columns of docs come first, as the struct doc_row, and then text.

    base: the base patterns' spans, kept as they are. spans: these and the runs that the Markov models take for secrets, by
    start and kind; of a run that reaches beyond base spans the whole is judged and the parts outside of them are added. A null or empty text has none; repeated rows are scanned alike; other columns
    are not read unless kept; an empty table gives an empty one."""
    text = text_of(text_col)
    head = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc_row")] if keep else [F.col(id_col)]
    rows = docs.select(*head, text.alias("t")).withColumn("base", base_spans(F.col("t")))
    long = rows.withColumn("more", _beyond(_runs(F.col("t"), CANDIDATE, 3), F.col("base")))

    def secret(x: Column) -> Column:
        word, n = F.substring(F.col("t"), x["s"] + 1, x["e"] - x["s"]), x["e"] - x["s"]
        return F.exists(F.array(_ratio(word, table)), lambda r: (r >= fit.total) & (r >= n * fit.each))

    added = F.when(F.size("more") > 0, F.flatten(F.transform(F.filter("more", secret), lambda x: _outside(x, F.col("base"))))).otherwise(F.col("more"))
    out = long.withColumn("spans", F.array_sort(F.concat("base", added)))
    return out.select(*(["doc_row", F.col("t").alias("text")] if keep else [id_col]), "base", "spans")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")


def masked(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, or run of overlapping spans, replaced by mark; spans are in order of starts."""
    ends = _before(spans, lambda x: x["e"], F.greatest)
    parts = F.zip_with(spans, ends, lambda x, at: F.when(x["s"] >= at, F.concat(F.substring(text, at + 1, x["s"] - at), F.lit(mark))).otherwise(F.lit("")))
    rest = F.substring(text, F.array_max(F.transform(spans, lambda x: x["e"])) + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(text)
