"""Toxicity: a linear-chain conditional random field tags toxic tokens; its marginals give spans and document scores."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, slices, text_of

TOKEN = re.compile(r"\w+")


@dataclass(frozen=True)
class Fit:
    """Bounds and rules of the training. The model is fitted on a bounded sample of labelled rows, the first by a hash of their
    ids; everything else (scoring) covers all rows."""

    #: Labelled documents at most, by label.
    max_toxic: int = 2000
    max_clean: int = 4000
    #: Tokens of one sequence in training; longer documents give several sequences.
    window: int = 50
    #: Sequences at most, with and without a toxic token.
    max_sequences: int = 2500
    #: A feature marks tokens as toxic if toxic documents hold it so many times more often than clean ones, and if its
    #: likelihood-ratio statistic is one that about so many of all features would pass by chance.
    lift: float = 12.0
    level: float = 0.2
    #: Features that fewer training tokens hold aren't given a weight.
    least: int = 3
    rounds: int = 60
    l2: float = 0.02


@dataclass
class Model:
    """Weights of the label "toxic" against "other": per feature, for a change of label, and of the document score."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -9.0
    #: log-potentials [from][to]; 0 is other, 1 is toxic.
    moves: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))
    #: Of the bias, and of what Scorer.summary gives.
    scale: tuple[float, ...] = (-4.0, 0.0, 0.0, 0.0)


def features(token: str) -> list[str]:
    """The word, its beginnings and its ending; lower case."""
    w = token.lower()
    return [f"w:{w}", *(f"p{k}:{w[:k]}" for k in (3, 4, 5, 6) if len(w) >= k), *(f"s{k}:{w[-k:]}" for k in (3,) if len(w) > k)]


def marginals(emit: np.ndarray, lengths: np.ndarray, moves: tuple, few: int = 8) -> np.ndarray:
    """Logits of the toxic label at each token by forward-backward, for many sequences laid end to end.

    With two labels each message is one number, the log-odds of the labels; the sequences advance together, the longest
    first, so that a step costs the sequences that are still running. The last ones go on one by one."""
    (oo, ot), (to, tt) = np.exp(np.array(moves)).tolist()
    order = np.argsort(-lengths, kind="stable")
    size, start = lengths[order], (np.cumsum(lengths) - lengths)[order]
    longest = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")
    together = int(np.count_nonzero(alive >= few))
    ahead, back = np.empty_like(emit), np.zeros_like(emit)
    odds = np.ones(len(size))
    for t in range(together):
        n = alive[t]
        at = start[:n] + t
        r = emit[at] if t == 0 else emit[at] + np.log((odds[:n] * tt + ot) / (odds[:n] * to + oo))
        ahead[at] = r
        odds = np.exp(np.clip(r, -60, 60))
    beta = np.zeros(len(size))
    for k in range(alive[together] if together < longest else 0):
        first, last = int(start[k]) + together, int(start[k] + size[k])
        e, o, found = emit[first:last].tolist(), float(odds[k]), []
        for i, x in enumerate(e):
            r = x + math.log((o * tt + ot) / (o * to + oo)) if together or i else x
            found.append(r)
            o = math.exp(max(-60.0, min(60.0, r)))
        ahead[first:last] = found
        b, found = 0.0, []
        for x in reversed(e):
            r = math.exp(max(-60.0, min(60.0, x + b)))
            b = math.log((r * tt + to) / (r * ot + oo))
            found.append(b)
        # the message of a token goes to the one before it
        if together:
            back[first - 1 : last - 1] = found[::-1]
            beta[k] = b
        else:
            back[first : last - 1] = found[-2::-1]
    for t in range(together - 2, -1, -1):
        n = alive[t + 1]
        at = start[:n] + t
        r = np.exp(np.clip(emit[at + 1] + beta[:n], -60, 60))
        beta[:n] = np.log((r * tt + to) / (r * ot + oo))
        back[at] = beta[:n]
    return ahead + back


def _partition(emit: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-partition summed over sequences of one padded block, node marginals and expected moves, by forward-backward."""
    n, width = len(lengths), int(lengths.max())
    at = np.cumsum(lengths) - lengths
    e = np.zeros((n, width))
    mask = np.arange(width) < lengths[:, None]
    e[mask] = emit
    a = np.zeros((n, width, 2))
    a[:, 0, 1] = e[:, 0]
    for t in range(1, width):
        step = np.logaddexp.reduce(a[:, t - 1, :, None] + moves, axis=1)
        step[:, 1] += e[:, t]
        a[:, t] = np.where(mask[:, t, None], step, a[:, t - 1])
    z = np.logaddexp.reduce(a[:, -1], axis=1)
    b = np.zeros((n, width, 2))
    expected = np.zeros((2, 2))
    for t in range(width - 2, -1, -1):
        nxt = b[:, t + 1].copy()
        nxt[:, 1] += e[:, t + 1]
        live = mask[:, t + 1]
        b[:, t] = np.where(live[:, None], np.logaddexp.reduce(moves + nxt[:, None, :], axis=2), 0.0)
        joint = a[:, t, :, None] + moves + nxt[:, None, :] - z[:, None, None]
        expected += np.exp(joint[live]).sum(0)
    node = np.exp(a[:, :, 1] + b[:, :, 1] - z[:, None])
    del at
    return float(z.sum()), node[mask], expected


def surprise(t: float, c: float, toxic: int, clean: int) -> float:
    """The likelihood-ratio statistic of a feature that t of the toxic and c of the clean documents hold."""
    def part(x: float, n: float) -> float:
        return x * math.log(x / n) if x else 0.0

    of = lambda x, n, rate: part(x, n) + part(n - x, n) - (x * math.log(rate) + (n - x) * math.log(1 - rate))
    rate = (t + c) / (toxic + clean)
    return 2 * (of(t, toxic, rate) + of(c, clean, rate)) if 0 < rate < 1 else 0.0


def bar(features_tried: int, level: float) -> float:
    """The statistic that at most about `level` of so many features pass by chance."""
    return 2 * math.log(max(1, features_tried) / level)


def significant(by: DataFrame, toxic: int, clean: int, tried: int, fit: Fit) -> set[str]:
    """The features of by (feature, t, c) that mark tokens; only these reach the driver, however many there are."""
    rate = lambda n, of: (F.col(n) + 0.5) / (of + 1.0)
    likely = by.where((F.col("t") >= 3) & (rate("t", toxic) > fit.lift * rate("c", clean)) & F.substring("feature", 1, 2).isin("w:", "p4", "p5", "p6"))
    part = lambda x, n: F.when(x > 0, x * F.log(x / n)).otherwise(0.0)
    share = (F.col("t") + F.col("c")) / F.lit(float(toxic + clean))
    of = lambda x, n: part(x, n) + part(n - x, n) - (x * F.log(share) + (n - x) * F.log(1 - share))
    statistic = 2 * (of(F.col("t"), F.lit(float(toxic))) + of(F.col("c"), F.lit(float(clean))))
    least = bar(tried, fit.level)
    # logarithms may differ in their last digits; surprise() decides
    found = likely.where(statistic > least - 1e-6).collect()
    return {r["feature"] for r in found if surprise(r["t"], r["c"], toxic, clean) > least}


def _train(kept: list[tuple[list[str], list[int]]], fit: Fit) -> Model:
    """Maximum likelihood with an L2 penalty by Adam; kept: sequences of tokens and their labels."""
    held = Counter(f for x, _ in kept for w in x for f in features(w))
    names = sorted(f for f, n in held.items() if n >= fit.least)
    index = {f: i for i, f in enumerate(names)}
    sequences = [([[index[f] for f in features(w) if f in index] for w in x], y) for x, y in kept]
    lengths = np.array([len(y) for _, y in sequences])
    y = np.concatenate([np.array(y, float) for _, y in sequences])
    flat = np.fromiter((f for x, _ in sequences for token in x for f in token), np.int64)
    owner = np.repeat(np.arange(len(y)), [len(token) for x, _ in sequences for token in x])
    seen = np.zeros((2, 2))
    inside = np.ones(len(y), bool)
    inside[np.cumsum(lengths) - lengths] = False
    i = np.flatnonzero(inside)
    np.add.at(seen, (y[i - 1].astype(int), y[i].astype(int)), 1)
    k = len(names)
    theta = np.zeros(k + 5)
    theta[k] = -4.0
    truth = np.bincount(flat, weights=y[owner], minlength=k)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, fit.rounds + 1):
        emit = np.bincount(owner, weights=theta[flat], minlength=len(y)) + theta[k]
        _, node, expected = _partition(emit, lengths, theta[k + 1 :].reshape(2, 2))
        g = np.concatenate([truth - np.bincount(flat, weights=node[owner], minlength=k), [y.sum() - node.sum()], (seen - expected).ravel()]) - fit.l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    moves = theta[k + 1 :].reshape(2, 2)
    return Model({n: float(w) for n, w in zip(names, theta[:k], strict=True) if abs(w) > 1e-3}, float(theta[k]), tuple(tuple(map(float, r)) for r in moves))


#: The log of a share of toxic tokens from which on it doesn't matter how few they are.
SPARSE = -8.0


class Scorer:
    """A model in a worker: per batch, the tokens' emissions (kept in a memo by token, of at most `memo` bytes, about) and the marginals
    of whole texts."""

    def __init__(self, model: Model, memo: int = 64 << 20):
        self.model, self.memo, self.most, self.held = model, {}, memo, 0

    def _learn(self, tokens: list[list[str]]) -> None:
        """Puts the emissions of new tokens into the memo."""
        seen = set().union(*tokens)
        new = seen.difference(self.memo)
        self.held += sum(map(len, new)) * 4 + 160 * len(new)
        if self.held > self.most:
            self.memo.clear()
            new, self.held = seen, sum(map(len, seen)) * 4 + 160 * len(seen)
        get, bias = self.model.weights.get, self.model.bias
        self.memo.update((w, bias + sum(get(f, 0.0) for f in features(w))) for w in new)

    def logits(self, texts: list[str]) -> list[np.ndarray]:
        tokens = [TOKEN.findall(t) for t in texts]
        self._learn(tokens)
        lengths = np.array([len(t) for t in tokens], np.int64)
        emit = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(tokens)), np.float64, int(lengths.sum()))
        full = lengths > 0
        out = marginals(emit, lengths[full], self.model.moves)
        return np.split(out, np.cumsum(lengths)[:-1]) if len(lengths) else []

    @staticmethod
    def summary(logits: np.ndarray) -> tuple[float, float, float]:
        """The best token's logit, the log of the expected number of tokens that are likelier toxic than not, and their share: a long
        text may hold one by chance. Without any such token number and share are those of none."""
        if not len(logits):
            return -12.0, 0.0, SPARSE
        hot = float((1 / (1 + np.exp(-logits[logits > 0]))).sum())
        return float(np.clip(logits.max(), -12, 12)), float(np.log1p(hot)), max(SPARSE, float(np.log(max(hot, 1e-9) / (len(logits) + 20))))

    def score(self, logits: np.ndarray) -> float:
        a, *slopes = self.model.scale
        total = a + sum(b * x for b, x in zip(slopes, self.summary(logits), strict=True))
        return float(1 / (1 + math.exp(-max(-500.0, min(500.0, total)))))

    @staticmethod
    def spans(text: str, logits: np.ndarray) -> list[tuple[int, int]]:
        """Offsets of runs of tokens that are likelier toxic than not; end exclusive."""
        if not (logits > 0).any():
            return []
        found, last = [], False
        for m, hot in zip(TOKEN.finditer(text), logits > 0, strict=True):
            if hot:
                found.append((found.pop()[0] if last else m.start(), m.end()))
            last = bool(hot)
        return found


def _parts(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, text, 8 << 20, 10_000)


def _signature(text: str, shingle: int = 3) -> int:
    """The smallest hash of a text's shingles of tokens; near copies mostly share it."""
    words = TOKEN.findall(text.lower())
    return min(xxhash.xxh64_intdigest(" ".join(words[i : i + shingle])) for i in range(max(1, len(words) - shingle + 1))) >> 1


def _labelled(docs: DataFrame, labels: DataFrame, fit: Fit, id_col: str, text_col: str) -> DataFrame:
    """(text, toxic) of the first labelled rows of each kind by a hash of their ids; of near copies one, or else what they share
    would look like evidence. A repeated label counts as toxic if one is."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("k")).agg(F.max("toxic").alias("toxic"))
    first = lambda want, n: marked.where(F.col("toxic") == want).orderBy(F.xxhash64(F.lit(5), "k"), "k").limit(n)
    chosen = F.broadcast(first(1, fit.max_toxic).unionByName(first(0, fit.max_clean)))  # bounded by the two parameters
    joined = docs.select(F.col(id_col).alias("k"), text_of(text_col).alias("text")).join(chosen, "k")

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, 0):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(_signature, batch.column(0).to_pylist()), pa.int64())], names=["text", "toxic", "sig"])

    rows = joined.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(signed, "text string, toxic int, sig bigint")
    return rows.groupBy("sig", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits a model on documents joined with labels (id_col, toxic 0 or 1).

    Tokens are labelled first: a feature that many toxic documents hold and almost no clean ones marks the tokens of toxic
    documents that have it; one that many toxic documents hold more than once and almost no clean ones marks those of the former. Then the field is trained on sequences of those documents, and last the scale of document
    scores on their marginals. Only counts of features that pass the bounds, bounded sequences and three numbers per sampled
    document reach the driver. Without toxic or without clean rows the model gives every text a score below 0.02."""
    spark = docs.sparkSession
    rows = materialize(_labelled(docs, labels, fit, id_col, text_col), "labelled")
    count = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not count.get(1) or not count.get(0):
        return Model()

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, 0):
            each = []
            for t in part.column(0).to_pylist():
                n = Counter()
                for w, k in Counter(TOKEN.findall(t)).items():
                    n.update(dict.fromkeys(features(w), k))
                each.append(n)
            y = np.repeat(np.array(part.column(1).to_pylist(), np.int32), [len(x) for x in each])
            twice = pa.array([int(k > 1) for x in each for k in x.values()], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([f for x in each for f in x], pa.string()), pa.array(y), twice], names=["feature", "toxic", "twice"])

    by = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(held, "feature string, toxic int, twice int")
    sums = {"t": F.col("toxic"), "c": 1 - F.col("toxic"), "t2": F.col("toxic") * F.col("twice"), "c2": (1 - F.col("toxic")) * F.col("twice")}
    by = materialize(by.groupBy("feature").agg(*(F.sum(x).alias(k) for k, x in sums.items())), "features")
    tried = 2 * by.count()
    once = significant(by, count[1], count[0], tried, fit)
    # what clean texts may hold once, toxic ones again and again
    again = significant(by.select("feature", F.col("t2").alias("t"), F.col("c2").alias("c")), count[1], count[0], tried, fit) - once

    window, most = fit.window, fit.max_sequences

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, 0):
            words, hot = [], []
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = TOKEN.findall(t)
                held_ = Counter(f for w in tokens for f in again.intersection(features(w))) if y == 1 else Counter()
                hot_ = once | {f for f, k in held_.items() if k > 1}
                marked = [int(y == 1 and not hot_.isdisjoint(features(w))) for w in tokens]
                for a in range(0, len(tokens), window):
                    words.append(tokens[a : a + window])
                    hot.append(marked[a : a + window])
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.string())), pa.array(hot, pa.list_(pa.int32()))], names=["words", "hot"])

    cuts = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(cut, "words array<string>, hot array<int>")
    cuts = materialize(cuts.withColumn("any", F.array_contains("hot", 1)).withColumn("h", F.xxhash64("words")), "sequences")
    kept = [(r["words"], r["hot"]) for want in (True, False) for r in cuts.where(F.col("any") == want).orderBy("h", "words").limit(most).collect()]
    if not any(any(y) for _, y in kept):
        return Model()
    model = _train(kept, fit)

    shared = spark.sparkContext.broadcast(model)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for part in _parts(batches, 0):
            found = np.array([scorer.summary(x) for x in scorer.logits(part.column(0).to_pylist())]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(pa.array(found[:, i]) for i in range(3)), part.column(1)], names=["x", "y", "z", "toxic"])

    discard(by, cuts)
    points = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(summed, "x double, y double, z double, toxic int").collect()
    discard(rows)
    p = np.array(sorted(map(tuple, points)))
    model.scale = _logistic(p[:, :3], p[:, 3])
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by damped Newton steps with a small ridge. Slopes aren't negative: more or clearer toxic tokens never
    lower a score; a column whose slope would be is left out."""
    used = list(range(x.shape[1]))
    while True:
        a = np.column_stack([np.ones(len(x)), x[:, used]])
        ridge, w = np.array([1e-3, *[0.05] * len(used)]), np.zeros(len(used) + 1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge)
            w += np.clip(np.linalg.solve(h, a.T @ (y - p) - ridge * w), -2, 2)
        if (w[1:] >= 0).all():
            slopes = dict(zip(used, w[1:], strict=True))
            return (float(w[0]), *(float(slopes.get(i, 0.0)) for i in range(x.shape[1])))
        used.pop(int(np.argmin(w[1:])))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """One row per row of docs: id_col, score (0 to 1) and spans, the offending offsets as an array of (start, end) in code
    points; with keep, the columns of docs come first, as the struct doc_row, so that none clashes.

    Whole texts are scored as one chain each. A null or empty text has no tokens: its score is that of no toxic token.
    Repeated rows are scored alike; an empty table gives an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cols = docs.columns if keep else [id_col]
    kept = [T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(cols)]
    read = [*cols, text_col][: len(cols) + (text_col not in cols)]
    where, n = read.index(text_col), len(cols)
    spans = T.ArrayType(T.StructType().add("start", "integer").add("end", "integer"))
    arrow_spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for part in _parts(batches, where):
            texts = [t or "" for t in part.column(where).to_pylist()]
            scores, found = [], []
            for t, x in zip(texts, scorer.logits(texts), strict=True):
                scores.append(scorer.score(x))
                found.append([{"start": a, "end": b} for a, b in scorer.spans(t, x)])
            yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(scores, pa.float64()), pa.array(found, arrow_spans)], names=[*(f"c{i}" for i in range(n)), "score", "spans"])

    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("spans", spans)])
    out = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(read))).mapInArrow(run, schema)
    rows = F.struct(*(F.col(f"c{i}").alias(c) for i, c in enumerate(cols))).alias("doc_row")
    return out.select(rows, "score", "spans") if keep else out.select(F.col("c0").alias(id_col), "score", "spans")
