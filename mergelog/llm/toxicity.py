"""Toxic passages by maximum-scoring segments.

A token's score is its log-odds between toxic and clean labelled texts with an informative
Dirichlet prior (the background counts), kept only where it is significant and near what a token
of toxic texts alone would have, a bar that doesn't move with the number of labels; every
other token costs a small constant. The linear-time scan for all maximal scoring segments then
finds every toxic passage of a text. Under clean text the scores of segments follow an
extreme-value law: with lambda from the clean token scores and K from clean segments,
E = K * n * exp(-lambda * S) is how many segments of score S to expect by chance in n
tokens. A text's segments are added up as lambda * S - ln(K * n) where positive, and a
one-dimensional logistic fit turns that and the best segment's value into a probability.

The model is fitted on at most TRAIN_ROWS labelled rows (the least hashes of their ids),
which are written once and read from there. Its settings were chosen by `choose`:
cross-validation over training rows alone.

Defined results: null and empty texts have no segment and get the least score. Without
labelled rows, or with one class only, every score is the share of toxic rows (0 without
rows). Labels that are null aren't used; of repeated labels of a row the largest counts.
Of training rows that share an id the least text counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import LOWER, column, slices, text_buffers, word_bounds, word_hashes
from .skew import near_least
from .staging import Staging

TRAIN_ROWS = 20_000
PRIOR = 0.2  # of the background counts
LEAST_Z = 2.5
LEAST_PART = 0.8  # of the log-odds that a token of toxic texts alone has
LEAST_COUNT = 4
COST = 0.05
SIGN = np.zeros(256, bool)
SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def tokens(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, first token of each row, token hashes): words without the signs around them, lower-cased in A-Z."""
    data, offsets = text_buffers(texts)
    for first, last in slices(offsets):
        part = LOWER[data[offsets[first] : offsets[last]]]
        starts, ends, heads = word_bounds(part, offsets[first : last + 1] - offsets[first])
        for _ in range(3):
            if len(starts):
                ends = ends - (SIGN[part[ends - 1]] & (ends - starts > 1))
                starts = starts + (SIGN[part[starts]] & (ends - starts > 1))
        yield first, heads, word_hashes(part, starts, ends)


def segments(scores: list[float]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, last exclusive), in linear time."""
    stack: list[list] = []  # [sum before, sum with, first, last, index of the nearest earlier segment that starts lower]
    total = 0.0
    for k, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        new = [before, total, k, k + 1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= new[0]:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= new[1]:
                stack.append([*new, j])
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
    return [(b - a, first, last) for a, b, first, last, _ in stack]


def found_segments(hashes: np.ndarray, keys: np.ndarray, weights: np.ndarray, cost: float = COST) -> list[tuple[float, int, int]]:
    """Segments of one text; stretches of plain tokens are one step each, since they can only be crossed whole."""
    if not len(keys) or not len(hashes):
        return []
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    hit = np.flatnonzero(keys[at] == hashes)
    if not len(hit) or not (weights[at[hit]] > 0).any():
        return []
    gaps = np.diff(hit, prepend=-1) - 1
    steps, place = [], []
    for p, g, w in zip(hit.tolist(), gaps.tolist(), weights[at[hit]].tolist(), strict=True):
        if g:
            steps.append(-cost * g)
            place.append((p - g, p))
        steps.append(w)
        place.append((p, p + 1))
    return [(s, place[a][0], place[b - 1][1]) for s, a, b in segments(steps)]


@dataclass
class Model:
    keys: np.ndarray
    weights: np.ndarray
    rate: float  # lambda
    log_k: float
    fit: tuple[float, ...]
    base: float
    cost: float = COST

    def found(self, hashes: np.ndarray) -> list[tuple[float, int, int]]:
        return found_segments(hashes, self.keys, self.weights, self.cost)

    def values(self, n: int, found: list[tuple[float, int, int]]) -> tuple[float, float]:
        """(the best segment's calibrated value, the sum of the positive ones)."""
        least = -self.log_k - np.log(max(n, 1))
        each = [self.rate * s + least for s, _, _ in found]
        return max(each, default=least), sum(v for v in each if v > 0)

    def score(self, best: np.ndarray, total: np.ndarray) -> np.ndarray:
        if not self.fit:
            return np.full(len(best), self.base)
        a, b, c = self.fit
        return 1 / (1 + np.exp(-np.clip(a + b * best + c * np.log1p(total), -40, 40)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = column(batch, "_toxic").to_numpy().astype(bool)
        for first, heads, h in tokens(column(batch, "_text")):
            if len(h):  # a token counts once in a text, so that one text's repetitions aren't evidence
                own = [np.unique(h[a:b]) for a, b in zip(heads[:-1], heads[1:], strict=True)]
                is_toxic = np.repeat(toxic[first : first + len(own)], [len(x) for x in own])
                h = np.concatenate(own)
                keys, at = np.unique(h, return_inverse=True)
                y1 = np.bincount(at, is_toxic, len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(y1), pa.array(np.bincount(at, minlength=len(keys)) - y1)], names=["token", "y1", "y0"])


def _measure(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = column(batch, "_toxic").cast(pa.int64())
            for first, heads, h in tokens(column(batch, "_text")):
                n = len(heads) - 1
                every = [[s for s, _, _ in model.found(h[heads[k] : heads[k + 1]])] for k in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(np.diff(heads)), pa.array(every, pa.list_(pa.float64())), toxic.slice(first, n)], names=["n", "scores", "toxic"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (p - y) + 1e-2 * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        w = w - np.linalg.solve(hessian, gradient)
    return tuple(float(v) for v in w)


def _rate(scores: np.ndarray, share: np.ndarray) -> float:
    """lambda > 0 where the mean of exp(lambda * score) over clean tokens is 1; the mean score is negative."""
    if not (scores > 0).any() or float((scores * share).sum()) >= 0:
        return 1.0
    low, high = 1e-4, 1.0
    while float((share * np.exp(high * scores)).sum()) < 1 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if float((share * np.exp(mid * scores)).sum()) < 1 else (low, mid)
    return high


def sample(docs: DataFrame, labels: DataFrame, trains: Column, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(_id, _text, _toxic) of at most train_rows labelled rows where `trains` (over `_id`) holds, written."""
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_toxic")).where(F.col("_toxic").isNotNull() & F.col("_id").isNotNull()).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    n = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).alias("_toxic")).where(F.col("_toxic").isNotNull() & trains).agg(F.approx_count_distinct("_id", 0.02)).first()[0]
    ids = known.where(trains & near_least("_id", train_rows, F.lit(max(1, n)))).orderBy(F.xxhash64("_id"), "_id").limit(train_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("_d"), F.col(text_col).alias("_text")).join(F.broadcast(ids), F.col("_d") == F.col("_id"))
    return Staging(docs.sparkSession, "toxicity").table(rows.groupBy("_id").agg(F.min("_text").alias("_text"), F.max("_toxic").alias("_toxic")), "sample")


def fit_sample(rows: DataFrame, prior: float = PRIOR, least_z: float = LEAST_Z, cost: float = COST, least_part: float = LEAST_PART) -> Model:
    """A model from rows (_text, _toxic); they are read three times."""
    counts = rows.mapInArrow(_count, "token long, y1 long, y0 long").groupBy("token").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0"))
    total, share = counts.agg(F.coalesce(F.sum("y1"), F.lit(0)), F.coalesce(F.sum("y0"), F.lit(0))), rows.agg(F.coalesce(F.avg(F.col("_toxic").cast("double")), F.lit(0.0)))
    (n1, n0), share = total.first(), share.first()[0]
    none = np.zeros(0, np.uint64)
    if not n1 or not n0:
        return Model(none, none.astype(float), 1.0, 0.0, (), share, cost)
    mass = prior * (n1 + n0)
    odds = counts.where(F.col("y1") + F.col("y0") >= LEAST_COUNT).withColumn("y", F.col("y1") + F.col("y0")).withColumn("a", F.col("y") * prior)
    odds = odds.withColumn("d", F.log((F.col("y1") + F.col("a")) / (n1 + mass - F.col("y1") - F.col("a"))) - F.log((F.col("y0") + F.col("a")) / (n0 + mass - F.col("y0") - F.col("a"))))
    odds = odds.withColumn("z", F.col("d") / F.sqrt(1 / (F.col("y1") + F.col("a")) + 1 / (F.col("y0") + F.col("a"))))
    least = least_part * float(np.log((1 + prior) / prior * (n0 + mass) / (n1 + mass)))
    kept = sorted((r[0] & 0xFFFFFFFFFFFFFFFF, r[1], r[2]) for r in odds.where((F.col("z") >= least_z) & (F.col("d") >= least)).select("token", "d", "y0").collect())
    keys = np.array([r[0] for r in kept], np.uint64)
    weights = np.array([r[1] for r in kept], float)
    seen = np.array([r[2] for r in kept], float) / n0
    rate = _rate(np.append(weights, -cost), np.append(seen, 1 - seen.sum()))
    model = Model(keys, weights, rate, 0.0, (), share, cost)
    got = rows.mapInArrow(_measure(model), "n long, scores array<double>, toxic long").toArrow()
    n, toxic, scores = got.column("n").to_numpy(), got.column("toxic").to_numpy(), got.column("scores").to_pylist()
    top, clean = np.array([max(s, default=0.0) for s in scores]), toxic == 0
    bar = max(float(np.quantile(top[clean], 0.5)), 1e-9) if clean.any() else 1.0
    over = max(1, int((top[clean] >= bar).sum()))
    model.log_k = float(np.log(over / max(1, n[clean].sum())) + rate * bar)
    values = np.array([model.values(int(k), [(v, 0, 0) for v in s]) for k, s in zip(n, scores, strict=True)])
    model.fit = _logistic(np.column_stack([values[:, 0], np.log1p(values[:, 1])]), toxic.astype(float))
    return model


def fit(docs: DataFrame, labels: DataFrame, trains: Column, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from at most train_rows labelled rows where `trains` (over `_id`) holds; only their tokens' kept weights and segments' scores come to the driver."""
    return fit_sample(sample(docs, labels, trains, train_rows, id_col, text_col, label_col))


def choose(rows: DataFrame, grid: list[tuple[float, ...]], folds: int = 4) -> list[tuple[float, float, tuple[float, ...]]]:
    """(mean log loss, error rate, (prior, least z, cost, least part)) of each setting, best first: cross-validation over the sample's own rows, by hashes of their ids."""
    fold, out = F.pmod(F.xxhash64("_id", F.lit("fold")), F.lit(folds)), []
    for setting in grid:
        loss = errors = n = 0.0
        for k in range(folds):
            model = fit_sample(rows.where(fold != k), *setting)
            for r in score(rows.where(fold == k), model, F.col("_toxic") > 0, "_id", "_text").select("held_out", "score").collect():
                p = min(max(r["score"], 1e-6), 1 - 1e-6)
                loss -= np.log(p if r["held_out"] else 1 - p)
                errors += (p >= 0.5) != r["held_out"]
                n += 1
        out.append((float(loss / max(n, 1)), float(errors / max(n, 1)), setting))
    return sorted(out)


def score(docs: DataFrame, model: Model, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, passages: token spans 'first:last:value') for every row, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(column(batch, "_text"))
            best, total, spans = np.zeros(n), np.zeros(n), [""] * n
            least = model.values(0, [])
            best[:] = least[0]
            for first, heads, h in tokens(column(batch, "_text")):
                for k in range(len(heads) - 1):
                    found = model.found(h[heads[k] : heads[k + 1]])
                    best[first + k], total[first + k] = model.values(int(heads[k + 1] - heads[k]), found)
                    if found:
                        bar = -model.log_k - np.log(heads[k + 1] - heads[k])
                        spans[first + k] = ",".join(f"{a}:{b}:{model.rate * s + bar:.3f}" for s, a, b in found if model.rate * s + bar > 0)
            p = model.score(best, total)
            yield pa.RecordBatch.from_arrays([column(batch, "_id"), column(batch, "_held"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(spans, pa.string())], names=["doc_id", "held_out", "score", "predicted", "passages"])

    return docs.select(F.col(id_col).cast("long").alias("_id"), held_out.alias("_held"), F.col(text_col).alias("_text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, passages string")
