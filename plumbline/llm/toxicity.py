"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed features of the words of a text, the words themselves and their first bytes, is trained from
confirmed toxic texts and unlabelled ones. Its risk is the class prior's share of the positive risk, and the unlabelled
risk less what the positives add to it; where that difference falls below zero, the step takes it back up. The prior is
estimated from the two samples as well: no label of a text that is not toxic is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_text, fitted, picked, slices, task
from .textbytes import LETTER, lowered, span_hashes, words

#: The training sample: so many confirmed and so many unlabelled texts, and so many code points of each, from a place given by a hash.
CONFIRMED, UNLABELLED, SAMPLE_CHARS = 1500, 4500, 4000
#: Hashed features; those that fewer texts have are too rare to weigh.
BUCKETS, LEAST_TEXTS = 1 << 18, 3
#: A weight leaves zero where the risk's slope is so many standard errors of the sample away from none; then its square costs so much.
ERRORS, DECAY = 5.0, 4e-3
PREFIXES = (3, 4, 5, 6, 8)
SCORED = "doc_id long, held_out boolean, score double, predicted int"


def distinct_words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, row, word, features): each distinct word of each text once, as a row of features.

    The features of a word are hashes of itself and of its first bytes.
    """
    for lo, hi, raw, offsets in slices(column):
        data = lowered(raw)
        text, start, end = words(data, offsets, LETTER)
        ends = [end, *[np.minimum(end, start + k) for k in PREFIXES]]
        h = span_hashes(data, np.tile(start, len(ends)), np.concatenate(ends)).reshape(len(ends), -1)
        _, first, which = np.unique(h[0], return_index=True, return_inverse=True)
        pairs = np.unique(text * len(first) + which) if len(first) else np.zeros(0, np.int64)
        n = max(1, len(first))
        f = h[:, first]
        for k in range(1, len(ends)):
            f[k] ^= np.uint64(k)  # a prefix and a whole word are two features
        yield lo, hi, pairs // n, pairs % n, f


@dataclass
class Model:
    weights: np.ndarray  # by bucket
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        out = []
        for lo, hi, row, word, f in distinct_words(column):
            value = self.weights[buckets(f)].sum(0)
            z = self.bias + np.bincount(row, value[word], hi - lo)
            out.append(1 / (1 + np.exp(-np.clip(z, -40, 40))))
        return np.concatenate(out) if out else np.zeros(0)


def buckets(features: np.ndarray) -> np.ndarray:
    return (features & np.uint64(BUCKETS - 1)).astype(np.int64)


class Sample:
    """Texts as a matrix of hashed features, held by columns: how many distinct words of the text have the feature."""

    def __init__(self, texts: list[str]):
        rows, columns, values = [], [], []
        for lo, _, row, word, f in distinct_words(pa.array(texts, pa.large_string())):
            key, count = np.unique(np.concatenate([row * BUCKETS + b[word] for b in buckets(f)]), return_counts=True)
            rows.append((key // BUCKETS + lo).astype(np.int32))
            columns.append((key % BUCKETS).astype(np.int32))
            values.append(count.astype(np.float32))
        row, column, value = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (rows, columns, values))
        self.n = len(texts)
        use = (np.bincount(column, minlength=BUCKETS) >= LEAST_TEXTS)[column]
        row, column, value = row[use], column[use], value[use]
        order = np.argsort(column, kind="stable")
        self.row, self.value, column = row[order], value[order], column[order]
        del row, value, order, use
        self.features, self.start, size = np.unique(column, return_index=True, return_counts=True)
        self.column = np.repeat(np.arange(len(size), dtype=np.int32), size)
        self.end = self.start + size
        self.scale = np.ones(len(size))
        mean, square = (self.slopes(np.ones(self.n), k) / max(1, self.n) for k in (1, 2))
        self.scale = 1 / np.sqrt(np.maximum(square - mean**2, 1e-9))

    def columns(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place in which, scaled value) of the entries of some columns."""
        size = self.end[which] - self.start[which]
        at = np.repeat(self.start[which] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        k = np.repeat(np.arange(len(which)), size)
        return self.row[at], k, self.value[at] * self.scale[which][k]

    def slopes(self, g: np.ndarray, power: int = 1) -> np.ndarray:
        """The derivative by each scaled column, from that by each row: the sum of g by rows, times the values to a power."""
        total = np.zeros(len(self.features))
        for k in range(0, len(self.row), 1 << 20):
            part = slice(k, k + (1 << 20))
            total += np.bincount(self.column[part], g[self.row[part]] * self.value[part] ** power, len(total))
        return total * self.scale


def risk(f: np.ndarray, share_p: np.ndarray, share_u: np.ndarray, prior: float, beta: float = 0.0, gamma: float = 1.0) -> tuple[float, np.ndarray]:
    """The non-negative risk of scores f under the logistic loss, and the direction of its step by row.

    share_p and share_u are the weights of the rows in the confirmed and in the unlabelled sample. Where the negative part is
    below -beta, the step is gamma times its rise alone.
    """
    up, down, s = np.logaddexp(0, f), np.logaddexp(0, -f), 1 / (1 + np.exp(-np.clip(f, -40, 40)))
    negative = share_u @ up - prior * (share_p @ up)
    rise = (share_u - prior * share_p) * s
    step = rise - prior * share_p * (1 - s) if negative >= -beta else -gamma * rise
    return float(prior * (share_p @ down) + max(0.0, negative)), step


def _descend(sample: Sample, which: np.ndarray, w: np.ndarray, b: float, shares: tuple, prior: float, cost: float, decay: float, steps: int, rate: float) -> tuple[np.ndarray, float]:
    """Steps on some weights and the bias, with a cost for each weight's size (cost) and square (decay), by preconditioned proximal descent."""
    row, k, value = sample.columns(which)
    m = len(which)
    first, second = np.zeros(m + 1), np.zeros(m + 1)
    for t in range(1, steps + 1):
        _, g = risk(np.bincount(row, w[k] * value, sample.n) + b, *shares, prior)
        slope = np.append(np.bincount(k, g[row] * value, m) + decay * w, g.sum())
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        size = rate * (1 - 0.9 * t / steps) / (np.sqrt(second / (1 - 0.99**t)) + 1e-4)
        move = size * first / (1 - 0.9**t)
        w, b = w - move[:-1], float(b - move[-1])
        w = np.sign(w) * np.maximum(0, np.abs(w) - size[:-1] * cost)
    return w, b


def descend(sample: Sample, is_p: np.ndarray, is_u: np.ndarray, prior: float, rounds: int = 8, steps: int = 300, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights of the scaled columns and the bias with the least risk, each weight at a cost (lasso), then again without for those not zero.

    All features are in the risk. A column takes part in the steps once the slope of the risk by its weight exceeds the cost:
    until then its weight stays zero at the optimum, so it needs no step.
    """
    shares = is_p / is_p.sum(), is_u / is_u.sum()
    cost = prior * ERRORS * np.sqrt(1 / is_p.sum() + 1 / is_u.sum())
    w, b = np.zeros(len(sample.features)), float(np.log(prior / (1 - prior)))
    active = np.zeros(len(w), bool)
    for _ in range(rounds):
        row, k, value = sample.columns(np.flatnonzero(active))
        _, g = risk(np.bincount(row, w[active][k] * value, sample.n) + b, *shares, prior)
        more = active | (np.abs(sample.slopes(g)) > cost)
        if (more == active).all():
            break
        active = more
        w[active], b = _descend(sample, np.flatnonzero(active), w[active], b, shares, prior, cost, 0.0, steps, rate)
    active = w != 0
    w[active], b = _descend(sample, np.flatnonzero(active), w[active], b, shares, prior, 0.0, DECAY, steps, rate)
    return w, b


def estimated_prior(p: np.ndarray, u: np.ndarray, sure: float = 0.1) -> float:
    """The share of positives among unlabelled scores u, given scores p of positives: that of the best top bin.

    Above a threshold hardly any negative is left; the threshold is the one with the least upper bound of the ratio of
    shares (Garg et al., 2021), so that thresholds with few texts above them are not trusted.
    """
    cuts = np.unique(np.concatenate([p, u]))
    share_p, share_u = (1 - np.searchsorted(np.sort(x), cuts, "left") / len(x) for x in (p, u))
    slack = np.sqrt(np.log(4 / sure) / 2 / len(p)) + np.sqrt(np.log(4 / sure) / 2 / len(u))
    ok = share_p > 0
    best = int(np.argmin((share_u[ok] + slack) / share_p[ok]))
    return float(np.clip(share_u[ok][best] / share_p[ok][best], 0.005, 0.95))


def train(confirmed: list[str], unlabelled: list[str], prior: float | None = None) -> Model:
    """A model with the least non-negative risk. Without a prior, it is estimated on one half of the texts by a model of the other.

    Without a confirmed or an unlabelled text, all score below one half.
    """
    if not confirmed or not unlabelled:
        return Model(np.zeros(BUCKETS), -2.0)
    sample = Sample([*confirmed, *unlabelled])
    is_p = np.arange(sample.n) < len(confirmed)
    if prior is None:
        half = np.arange(sample.n) % 2 == 0
        parts = [m & h for m in (is_p, ~is_p) for h in (half, ~half)]
        prior = 0.1
        if all(m.any() for m in parts):
            w, b = descend(sample, parts[0], parts[2], 0.1)
            f = np.bincount(sample.row, sample.value * (w * sample.scale)[sample.column], sample.n) + b
            prior = estimated_prior(f[parts[1]], f[parts[3]])
    w, b = descend(sample, is_p, ~is_p, prior)
    weights = np.zeros(BUCKETS)
    weights[sample.features] = w * sample.scale
    return Model(weights, b)


def _window(chars: int, by: str) -> Column:
    return F.expr(f"substring(text, cast(1 + pmod({by}, greatest(1, length(text) - {chars} + 1)) as int), {chars})").alias("text")


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5) -> Model:
    """Learns in one task from the toxic labels of rows whose crc32(doc_id) mod folds is not 0, and from the texts of such rows."""
    inside = F.pmod(crc32_text("doc_id"), F.lit(folds)) != 0
    own = labels.where(inside).where("toxic = 1").select("doc_id").distinct()
    rows = docs.where(inside).where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("_h"))
    toxic = picked(own.select("doc_id", F.xxhash64("doc_id").alias("_d")), "_d", CONFIRMED)
    some = picked(rows.select("_h"), "_h", UNLABELLED)
    if toxic is None or some is None:
        return train([], [])
    found = [rows.join(few, by).groupBy("_h").agg(F.min("text").alias("text")).select(F.lit(k).alias("k"), _window(SAMPLE_CHARS, "_h")) for k, (few, by) in enumerate(((toxic, "doc_id"), (some, "_h")))]
    return fitted(found[0].unionByName(found[1]), lambda got: train([t for k, t in got if k == 0], [t for k, t in got if k]))


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, held_out, score, predicted.

    labels has doc_id and toxic; a null there is no label. A null text is empty; a row without an id is held out.
    Repeated rows give equal rows; without labels nothing is predicted toxic; an empty table gives an empty one; other
    columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, folds))  # of a fixed size
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.pmod(crc32_text("doc_id"), F.lit(folds)) == 0, F.lit(True)).alias("held_out"), "text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in it:
            s = m.scores(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(task(run), SCORED)
