"""Language identification by a linear-chain conditional random field over words.

Each word has a label; its scores come from affixes, n-grams of bytes and lexicons, and learned transitions join
neighbours. Forward-backward gives the probability of each label at each word; a text's language has the most of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fitted, slices, task
from .textbytes import ASCII_LETTER, LETTER, lowered, mix, span_hashes, words

#: The training sample: so many texts of each language, and so many code points of each, from a place given by a hash.
SAMPLE_TEXTS, SAMPLE_CHARS = 250, 2400
BUCKETS = 1 << 16
SEGMENT = 32
LEXICON_LEAST = 3
#: Bytes of whole texts that are scored at once; the arrays over their words take some 80 times as much.
SCORED_BYTES = 1 << 18
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


def word_matrix(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of buckets: (word, bucket) pairs for prefixes and suffixes of 1 to 3 bytes and n-grams of 2 to 4 bytes."""
    n = end - start
    rows, codes = [], []
    d = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint64)

    def gram(at: np.ndarray, k: int, salt: int) -> np.ndarray:
        h = np.full(len(at), salt, np.uint64)
        for j in range(k):
            h = h * np.uint64(0x100000001B3) + d[at + j] + np.uint64(1)
        return (mix(h) & np.uint64(BUCKETS - 1)).astype(np.int32)

    for k in (1, 2, 3):
        own = np.flatnonzero(n >= k)
        rows += [own.astype(np.int32)] * 2
        codes += [gram(start[own], k, 101 + k), gram(end[own] - k, k, 201 + k)]
    for k in (2, 3, 4):
        many = np.maximum(0, n - k + 1)
        rows.append(np.repeat(np.arange(len(n), dtype=np.int32), many))
        codes.append(gram(np.repeat(start - (np.cumsum(many) - many), many) + np.arange(many.sum()), k, 301 + k))
    return np.concatenate(rows), np.concatenate(codes)


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # buckets x labels
    lexicon: np.ndarray  # sorted hashes of words
    member: np.ndarray  # words of the lexicon x labels: 1 if the word is in the label's lexicon
    lex_weights: np.ndarray  # labels + 1 (in no lexicon) x labels
    transitions: np.ndarray  # labels x labels, from row to column

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Lexicon features of words: one for each label, and one for words in no lexicon."""
        out = np.zeros((len(hashes), len(self.labels) + 1), np.float32)
        if len(self.lexicon):
            at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
            hit = self.lexicon[at] == hashes
            out[hit, :-1] = self.member[at[hit]]
        out[:, -1] = ~out[:, :-1].any(1)
        return out

    def emissions(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Scores of each label for words, each distinct word scored once."""
        _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        row, code = word_matrix(data, start[first], end[first])
        n = end[first] - start[first]
        size = np.maximum(1, np.bincount(row, minlength=len(first)) if len(row) else n)
        score = np.stack([np.bincount(row, self.weights[code, k], len(first)) for k in range(len(self.labels))], 1) if len(row) else np.zeros((len(first), len(self.labels)))
        return ((score / np.sqrt(size)[:, None] + self.known(hashes[first]) @ self.lex_weights)[inverse]).astype(np.float32)


def posteriors(emissions: np.ndarray, text: np.ndarray, n: int, transitions: np.ndarray, forward: np.ndarray | None = None) -> np.ndarray:
    """Probability of each label at each word, for the chains of n texts at once; forward is filled with that given the words up to it.

    Chains are cut into segments. A first pass multiplies the step matrices of each segment, a second one carries
    vectors from segment to segment, a third one runs within all segments side by side: the result is that of one pass
    over each chain.
    """
    labels = emissions.shape[1]
    if not len(emissions):
        return emissions
    counts = np.bincount(text, minlength=n)
    per = -(-counts // SEGMENT)
    seg0 = np.concatenate([[0], np.cumsum(per)])
    word0 = np.concatenate([[0], np.cumsum(counts)])
    place = np.arange(len(text)) - word0[text]
    seg, at = seg0[text] + place // SEGMENT, place % SEGMENT
    total = int(seg0[-1])
    e = np.ones((total, SEGMENT, labels), np.float32)
    e[seg, at] = np.exp(emissions - emissions.max(1, keepdims=True))
    real = np.zeros((total, SEGMENT), bool)
    real[seg, at] = True
    t = np.exp(transitions).astype(np.float32)
    product = np.broadcast_to(np.eye(labels, dtype=np.float32), (total, labels, labels)).copy()
    for k in range(SEGMENT):
        step = (product.reshape(-1, labels) @ t).reshape(total, labels, labels) * e[:, k, None, :]
        step /= step.sum((1, 2), keepdims=True)
        product = np.where(real[:, k, None, None], step, product)
    head, tail = np.full((total, labels), 1 / labels, np.float32), np.full((total, labels), 1 / labels, np.float32)
    longest = int(per.max())
    for k in range(longest - 1):
        own = np.flatnonzero(per > k + 1)
        v = np.einsum("si,sij->sj", head[seg0[own] + k], product[seg0[own] + k])
        head[seg0[own] + k + 1] = v / v.sum(1, keepdims=True)
        back = seg0[own + 1] - 1 - k
        v = np.einsum("sij,sj->si", product[back], tail[back])
        tail[back - 1] = v / v.sum(1, keepdims=True)
    alpha = np.empty((total, SEGMENT, labels), np.float32)
    v = head
    for k in range(SEGMENT):
        step = (v @ t) * e[:, k]
        v = np.where(real[:, k, None], step / step.sum(1, keepdims=True), v)
        alpha[:, k] = v
    if forward is not None:
        forward[:] = alpha[seg, at]
    v = tail
    for k in range(SEGMENT - 1, -1, -1):
        alpha[:, k] *= v
        step = (v * e[:, k]) @ t.T
        v = np.where(real[:, k, None], step / step.sum(1, keepdims=True), v)
    out = alpha[seg, at]
    return out / out.sum(1, keepdims=True)


def pairs(before: np.ndarray, after: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Probabilities of the labels of two neighbours: before is what the words up to the first say of it, after what all say of the second."""
    way = before[:, :, None] * np.exp(transitions)[None]
    return way / way.sum(1, keepdims=True) * after[:, None, :]


def train(samples: list[tuple[str, str]], seed: int = 7, epochs: int = 3, rate: float = 0.5) -> Model:
    """A model from (text, language). Chains are runs of words; a third of them switch to another language's run."""
    labels = sorted({lang for _, lang in samples})
    count = len(labels)
    column = pa.array([t for t, _ in samples], pa.large_string())
    y_text = np.array([labels.index(lang) for _, lang in samples], np.int64)
    parts = [(lo, lowered(d), o) for lo, _, d, o in slices(column, 1 << 30)]
    if not parts or not count:
        return Model(labels, np.zeros((BUCKETS, count), np.float32), np.zeros(0, np.uint64), np.zeros((0, count), np.float32), np.zeros((count + 1, count), np.float32), np.zeros((count, count), np.float32))
    _, data, offsets = parts[0]
    text, start, end = words(data, offsets, LETTER)
    hashes = span_hashes(data, start, end)
    y = y_text[text]
    u, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    seen = np.zeros((len(u), count))
    np.add.at(seen, (inverse, y), 1)
    keep = seen.sum(1) >= LEXICON_LEAST
    member = (seen[keep] >= 0.1 * seen[keep].sum(1, keepdims=True)).astype(np.float32)
    m = Model(labels, np.zeros((BUCKETS, count), np.float32), u[keep], member, np.zeros((count + 1, count), np.float32), np.zeros((count, count), np.float32))
    row, code = word_matrix(data, start[first], end[first])
    by = np.argsort(row, kind="stable")
    row, code = row[by], code[by]
    ptr = np.searchsorted(row, np.arange(len(u) + 1))
    lex = m.known(u)
    lex[np.random.default_rng(seed).random(len(lex)) < 0.5, :-1] = 0  # else the n-grams learn nothing from known words
    rng = np.random.default_rng(seed)
    runs = [np.arange(a, min(a + 12, b)) for lo, hi in zip(np.searchsorted(text, np.arange(len(samples))), np.searchsorted(text, np.arange(1, len(samples) + 1)), strict=True) for a in range(lo, hi, 12) for b in [hi]]
    square_w, square_l, square_t = np.full(m.weights.shape, 1e-3, np.float32), np.full(m.lex_weights.shape, 1e-3), np.full(m.transitions.shape, 1e-3)
    for _ in range(epochs):
        order = rng.permutation(len(runs))
        for at in range(0, len(order), 256):
            pick = order[at : at + 256]
            chains = [np.concatenate([runs[i], runs[int(rng.integers(len(runs)))]]) if rng.random() < 1 / 3 else runs[i] for i in pick]
            w = np.concatenate(chains)
            chain = np.repeat(np.arange(len(chains)), [len(c) for c in chains])
            uw, where = np.unique(inverse[w], return_inverse=True)
            n = ptr[uw + 1] - ptr[uw]
            idx = np.repeat(ptr[uw] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            r, c = np.repeat(np.arange(len(uw)), n), code[idx]
            scale = 1 / np.sqrt(np.maximum(1, n))
            e = np.stack([np.bincount(r, m.weights[c, k], len(uw)) for k in range(count)], 1) * scale[:, None] + lex[uw] @ m.lex_weights
            before = np.empty((len(w), count), np.float32)
            p = posteriors(e[where].astype(np.float32), chain, len(chains), m.transitions, before)
            g = -p.astype(np.float64)
            g[np.arange(len(w)), y[w]] += 1
            gu = np.stack([np.bincount(where, g[:, k], len(uw)) for k in range(count)], 1) / len(chains)
            gw = np.zeros_like(m.weights)
            for k in range(count):
                gw[:, k] = np.bincount(c, (gu[:, k] * scale)[r], BUCKETS)
            gl = lex[uw].T @ gu
            inner = chain[1:] == chain[:-1]
            gt = np.zeros((count, count))
            np.add.at(gt, (y[w][:-1][inner], y[w][1:][inner]), 1)
            gt = (gt - pairs(before[:-1][inner], p[1:][inner], m.transitions).sum(0)) / len(chains)
            for value, square, grad in ((m.weights, square_w, gw), (m.lex_weights, square_l, gl), (m.transitions, square_t, gt)):
                square += grad**2
                value += (rate * grad / np.sqrt(square) * (grad != 0)).astype(value.dtype)
            m.weights *= 1 - 1e-4
    return m


def score_texts(m: Model, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """The language of each text and the mean probability of it over the text's words."""
    names, scores = [], []
    for lo, hi, raw, offsets in slices(column, SCORED_BYTES):
        n = hi - lo
        data = lowered(raw)
        text, start, end = words(data, offsets, LETTER)
        ascii_words = np.bincount(np.searchsorted(offsets, np.flatnonzero(ASCII_LETTER[data]), "right") - 1, minlength=n)
        if len(m.labels) and len(text):
            p = posteriors(m.emissions(data, start, end, span_hashes(data, start, end)), text, n, m.transitions)
            share = np.stack([np.bincount(text, p[:, k], n) for k in range(len(m.labels))], 1)
            share /= np.maximum(share.sum(1, keepdims=True), 1e-30)
        else:
            share = np.zeros((n, max(1, len(m.labels))))
        best = share.argmax(1)
        top = share[np.arange(n), best]
        for i in range(n):
            if not m.labels or top[i] <= 0 or (not ascii_words[i] and not any(c.isalpha() for c in column[lo + i].as_py() or "")):
                names.append("und")
                scores.append(0.0)
            else:
                names.append(m.labels[int(best[i])])
                scores.append(float(min(1.0, top[i])))
    return names, np.array(scores)


def sample(docs: DataFrame, learn_from: str, texts_each: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> DataFrame | None:
    """About texts_each distinct (text, lang) for each language, by the hash of the text; a long text gives one window. None without any.

    Hashes are picked first, in 64 parts of each language, since one language can hold most rows; then their texts. Texts
    below 40 code points come only where a part of a language has too few longer ones.
    """
    rows = docs.where(F.expr(learn_from)).where("text is not null and lang is not null").select("lang", "text", F.xxhash64("text").alias("_h"), (F.length("text") < 40).alias("_short"))
    part = Window.partitionBy("lang", F.pmod("_h", F.lit(64))).orderBy("_short", "_h")
    picked = rows.select("lang", "_h", "_short").distinct().withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= -(-texts_each // 64)).select("lang", "_h").collect()
    if not picked:
        return None
    few = F.broadcast(docs.sparkSession.createDataFrame(picked, "lang string, _h long"))  # texts_each for each language
    window = F.expr(f"substring(text, cast(1 + pmod(_h, greatest(1, length(text) - {chars} + 1)) as int), {chars})").alias("text")
    return rows.select("lang", "text", "_h").join(few, ["lang", "_h"]).groupBy("lang", "_h").agg(F.min("text").alias("text")).select(window, "lang")


def fit(docs: DataFrame, learn_from: str) -> Model:
    """A model from the sample of docs, trained in one task."""
    some = sample(docs, learn_from)
    return train([]) if some is None else fitted(some, train)


#: Rows that are learned from, unless the caller says otherwise.
LEARN_FROM = "pmod(crc32(cast(cast(doc_id as string) as binary)), 4) <> 2"


def identify(docs: DataFrame, learn_from: str = LEARN_FROM) -> DataFrame:
    """One row for each row of docs (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    learn_from says which rows are learned from; the others are held out. lang_pred is `und` with score 0 for a null
    text, one without a letter, or where there was nothing to learn from. A row without an id is learned from never and
    is held out. Ties between languages go to the first by name; repeated rows give equal rows; other columns are not
    read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, learn_from))  # its size is set by BUCKETS and the sample
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(~F.expr(learn_from), F.lit(True)).alias("held_out"), "text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            names, scores = score_texts(sent.value, b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(task(run), PREDICTED)


def with_language(docs: DataFrame, learn_from: str = LEARN_FROM) -> DataFrame:
    """The rows of docs, whole, whose text has a language, be it one of several in the text."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, learn_from))
    at = docs.columns.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            names, _ = score_texts(sent.value, b.column(at))
            yield b.filter(pa.array([n != "und" for n in names], pa.bool_()))

    return docs.mapInArrow(task(run), docs.schema)
