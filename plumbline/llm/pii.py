"""Personal data by a character-level bidirectional LSTM with CRF transitions, in numpy.

Base patterns give spans of their own and, with forms written in other ways, the labels to train from. The network reads
every text whole that a span can stand in, in overlapping windows. The scores of overlapping windows are blended into one chain for the text; where
no tag but the outside one can be on a best path the chain needs no decoding, and what is left is decoded as a whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fitted, picked, strings, task, texts

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. A run of digits is entered at its start alone, which changes no match.
EMAIL_LOCAL, EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9._%+-]"), re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
IP_RAW = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
TRIGGER = re.compile(r"[0-9@]")
#: The training sample and its windows; the windows read, which overlap by WIDTH - STRIDE; places decoded beside an open one; windows scored at once.
SAMPLE_TEXTS, LEARNED, WIDTH, STRIDE, REACH, BATCH = 384, 160, 256, 224, 64, 384
EMBED, HIDDEN = 12, 16
#: Rows read at once.
ROWS = 256
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def octets(text: str) -> bool:
    parts = [p.lstrip("0") or "0" for p in text.split(".")]  # padded parts can be of any length
    return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)


def _digits(text: str) -> str:
    return "".join([c for c in text if c in "0123456789"])


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the pattern, found from their at-signs in linear time."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in LOCAL:
            lo -= 1
        m = EMAIL_DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            out.append((lo, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted."""
    out = [(a, 0, b) for a, b in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if octets(m[0])]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


PAD, CLASSES = 1, 130
_fold = np.arange(2, 130)
_fold[ord("0") : ord("9") + 1] = ord("0") + 2
_fold[ord("A") : ord("Z") + 1] = _fold[ord("a") : ord("z") + 1]


def classes(text: str) -> np.ndarray:
    """Code points as classes: ASCII from 2 on, digits and cases of a letter as one; other letters 0, the rest 1."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(c < 128, _fold[np.minimum(c, 127)], c > 0x2FF).astype(np.uint8)


@dataclass
class Net:
    """embed; for each direction one matrix from [input, hidden, 1] to the four gates; out; CRF transitions and start."""

    embed: np.ndarray
    gates: list[np.ndarray]
    out: np.ndarray
    trans: np.ndarray
    start: np.ndarray

    def all(self) -> list[np.ndarray]:
        return [self.embed, *self.gates, self.out, self.trans, self.start]


def new_net(rng: np.random.Generator) -> Net:
    scale = 1 / np.sqrt(EMBED + HIDDEN)
    gates = [rng.normal(0, scale, (EMBED + HIDDEN + 1, 4 * HIDDEN)).astype(np.float32) for _ in range(2)]
    for g in gates:
        g[-1, HIDDEN : 2 * HIDDEN] = 1
    return Net(rng.normal(0, 0.3, (CLASSES, EMBED)).astype(np.float32), gates, rng.normal(0, 0.2, (2 * HIDDEN + 1, TAGS)).astype(np.float32), np.zeros((TAGS, TAGS), np.float32), np.zeros(TAGS, np.float32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def lstm(x: np.ndarray, w: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """x: steps x windows x EMBED. Returns hidden states and, if asked for, what the way back needs."""
    steps, n, _ = x.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    out, tape = np.empty((steps, n, HIDDEN), np.float32), []
    pre = x.reshape(-1, EMBED) @ w[:EMBED] + w[-1]
    pre = pre.reshape(steps, n, -1)
    for t in range(steps):
        z = pre[t] + h @ w[EMBED:-1]
        s = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
        new = f * c + i * g
        tc = np.tanh(new)
        if keep:
            tape.append((h, c, i, f, o, g, tc))
        h, c = o * tc, new
        out[t] = h
    return out, tape


def lstm_back(x: np.ndarray, w: np.ndarray, tape: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps, n, _ = x.shape
    dz_all = np.empty((steps, n, 4 * HIDDEN), np.float32)
    dh, dc, dw = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32), np.zeros_like(w)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, tc = tape[t]
        dh = dh + d_out[t]
        dc = dc + dh * o * (1 - tc**2)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g**2)], 1)
        dz_all[t] = dz
        dw[EMBED:-1] += h.T @ dz
        dh, dc = dz @ w[EMBED:-1].T, dc * f
    flat = dz_all.reshape(-1, 4 * HIDDEN)
    dw[:EMBED] += x.reshape(-1, EMBED).T @ flat
    dw[-1] += flat.sum(0)
    return (flat @ w[:EMBED].T).reshape(x.shape), dw


def scores(net: Net, windows: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
    """Tag scores of windows (windows x steps of classes): steps x windows x TAGS."""
    x = net.embed[windows.T]
    a, tape_a = lstm(x, net.gates[0], keep)
    b, tape_b = lstm(x[::-1], net.gates[1], keep)
    h = np.concatenate([a, b[::-1], np.ones((*a.shape[:2], 1), np.float32)], 2)
    return h @ net.out, (x, tape_a, tape_b, h)


def crf_step(net: Net, windows: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean negative log-likelihood of the tags and its gradient."""
    e, (x, tape_a, tape_b, h) = scores(net, windows, True)
    steps, n, _ = e.shape
    alpha, beta = np.empty((steps, n, TAGS)), np.zeros((steps, n, TAGS))
    lse = lambda v, axis: np.log(np.exp(v - (m := v.max(axis, keepdims=True))).sum(axis)) + m.squeeze(axis)
    alpha[0] = net.start + e[0]
    for t in range(1, steps):
        alpha[t] = lse(alpha[t - 1][:, :, None] + net.trans, 1) + e[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = lse(net.trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    z = lse(alpha[-1], 1)
    y, rows = tags.T, np.arange(n)
    gold = net.start[y[0]] + e[0][rows, y[0]]
    d_e = np.exp(alpha + beta - z[:, None]).astype(np.float32)
    d_start = d_e[0].sum(0)
    np.subtract.at(d_start, y[0], 1)
    d_trans = np.zeros((TAGS, TAGS))
    for t in range(steps):
        if t:
            pair = alpha[t - 1][:, :, None] + net.trans + (e[t] + beta[t])[:, None, :] - z[:, None, None]
            d_trans += np.exp(pair).sum(0)
            np.subtract.at(d_trans, (y[t - 1], y[t]), 1)
            gold = gold + net.trans[y[t - 1], y[t]] + e[t][rows, y[t]]
        d_e[t][rows, y[t]] -= 1
    d_e /= n
    d_h = d_e @ net.out.T
    d_out = h.reshape(-1, h.shape[2]).T @ d_e.reshape(-1, TAGS)
    dx_a, dw_a = lstm_back(x, net.gates[0], tape_a, d_h[:, :, :HIDDEN])
    dx_b, dw_b = lstm_back(x[::-1], net.gates[1], tape_b, d_h[::-1, :, HIDDEN : 2 * HIDDEN])
    d_embed = np.zeros_like(net.embed)
    np.add.at(d_embed, windows.T, dx_a + dx_b[::-1])
    return float((z - gold).mean()), [d_embed, dw_a, dw_b, d_out, (d_trans / n).astype(np.float32), d_start / n]


#: Other ways to write a kind, as (pattern, replacement), by kind.
OTHER_FORMS = (
    ((("@", " (at) "), (".", " (dot) ")), (("@", " (at) "),), (("@", " @ "),), (("@", "[at]"),), (("@", " [at] "), (".", " [dot] "))),
    (((".", "[.]"),), ((".", " . "),), ((".", "[dot]"),)),
    ((("-", " "),), ((" ", "."),), ((" ", "/"),)),
    ((("+", ""),), (("+", "00"),), (("(", ""), (")", ""), (" ", ".")), (("+1 ", ""),), (("-", " "),)),
)
#: Numbers that are no personal data, 0 for any digit.
PLAIN_NUMBERS = ("0000-00-00", "00:00:00", "0.0", "0.0.0", "000,000.00", "$00.00", "0000", "00000000", "00/00/0000", "000000", "#0000", "(0000)", "[00]", "0000-0000", "00%")


def redrawn(body: str, rng: np.random.Generator, letters: bool = False) -> str:
    """The body with other digits, and other letters if asked for: shapes are to be learned, not names and numbers."""
    new = rng.integers(0, 10, len(body)).tolist(), rng.integers(97, 123, len(body)).tolist()
    return "".join([str(d) if "0" <= c <= "9" else chr(a) if letters and "a" <= c <= "z" else c for c, d, a in zip(body, *new, strict=True)])


def in_other_form(body: str, kind: int, rng: np.random.Generator) -> str:
    if kind == 2 and body.isdigit():  # in groups first
        body = " ".join([body[k : k + 4] for k in range(0, len(body), 4)])
    for x, y in OTHER_FORMS[kind][int(rng.integers(len(OTHER_FORMS[kind])))]:
        body = body.replace(x, y)
    return body


#: Words that may be data in another form.
UNSURE = re.compile(r"\S*(?:[0-9@]|[\[(](?:at|dot)[\])])\S*")


def doubtful(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Words with digits, at-signs and the like beside the spans: nobody says what they are, so nothing is learned from them."""
    out, k = [], 0
    for m in UNSURE.finditer(text):
        while k < len(spans) and spans[k][2] <= m.start():
            k += 1
        if k == len(spans) or m.end() <= spans[k][0]:
            out.append((m.start(), m.end()))
    return out


def training_set(some: list[str], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Windows with the tags of their spans: around spans and plain numbers, and anywhere.

    Digits of spans are redrawn, a part of the spans is written in another form, plain numbers are put between words, and
    doubtful words go.
    """
    xs, ys = [], []
    for text in some:
        spans: list[tuple[int, int, int]] = []
        for s in base_spans(text):  # a card may lie in another span, as digits of it
            if not spans or s[0] >= spans[-1][2]:
                spans.append(s)
        spans += [(a, -1, b) for a, b in doubtful(text, spans)]
        spans += [(m.start(), -2, m.start()) for m in re.finditer(" ", text) if rng.random() < 0.01]
        out, tags, at, centres = [], [], 0, []
        for a, kind, b in sorted(spans):
            if a < at:
                continue
            if kind == -2:
                body, own = " " + redrawn(PLAIN_NUMBERS[int(rng.integers(len(PLAIN_NUMBERS)))], rng), 0
            elif kind == -1:
                body, own = "", 0
            else:
                body, own = redrawn(text[a:b], rng, kind == 0 and rng.random() < 0.5), 1 + 2 * kind
                body = in_other_form(body, kind, rng) if rng.random() < 0.5 else body
            out.append(text[at:a] + body)
            tags += [0] * (a - at)
            centres.append(len(tags))
            tags += ([own] + [own + 1 if own else 0] * (len(body) - 1)) if body else []
            at = b
        out.append(text[at:])
        tags += [0] * (len(text) - at)
        new = "".join(out)
        c, t = classes(new), np.array(tags, np.int64)
        anywhere = rng.integers(0, max(1, len(new)), 3).tolist()
        for p in [*centres[:: max(1, len(centres) // 12)], *anywhere]:
            lo = max(0, min(p - int(rng.integers(LEARNED - 16)), len(new) - LEARNED))
            x, y = np.full(LEARNED, PAD, np.uint8), np.zeros(LEARNED, np.int64)
            n = min(LEARNED, len(new) - lo)
            x[:n], y[:n] = c[lo : lo + n], t[lo : lo + n]
            xs.append(x)
            ys.append(y)
    return np.array(xs, np.uint8).reshape(-1, LEARNED), np.array(ys, np.int64).reshape(-1, LEARNED)


def train(some: list[str], seed: int = 5, steps: int = 500, batch: int = 64, rate: float = 0.02, windows: int = 2000, draws: int = 64) -> Net:
    """A net from texts, each drawn in several forms, by Adam; the labels are their base spans. Without one it tags nothing."""
    rng = np.random.default_rng(seed)
    net = new_net(rng)
    drawn = [training_set(some, rng)]
    with_spans = sum((y > 0).any(1).sum() for _, y in drawn)
    while with_spans and with_spans < windows and len(drawn) < draws:  # few texts are drawn in more forms
        drawn.append(training_set(some, rng))
        with_spans += (drawn[-1][1] > 0).any(1).sum()
    x, y = (np.concatenate(p) for p in zip(*drawn, strict=True))
    if not (y > 0).any():
        net.out[:] = 0
        net.out[-1, 0] = 10
        return net
    params = net.all()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for k in range(1, steps + 1):
        pick = rng.integers(len(x), size=min(batch, len(x)))
        _, grads = crf_step(net, x[pick], y[pick])
        norm = np.sqrt(sum(float((g**2).sum()) for g in grads))
        for p, m, v, g in zip(params, first, second, grads, strict=True):
            g = g * min(1.0, 5 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g**2 - v)
            p -= (rate * (1 - 0.8 * k / steps) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-7)).astype(p.dtype)
    return net


class Reader:
    """A net as tables for reading: for each direction the gates' inputs by class, and the weights of the state.

    The sigmoid gates are halved beforehand, so that one tanh serves all four.
    """

    def __init__(self, net: Net):
        self.net = net
        half = np.repeat([0.5, 0.5, 0.5, 1.0], HIDDEN).astype(np.float32)
        self.inputs, self.states = [], []
        for w in net.gates:
            table = (net.embed @ w[:EMBED] + w[-1]) * half
            self.inputs.append(np.ascontiguousarray(table.reshape(CLASSES, 4, HIDDEN).transpose(1, 0, 2)))
            self.states.append(np.ascontiguousarray((w[EMBED:-1] * half).reshape(HIDDEN, 4, HIDDEN).transpose(1, 0, 2)))
        # the most that a tag can gain over the outside one by the transitions into it and out of it
        own = net.trans - net.trans[0, 0]
        self.gain = np.maximum(own[:, 1:].max(0), net.start[1:] - net.start[0]) + np.maximum(0, own[1:, 0])

    def one_way(self, x: np.ndarray, k: int, out: np.ndarray) -> None:
        """Hidden states of one direction: x and out are steps x windows, the states in the last axis of out."""
        h, c = np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros((x.shape[1], HIDDEN), np.float32)
        z, v = np.empty((4, *h.shape), np.float32), np.empty((4, *h.shape), np.float32)
        for t in range(len(x)):
            np.take(self.inputs[k], x[t], axis=1, out=v, mode="clip")
            np.matmul(h, self.states[k], out=z)
            z += v
            np.tanh(z, out=z)
            s = z[:3]
            s *= 0.5
            s += 0.5
            c *= z[1]
            z[0] *= z[3]
            c += z[0]
            np.tanh(c, out=h)
            h *= z[2]
            out[t] = h

    def scores(self, windows: np.ndarray) -> np.ndarray:
        """Tag scores of windows: windows x steps x TAGS."""
        x = np.ascontiguousarray(windows.T)
        h = np.empty((*x.shape, 2 * HIDDEN), np.float32)
        self.one_way(x, 0, h[:, :, :HIDDEN])
        self.one_way(x[::-1], 1, h[::-1, :, HIDDEN:])
        e = h @ self.net.out[:-1]
        e += self.net.out[-1]
        return e.transpose(1, 0, 2)

    def open(self, e: np.ndarray) -> np.ndarray:
        """Places whose scores let a tag other than the outside one be on a best path; each span on one holds such a place."""
        most = e[..., 1] + self.gain[0]
        for k in range(2, TAGS):
            np.maximum(most, e[..., k] + self.gain[k - 1], out=most)
        return most > e[..., 0]


_ramp = np.minimum(np.arange(1, WIDTH + 1), np.arange(WIDTH, 0, -1)).astype(np.float32)[:, None]


def starts(n: int) -> np.ndarray:
    """Where the windows of a text of n code points begin."""
    return np.arange(0, max(1, n - WIDTH + STRIDE), STRIDE)


def open_chains(reader: Reader, chains: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(chain, place, blended scores) of the stretches of chains of classes that need decoding.

    All windows of all chains are scored. Overlapping windows are weighted by the distance to the window's edge; a place that
    is closed in both is closed in the blend, so only windows with an open place and their neighbours are blended.
    """
    size = np.array([len(c) for c in chains], np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    every = np.concatenate([*chains, np.full(1, PAD, np.uint8)])
    at = [starts(int(n)) if n else np.zeros(0, np.int64) for n in size]
    chain, lo = np.repeat(np.arange(len(chains)), [len(a) for a in at]), np.concatenate([np.zeros(0, np.int64), *at])
    kept: dict[int, np.ndarray] = {}
    before: tuple[int, np.ndarray] | None = None  # the last window of the batch before, in case its neighbour opens
    wanted = -1
    opened: list[int] = []
    for k in range(0, len(lo), BATCH):
        own = lo[k : k + BATCH, None] + np.arange(WIDTH)
        inside = own < size[chain[k : k + BATCH], None]
        e = reader.scores(every[np.where(inside, own + first[chain[k : k + BATCH], None], len(every) - 1)])
        hit = (reader.open(e) & inside).any(1)
        if before is not None and hit[0]:
            kept.setdefault(*before)
        near = hit.copy()
        near[1:] |= hit[:-1]
        near[:-1] |= hit[1:]
        near[0] |= wanted == k
        for r in np.flatnonzero(near).tolist():
            kept[k + r] = e[r].copy()
        opened += (np.flatnonzero(hit) + k).tolist()
        before, wanted = (k + len(hit) - 1, e[-1].copy()), k + len(hit) if hit[-1] else -1
    run: list[int] = []
    for w in [*opened, -1]:
        if run and (w < 0 or w != run[-1] + 1 or chain[w] != chain[run[0]]):
            yield from _stretches(reader, int(chain[run[0]]), size, lo, chain, kept, run)
            run = []
        run.append(w)


def _stretches(reader: Reader, k: int, size: np.ndarray, lo: np.ndarray, chain: np.ndarray, kept: dict[int, np.ndarray], run: list[int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """The blended scores of a run of open windows, cut to the places around open ones."""
    a, b = int(lo[run[0]]), min(int(lo[run[-1]]) + WIDTH, int(size[k]))
    total, weight = np.zeros((b - a, TAGS), np.float32), np.zeros((b - a, 1), np.float32)
    for w in range(run[0] - 1, run[-1] + 2):
        if w not in kept or chain[w] != k:
            continue
        x, y = max(a, int(lo[w])), min(b, int(lo[w]) + WIDTH)
        if x < y:
            own = slice(x - int(lo[w]), y - int(lo[w]))
            total[x - a : y - a] += kept[w][own] * _ramp[own]
            weight[x - a : y - a] += _ramp[own]
    e = total / weight
    places = np.flatnonzero(reader.open(e))
    if len(places):
        cuts = np.flatnonzero(np.diff(places) > 2 * REACH)
        for p, q in zip(places[np.r_[0, cuts + 1]].tolist(), places[np.r_[cuts, len(places) - 1]].tolist(), strict=True):
            p, q = max(0, p - REACH), min(len(e), q + 1 + REACH)
            yield k, a + p, e[p:q]


def decode(net: Net, e: np.ndarray) -> list[tuple[int, int, int]]:
    """The best path over a whole chain, as (start, kind, end)."""
    best, back = net.start + e[0], np.empty((len(e), TAGS), np.int8)
    for t in range(1, len(e)):
        options = best[:, None] + net.trans
        back[t] = options.argmax(0)
        best = options[back[t], np.arange(TAGS)] + e[t]
    tags = np.empty(len(e), np.int64)
    tags[-1] = best.argmax()
    for t in range(len(e) - 1, 0, -1):
        tags[t - 1] = back[t][tags[t]]
    out, t = [], 0
    while t < len(tags):
        if tags[t]:
            kind, u = (tags[t] - 1) // 2, t + 1
            while u < len(tags) and tags[u] == 2 + 2 * kind:
                u += 1
            out.append((t, int(kind), u))
            t = u
        else:
            t += 1
    return out


def plausible(text: str, start: int, kind: int, end: int) -> bool:
    """An exact check of what the net adds: whole words, and what the kind asks for in another spelling.

    A number of 15 or 16 digits may miss its check digit: it can be a card with a slip.
    """
    if (start and text[start - 1].isalnum() and text[start].isalnum()) or (end < len(text) and text[end].isalnum() and text[end - 1].isalnum()):
        return False
    body = text[start:end]
    d = _digits(body)
    if kind == 0:
        plain = re.sub(r"\s*[\[(](?:at)[\])]\s*|\s+@\s+", "@", body)
        plain = re.sub(r"\s*[\[(](?:dot)[\])]\s*", ".", plain)
        return any(a == 0 and b == len(plain) for a, b in emails(plain))
    if kind == 1:
        plain = re.sub(r"\s*(?:\[\.\]|\[dot\]|\(dot\)|\.)\s*", ".", body)
        return bool(re.fullmatch(r"[0-9]+(\.[0-9]+){3}", plain)) and octets(plain)
    if kind == 2:
        return bool(re.fullmatch(r"[0-9](?:[ ./-]?[0-9])+", body)) and (len(d) in (15, 16) or (12 <= len(d) <= 19 and luhn(d)))
    return 9 <= len(d) <= 15 and bool(re.fullmatch(r"[+0-9 ()./-]+", body)) and any(c in body for c in "+(-.")


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """A span without the white space and the marks of a sentence at its ends."""
    while end > start and (text[end - 1].isspace() or text[end - 1] in ".,;:!?-/"):
        end -= 1
    while end > start and (text[start].isspace() or text[start] in ".,;:!?-/"):
        start += 1
    return start, end


#: What every span that plausible() accepts has in it: a digit, or an at-sign in one of its spellings.
MARK = re.compile(r"[0-9@]|[\[(]at[\])]")


def find_spans(reader: Reader, some: list[str]) -> list[tuple[list, list]]:
    """For each text its base spans, and all its spans, as (start, kind, end).

    The network reads each text whole. A text without a mark has no span that passes the exact check, so it is not read.
    """
    base = [base_spans(t) if TRIGGER.search(t) else [] for t in some]
    added: dict[int, list] = {}
    read = [k for k, t in enumerate(some) if MARK.search(t)]
    for r, a, e in open_chains(reader, [classes(some[k]) for k in read]):
        k = read[r]
        for s, kind, u in decode(reader.net, e):
            s, u = trimmed(some[k], s + a, u + a)
            if u > s and not any(x < u and s < y for x, _, y in base[k]) and plausible(some[k], s, kind, u):
                added.setdefault(k, []).append((s, kind, u))
    return [(b, sorted(b + added.get(k, []))) for k, b in enumerate(base)]


def sample(docs: DataFrame, many: int = SAMPLE_TEXTS) -> DataFrame | None:
    """About many texts that hold a trigger, by their hash, each as a window of 2000 code points around one; None without any."""
    rows = docs.select("text").where("text rlike '[0-9@]'").select("text", F.xxhash64("text").alias("_h"))
    few = picked(rows.select("_h"), "_h", many)
    if few is None:
        return None
    found = rows.join(few, "_h").groupBy("_h").agg(F.min("text").alias("text"))
    place = F.length(F.regexp_substr("text", F.lit("^[^0-9@]*")))
    return found.select(F.substr("text", F.greatest(F.lit(1), place - 300).cast("int"), F.lit(2000)).alias("text"))


def fit(docs: DataFrame) -> Net:
    """A net from the sample of docs, trained in one task."""
    some = sample(docs)
    return train([]) if some is None else fitted(some, lambda rows: train([t for (t,) in rows]))


def show(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])


def scan(docs: DataFrame, net: Net | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, counts of the base spans, base_sha256, spans.

    A null text is empty and has no span; repeated rows give equal rows; an empty table gives an empty one; other
    columns are not read. Spans that the net adds pass an exact check and meet no base span. Without a net, one is trained.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net or fit(docs))  # a net of fixed size

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(sent.value)
        for b in it:
            rows = []
            for base, spans in find_spans(reader, strings(b.column(1))):
                count = [0] * len(KINDS)
                for _, k, _ in base:
                    count[k] += 1
                rows.append((*count, hashlib.sha256(show(base).encode()).hexdigest(), show(spans)))
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.string()] * 2, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=[f.split(" ")[0] for f in FOUND.split(", ")])

    return texts(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").mapInArrow(task(run, ROWS), FOUND)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or run of overlapping ones, replaced by the first's kind in brackets."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, net: Net | None = None) -> DataFrame:
    """docs with personal data in text masked and n_chars following it. Texts without any, and null ones, stay."""
    sent = docs.sparkSession.sparkContext.broadcast(net or fit(docs))
    at, size = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(sent.value)
        for b in it:
            given = b.column(at).to_pylist()
            new = [None if t is None else masked(t, s) if s else t for t, (_, s) in zip(given, find_spans(reader, [t or "" for t in given]), strict=True)]
            columns = list(b.columns)
            columns[at] = pa.array(new, b.schema.field(at).type)
            if size is not None:
                columns[size] = pa.array([c if t is None or t == g else len(t) for t, g, c in zip(new, given, b.column(size).to_pylist(), strict=True)], b.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(task(run, ROWS), docs.schema)
