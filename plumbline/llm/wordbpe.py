"""BPE encoding by dynamic programming over prefixes.

Under BPE each prefix of a word has one last token. A suffix automaton of the vocabulary gives the tokens that end at a
place; of these the last token is the one that may stand after the last token of what is before it. Back-pointers then
give the ids. Two tokens may stand side by side if no merge joins them across their border at any time.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import strings, task, texts

#: The words of the vocabulary's pre-tokenizer.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = "</w>"
#: The last symbol of a word is another symbol: its code is larger by this.
LAST = 0x400
_SYMBOL_BITS, _MATCH_BITS = 12, 10
_SYMBOL_MASK, _MATCH_MASK = (1 << _SYMBOL_BITS) - 1, (1 << _MATCH_BITS) - 1
#: A worker forgets what it knows once it has so many words or chunks; texts come in groups of about so many characters.
CACHE_WORDS, GROUP_CHARS = 250_000, 2_000_000
NEVER = 1 << 60

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself where it is printable, else the next free one from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in kept}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(kept))
    return [out[b] for b in range(256)]


def symbols(token: str) -> str:
    return token[: -len(END) - 1] + chr(ord(token[-len(END) - 1]) + LAST) if token.endswith(END) and len(token) > len(END) else token


class Vocabulary:
    """What encoding needs, in plain arrays, to be sent to the workers once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        vocab = d["model"]["vocab"]
        self.tokens = [""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.tokens[i] = t
        self.special = {x["content"]: x["id"] for x in d["added_tokens"]}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in d["model"]["merges"]]
        self.merges = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64)
        for t, i in self.special.items():
            if i >= len(self.tokens):
                self.tokens += [""] * (i + 1 - len(self.tokens))
            self.tokens[i] = t
        self._automaton({symbols(t): i for t, i in vocab.items()})

    def _automaton(self, of: dict[str, int]) -> None:
        """The suffix automaton of all tokens: keys (state, symbol), next states, links, lengths, and tokens by state."""
        follow: list[dict[str, int]] = [{}]
        link, length = [-1], [0]

        def extend(last: int, c: str) -> int:
            q = follow[last].get(c)
            if q is not None and length[q] == length[last] + 1:
                return q
            new = q
            if q is None:
                new = len(follow)
                follow.append({})
                link.append(0)
                length.append(length[last] + 1)
                p = last
                while p >= 0 and c not in follow[p]:
                    follow[p][c] = new
                    p = link[p]
                if p < 0:
                    return new
                q = follow[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                    return new
            else:
                p = last
            copy = len(follow)
            follow.append(dict(follow[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            while p >= 0 and follow[p].get(c) == q:
                follow[p][c] = copy
                p = link[p]
            link[q] = copy
            if new != q:
                link[new] = copy
                return new
            return copy

        for t in of:
            last = 0
            for c in t:
                last = extend(last, c)
        ends = []
        for t, i in of.items():
            s = 0
            for c in t:
                s = follow[s][c]
            ends.append((s, len(t), i))
        self.keys = np.array([(s << _SYMBOL_BITS) | ord(c) for s, d in enumerate(follow) for c in d], np.int64)
        self.next = np.array([n for d in follow for n in d.values()], np.int32)
        self.link, self.length = np.array(link, np.int32), np.array(length, np.int32)
        self.ends = np.array(sorted(ends, key=lambda x: (x[0], -x[1])), np.int64)


class Encoder:
    def __init__(self, v: Vocabulary):
        import regex

        self.find = regex.compile(WORD).findall
        self.white = regex.compile(r"\s+")
        self.follow = dict(zip(v.keys.tolist(), v.next.tolist(), strict=True))
        self.link, self.length = v.link.tolist(), v.length.tolist()
        self.ending: dict[int, list[tuple[int, int]]] = {}
        for s, n, i in v.ends.tolist():
            self.ending.setdefault(s, []).append((n, i))
        up = self.link.copy()  # the nearest state with tokens, from each state on
        for s in np.argsort(v.length, kind="stable").tolist()[1:]:
            if up[s] > 0 and up[s] not in self.ending:
                up[s] = up[up[s]]
        self.up = up
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(v.merges.tolist())}
        self.made = {c: (r, a, b) for r, (a, b, c) in enumerate(v.merges.tolist())}
        self.tokens, self.special = v.tokens, v.special
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, v.special)) + ")").split
        self.byte = byte_symbols()
        self.pairs: dict[int, bool] = {}
        self.edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.steps: dict[int, tuple[int, list[tuple[int, int]]]] = {}
        self.words: dict[str, tuple[int, bytes, bytes]] = {}
        self.chunks: dict[str, tuple[int, bytes, bytes]] = {}

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at one edge of a token while it is made, each with the rank of the merge that ends it."""
        found = self.edges.get((token, side))
        if found is None:
            found, until, t = [], NEVER, token
            while True:
                found.append((t, until))
                if t not in self.made:
                    break
                until, *parts = self.made[t]
                t = parts[side]
            self.edges[token, side] = found
        return found

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b stay apart side by side; of equal merges the left one comes first."""
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            rank, known = self.rank, True
            for x, x_until in self.edge(a, 1):
                for y, y_until in self.edge(b, 0):
                    r = rank.get((x, y))
                    if r is not None and r < x_until and r <= y_until:
                        known = False
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def candidates(self, state: int, match: int) -> list[tuple[int, int]]:
        """The tokens (length, id) that end where the automaton stands, the longest first."""
        found, v, m = [], state, match
        while v > 0:
            found += [x for x in self.ending.get(v, ()) if x[0] <= m]
            v = self.up[v]
            m = self.length[v]
        return found

    def step(self, key: int) -> tuple[int, list[tuple[int, int]]]:
        """From state, match and symbol, packed, to the next state and match, packed for the next symbol, and its tokens."""
        code, at = key & _SYMBOL_MASK, key >> _SYMBOL_BITS
        state, match = at >> _MATCH_BITS, at & _MATCH_MASK
        while (t := self.follow.get(state << _SYMBOL_BITS | code)) is None:
            state = self.link[state]
            match = self.length[state]
        if len(self.steps) > 250_000:
            self.steps.clear()
        found = self.steps[key] = ((t << _MATCH_BITS | match + 1) << _SYMBOL_BITS, self.candidates(t, match + 1))
        return found

    def encode_words(self, spelled: list[str]) -> Iterator[list[int]]:
        """The ids of words, given as symbols in sorted order: what a word's prefix shares with the word before is kept."""
        steps, step, pairs, compatible = self.steps, self.step, self.pairs, self.compatible
        last, size, at = [0], [0], [0]
        before = ""
        for s in spelled:
            n, k = len(s), 0
            for x, y in zip(before, s, strict=False):
                if x != y:
                    break
                k += 1
            del last[k + 1 :], size[k + 1 :], at[k + 1 :]
            state = at[k]
            for i in range(k, n):
                key = state | ord(s[i])
                state, found = steps.get(key) or step(key)
                for m, token in found:
                    if m <= i:
                        a = last[i + 1 - m]
                        ok = pairs.get(a << 20 | token)
                        if ok is None:
                            ok = compatible(a, token)
                        if not ok:
                            continue
                    last.append(token)
                    size.append(m)
                    at.append(state)
                    break
                else:
                    raise ValueError(f"no token ends the prefix {s[: i + 1]!r}")
            before, out, i = s, [], n
            while i:
                out.append(last[i])
                i -= size[i]
            out.reverse()
            yield out

    def spell(self, word: str) -> str:
        s = "".join([self.byte[b] for b in word.encode()])
        return s[:-1] + chr(ord(s[-1]) + LAST)

    def parts(self, chunk: str) -> list[str]:
        """The words of what stands between white space."""
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
        low = chunk.lower()
        return [low] if low.isalpha() and low.isascii() else self.find(low)

    def learn(self, chunks: set[str]) -> None:
        """Encodes the words that are new, all in sorted order, and then the chunks."""
        split = {c: self.parts(c) for c in chunks}
        new = {w for ws in split.values() for w in ws if w not in self.words}
        spelled = sorted([(self.spell(w), w) for w in new])
        for (_, w), ids in zip(spelled, self.encode_words([s for s, _ in spelled]), strict=True):
            self.words[w] = (len(ids), array("I", ids).tobytes(), " ".join([self.tokens[i] for i in ids]).encode())
        words = self.words
        for c, ws in split.items():
            if len(ws) == 1:
                self.chunks[c] = words[ws[0]]
            else:
                xs = [words[w] for w in ws]
                self.chunks[c] = (sum([x[0] for x in xs]), b"".join([x[1] for x in xs]), b" ".join([x[2] for x in xs]))

    def pieces(self, text: str) -> list[tuple[bool, list[str]]]:
        """Special tokens, and the chunks between white space of what is between them."""
        out = []
        for p in self.split_special(text) if any(s in text for s in self.special) else (text,):
            if p in self.special:
                out.append((True, [p]))
            else:  # some separators are white space to str.split() alone
                out.append((False, self.white.split(p) if any(c in p for c in "\x1c\x1d\x1e\x1f") else p.split()))
        return out

    def encode(self, some: list[str]) -> Iterator[tuple[int, bytes, bytes]]:
        """For each text: number of ids, ids (little-endian unsigned 32-bit), decoded text (UTF-8)."""
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        if len(self.chunks) > CACHE_WORDS:
            self.chunks.clear()
        known = self.chunks
        cut = [self.pieces(t) for t in some]
        self.learn({c for ps in cut for is_special, cs in ps if not is_special for c in cs if c not in known})
        for ps in cut:
            found = []
            for is_special, cs in ps:
                if is_special:
                    found.append((1, self.special[cs[0]].to_bytes(4, "little"), cs[0].encode()))
                else:
                    found += [known[c] for c in cs]
            yield sum([x[0] for x in found]), b"".join([x[1] for x in found]), b" ".join([x[2] for x in found if x[0]])


_encoders: dict[str, Encoder] = {}


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text is empty and has no token; other columns are not read; an empty table gives an empty one. path is the
    vocabulary's file on the driver.
    """
    key = uuid.uuid4().hex
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))  # as large as the vocabulary, whatever the input

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = Encoder(sent.value)
        e = _encoders[key]
        for b in it:
            ids, some = b.column(0), strings(b.column(1))
            lo = 0
            while lo < len(some):
                hi, n = lo, 0
                while hi < len(some) and n < GROUP_CHARS:
                    n += len(some[hi])
                    hi += 1
                rows = [(k, hashlib.sha256(i).hexdigest(), hashlib.sha256(d).hexdigest()) for k, i, d in e.encode(some[lo:hi])]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                lo = hi

    return texts(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").mapInArrow(task(run), ENCODED)
