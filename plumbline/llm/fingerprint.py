"""Document fingerprints from prefix polynomial hashes.

Arrays of prefix hashes modulo two primes answer the equality of any two spans at once, and binary search on them finds
the longest common extension of two places. A fingerprint is the hash of the whole text and the least hashes of its
windows; two fingerprints are as alike as the windows they share. Texts at hand are compared by all their windows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import task

#: Two primes below 2^31, and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
WINDOW, KEPT = 24, 64
FINGERPRINTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_powers: list[np.ndarray] = [np.ones(1, np.uint64) for _ in range(4)]


def _power(k: int, n: int) -> np.ndarray:
    """Powers 0 to n - 1 of the k-th of the two bases and their two inverses."""
    have = _powers[k]
    if len(have) < n:
        p, b = PRIMES[k % 2], BASES[k % 2]
        b = b if k < 2 else pow(b, -1, p)
        while len(have) < n:  # doubling: the next powers are those there, times the last but one
            have = np.concatenate([have, have * np.uint64(pow(b, len(have), p)) % np.uint64(p)])
        _powers[k] = have[: max(n, 1 << 18)]
    return have[:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class PrefixHash:
    """The prefix hashes of a sequence of code points."""

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        self.prefix = []
        self.sets: dict[int, np.ndarray] = {}
        c = points.astype(np.uint64) + np.uint64(1)
        for k, p in enumerate(PRIMES):
            h = np.zeros(self.n + 1, np.uint64)
            np.cumsum(c * _power(k, self.n) % np.uint64(p), out=h[1:])
            self.prefix.append(h % np.uint64(p))

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 62-bit hash of each span; equal spans have equal ones, at whatever place and in whatever text."""
        out = np.zeros(len(start), np.uint64)
        for k, p in enumerate(PRIMES):
            q, h = np.uint64(p), self.prefix[k]
            out = (out << np.uint64(31)) | ((h[end] + q - h[start]) % q * _power(2 + k, self.n + 1)[start] % q)
        return out

    def windows(self, width: int) -> np.ndarray:
        """The hashes of all spans of a width."""
        m, out = self.n - width + 1, np.zeros(max(0, self.n - width + 1), np.uint64)
        for k, p in enumerate(PRIMES):
            q, h = np.uint64(p), self.prefix[k]
            out = (out << np.uint64(31)) | ((h[width:] + q - h[:m]) % q * _power(2 + k, m) % q)
        return out

    def distinct(self, width: int) -> np.ndarray:
        """The distinct hashes of all spans of a width, in order."""
        if width not in self.sets:
            self.sets[width] = np.unique(self.windows(width))
        return self.sets[width]

    def span(self, start: int, end: int) -> int:
        return int(self.spans(np.array([start]), np.array([end]))[0])

    def same(self, start: int, end: int, other: PrefixHash, at: int) -> bool:
        """Whether the span stands in other at a place."""
        return at + end - start <= other.n and self.span(start, end) == other.span(at, at + end - start)

    def extension(self, start: int, other: PrefixHash, at: int) -> int:
        """The length of the longest common extension of two places."""
        lo, hi = 0, min(self.n - start, other.n - at)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self.same(start, start + mid, other, at):
                lo = mid
            else:
                hi = mid - 1
        return lo


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def least(h: np.ndarray, kept: int) -> np.ndarray:
    """The kept least distinct values, in order."""
    part = 4 * kept
    while True:
        few = np.unique(h if part >= len(h) else h[h <= np.uint64((1 << 64) // len(h) * part - 1)])
        if len(few) >= kept or part >= len(h):
            return few[:kept]
        part *= 8


def fingerprint(points: np.ndarray, h: PrefixHash | None = None) -> tuple[int, int, np.ndarray]:
    """Length, hash of the whole, and least window hashes. A text shorter than a window is one window; an empty one has none."""
    h = h or PrefixHash(points)
    if not h.n:
        return 0, 0, np.zeros(0, np.uint64)
    whole = h.span(0, h.n)
    return h.n, whole, least(_spread(h.distinct(WINDOW) if h.n >= WINDOW else np.array([whole], np.uint64)), KEPT)


def text_form(f: tuple[int, int, np.ndarray]) -> str:
    return f"{f[0]:x}.{f[1]:x}.{base64.b64encode(f[2].astype('<u8').tobytes()).decode()}"


def parse(form: str) -> tuple[int, int, np.ndarray]:
    n, whole, rest = form.split(".")
    return int(n, 16), int(whole, 16), np.frombuffer(base64.b64decode(rest), "<u8")


def likeness(a: tuple[int, int, np.ndarray], b: tuple[int, int, np.ndarray]) -> float:
    """The share of windows that two texts have in common, out of both texts' (Dice), as their fingerprints tell."""
    if a[:2] == b[:2]:
        return 1.0
    if not len(a[2]) or not len(b[2]):
        return 0.0
    union = np.union1d(a[2], b[2])[:KEPT]  # the least of both texts' windows
    j = (np.isin(union, a[2]) & np.isin(union, b[2])).mean()
    return float(2 * j / (1 + j))


def common(a: PrefixHash, b: PrefixHash, width: int = WINDOW) -> float:
    """The share of windows that two texts have in common, out of both texts' (Dice), by all windows."""
    if a.n == b.n and a.span(0, a.n) == b.span(0, b.n):
        return 1.0
    if min(a.n, b.n) < width:
        return 0.0
    u, v = a.distinct(width), b.distinct(width)
    shared = int((v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u).sum())
    return 2 * shared / (len(u) + len(v))


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, text): the fingerprint of the text and of its edited text.

    The edited text has its last third replaced by as much of the start of the next document by descending doc_id.
    near_edited and near_next are the shares of windows in common with the edited and the next text, by all windows; for
    near_edited, windows are half as wide as the shorter text where that is less, so that each has some that are kept. A
    null text is empty; rows of one id follow each other by a hash of their texts; rows without an id come last. Rows
    are dealt by ranges of doc_id, their texts compressed, and the first row of each range goes to the range before
    too, so that each text moves once. An empty table gives an empty one; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = rows.agg(F.max("key").alias("top"), F.percentile_approx("key", [k / parts for k in range(1, parts)] or [0.5], 100 * parts).alias("cuts")).first()
    if found["top"] is None:
        return spark.createDataFrame([], FINGERPRINTS)
    top = found["top"]
    cuts = np.array(sorted({c for c in found["cuts"] if c != top}), np.int64)  # as many as partitions

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for b in it:
            key = b.column(0).to_numpy()
            part = len(cuts) - np.searchsorted(cuts, key, "left")
            body = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in b.column(2)]
            tie = [int.from_bytes(hashlib.blake2b(t, digest_size=7).digest(), "big") for t in body]
            body = [pack(t) for t in body]
            again = np.flatnonzero(np.isin(key, cuts) | (key == top))
            to = np.where(key[again] == top, len(cuts), part[again] - 1)
            take = np.concatenate([np.arange(len(key)), again])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([part, to]), pa.int32()), pa.array(np.repeat([0, 1], [len(key), len(again)]), pa.int32()), pa.array(key[take]), b.column(1).take(pa.array(take)), pa.array([tie[i] for i in take], pa.int64()), pa.array([body[i] for i in take], pa.binary())], names=["part", "halo", "key", "doc_id", "tie", "body"])

    dealt = rows.mapInArrow(task(deal), "part int, halo int, key long, doc_id long, tie long, body binary")
    ordered = dealt.repartitionById(len(cuts) + 1, "part").sortWithinPartitions("part", "halo", F.desc("key"), "tie")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        names = [f.split(" ")[0] for f in FINGERPRINTS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        last, out, over = None, [], None
        for b in it:
            for part, halo, doc_id, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(5).to_pylist(), strict=True):
                if over == part:
                    continue
                points = code_points(unpack(body).decode("utf-8", "surrogatepass"))
                h = PrefixHash(points)
                if last is not None:
                    out.append(one(*last, points, h))
                last = None if halo else (doc_id, points, h)
                over = part if halo else None
                if len(out) >= 1024:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def one(doc_id: int, points: np.ndarray, h: PrefixHash, follow: np.ndarray, g: PrefixHash) -> tuple:
        cut = len(points) // 3
        edited = np.concatenate([points[: len(points) - cut], follow[:cut]])
        e = PrefixHash(edited)
        width = max(1, min(WINDOW, h.n // 2, e.n // 2))
        sha = hashlib.sha256(edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, len(points), sha, text_form(fingerprint(points, h)), text_form(fingerprint(edited, e)), common(h, e, width), common(h, g)

    return ordered.mapInArrow(task(run), FINGERPRINTS)
