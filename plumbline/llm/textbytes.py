"""Words and their hashes over the bytes of many texts at once, with numpy."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base and its inverse modulo 2^64, to the powers 0 to n - 1."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    found = _powers[0][:n], _powers[1][:n]
    if n > 1 << 22:  # a very long text: its powers are not kept
        _powers[:] = [p[: 1 << 20].copy() for p in _powers]
    return found


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


#: ASCII white space.
WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_letter = np.arange(256)
#: ASCII letters and every byte of another character.
LETTER = ((_letter >= 65) & (_letter <= 90)) | ((_letter >= 97) & (_letter <= 122)) | (_letter >= 128)
ASCII_LETTER = LETTER & (_letter < 128)


def lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 with ASCII and Latin-1 capitals in lower case."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        after = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][after] += 32
    return out


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the runs of bytes for which inside holds; no run crosses texts."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    own = inside[data]
    first, last = own.copy(), own.copy()
    first[1:] &= ~own[:-1]
    last[:-1] &= ~own[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = own[edge]
    last[edge - 1] = own[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.searchsorted(offsets, start, "right") - 1, start, end


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes, equal for equal spans."""
    up, down = powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def shingles(text: np.ndarray, hashes: np.ndarray, n: int, width: int = 5) -> list[np.ndarray]:
    """For each of n texts, the sorted distinct hashes of its runs of width words; of all its words if it has fewer."""
    bounds = np.searchsorted(text, np.arange(n + 1))
    if len(hashes) >= width:
        total = np.zeros(len(hashes) - width + 1, np.uint64)
        for k in range(width):
            total = (total + hashes[k : len(hashes) - width + 1 + k]) * np.uint64(0xD6E8FEB86659FD93)
            total ^= total >> np.uint64(32)
        total = mix(total)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(total[a : b - width + 1]))
        elif b > a:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for x in hashes[a:b]:
                    h = h * np.uint64(0xD6E8FEB86659FD93) + x
            out.append(mix(np.array([h])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
