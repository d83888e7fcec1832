"""Numeric kernels on image arrays: filters, corners, optical flow, phase correlation, equalisation."""

from __future__ import annotations

import numpy as np

#: The five-tap pyramid filter, and the Scharr derivative and its smoothing.
PYRAMID = np.array([1, 4, 6, 4, 1]) / 16
SCHARR = np.array([3, 10, 3]) / 32
DERIVATIVE = np.array([-1, 0, 1])


def correlate(img: np.ndarray, kx: np.ndarray, ky: np.ndarray) -> np.ndarray:
    """Separable correlation, borders mirrored without the edge itself."""
    out = img.astype(np.float64)
    for axis, k in ((1, kx), (0, ky)):
        h = len(k) // 2
        pad = [(0, 0), (0, 0)]
        pad[axis] = (h, h)
        p = np.pad(out, pad, mode="reflect" if out.shape[axis] > h else "edge")
        n = out.shape[axis]
        out = sum(w * (p[:, i : i + n] if axis else p[i : i + n]) for i, w in enumerate(k))
    return out


def stretch(img: np.ndarray) -> np.ndarray:
    """Eight-bit values by the least and largest; bytes stay as they are."""
    if img.dtype == np.uint8:
        return img
    lo, hi = np.nanmin(img), np.nanmax(img)
    return np.zeros(img.shape, np.uint8) if not hi > lo else np.nan_to_num(np.floor((img - lo) / (hi - lo) * 255)).astype(np.uint8)


def stretch_percentile(img: np.ndarray, low: float = 2, high: float = 98) -> np.ndarray:
    v = img[np.isfinite(img)]
    if not len(v):
        return np.zeros(img.shape, np.uint8)
    a, b = np.percentile(v, [low, high])
    return np.zeros(img.shape, np.uint8) if not b > a else np.nan_to_num(np.clip((img - a) / (b - a), 0, 1) * 255).astype(np.uint8)


def _powers(k: int, base: list[int], times: int) -> np.ndarray:
    out = np.array(base, float)
    for _ in range(times):
        out = np.convolve(out, [1, 1])
    return out


def laplacian(u8: np.ndarray, k: int) -> np.ndarray:
    """Sum of the two second derivatives under a kernel of odd size k, cut to eight bits."""
    if k == 1:
        d2, smooth = np.array([1.0, -2, 1]), np.array([0.0, 1, 0])
    else:
        d2, smooth = _powers(k, [1, -2, 1], k - 3), _powers(k, [1], k - 1)
    out = correlate(u8, d2, smooth) + correlate(u8, smooth, d2)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def sobel(img: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = np.array([1, 2, 1])
    return correlate(img, DERIVATIVE, s), correlate(img, s, DERIVATIVE)


def box(img: np.ndarray, size: int) -> np.ndarray:
    """Sums over a square of a size, by prefix sums."""
    h = size // 2
    p = np.pad(img, ((h + 1, size - 1 - h), (h + 1, size - 1 - h)), mode="reflect" if min(img.shape) > size else "edge").cumsum(0).cumsum(1)
    return p[size:, size:] - p[:-size, size:] - p[size:, :-size] + p[:-size, :-size]


def min_eigen(img: np.ndarray, block: int) -> np.ndarray:
    gx, gy = sobel(img)
    a, b, c = box(gx * gx, block), box(gx * gy, block), box(gy * gy, block)
    return (a + c) / 2 - np.sqrt(((a - c) / 2) ** 2 + b * b)


def corners(img: np.ndarray, mask: np.ndarray | None, most: int, quality: float, distance: float, block: int) -> np.ndarray:
    """Corners (x, y) by falling response: local maxima that are no nearer to a better one than distance; most = 0 is all."""
    r = min_eigen(img, block)
    top = r.max() if r.size else 0
    if not top > 0:
        return np.zeros((0, 2))
    p = np.pad(r, 1, constant_values=-np.inf)
    peak = np.max([p[i : i + r.shape[0], j : j + r.shape[1]] for i in range(3) for j in range(3)], 0)
    ok = (r >= quality * top) & (r == peak)
    ok[[0, -1]] = False
    ok[:, [0, -1]] = False
    if mask is not None:
        ok &= mask != 0
    ys, xs = np.nonzero(ok)
    order = np.argsort(-r[ys, xs], kind="stable")
    taken: dict[tuple[int, int], list[tuple[int, int]]] = {}
    cell, out = max(1, int(distance)), []
    for x, y in zip(xs[order].tolist(), ys[order].tolist(), strict=True):
        cx, cy = x // cell, y // cell
        if distance >= 1 and any((x - u) ** 2 + (y - v) ** 2 < distance**2 for i in (-1, 0, 1) for j in (-1, 0, 1) for u, v in taken.get((cx + i, cy + j), ())):
            continue
        taken.setdefault((cx, cy), []).append((x, y))
        out.append((x, y))
        if most and len(out) >= most:
            break
    return np.array(out, float).reshape(-1, 2)


def sample(img: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear values; coordinates are held inside the image."""
    h, w = img.shape
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    i, j = np.minimum(x.astype(int), max(0, w - 2)), np.minimum(y.astype(int), max(0, h - 2))
    u, v = x - i, y - j
    i1, j1 = np.minimum(i + 1, w - 1), np.minimum(j + 1, h - 1)
    return img[j, i] * (1 - u) * (1 - v) + img[j, i1] * u * (1 - v) + img[j1, i] * (1 - u) * v + img[j1, i1] * u * v


def flow(a: np.ndarray, b: np.ndarray, points: np.ndarray, window: int, levels: int = 1, rounds: int = 30, eps: float = 0.03) -> np.ndarray:
    """Places in b of points of a by pyramidal Lucas-Kanade, all points at once in groups."""
    pyramid = [(a.astype(float), b.astype(float))]
    for _ in range(levels):
        pyramid.append(tuple(correlate(i, PYRAMID, PYRAMID)[::2, ::2] for i in pyramid[-1]))
    slopes = [(correlate(i, DERIVATIVE, SCHARR), correlate(i, SCHARR, DERIVATIVE)) for i, _ in pyramid]
    h = window // 2
    oy, ox = np.mgrid[-h : h + 1, -h : h + 1]
    out = np.zeros_like(points)
    for lo in range(0, len(points), 512):
        p = points[lo : lo + 512]
        move = np.zeros_like(p)
        for level in range(levels, -1, -1):
            (i, j), (gx, gy) = pyramid[level], slopes[level]
            at, move = p / 2**level, move * 2
            x, y = at[:, 0, None, None] + ox, at[:, 1, None, None] + oy
            t, dx, dy = sample(i, x, y), sample(gx, x, y), sample(gy, x, y)
            sxx, sxy, syy = (dx * dx).sum((1, 2)), (dx * dy).sum((1, 2)), (dy * dy).sum((1, 2))
            det = sxx * syy - sxy * sxy
            det = np.where(det > 1e-9, det, np.inf)
            live = np.ones(len(p), bool)
            for _ in range(rounds):
                k = np.flatnonzero(live)
                if not len(k):
                    break
                e = t[k] - sample(j, x[k] + move[k, 0, None, None], y[k] + move[k, 1, None, None])
                bx, by = (e * dx[k]).sum((1, 2)), (e * dy[k]).sum((1, 2))
                step = np.stack([(syy[k] * bx - sxy[k] * by) / det[k], (sxx[k] * by - sxy[k] * bx) / det[k]], 1)
                move[k] += step
                live[k] = np.hypot(step[:, 0], step[:, 1]) >= eps
        out[lo : lo + 512] = p + move
    return out


def phase_peak(moved: np.ndarray, fixed: np.ndarray) -> tuple[int, int]:
    """(row, column) by which moved has to go to meet fixed, by the peak of the normalised cross-power spectrum."""
    spectrum = np.fft.fft2(moved) * np.conj(np.fft.fft2(fixed))
    c = np.abs(np.fft.ifft2(spectrum / np.maximum(np.abs(spectrum), 1e-12)))
    at = np.unravel_index(int(c.argmax()), c.shape)
    return tuple(-int(k) if k <= n // 2 else n - int(k) for k, n in zip(at, c.shape, strict=True))


def shift(img: np.ndarray, x_off: int, y_off: int) -> np.ndarray:
    """out[y, x] = img[y + y_off, x + x_off], zero outside."""
    h, w = img.shape
    out = np.zeros_like(img)
    ys, xs = slice(max(0, -y_off), min(h, h - y_off)), slice(max(0, -x_off), min(w, w - x_off))
    if ys.stop > ys.start and xs.stop > xs.start:
        out[ys, xs] = img[ys.start + y_off : ys.stop + y_off, xs.start + x_off : xs.stop + x_off]
    return out


def equalized(u8: np.ndarray, blocks: int = 8, clip: float = 2.0) -> np.ndarray:
    """Contrast-limited adaptive equalisation: tables by block, blended between block centres."""
    h, w = u8.shape
    by, bx = np.arange(h) * blocks // h, np.arange(w) * blocks // w
    tables = np.zeros((blocks, blocks, 256))
    for i in range(blocks):
        for j in range(blocks):
            v = u8[by == i][:, bx == j]
            n = np.bincount(v.ravel(), minlength=256).astype(float)
            cut = np.minimum(n, max(1.0, np.floor(v.size * clip / 256)))
            tables[i, j] = (np.cumsum(cut) + np.arange(1, 257) * (v.size - cut.sum()) / 256) * 255 / max(1, v.size)
    fy, fx = np.clip((np.arange(h) + 0.5) * blocks / h - 0.5, 0, blocks - 1), np.clip((np.arange(w) + 0.5) * blocks / w - 0.5, 0, blocks - 1)
    i, j = np.minimum(fy.astype(int), max(0, blocks - 2))[:, None], np.minimum(fx.astype(int), max(0, blocks - 2))[None, :]
    u, v = fx[None, :] - j, fy[:, None] - i
    i1, j1 = np.minimum(i + 1, blocks - 1), np.minimum(j + 1, blocks - 1)
    out = tables[i, j, u8] * (1 - u) * (1 - v) + tables[i, j1, u8] * u * (1 - v) + tables[i1, j, u8] * (1 - u) * v + tables[i1, j1, u8] * u * v
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)
