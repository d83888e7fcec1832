"""Patch similarity of key points: ZNCC and two normalised mutual informations.

Pixels are sent to tiles with a margin, the different places of points to the pair of tiles that holds them, and numpy works
group by group: a task holds two tiles, and no pixel is repeated for each point. ``patch_sums`` is the relational form of the same gather.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import nearest, pixel
from .keypoints import HALF_CHIP, patch_bounds

HALF_ZNCC, BINS, TILE = 21, 32, 256
PATCHES, CHUNK = 4096, 16
PLACES, TILES = ("xr", "yr", "xm", "ym"), ("ref_tile_x", "ref_tile_y", "mon_tile_x", "mon_tile_y")
KEYS = (*TILES, "_slice")
SCORES = "xr long, yr long, xm long, ym long, zncc double, nmi_sum double, nmi_studholme double"


def zncc(a: np.ndarray, b: np.ndarray) -> float:
    """Zero-normalised cross-correlation of two patches; NaN if one is constant."""
    a, b = a.astype(float) - a.mean(), b.astype(float) - b.mean()
    s = np.sqrt((a * a).sum() * (b * b).sum())
    return float((a * b).sum() / s) if s > 0 else float("nan")


def bins_of(v: np.ndarray, bins: int) -> np.ndarray:
    lo, hi = v.min(), v.max()
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    return np.minimum(np.floor((v - lo) * float(bins) / (hi - lo)).astype(np.int64), bins - 1)


def entropies(a: np.ndarray, b: np.ndarray, bins: int = BINS) -> tuple[float, float, float]:
    """Natural entropies of two patches' histograms and of their joint one."""
    joint = np.bincount(bins_of(a.ravel().astype(float), bins) * bins + bins_of(b.ravel().astype(float), bins), minlength=bins * bins).reshape(bins, bins) / a.size
    h = lambda p: float(-(p[p > 0] * np.log(p[p > 0])).sum())
    return h(joint.sum(1)), h(joint.sum(0)), h(joint.ravel())


def nmi_sum(a: np.ndarray, b: np.ndarray, bins: int = BINS) -> float:
    """2 (Hx + Hy - Hxy) / (Hx + Hy), in [0, 1]; NaN if both are constant."""
    x, y, xy = entropies(a, b, bins)
    return 2 * (x + y - xy) / (x + y) if x + y > 0 else float("nan")


def nmi_studholme(a: np.ndarray, b: np.ndarray, bins: int = BINS) -> float:
    """(Hx + Hy) / Hxy, in [1, 2]; NaN if both are constant."""
    x, y, xy = entropies(a, b, bins)
    return (x + y) / xy if xy > 0 else float("nan")


def _to_tiles(px: DataFrame, size: int, margin: int) -> DataFrame:
    """Pixels with the tiles whose area, widened by a margin, holds them."""
    span = lambda c: F.sequence(F.floor((F.col(c) - margin) / size).cast("int"), F.floor((F.col(c) + margin) / size).cast("int"))
    return px.select("*", F.explode(span("x")).alias("tile_x"), span("y").alias("_ty")).select(*px.columns, "tile_x", F.explode("_ty").alias("tile_y"))


def all_scores(ref: np.ndarray, mon: np.ndarray, at: np.ndarray) -> np.ndarray:
    """ZNCC and both mutual informations (n, 3) of the chips around places (xr, yr, xm, ym) of two images."""
    side = 2 * HALF_CHIP + 1
    inner = slice(HALF_CHIP - HALF_ZNCC, HALF_CHIP + HALF_ZNCC + 1)
    views = [np.lib.stride_tricks.sliding_window_view(im, (side, side)) for im in (ref, mon)]
    out = np.empty((len(at), 3))
    for k in range(0, len(at), CHUNK):
        p = at[k : k + CHUNK] - HALF_CHIP
        n, bins, centred = len(p), [], []
        for view, x, y in zip(views, (p[:, 0], p[:, 2]), (p[:, 1], p[:, 3]), strict=True):
            v = view[y, x]
            z = v[:, inner, inner].reshape(n, -1)
            centred.append(z - z.mean(1, keepdims=True))
            v = v.reshape(n, -1)
            lo, hi = v.min(1, keepdims=True), v.max(1, keepdims=True)
            flat = lo == hi
            lo, hi = lo - 0.5 * flat, hi + 0.5 * flat
            v -= lo
            v *= float(BINS)
            v /= hi - lo
            bins.append(np.minimum(v.astype(np.int64), BINS - 1))  # none is negative
        joint = np.bincount((np.arange(n)[:, None] * BINS**2 + bins[0] * BINS + bins[1]).ravel(), minlength=n * BINS**2).reshape(n, BINS, BINS) / side**2
        h = [-(q * np.log(np.where(q > 0, q, 1))).reshape(n, -1).sum(1) for q in (joint.sum(2), joint.sum(1), joint)]
        e, (u, w) = h[0] + h[1], centred
        with np.errstate(divide="ignore", invalid="ignore"):
            s = np.sqrt((u * u).sum(1) * (w * w).sum(1))
            out[k : k + n, 0] = np.where(s > 0, (u * w).sum(1) / s, np.nan)
            out[k : k + n, 1] = np.where(e > 0, 2 * (e - h[2]) / e, np.nan)
            out[k : k + n, 2] = np.where(h[2] > 0, e / h[2], np.nan)
    return out


def patch_scores(kp: DataFrame, pairs: DataFrame, width: int, height: int, threshold: float | None = 0.4, size: int = TILE, most: int = PATCHES) -> DataFrame:
    """kp_id and the three scores of points of at least the threshold; null where a chip leaves an image or is constant.

    pairs: x, y, ref, mon. Points with the same two places have the same scores, which are found once. A group holds places
    of one tile of each image, about as many as most, and these two tiles with a margin of half a chip, so that neither the
    number of points nor the largest displacement is in the size of a task.
    """
    scored = F.col("in_bounds") if threshold is None else F.col("in_bounds") & (F.col("score") >= threshold)
    b = patch_bounds(kp, width, height).select("kp_id", *PLACES, F.coalesce(scored, F.lit(False)).alias("_scored"))
    tile = lambda c: F.floor(F.col(c) / size).cast("int")
    places = b.where("_scored").select(*PLACES).distinct().select("*", *[tile(c).alias(t) for c, t in zip(PLACES, TILES, strict=True)])
    counts = places.groupBy(*TILES).agg(F.ceil(F.count("*") / most).cast("int").alias("_slices"))
    dealt = places.join(F.broadcast(counts), [*TILES]).withColumn("_slice", F.pmod(F.xxhash64(*PLACES), F.col("_slices")).cast("int"))
    groups = counts.select(*TILES, F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("_slice"))

    def sent(value: str, x: str, y: str) -> DataFrame:
        px = _to_tiles(pairs.select("x", "y", F.col(value).cast("double").alias("v")), size, HALF_CHIP).withColumnsRenamed({"tile_x": x, "tile_y": y})
        return px.join(F.broadcast(groups), [x, y]).select(*[F.col(c).alias(c) for c in KEYS], "x", "y", "v", F.lit(value == "mon").alias("mon"))  # columns of their own, for the cogroup

    def score(key: tuple, pts: pd.DataFrame, px: pd.DataFrame) -> pd.DataFrame:
        if pts.empty:
            return pd.DataFrame({c: [] for c in (*PLACES, "zncc", "nmi_sum", "nmi_studholme")})
        images, at = np.zeros((2, size + 2 * HALF_CHIP, size + 2 * HALF_CHIP)), pts[list(PLACES)].to_numpy()
        start = np.array(key[:4]) * size - HALF_CHIP
        for im, (x0, y0), one in zip(images, (start[:2], start[2:]), (px[~px["mon"].astype(bool)], px[px["mon"].astype(bool)]), strict=True):
            im[one["y"] - y0, one["x"] - x0] = one["v"]
        got = all_scores(*images, at - start)
        return pd.DataFrame({**{c: at[:, k] for k, c in enumerate(PLACES)}, "zncc": got[:, 0], "nmi_sum": got[:, 1], "nmi_studholme": got[:, 2]})

    pixels = sent("ref", *TILES[:2]).unionByName(sent("mon", *TILES[2:]))
    found = dealt.groupBy(*KEYS).cogroup(pixels.groupBy(*KEYS)).applyInPandas(score, SCORES)
    clean = found.select(*PLACES, *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("zncc", "nmi_sum", "nmi_studholme")])
    none = b.where(~F.col("_scored")).select("kp_id", *[F.lit(None).cast("double").alias(c) for c in ("zncc", "nmi_sum", "nmi_studholme")])
    return b.where("_scored").join(clean, [*PLACES], "left").select(*none.columns).unionByName(none)


def _window(at: DataFrame, px: DataFrame, half: int) -> DataFrame:
    """cx, cy, x, y and the rest of px for each pixel of the window around a place (cx, cy).

    Exploded rows are many times what Spark estimates, so that they must not be broadcast: rows are sorted and merged.
    """
    span = lambda c: F.sequence(F.col(c) - half, F.col(c) + half)
    rows = at.select("cx", "cy", F.explode(span("cx")).alias("x"), span("cy").alias("_ys")).select("cx", "cy", "x", F.explode("_ys").alias("y"))
    return rows.join(px.hint("merge"), ["x", "y"])


def patch_sums(kp: DataFrame, px: DataFrame, half: int) -> DataFrame:
    """kp_id, n, total of dn over the window around each point: windows are summed once for each pixel that holds points."""
    at = kp.select("kp_id", pixel("x0").alias("cx"), pixel("y0").alias("cy"))
    sums = _window(at.select("cx", "cy").distinct(), px, half).groupBy("cx", "cy").agg(F.count("*").alias("n"), F.sum("dn").alias("total"))
    return at.join(sums.hint("merge"), ["cx", "cy"]).groupBy("kp_id").agg(F.sum("n").alias("n"), F.sum("total").cast("long").alias("total"))


def chips(kp: DataFrame, px: DataFrame, half: int = HALF_CHIP) -> DataFrame:
    """kp_id and the window around each point as an array, row by row; only whole windows."""
    at = kp.select("kp_id", pixel("x0").alias("cx"), pixel("y0").alias("cy"))
    got = _window(at.select("cx", "cy").distinct(), px, half).groupBy("cx", "cy").agg(F.sort_array(F.collect_list(F.struct("y", "x", "dn"))).alias("c"))
    whole = got.where(F.size("c") == (2 * half + 1) ** 2).select("cx", "cy", F.transform("c", lambda p: p["dn"]).alias("chip"))
    return at.join(whole.hint("merge"), ["cx", "cy"]).select("kp_id", "chip")


def moved(kp: DataFrame) -> DataFrame:
    """Points at their place in the monitored image."""
    return kp.withColumn("x0", nearest(F.col("x0") + F.col("dx")).cast("double")).withColumn("y0", nearest(F.col("y0") + F.col("dy")).cast("double"))


