"""Matching of image pairs: tracked key points by tile, large offsets, alignment."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import alignment as A
from ..kernels import images as I

#: Sizes tried by the automatic search, and the forward-backward tolerance.
SIZES = (3, 5, 7, 9, 11)
TOLERANCE = 0.1
KEY_POINTS = "tile_x int, tile_y int, x0 double, y0 double, dx double, dy double, score double, mon_k int, ref_k int, polarity string, n_init int"


@dataclass(frozen=True)
class Settings:
    """How tiles are matched. ksize: (monitored, reference), or "auto"; invert: True, False or "auto"."""

    tile_size: int = 20000
    max_corners: int = 20000
    quality: float = 0.1
    min_distance: float = 10
    window: int = 25
    block: int = 15
    ksize: tuple[int, int] | str = (7, 7)
    invert: bool | str = False
    outliers: bool = False
    x_start: int = 0


def without_outliers(dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    """The rows left when those away from the mean are removed again and again."""
    keep = np.ones(len(dx), bool)
    while keep.any():
        new = keep.copy()
        for v in (dx, dy):
            away = np.abs(v - v[keep].mean())
            new &= (away < 3 * v[keep].std()) & (away < 20)
        if new.sum() == keep.sum():
            break
        keep = new
    return keep


def track(ref: np.ndarray, mon: np.ndarray, mask: np.ndarray | None, s: Settings, start: np.ndarray | None = None) -> tuple[pd.DataFrame, int] | None:
    """Key points of two eight-bit images and the number of corners; None if there is no corner."""
    p0 = I.corners(ref, mask, s.max_corners, s.quality, s.min_distance, s.block) if start is None else start
    if not len(p0):
        return None
    p1 = I.flow(ref, mon, p0, s.window)
    back = I.flow(mon, ref, p1, s.window)
    d = np.abs(p0 - back).max(1)
    ok = d < TOLERANCE
    move = p1[ok] - p0[ok]
    kp = pd.DataFrame({"x0": p0[ok, 0], "y0": p0[ok, 1], "dx": move[:, 0], "dy": move[:, 1], "score": 1 - d[ok] / TOLERANCE})
    return (kp[without_outliers(move[:, 0], move[:, 1])] if s.outliers else kp), len(p0)


def match_tile(ref: np.ndarray, mon: np.ndarray, mask: np.ndarray, s: Settings) -> pd.DataFrame | None:
    """The best track over the kernel sizes and polarities that the settings leave open; of equal ones the first."""
    ref8, mon8 = I.stretch(ref), I.stretch(mon)
    sizes = [(m, r) for m in SIZES for r in SIZES] if s.ksize == "auto" else [tuple(s.ksize)]
    polarities = ["normal", "inverted"] if s.invert == "auto" else ["inverted" if s.invert else "normal"]
    refs = {r: I.laplacian(ref8, r) for r in {r for _, r in sizes}}
    starts = {r: I.corners(im, mask, s.max_corners, s.quality, s.min_distance, s.block) for r, im in refs.items()}
    best = None
    for polarity in polarities:
        base = mon8 if polarity == "normal" else 255 - mon8
        mons = {m: I.laplacian(base, m) for m in {m for m, _ in sizes}}
        for m, r in sizes:
            got = track(refs[r], mons[m], mask, s, starts[r])
            if got and (best is None or len(got[0]) / got[1] > best[0]):
                best = len(got[0]) / got[1], got[0].assign(mon_k=m, ref_k=r, polarity=polarity, n_init=got[1])
    return best[1] if best else None


def match(pairs: DataFrame, width: int, height: int, s: Settings, mask: DataFrame | None = None, ref_nodata: float | None = None, mon_nodata: float | None = None, kinds: tuple[str, str] = ("float64", "float64")) -> DataFrame:
    """Key points of two images given as pixels (x, y, ref, mon), one task for each tile.

    Without a mask, pixels that are zero, not finite or no-data in either image are not valid; a tile without a valid
    pixel gives nothing. Each tile is stretched by itself, so the tile size is part of the result; images of bytes (kinds
    names the types of the reference and the monitored image) stay as they are.
    """
    from .raster import tile_of, with_valid

    px = pairs.join(mask.select("x", "y", (F.col("m") != 0).alias("valid")), ["x", "y"]) if mask is not None else with_valid(pairs, ref_nodata, mon_nodata)
    tx, ty = tile_of(s.tile_size)
    px = px.withColumn("tile_x", tx.cast("int")).withColumn("tile_y", ty.cast("int")).where(F.col("tile_x") * s.tile_size >= s.x_start)
    names = [c.split(" ")[0] for c in KEY_POINTS.split(", ")]

    def run(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        x_off, y_off = key[0] * s.tile_size, key[1] * s.tile_size
        w, h = min(s.tile_size, width - x_off), min(s.tile_size, height - y_off)
        images = np.zeros((3, h, w))
        for k, c in enumerate(("ref", "mon", "valid")):
            images[k, t["y"] - y_off, t["x"] - x_off] = t[c]
        both = [im.astype(np.uint8) if kind == "uint8" else im for im, kind in zip(images, kinds, strict=False)]
        kp = match_tile(*both, images[2], s) if images[2].any() else None
        if kp is None:
            return pd.DataFrame({c: [] for c in names})
        kp = kp.assign(tile_x=key[0], tile_y=key[1], x0=kp["x0"] + x_off, y0=kp["y0"] + y_off)
        return kp.sort_values(["x0", "y0"])[names]

    return px.select("tile_x", "tile_y", "x", "y", "ref", "mon", "valid").groupBy("tile_x", "tile_y").applyInPandas(run, KEY_POINTS)


def tile_choices(kp: DataFrame) -> DataFrame:
    """What the matcher settled on: a row for each tile with key points (tile_x, tile_y, mon_k, ref_k, polarity)."""
    return kp.select("tile_x", "tile_y", "mon_k", "ref_k", "polarity").distinct()


def settled(kp: DataFrame) -> tuple[tuple[int, int], bool] | None:
    """The kernel sizes (monitored, reference) and whether the monitored image is inverted, as most tiles have it.

    Of equally frequent ones the first tile decides; None without a key point.
    """
    from .stats import mode

    tiles = tile_choices(kp).withColumn("tile", F.struct("tile_y", "tile_x"))
    k, p = mode(tiles, ["mon_k", "ref_k"], "tile").first(), mode(tiles, ["polarity"], "tile").first()
    return ((k["mon_k"], k["ref_k"]), p["polarity"] == "inverted") if k else None


def write_laplacians(choices: DataFrame, reference, monitored, tile_size: int, out: str) -> DataFrame:
    """Writes the Laplacians that the tiles were matched on, and gives a row (name) for each file.

    Each task reads the windows of its tiles from the two headers' files, so out and the images are on a shared path.
    """
    from ..sources.geotiff import write

    height, width = reference.shape

    def run(it):
        for t in it:
            names = []
            for c in t.itertuples(index=False):
                x, y = c.tile_x * tile_size, c.tile_y * tile_size
                w, h = min(tile_size, width - x), min(tile_size, height - y)
                inverted = c.polarity == "inverted"
                mon, ref = (I.stretch(im.window(1, x, y, w, h)) for im in (monitored, reference))
                for name, im, k in ((f"mon_laplacian{'_inv' if inverted else ''}", 255 - mon if inverted else mon, c.mon_k), ("ref_laplacian", ref, c.ref_k)):
                    names.append(f"{name}_k{k}_{x}_{y}_{w}_{h}.tif")
                    write(f"{out}/{names[-1]}", [I.laplacian(im, k).astype("float32")], None, None, None)
            yield pd.DataFrame({"name": names})

    return choices.repartition("tile_x", "tile_y").mapInPandas(run, "name string")


def _whole(pairs: DataFrame, width: int, height: int, run, schema: str) -> DataFrame:
    """A kernel over a whole image pair, which one task holds; larger images are matched by tiles."""

    def one(t: pd.DataFrame) -> pd.DataFrame:
        ref, mon = np.zeros((height, width)), np.zeros((height, width))
        ref[t["y"], t["x"]], mon[t["y"], t["x"]] = t["ref"], t["mon"]
        return run(ref, mon)

    return pairs.select("x", "y", "ref", "mon").groupBy(F.lit(1).alias("pair")).applyInPandas(one, schema)


def phase_offset(pairs: DataFrame, width: int, height: int) -> DataFrame:
    """One row (row_off, col_off): how far the monitored image is from the reference."""

    def run(ref: np.ndarray, mon: np.ndarray) -> pd.DataFrame:
        row, column = I.phase_peak(mon, ref)
        return pd.DataFrame({"row_off": [-row], "col_off": [-column]})

    return _whole(pairs, width, height, run, "row_off int, col_off int")


_MATRIX = ", ".join(f"h{i}{j} double" for i in range(3) for j in range(3))


def _flat(h: np.ndarray | None) -> dict:
    return {f"h{i}{j}": [float(h[i, j]) if h is not None else None] for i in range(3) for j in range(3)}


def ransac(kp: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """One row: the homography from reference to monitored points that most key points agree on, their number and all."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["x0", "y0"])
        a = t[["x0", "y0"]].to_numpy(float)
        h, ok = A.ransac(a, a + t[["dx", "dy"]].to_numpy(float), tolerance)
        return pd.DataFrame({**_flat(h), "n_inliers": [int(ok.sum())], "n_matches": [len(t)]})

    return kp.select("x0", "y0", "dx", "dy").groupBy(F.lit(1).alias("pair")).applyInPandas(run, f"{_MATRIX}, n_inliers long, n_matches long")


def ecc(pairs: DataFrame, width: int, height: int, start: list[list[float]] | None = None) -> DataFrame:
    """One row: the refined homography from reference to monitored pixels, and its correlation."""

    def run(ref: np.ndarray, mon: np.ndarray) -> pd.DataFrame:
        begin = np.array(start) if start is not None else None
        if begin is None:
            row, column = I.phase_peak(mon, ref)
            begin = np.array([[1, 0, -column], [0, 1, -row], [0, 0, 1]], float)
        h, rho = A.ecc(I.stretch_percentile(mon), I.stretch_percentile(ref), begin)
        return pd.DataFrame({**_flat(h), "ecc": [rho]})

    return _whole(pairs, width, height, run, f"{_MATRIX}, ecc double")


def sift_matches(pairs: DataFrame, width: int, height: int, ratio: float = 0.75) -> DataFrame:
    """Matched features: xm, ym in the monitored image, xr, yr in the reference."""

    def run(ref: np.ndarray, mon: np.ndarray) -> pd.DataFrame:
        (pm, dm), (pr, dr) = (A.sift(I.equalized(I.stretch_percentile(im))) for im in (mon, ref))
        m = A.match(dm, dr, ratio)
        return pd.DataFrame({"xm": pm[m[:, 0], 0], "ym": pm[m[:, 0], 1], "xr": pr[m[:, 1], 0], "yr": pr[m[:, 1], 1]})

    return _whole(pairs, width, height, run, "xm double, ym double, xr double, yr double")
