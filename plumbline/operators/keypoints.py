"""Enrichment and filters of key points (kp_id, x0, y0, dx, dy, score)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import angle, nearest, no_nan, pixel, r8, radial

#: Forward-backward tolerance, outlier limits, half of a chip.
TOLERANCE, SIGMAS, FAR, HALF_CHIP = 0.1, 3.0, 20.0, 28


def enrich(kp: DataFrame) -> DataFrame:
    return kp.withColumn("radial_error", radial()).withColumn("angle", angle())


def confident(kp: DataFrame, threshold: float | None) -> DataFrame:
    """Points of a score above the threshold; all without one."""
    return kp if threshold is None else kp.where(F.col("score") > threshold)


def candidates(kp: DataFrame, threshold: float | None) -> DataFrame:
    """Points worth scoring: the threshold itself counts."""
    return kp if threshold is None else kp.where(F.col("score") >= threshold)


def consistent(tracks: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Tracks (x0, y0, x1, y1, xr, yr) whose way back ends near the start, with displacement and score."""
    d = F.greatest(F.abs(F.col("x0") - F.col("xr")), F.abs(F.col("y0") - F.col("yr")))
    return tracks.withColumn("d", d).where(F.col("d") < tolerance).withColumn("dx", F.col("x1") - F.col("x0")).withColumn("dy", F.col("y1") - F.col("y0")).withColumn("score", 1 - F.col("d") / tolerance)


def to_image(kp: DataFrame, x_off: Column, y_off: Column) -> DataFrame:
    """Tile coordinates as image coordinates."""
    return kp.withColumn("x0", F.col("x0") + x_off).withColumn("y0", F.col("y0") + y_off)


def corrected(kp: DataFrame, x_off: float, y_off: float) -> DataFrame:
    """The displacement with a large shift added back; radial error and angle stay those of the raw one."""
    return kp.withColumn("dx", F.col("dx") + x_off).withColumn("dy", F.col("dy") + y_off)


def with_dn(kp: DataFrame, reference: DataFrame, monitored: DataFrame) -> DataFrame:
    """Both images' values at the reference position; points outside the images go."""
    at = kp.withColumn("x", pixel("x0")).withColumn("y", pixel("y0"))
    return at.join(reference.withColumnRenamed("dn", "ref_dn"), ["x", "y"]).join(monitored.withColumnRenamed("dn", "mon_dn"), ["x", "y"])


def _excluded(no_values: list[int], ref_nodata: float | None, mon_nodata: float | None) -> tuple[Column, Column]:
    never = F.lit(False)
    either = F.col("ref_dn").isin(no_values) | F.col("mon_dn").isin(no_values) if no_values else never
    own = never
    if ref_nodata is not None:
        own = own | (F.col("ref_dn") == ref_nodata)
    if mon_nodata is not None:
        own = own | (F.col("mon_dn") == mon_nodata)
    return F.coalesce(either, never), F.coalesce(own, never)


def without_values(kp: DataFrame, reference: DataFrame, monitored: DataFrame, no_values: list[int] | None = None, ref_nodata: float | None = None, mon_nodata: float | None = None) -> DataFrame:
    """Points whose pixels hold no excluded value and no no-data value of their own image."""
    if not no_values and ref_nodata is None and mon_nodata is None:
        return kp
    either, own = _excluded(no_values or [], ref_nodata, mon_nodata)
    return with_dn(kp, reference, monitored).where(~either & ~own).select(*kp.columns, "ref_dn", "mon_dn")


def excluded_counts(kp: DataFrame, reference: DataFrame, monitored: DataFrame, no_values: list[int], ref_nodata: float | None, mon_nodata: float | None) -> DataFrame:
    either, own = _excluded(no_values, ref_nodata, mon_nodata)
    n = lambda c: F.count_if(c)
    got = with_dn(kp, reference, monitored).agg(
        F.count("*").alias("total"), *[n((F.col("ref_dn") == v) | (F.col("mon_dn") == v)).alias(f"value_{v}") for v in no_values],
        n(F.col("ref_dn") == ref_nodata).alias("ref_nodata"), n(F.col("mon_dn") == mon_nodata).alias("mon_nodata"), n(either | own).alias("removed"))
    return got.withColumn("removed_pct", r8(F.try_divide(F.lit(100.0) * F.col("removed"), F.col("total"))))


def outlier_bounds(kp: DataFrame) -> Column:
    """The condition that is left when points away from the mean are removed again and again.

    Each round keeps what lies within three population deviations and 20 pixels of the mean, on both axes. The rounds'
    conditions are intervals, so that what survives all of them lies in their intersection, four numbers: a round is one
    aggregate over two columns of the source, whatever the rounds before. The number of points falls with each round but the
    last. Where no deviation is left, no point is.
    """
    columns = ("dx", "dy")
    moves = kp.select(*columns)
    low, high, n = dict.fromkeys(columns, -math.inf), dict.fromkeys(columns, math.inf), -1
    while True:
        keep = F.lit(True)
        for c in columns:
            if math.isfinite(low[c]):
                keep = keep & (F.col(c) > low[c]) & (F.col(c) < high[c])
        m = moves.where(keep).agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        if m["n"] in (n, 0) or any(m[f"m_{c}"] is None for c in columns):
            return keep
        n = m["n"]
        for c in columns:
            away = min(SIGMAS * m[f"s_{c}"], FAR)
            low[c], high[c] = max(low[c], m[f"m_{c}"] - away), min(high[c], m[f"m_{c}"] + away)


def without_outliers(kp: DataFrame) -> DataFrame:
    return kp.where(outlier_bounds(kp))


def patch_bounds(kp: DataFrame, width: int, height: int, half: int = HALF_CHIP) -> DataFrame:
    """Whether the chips around a point lie in both images."""
    inside = lambda x, y: (x - half >= 0) & (x < width - half) & (y - half >= 0) & (y < height - half)
    at = kp.withColumn("xr", pixel("x0")).withColumn("yr", pixel("y0")).withColumn("xm", nearest(F.col("x0") + F.col("dx"))).withColumn("ym", nearest(F.col("y0") + F.col("dy")))
    return at.withColumn("ref_ok", inside(F.col("xr"), F.col("yr"))).withColumn("mon_ok", inside(F.col("xm"), F.col("ym"))).withColumn("in_bounds", F.col("ref_ok") & F.col("mon_ok"))


def thresholded_offsets(offsets: DataFrame, least: float) -> DataFrame:
    """Offsets (row_off, col_off), each axis zero below the threshold; applied if any is left."""
    cut = lambda c: F.when(F.abs(c) < least, F.lit(0.0)).otherwise(F.col(c))
    got = offsets.withColumn("row_off", cut("row_off")).withColumn("col_off", cut("col_off"))
    return got.withColumn("applied", (F.col("row_off") != 0) | (F.col("col_off") != 0))


def nan_as_null(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[no_nan(c).alias(c) if c in columns else F.col(c) for c in df.columns])
