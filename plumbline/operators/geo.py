"""Georeferencing, homographies and products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import no_nan, pixel


def to_crs(kp: DataFrame, gt: list[float]) -> DataFrame:
    """Coordinates of the pixels' corners under all six coefficients."""
    return kp.withColumn("easting", gt[0] + F.col("x0") * gt[1] + F.col("y0") * gt[2]).withColumn("northing", gt[3] + F.col("x0") * gt[4] + F.col("y0") * gt[5])


def prior(mon: DataFrame, ref: DataFrame) -> DataFrame:
    """The homography that two geotransforms imply, for headers (pair_id, gt, srs) of one reference system."""
    m, r = mon.alias("m"), ref.alias("r")
    j = m.join(r, (F.col("m.pair_id") == F.col("r.pair_id")) & F.col("m.srs").eqNullSafe(F.col("r.srs")))
    g = lambda s, k: F.col(f"{s}.gt")[k]
    zero, one = F.lit(0.0), F.lit(1.0)
    return j.select(F.col("m.pair_id").alias("pair_id"), F.array(g("m", 1) / g("r", 1), zero, (g("m", 0) - g("r", 0)) / g("r", 1), zero, g("m", 5) / g("r", 5), (g("m", 3) - g("r", 3)) / g("r", 5), zero, zero, one).alias("h"))


def decomposed(h: DataFrame) -> DataFrame:
    """Rotation in degrees, scales, translation and perspective of homographies h (nine values by rows)."""
    e = lambda k: F.col("h")[k]
    return h.select("pair_id", F.degrees(F.atan2(e(3), e(0))).alias("rotation"), F.hypot(e(0), e(3)).alias("scale_x"), F.hypot(e(1), e(4)).alias("scale_y"), e(2).alias("tx"), e(5).alias("ty"), F.hypot(e(6), e(7)).alias("perspective"))


def kp_mask(kp: DataFrame) -> DataFrame:
    """The pixels that hold a point."""
    return kp.select(pixel("x0").alias("x"), pixel("y0").alias("y")).distinct()


def kp_delta(kp: DataFrame) -> DataFrame:
    """dx and dy at the pixels of points; of several the last by kp_id."""
    return kp.groupBy(pixel("x0").alias("x"), pixel("y0").alias("y")).agg(F.max_by("dx", "kp_id").alias("dx"), F.max_by("dy", "kp_id").alias("dy"))


def feature(kp: DataFrame, gt: list[float], columns: list[str]) -> DataFrame:
    """GeoJSON features as text: kp_id, feature. A NaN becomes null; radial_error is written with a space."""
    p = to_crs(kp, gt)
    name = lambda c: c.replace("radial_error", "radial error")
    props: Column = F.struct(*[no_nan(c).alias(name(c)) for c in columns])
    point = F.struct(F.lit("Point").alias("type"), F.array("easting", "northing").alias("coordinates"))
    return p.select("kp_id", F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), props.alias("properties")), {"ignoreNullFields": "false"}).alias("feature"))


def compatible(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether two headers (pair_id, gt, srs, x_size, y_size) share a grid; two without a reference system do."""
    x, y = a.alias("a"), b.alias("b")
    same = F.col("a.srs").eqNullSafe(F.col("b.srs")) & F.col("a.gt").eqNullSafe(F.col("b.gt")) & (F.col("a.x_size") == F.col("b.x_size")) & (F.col("a.y_size") == F.col("b.y_size"))
    return x.join(y, F.col("a.pair_id") == F.col("b.pair_id")).select(F.col("a.pair_id").alias("pair_id"), same.alias("compatible"))
