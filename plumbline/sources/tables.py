"""Key-point tables, vector layers, chips."""

from __future__ import annotations

import json
import struct
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import RasterError

KEY_POINTS = "x0 double, y0 double, dx double, dy double, score double, `radial error` double, angle double, zncc_score double, mutual_info_score double, mi_score double"


def read_key_points(spark: SparkSession, path: str) -> DataFrame:
    """A key-point file (`;`, with header) with a unique kp_id in the order of the file's rows."""
    df = spark.read.schema(KEY_POINTS).option("sep", ";").option("header", True).option("nanValue", "").csv(path)
    return df.withColumnRenamed("radial error", "radial_error").withColumn("kp_id", F.monotonically_increasing_id())


def write_key_points(kp: DataFrame, path: str) -> str:
    """One `;`-separated file with header, sorted by tile, x0, y0; columns that are missing are empty."""
    df = kp.withColumnRenamed("radial_error", "radial error")
    names = [c.split(" double")[0].strip("`") for c in KEY_POINTS.split(", ")]
    order = [c for c in ("tile_x", "tile_y", "x0", "y0") if c in df.columns]
    out = df.orderBy(*order).select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("double").alias(c) for c in names])
    out.coalesce(1).write.mode("overwrite").option("sep", ";").option("header", True).csv(path)
    return path


def read_chips(spark: SparkSession, path: str) -> DataFrame:
    """chips.csv, the last row of each place; an unreadable one is empty."""
    df = read_key_points(spark, path)
    best = df.groupBy(F.col("x0").cast("long").alias("x"), F.col("y0").cast("long").alias("y")).agg(F.max_by(F.struct(*df.columns), "kp_id").alias("r"))
    return best.select("x", "y", "r.*")


#: Shape types of polygons, plain and with further coordinates.
POLYGONS = (5, 15, 25)


Ring = list[tuple[float, float]]


def _shapes(path: str) -> list[list[Ring]]:
    """The polygons of a shapefile, each with all its rings."""
    out = []
    try:
        raw = Path(path).read_bytes()
        at = 100
        while at < len(raw):
            size = 2 * struct.unpack(">I", raw[at + 4 : at + 8])[0]
            body, at = raw[at + 8 : at + 8 + size], at + 8 + size
            if struct.unpack("<I", body[:4])[0] in POLYGONS:
                parts, points = struct.unpack("<II", body[36:44])
                start = [*struct.unpack(f"<{parts}I", body[44 : 44 + 4 * parts]), points]
                xy = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
                out.append([[(xy[2 * k], xy[2 * k + 1]) for k in range(a, b - 1)] for a, b in zip(start[:-1], start[1:], strict=True)])
    except (OSError, struct.error) as e:
        raise RasterError(f"cannot read {path}: {e}") from e
    if not out:
        raise RasterError(f"no polygon in {path}")
    return out


def polygons(path: str) -> list[list[Ring]]:
    """The polygons of a vector layer, each with its outer rings and its holes."""
    if str(path).lower().endswith(".shp"):
        return _shapes(path)
    try:
        d = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        raise RasterError(f"cannot read {path}: {e}") from e
    out = []
    for f in d.get("features", [d]):
        g = f.get("geometry", f)
        some = [g["coordinates"]] if g.get("type") == "Polygon" else g["coordinates"] if g.get("type") == "MultiPolygon" else []
        out += [[[(float(p[0]), float(p[1])) for p in ring[:-1]] for ring in poly] for poly in some if poly]
    if not out:
        raise RasterError(f"no polygon in {path}")
    return out


def to_pixels(ring: list[tuple[float, float]], gt: list[float]) -> list[tuple[float, float]]:
    """A ring in a reference system as pixel coordinates of a north-up grid."""
    return [((x - gt[0]) / gt[1], (y - gt[3]) / gt[5]) for x, y in ring]
