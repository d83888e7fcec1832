"""Selection of key points spread over the image."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stats import max_window

GRID = 5


def with_cell(kp: DataFrame, width: int, height: int, grid: int = GRID) -> DataFrame:
    """Adds cell, row by row; what lies on or beyond an edge goes to the cell at the edge."""
    clip = lambda c, size: F.greatest(F.lit(0), F.least(F.floor(F.col(c) / (size / grid)), F.lit(grid - 1))).cast("long")
    return kp.withColumn("cell", clip("y0", height) * grid + clip("x0", width))


def _with_centre(kp: DataFrame, width: int, height: int, grid: int) -> DataFrame:
    w, h = width / grid, height / grid
    c = with_cell(kp, width, height, grid)
    c = c.withColumn("xs", (F.col("cell") % grid) * F.lit(w)).withColumn("ys", F.floor(F.col("cell") / grid) * F.lit(h))
    c = c.withColumn("xe", F.when(F.col("cell") % grid < grid - 1, ((F.col("cell") % grid) + 1) * F.lit(w)).otherwise(F.lit(float(width))))
    c = c.withColumn("ye", F.when(F.floor(F.col("cell") / grid) < grid - 1, (F.floor(F.col("cell") / grid) + 1) * F.lit(h)).otherwise(F.lit(float(height))))
    return c.withColumn("xm", (F.col("xs") + F.col("xe")) / 2).withColumn("ym", (F.col("ys") + F.col("ye")) / 2).withColumn("dist", F.sqrt((F.col("x0") - F.col("xm")) ** 2 + (F.col("y0") - F.col("ym")) ** 2))


def cell_counts(kp: DataFrame, width: int, height: int, grid: int = GRID) -> DataFrame:
    return with_cell(kp, width, height, grid).groupBy("cell").agg(F.count("*").alias("n"))


def centres(kp: DataFrame, width: int, height: int, grid: int = GRID) -> DataFrame:
    """For each cell the point nearest its centre; ties by score, then kp_id."""
    got = _with_centre(kp, width, height, grid).groupBy("cell").agg(F.min_by(F.struct("kp_id", "x0", "y0", "score", "dist"), F.struct("dist", -F.col("score"), "kp_id")).alias("p"))
    return got.select("cell", F.lit(-1).alias("quarter"), "p.*")


def quarters(kp: DataFrame, width: int, height: int, grid: int = GRID) -> DataFrame:
    """For each quarter of a cell, without the cell's centre point: the point whose distance to the centre is nearest the quarter's median.

    A point on the right edge of a right quarter, or the lower one of a lower quarter, is in it whatever its other
    coordinate, so that it can be in two.
    """
    pts = _with_centre(kp, width, height, grid).join(F.broadcast(centres(kp, width, height, grid).select("kp_id")), "kp_id", "left_anti")
    left, top = (F.col("x0") >= F.col("xs")) & (F.col("x0") < F.col("xm")), (F.col("y0") >= F.col("ys")) & (F.col("y0") < F.col("ym"))
    right, low = (F.col("x0") >= F.col("xm")) & (F.col("x0") < F.col("xe")), (F.col("y0") >= F.col("ym")) & (F.col("y0") < F.col("ye"))
    on_right = F.col("x0") == F.col("xe")
    tests = (left & top, (right & top) | on_right, (left & low) | (F.col("y0") == F.col("ye")), (right & low) | on_right | (F.col("y0") == F.col("ye")))
    inside = F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in enumerate(tests)]))
    q = pts.withColumn("quarter", F.explode(inside))
    medians = q.groupBy("cell", "quarter").agg(F.median("dist").alias("m"))  # a few rows for each cell
    q = q.join(F.broadcast(medians), ["cell", "quarter"])
    best = q.groupBy("cell", "quarter").agg(F.min_by(F.struct("kp_id", "x0", "y0", "score", "dist"), F.struct(F.abs(F.col("dist") - F.col("m")), -F.col("score"), F.col("kp_id"))).alias("p"))
    return best.select("cell", "quarter", "p.*")


def select(kp: DataFrame, width: int, height: int, grid: int = GRID) -> DataFrame:
    return centres(kp, width, height, grid).unionByName(quarters(kp, width, height, grid))


def top_by_score(kp: DataFrame, width: int, height: int, top: int = 4, grid: int = GRID) -> DataFrame:
    """The top points of each cell by score; ties by kp_id."""
    w = Window.partitionBy("cell").orderBy(F.desc("score"), "kp_id")
    return with_cell(kp, width, height, grid).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def best_pair(ratios: DataFrame, tile: str = "tile") -> DataFrame:
    """For each tile the kernel sizes with the largest ratio; the first in order of mon_k, ref_k wins ties."""
    return max_window(ratios.where("ratio is not null"), [tile], [F.desc("ratio"), "mon_k", "ref_k"])


def best_polarity(ratios: DataFrame, tile: str = "tile") -> DataFrame:
    """For each tile the polarity with the largest ratio; `normal` wins ties."""
    return max_window(ratios.where("ratio is not null"), [tile], [F.desc("ratio"), F.desc("polarity")])


def chip_cards(files: DataFrame, chips: DataFrame) -> DataFrame:
    """Chip files (path) with the facts of their points, from the coordinates in their names."""
    at = lambda k: F.regexp_extract("path", r"REF_(-?\d+)_(-?\d+)\.", k).cast("long")
    facts = chips.groupBy(F.col("x0").cast("long").alias("x"), F.col("y0").cast("long").alias("y")).agg(F.max_by(F.struct("dx", "dy", "score"), "kp_id").alias("c"))
    got = files.select("path", at(1).alias("x"), at(2).alias("y")).join(facts, ["x", "y"], "left")
    got = got.select("path", "x", "y", F.coalesce("c.dx", F.lit(0.0)).alias("dx"), F.coalesce("c.dy", F.lit(0.0)).alias("dy"), F.col("c.score").alias("score"))
    cross = lambda d: F.greatest(F.lit(2.0), F.least(F.lit(112.0), 57 - 2 * F.col(d)))
    return got.withColumn("dist", F.col("dx") ** 2 + F.col("dy") ** 2).withColumn("cross_x", cross("dx")).withColumn("cross_y", cross("dy"))
