"""Mean profiles of displacements by row, column or altitude."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mean_profile(df: DataFrame, value: str, position: str, bin_size: int) -> DataFrame:
    """For each bin of positions: pos (its label), n (values that are not null), mean, std (sample; null for one)."""
    b = F.floor(F.col(position) / bin_size)
    got = df.where(F.col(position).isNotNull()).groupBy(b.cast("long").alias("b")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev(value).alias("std"))
    return got.select((F.col("b") * bin_size + bin_size // 2).alias("pos"), "n", "mean", "std")


def shift_profile(kp: DataFrame, direction: str, axis: str, bin_size: int) -> DataFrame:
    """The profile of a direction, dx or dy, along the image's columns or rows (col, row), with its band."""
    if direction not in ("dx", "dy") or axis not in ("col", "row"):
        raise ValueError(f"no profile of {direction} by {axis}: dx or dy, by col or row")
    return std_band(mean_profile(kp, direction, "x0" if axis == "col" else "y0", bin_size))


def by_cell(kp: DataFrame, width: int, height: int, cells: int = 48) -> DataFrame:
    """Means by cell of a grid over the image (x, y): dx, dy, radial error, and theta, the direction of the mean shift in degrees."""
    cell = lambda c, size: F.floor(F.col(c) * cells / size).cast("int")
    means = [F.avg(c).alias(c) for c in ("dx", "dy", "radial_error")]
    got = kp.groupBy(cell("x0", width).alias("x"), cell("y0", height).alias("y")).agg(F.count("*").alias("n"), *means)
    return got.withColumn("theta", F.degrees(F.atan2("dy", "dx")))


def by_shift(kp: DataFrame, lo: float, hi: float, cells: int = 48) -> DataFrame:
    """Points by cell of a square grid of displacements from lo to hi: x, y, n."""
    cell = lambda c: F.least(F.floor((F.col(c) - lo) * cells / (hi - lo)), F.lit(cells - 1)).cast("int")
    return kp.where("dx is not null and dy is not null").groupBy(cell("dx").alias("x"), cell("dy").alias("y")).agg(F.count("*").alias("n"))


def std_band(profile: DataFrame) -> DataFrame:
    """Adds lo and hi: the mean less and plus std * sqrt(1/G + (g - mean g)^2 / sum (g - mean g)^2), over all G groups.

    A profile has a row for each bin: it is small. One group alone has no band.
    """
    w = Window.partitionBy()
    g = F.col("pos").cast("double")
    df = profile.withColumn("_g", g - F.avg(g).over(w)).withColumn("_n", F.count("*").over(w)).withColumn("_s", F.sum(F.col("_g") * F.col("_g")).over(w))
    band = F.col("std") * F.sqrt(1 / F.col("_n") + F.try_divide(F.col("_g") * F.col("_g"), F.col("_s")))
    return df.withColumn("lo", F.col("mean") - band).withColumn("hi", F.col("mean") + band).drop("_g", "_n", "_s")


def axis_limits(profile: DataFrame) -> DataFrame:
    """One row: the limit of the mean's axis, one more than the whole part of the largest mean, and the largest count."""
    return profile.agg((F.floor(F.max(F.abs("mean"))) + 1).alias("mean_limit"), F.max("n").alias("most"))


def by_altitude(kp_alt: DataFrame, value: str, bin_size: int = 100, factor: float = 1.0) -> DataFrame:
    """The profile by altitude, with the root mean square of each bin."""
    p = mean_profile(kp_alt.withColumn("_v", F.col(value) * factor), "_v", "alt", bin_size)
    return p.withColumn("rmse", F.sqrt(F.col("mean") ** 2 + F.col("std") ** 2))


def boxes(df: DataFrame, value: str, position: str, bin_size: int) -> DataFrame:
    """Box plots by bin: quartiles, whiskers at the furthest values within 1.5 interquartile ranges, number of fliers."""
    v = df.select(F.floor(F.col(position) / bin_size).cast("long").alias("b"), F.col(value).alias("v")).where("b is not null and v is not null")
    q = v.groupBy("b").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    q = q.select("b", F.col("q")[0].alias("q1"), F.col("q")[1].alias("med"), F.col("q")[2].alias("q3")).withColumn("r", 1.5 * (F.col("q3") - F.col("q1")))
    inside = (F.col("v") >= F.col("q1") - F.col("r")) & (F.col("v") <= F.col("q3") + F.col("r"))
    got = v.join(q, "b").groupBy("b", "q1", "med", "q3").agg(F.min(F.when(inside, F.col("v"))).alias("whisker_lo"), F.max(F.when(inside, F.col("v"))).alias("whisker_hi"), F.count_if(~inside).alias("fliers"))
    # a whisker never ends inside the box
    return got.select((F.col("b") * bin_size + bin_size // 2).alias("pos"), "q1", "med", "q3", F.least("whisker_lo", "q1").alias("whisker_lo"), F.greatest("whisker_hi", "q3").alias("whisker_hi"), "fliers")
