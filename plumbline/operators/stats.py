"""Accuracy statistics of key points."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import cents, decimals, r8, radial, ratio
from ..functions.ranking import cumulative, quantile_type4
from .keypoints import confident

THRESHOLD = 0.4


def geometric(kp: DataFrame, threshold: float | None = THRESHOLD, flip_y: bool = True) -> DataFrame:
    """One row: count, and least, largest, median, mean and population deviation of dx, dy and score. Northing is up if flip_y."""
    if missing := [c for c in ("dx", "dy", "score") if c not in kp.columns]:
        raise ValueError(f"key points lack {missing}; they have {kp.columns}")
    c = confident(kp, threshold).withColumn("dy", -F.col("dy") if flip_y else F.col("dy"))
    out = [F.count("*").alias("n")]
    for name in ("dx", "dy", "score"):
        out += [f(name).alias(f"{k}_{name}") for k, f in (("min", F.min), ("max", F.max), ("median", F.median), ("mean", F.avg), ("std", F.stddev_pop))]
    return c.agg(*out)


def percentages(kp: DataFrame, valid_pixels: DataFrame, threshold: float | None = THRESHOLD) -> DataFrame:
    """Confident points out of all points and out of valid pixels (a table of one row)."""
    ok = F.col("score") > threshold if threshold is not None else F.lit(True)
    n = kp.agg(F.count_if(ok).alias("sample_pixel"), F.count("*").alias("total_kp")).crossJoin(valid_pixels)
    hundred = F.lit(100.0) * F.col("sample_pixel")
    return n.withColumn("pct_match", r8(ratio(hundred, F.col("total_kp")))).withColumn("pct_pixel", r8(ratio(hundred, F.col("valid_pixels"))))


def circular_error(kp: DataFrame, p: float, factor: float = 1.0, threshold: float | None = THRESHOLD) -> DataFrame:
    """One row (ce): the type 4 quantile of the radial error, times a pixel size."""
    q = quantile_type4(confident(kp, threshold).select((radial() * factor).alias("r")), "r", p)
    return q.select(F.col("q").alias("ce"))


def rmse(kp: DataFrame, threshold: float | None = THRESHOLD, factor: float = 1.0) -> DataFrame:
    m = confident(kp, threshold).agg(*[(f(c) * factor).alias(f"{k}_{c}") for c in ("dx", "dy") for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    m = m.withColumn("rmse_x", F.sqrt(F.col("m_dx") ** 2 + F.col("s_dx") ** 2)).withColumn("rmse_y", F.sqrt(F.col("m_dy") ** 2 + F.col("s_dy") ** 2))
    return m.select("rmse_x", "rmse_y", F.sqrt(F.col("rmse_x") ** 2 + F.col("rmse_y") ** 2).alias("rmse"))


def accuracy(kp: DataFrame, threshold: float = THRESHOLD, factor: float = 1.0, flip_y: bool = True) -> DataFrame:
    """The accuracy row: statistics, root mean squares and circular errors."""
    row = geometric(kp, threshold, flip_y).crossJoin(rmse(kp, threshold, factor))
    for p in (90, 95):
        row = row.crossJoin(circular_error(kp, p / 100, factor, threshold).withColumnRenamed("ce", f"ce{p}"))
    return row


def histogram(kp: DataFrame, value: str, factor: float = 1.0) -> DataFrame:
    """Bins of a symmetric range, as many as the square-root rule gives, empty ones too: bin, lo, hi, n."""
    v = kp.select((F.col(value) * factor).alias("v")).where("v is not null")
    m = v.agg(F.count("*").alias("cnt"), F.min("v").alias("a"), F.max("v").alias("b"))
    m = m.where("cnt > 0").select("cnt", F.greatest(F.abs("a"), F.abs("b")).alias("vmax"), (F.col("b") - F.col("a")).alias("ptp"))
    m = m.withColumn("nb", F.when(F.col("ptp") > 0, F.ceil(2 * F.col("vmax") / F.try_divide("ptp", F.sqrt("cnt")))).otherwise(1).cast("long"))
    m = m.withColumn("w", F.try_divide(2 * F.col("vmax"), F.col("nb")))
    got = v.crossJoin(F.broadcast(m)).groupBy(F.least(F.floor(F.try_divide(F.col("v") + F.col("vmax"), F.col("w"))), F.col("nb") - 1).alias("bin")).agg(F.count("*").alias("n"))
    bins = m.select("w", "vmax", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("bin"))
    return bins.join(got, "bin", "left").select("bin", (F.col("bin") * F.col("w") - F.col("vmax")).alias("lo"), ((F.col("bin") + 1) * F.col("w") - F.col("vmax")).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


#: D'Agostino and Pearson's test, from moments m1 (skewness), b2 (kurtosis) and n.
NORMALITY = """
SELECT n, z1*z1 + z2*z2 AS k2, exp(-(z1*z1 + z2*z2)/2) AS p, exp(-(z1*z1 + z2*z2)/2) < CAST(0.001 AS DOUBLE) AS rejected FROM (
 SELECT n, d*ln(yy/alpha + sqrt((yy/alpha)*(yy/alpha) + 1)) AS z1,
  ((1 - 2/(9*a)) - sign((1 - 2/a)/(1 + x*sqrt(2/(a - 4))))*pow(abs((1 - 2/a)/(1 + x*sqrt(2/(a - 4)))), 1/CAST(3 AS DOUBLE)))/sqrt(2/(9*a)) AS z2 FROM (
  SELECT n, yy, 1/sqrt(ln(w2)/2) AS d, sqrt(2/(w2 - 1)) AS alpha, x, 6 + 8/s*(2/s + sqrt(1 + 4/(s*s))) AS a FROM (
   SELECT n, g1*sqrt((n+1)*(n+3)/(6*(n-2))) AS yy, sqrt(2*(3*(n*n+27*n-70)*(n+1)*(n+3)/((n-2)*(n+5)*(n+7)*(n+9)) - 1)) - 1 AS w2,
    (b2 - 3*(n-1)/(n+1))/sqrt(24*n*(n-2)*(n-3)/((n+1)*(n+1)*(n+3)*(n+5))) AS x,
    6*(n*n-5*n+2)/((n+7)*(n+9))*sqrt(6*(n+3)*(n+5)/(n*(n-2)*(n-3))) AS s FROM moments WHERE n >= 8 AND g1 IS NOT NULL)))
"""


def normality(hist: DataFrame) -> DataFrame:
    """One row (n, k2, p, rejected) of the normality test on a histogram's counts; none below eight bins or without spread."""
    v = hist.select(F.col("n").cast("double").alias("v"))
    m = v.agg(F.count("*").cast("double").alias("n"), F.avg("v").alias("mean"))
    c = v.crossJoin(F.broadcast(m)).withColumn("c", F.col("v") - F.col("mean"))
    p = c.agg(F.max("n").alias("n"), *[F.avg(F.pow("c", F.lit(k))).alias(f"m{k}") for k in (2, 3, 4)])
    moments = p.select("n", F.try_divide(F.col("m3"), F.pow("m2", F.lit(1.5))).alias("g1"), F.try_divide(F.col("m4"), F.col("m2") * F.col("m2")).alias("b2"))
    return moments.sparkSession.sql(NORMALITY.replace("moments", "{m}"), m=moments)


def gauss(hist: DataFrame, kp: DataFrame, value: str, factor: float = 1.0) -> DataFrame:
    """The normal curve at all bin edges, scaled to the histogram's total: edge, y."""
    edges = hist.select(F.col("bin").alias("k"), F.col("lo").alias("edge")).unionByName(hist.groupBy().agg(F.max(F.struct("bin", "hi")).alias("m")).select((F.col("m.bin") + 1).alias("k"), F.col("m.hi").alias("edge")))
    m = kp.agg((F.avg(value) * factor).alias("mu"), (F.stddev_pop(value) * factor).alias("s")).crossJoin(hist.agg(F.sum("n").alias("total")))
    y = edges.crossJoin(F.broadcast(m)).withColumn("g", F.try_divide(F.exp(-F.try_divide((F.col("edge") - F.col("mu")) ** 2, 2 * F.col("s") ** 2)), F.col("s") * math.sqrt(2 * math.pi)))
    return y.crossJoin(F.broadcast(y.agg(F.sum("g").alias("all")))).select("k", "edge", (ratio(F.col("g"), F.col("all")) * F.col("total")).alias("y"))


def density(kp: DataFrame, bins: int = 10) -> DataFrame:
    """Points by cell of a grid over the range of dx and dy: bx, by, n, density."""
    m = kp.agg(*[f(c).alias(f"{k}_{c}") for c in ("dx", "dy") for k, f in (("a", F.min), ("b", F.max))], F.count("*").alias("total"))
    cell = lambda c: F.least(F.floor(F.try_divide((F.col(c) - F.col(f"a_{c}")) * bins, F.col(f"b_{c}") - F.col(f"a_{c}"))), F.lit(bins - 1).cast("long"))
    got = kp.crossJoin(F.broadcast(m)).groupBy(cell("dx").alias("bx"), cell("dy").alias("by")).agg(F.count("*").alias("n"))
    area = (F.col("b_dx") - F.col("a_dx")) * (F.col("b_dy") - F.col("a_dy")) / (bins * bins)
    return got.crossJoin(F.broadcast(m)).select("bx", "by", "n", ratio(F.col("n"), F.col("total") * area).alias("density"))


def radial_cdf(kp: DataFrame, factor: float = 1.0) -> DataFrame:
    """Each radial error in order with the percentage of the sample: i, pct, r."""
    c = cumulative(kp.select((radial() * factor).alias("r")), "r")
    rows = c.select("total", F.col("value").alias("r"), F.explode(F.sequence(F.col("upto") - F.col("n") + 1, F.col("upto"))).alias("i"))
    return rows.select("i", F.coalesce(ratio(100.0 * (F.col("i") - 1), F.col("total") - 1), F.lit(0.0)).alias("pct"), "r")


def color_limits(kp: DataFrame) -> DataFrame:
    """Limits of colour scales: three sample deviations around the mean, with the centre that their signs ask for."""
    one = lambda c: [(F.avg(c) - 3 * F.stddev(c)).alias(f"{c}_lo"), (F.avg(c) + 3 * F.stddev(c)).alias(f"{c}_hi")]
    m = kp.withColumn("radial", radial()).agg(*one("dx"), *one("dy"), *one("radial"))
    for c in ("dx", "dy"):
        lo, hi = F.col(f"{c}_lo"), F.col(f"{c}_hi")
        m = m.withColumn(f"{c}_vmin", F.when(lo > 0, 0.0).otherwise(lo)).withColumn(f"{c}_centre", F.when((hi > 0) & (lo < 0), 0.0).when(lo > 0, lo).when(hi < 0, hi)).withColumn(f"{c}_vmax", F.when(hi < 0, 0.0).otherwise(hi))
    return m.select("dx_vmin", "dx_centre", "dx_vmax", "dy_vmin", "dy_centre", "dy_vmax", F.col("radial_hi").alias("radial_vmax"), (F.col("radial_hi") / 2).alias("radial_centre"))


def axis_limits(kp: DataFrame) -> DataFrame:
    """One row (lo, hi): whole numbers around dx, dy and the radial error."""
    k = kp.withColumn("radial", radial())
    each = lambda f: [f(c) for c in ("dx", "dy", "radial")]
    return k.agg(F.floor(F.least(*each(F.min))).cast("long").alias("lo"), F.ceil(F.greatest(*each(F.max))).cast("long").alias("hi"))


def inlier_ratios(trials: DataFrame, *keys: str) -> DataFrame:
    """Points kept out of points tracked, for each group of trials."""
    return trials.groupBy(*keys).agg(F.count_if("inlier").alias("inliers"), F.count("*").alias("n")).withColumn("ratio", ratio(F.col("inliers"), F.col("n")))


def tile_stats(kp: DataFrame, size: int) -> DataFrame:
    """Count, mean and sample deviation of dx and dy for each tile."""
    tile = lambda c: F.floor(F.col(c) / size).cast("long")
    return kp.groupBy(tile("x0").alias("tile_x"), tile("y0").alias("tile_y")).agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for c in ("dx", "dy") for k, f in (("mean", F.avg), ("std", F.stddev))])


def circle(radius: DataFrame, steps: int = 110) -> DataFrame:
    """Points of a circle of radius ce: k, x, y."""
    t = radius.select("ce", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("k")).withColumn("t", F.col("k") * (2 * math.pi / (steps - 1)))
    return t.select("k", (F.col("ce") * F.cos("t")).alias("x"), (F.col("ce") * F.sin("t")).alias("y"))


def mode(votes: DataFrame, value: list[str], order: str) -> DataFrame:
    """The most frequent value; of equally frequent ones the one seen first."""
    got = votes.groupBy(*value).agg(F.count("*").alias("votes"), F.min(order).alias("first"))
    return got.orderBy(F.desc("votes"), "first").limit(1)


def stat_line(row: DataFrame, ref: str, mon: str, valid: DataFrame, threshold: float = THRESHOLD, digits: int | None = 4) -> DataFrame:
    """The space-separated line of the statistics file; without a number of digits, with all that tell a value."""
    parts = [F.lit(ref), F.lit(mon), F.col("valid_pixels"), F.col("n"), F.lit(f"{threshold}")]
    show = lambda c: F.col(c).cast("string") if digits is None else F.format_string(f"%.{digits}f", decimals(c, digits))
    parts += [show(f"{k}_{c}") for c in ("dx", "dy") for k in ("min", "max", "median", "mean", "std")]
    return row.crossJoin(valid).select(F.concat_ws(" ", *parts).alias("line"))


#: The lines of the block beside a figure, as (label, column), after confidence and share of pixels.
BLOCK_X = ((" Conf_Value : ", ""), (" %Conf Px   :", "%"), ("Minimum    : ", "min"), ("Maximum   : ", "max"), ("Mean          : ", "mean"), ("Std Dev      : ", "std"), ("Median       : ", "median"))
BLOCK_Y = ((" Conf_Value :", ""), *BLOCK_X[1:])


def stat_block(row: DataFrame, pct: DataFrame, factor: float = 1.0, threshold: float = THRESHOLD) -> DataFrame:
    """The text block of each direction: confidence, share of pixels, and the statistics times a pixel size."""
    out = []
    for direction, c, labels in (("x", "dx", BLOCK_X), ("y", "dy", BLOCK_Y)):
        shown = {"": F.lit(threshold), "%": F.col("pct_pixel")}
        lines = [F.concat(F.lit(label), F.format_string("%.2f", cents(shown[k] if k in shown else F.col(f"{k}_{c}") * factor)), F.lit("%" if k == "%" else "")) for label, k in labels]
        out.append(F.struct(F.lit(direction).alias("direction"), F.concat_ws("\n ", *lines).alias("block")))
    return row.crossJoin(pct).select(F.explode(F.array(*out)).alias("b")).select("b.*")


def prior_errors(matches: DataFrame, prior: list[list[float]]) -> DataFrame:
    """One row: median, least and largest distance of matches (x_mon, y_mon, x_ref, y_ref) from where an affine prior puts them."""
    at = [F.lit(r[0]) * F.col("x_mon") + F.lit(r[1]) * F.col("y_mon") + F.lit(r[2]) for r in prior[:2]]
    e = matches.select(F.sqrt((F.col("x_ref") - at[0]) ** 2 + (F.col("y_ref") - at[1]) ** 2).alias("e"))
    return e.agg(F.median("e").alias("median"), F.min("e").alias("least"), F.max("e").alias("largest"))


def max_window(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group in an order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rn = 1").drop("_rn")
