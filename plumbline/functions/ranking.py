"""Order statistics without a task that holds all rows.

Values are counted first, so that ties cost nothing, and the distinct values are dealt over ranges; the counts of the
ranges before shift the running counts of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64


def cumulative(df: DataFrame, value: str, ranges: int = RANGES) -> DataFrame:
    """The distinct values of a column that are not null: value, n (how often), upto (rows of at most this value), total."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    cuts = counts.agg(F.percentile_approx("value", [k / ranges for k in range(1, ranges)], 20 * ranges).alias("c")).first()["c"] or []
    part: Column = F.lit(0)
    for c in sorted(set(cuts)):
        part = part + (F.col("value") > F.lit(c)).cast("int")
    dealt = counts.withColumn("_part", part)
    sums = dealt.groupBy("_part").agg(F.sum("n").alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    shifts = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"), F.sum("_sum").over(Window.partitionBy()).alias("total"))
    own = Window.partitionBy("_part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.withColumn("_own", F.sum("n").over(own)).join(F.broadcast(shifts), "_part").select("value", "n", (F.col("_own") + F.col("_before")).alias("upto"), "total")


def order_statistic(k: Column) -> Column:
    """Aggregate over cumulative(): the k-th smallest value, from 1; null if there is none."""
    return F.max(F.when((F.col("upto") >= k) & (F.col("upto") - F.col("n") < k), F.col("value")))


def quantile_type4(df: DataFrame, value: str, p: float) -> DataFrame:
    """One row (q): linear interpolation between the floor(p n)-th and the next value, counted from 1.

    Null without rows; the least value where p n is below one; the largest at p = 1.
    """
    at = F.lit(p) * F.col("total")
    k = F.floor(at)
    low, high = order_statistic(F.greatest(k, F.lit(1))), order_statistic(F.greatest(F.least(k + 1, F.col("total")), F.lit(1)))
    got = cumulative(df, value).agg(low.alias("a"), high.alias("b"), F.max(at - k).alias("f"), F.max(k).alias("k"))
    return got.select(F.when(F.col("k") < 1, F.col("a")).otherwise(F.col("a") + F.col("f") * (F.col("b") - F.col("a"))).alias("q"))
