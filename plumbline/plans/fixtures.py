"""Key points and rasters derived from the driver's tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, HEIGHT = 200, 160

#: Common table expressions for the SQL side.
SQL = """
kp AS MATERIALIZED (SELECT event_id AS kp_id, CAST(event_id % 200 AS DOUBLE) AS x0,
  CAST((CAST(floor(event_id/CAST(200 AS DOUBLE)) AS BIGINT)*37) % 160 AS DOUBLE) AS y0,
  (value-CAST(60 AS DOUBLE))/CAST(40 AS DOUBLE) AS dx,
  (CAST((event_id*53)%601 AS DOUBLE)-CAST(300 AS DOUBLE))/CAST(150 AS DOUBLE) AS dy,
  CAST((event_id*29)%11 AS DOUBLE)/CAST(10 AS DOUBLE) AS score FROM events),
conf AS (SELECT * FROM kp WHERE score > CAST(0.4 AS DOUBLE)),
px_ref AS MATERIALIZED (SELECT CAST(a.p_partkey AS BIGINT) AS x, CAST(b.p_partkey AS BIGINT) AS y,
  CAST((a.p_size*b.p_size + 3*a.p_partkey + 5*b.p_partkey) % 251 AS BIGINT) AS dn
  FROM part a CROSS JOIN part b WHERE a.p_partkey < 200 AND b.p_partkey < 160),
px_mon AS MATERIALIZED (SELECT g.x, g.y, COALESCE(r.dn + (g.x*7+g.y*11)%5, 0) AS dn
  FROM px_ref g LEFT JOIN px_ref r ON r.x = g.x-2 AND r.y = g.y-3),
dem AS MATERIALIZED (SELECT CAST(a.p_partkey AS BIGINT) AS x, CAST(b.p_partkey AS BIGINT) AS y, CAST(a.p_size*37 + b.p_size*23 AS DOUBLE) AS alt
  FROM part a CROSS JOIN part b WHERE a.p_partkey < 200 AND b.p_partkey < 160)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    return e.select(
        i.alias("kp_id"),
        (i % 200).cast("double").alias("x0"),
        ((F.floor(i / F.lit(200.0)).cast("long") * 37) % 160).cast("double").alias("y0"),
        ((F.col("value") - 60.0) / 40.0).alias("dx"),
        ((((i * 53) % 601).cast("double") - 300.0) / 150.0).alias("dy"),
        (((i * 29) % 11).cast("double") / 10.0).alias("score"),
    )


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a column and a row: 200 x 160 rows, whatever the input."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"), F.col("p_size").cast("long").alias("s"))
    a = part.where("k < 200").select(F.col("k").alias("x"), F.col("s").alias("sx"))
    b = part.where("k < 160").select(F.col("k").alias("y"), F.col("s").alias("sy"))
    return a.crossJoin(F.broadcast(b))


def reference_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).select("x", "y", F.expr("(sx*sy + 3*x + 5*y) % 251").alias("dn"))


def monitored_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference moved by (2, 3), with a little noise."""
    ref = reference_pixels(spark, sf_dir)
    moved = ref.select((F.col("x") + 2).alias("x"), (F.col("y") + 3).alias("y"), F.col("dn").alias("m"))
    return ref.select("x", "y").join(moved, ["x", "y"], "left").select("x", "y", F.expr("coalesce(m + (x*7+y*11)%5, 0)").alias("dn"))


def elevation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).select("x", "y", F.expr("cast(sx*37 + sy*23 as double)").alias("alt"))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracking trials: tile, polarity, kernel sizes, and whether a point was kept."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    return e.select((i % 16).alias("tile"), F.floor(i / F.lit(16.0)).alias("q"), (((i * 29) % 11) > 4).alias("inlier")).select("tile", (3 + 2 * (F.col("q") % 5)).alias("mon_k"), (3 + 2 * (F.floor(F.col("q") / F.lit(5.0)) % 5)).alias("ref_k"), F.when(F.floor(F.col("q") / F.lit(25.0)) % 2 == 0, "normal").otherwise("inverted").alias("polarity"), "inlier")


TRIALS_SQL = """
trial0 AS (SELECT event_id % 16 AS tile, CAST(floor(event_id/CAST(16 AS DOUBLE)) AS BIGINT) AS q, (event_id*29)%11 > 4 AS inlier FROM events),
trial AS (SELECT tile, 3+2*(q%5) AS mon_k, 3+2*(CAST(floor(q/CAST(5 AS DOUBLE)) AS BIGINT)%5) AS ref_k,
  CASE WHEN CAST(floor(q/CAST(25 AS DOUBLE)) AS BIGINT)%2 = 0 THEN 'normal' ELSE 'inverted' END AS polarity, inlier FROM trial0)
"""


def descriptors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Monitored (even ids) and reference (odd ids) descriptors."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return v.where("vec_id % 2 = 0"), v.where("vec_id % 2 = 1")
