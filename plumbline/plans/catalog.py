"""The catalogue of queries of the engine, and the SQL that gives the same rows.

Each query wires operators to the key points and rasters of ``fixtures``; each SQL text is written on its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import negative, product_type, r8, safe_name
from ..operators import descriptors as D
from ..operators import geo as G
from ..operators import keypoints as K
from ..operators import matching as M
from ..operators import profiles as P
from ..operators import raster as R
from ..operators import selection as S
from ..operators import similarity as Y
from ..operators import stats as T
from . import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
W, H = X.WIDTH, X.HEIGHT
NO_VALUES, REF_NODATA, MON_NODATA = [0, 100], 7, 9
GT = [500000.0, 10.0, 0.5, 4000000.0, 0.25, -10.0]
HOMOGRAPHY = [[1.01, 0.02, 1.5], [-0.015, 0.99, -2.25], [0.00001, -0.00002, 1.0]]
RINGS = [[(20.0, 20.0), (180.0, 30.5), (150.25, 140.0), (60.0, 120.0)]]


def query(sql: str | None = None, with_: str = X.SQL) -> Callable:
    """Registers a query by its name, with SQL that begins after the fixtures."""

    def take(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            body = sql.strip()
            more = body.startswith("+")
            head = ", ".join([*([with_.strip()] if with_ else []), *([""] if more else [])])
            ORACLES[f.__name__] = (f"WITH {head} " if with_ or more else "") + body.removeprefix("+")
        return f

    return take


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """df, or some columns of it, with eight decimals in its doubles."""
    return df.select(*[r8(c).alias(c) if df.schema[c].dataType.simpleString() == "double" else F.col(c) for c in columns or df.columns])


def signed(df: DataFrame) -> DataFrame:
    """df with eight decimals in its doubles; what rounds to zero keeps its sign."""
    return df.select(*[F.when(negative(c), -F.abs(r8(c))).otherwise(r8(c)).alias(c) if df.schema[c].dataType.simpleString() == "double" else F.col(c) for c in df.columns])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accuracy row of the points that the filter on pixel values leaves."""
    kp = K.without_values(X.key_points(spark, sf_dir), X.reference_pixels(spark, sf_dir), X.monitored_pixels(spark, sf_dir), NO_VALUES, REF_NODATA, MON_NODATA)
    return rounded(T.accuracy(kp))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return R.zipped(X.reference_pixels(spark, d), X.monitored_pixels(spark, d))


def mask_a(spark: SparkSession, d: str) -> DataFrame:
    return X.reference_pixels(spark, d).select("x", "y", F.expr("cast((x + y) % 7 <> 0 as int)").alias("m"))


def mask_b(spark: SparkSession, d: str) -> DataFrame:
    return X.reference_pixels(spark, d).select("x", "y", F.expr("cast(x between 20 and 180 and y between 20 and 140 as int)").alias("m"))


# --- enrichment and filters


@query("SELECT kp_id, round(sqrt(dx*dx+dy*dy), 8) AS radial_error, round(degrees(atan2(dy, dx)), 8) AS angle FROM kp")
def kp_enrich(spark, d):
    return rounded(K.enrich(X.key_points(spark, d)), "kp_id", "radial_error", "angle")


@query("SELECT kp_id, score FROM conf")
def confidence_filter(spark, d):
    return K.confident(X.key_points(spark, d), 0.4).select("kp_id", "score")


@query("SELECT kp_id, score FROM kp WHERE score >= CAST(0.4 AS DOUBLE)")
def candidate_filter(spark, d):
    return K.candidates(X.key_points(spark, d), 0.4).select("kp_id", "score")


@query("""+t AS (SELECT kp_id, x0, y0, x0+dx AS x1, y0+dy AS y1, x0 + CAST((kp_id*17)%41-20 AS DOUBLE)/CAST(150 AS DOUBLE) AS xr, y0 + CAST((kp_id*23)%37-18 AS DOUBLE)/CAST(150 AS DOUBLE) AS yr FROM kp)
SELECT kp_id, round(x1-x0, 8) AS dx, round(y1-y0, 8) AS dy, round(1 - greatest(abs(x0-xr), abs(y0-yr))/CAST(0.1 AS DOUBLE), 8) AS score FROM t WHERE greatest(abs(x0-xr), abs(y0-yr)) < CAST(0.1 AS DOUBLE)""")
def fb_consistency(spark, d):
    kp = X.key_points(spark, d)
    t = kp.select("kp_id", "x0", "y0", (F.col("x0") + F.col("dx")).alias("x1"), (F.col("y0") + F.col("dy")).alias("y1"), (F.col("x0") + ((F.col("kp_id") * 17) % 41 - 20).cast("double") / 150.0).alias("xr"), (F.col("y0") + ((F.col("kp_id") * 23) % 37 - 18).cast("double") / 150.0).alias("yr"))
    return rounded(K.consistent(t), "kp_id", "dx", "dy", "score")


_DN = "+j AS (SELECT kp.*, r.dn AS ref_dn, m.dn AS mon_dn FROM kp JOIN px_ref r ON r.x = CAST(trunc(x0) AS BIGINT) AND r.y = CAST(trunc(y0) AS BIGINT) JOIN px_mon m ON m.x = r.x AND m.y = r.y)"


@query(_DN + " SELECT kp_id, ref_dn, mon_dn FROM j WHERE ref_dn NOT IN (0,100) AND mon_dn NOT IN (0,100) AND ref_dn <> 7 AND mon_dn <> 9")
def dn_filter(spark, d):
    return K.without_values(X.key_points(spark, d), X.reference_pixels(spark, d), X.monitored_pixels(spark, d), NO_VALUES, REF_NODATA, MON_NODATA).select("kp_id", "ref_dn", "mon_dn")


@query(_DN + """ SELECT count(*) AS total, count_if(ref_dn=0 OR mon_dn=0)::BIGINT AS value_0, count_if(ref_dn=100 OR mon_dn=100)::BIGINT AS value_100, count_if(ref_dn=7)::BIGINT AS ref_nodata, count_if(mon_dn=9)::BIGINT AS mon_nodata,
count_if(ref_dn IN (0,100) OR mon_dn IN (0,100) OR ref_dn=7 OR mon_dn=9)::BIGINT AS removed, round(100.0::DOUBLE*count_if(ref_dn IN (0,100) OR mon_dn IN (0,100) OR ref_dn=7 OR mon_dn=9)/count(*), 8) AS removed_pct FROM j""")
def dn_filter_counts(spark, d):
    return K.excluded_counts(X.key_points(spark, d), X.reference_pixels(spark, d), X.monitored_pixels(spark, d), NO_VALUES, REF_NODATA, MON_NODATA)


def _unrolled(passes: int) -> str:
    steps = ["o0 AS (SELECT * FROM kp)"]
    for k in range(passes):
        steps.append(f"o{k + 1} AS (SELECT o.* FROM o{k} o, (SELECT avg(dx) AS ax, stddev_pop(dx) AS sx, avg(dy) AS ay, stddev_pop(dy) AS sy FROM o{k}) s WHERE abs(dx-ax) < 3*sx AND abs(dy-ay) < 3*sy AND abs(dx-ax) < 20 AND abs(dy-ay) < 20)")
    return "+" + ", ".join(steps) + f" SELECT kp_id, round(dx, 8) AS dx, round(dy, 8) AS dy FROM o{passes}"


@query(_unrolled(12))
def outlier_fixpoint(spark, d):
    return rounded(K.without_outliers(X.key_points(spark, d)), "kp_id", "dx", "dy")


_ZIP = "+z AS (SELECT r.x, r.y, r.dn AS ref, m.dn AS mon FROM px_ref r JOIN px_mon m ON r.x = m.x AND r.y = m.y)"
_VALID = _ZIP + ", v AS (SELECT *, ref <> 0 AND mon <> 0 AND ref <> 7 AND mon <> 9 AS valid FROM z)"


@query(_ZIP + " SELECT x, y, ref, mon FROM z")
def pixel_zip(spark, d):
    return pairs(spark, d).select("x", "y", "ref", "mon")


@query(_VALID + " SELECT x, y, valid FROM v")
def valid_mask(spark, d):
    return R.with_valid(pairs(spark, d), REF_NODATA, MON_NODATA).select("x", "y", "valid")


@query(_VALID + " SELECT CAST(x//50 AS BIGINT) AS tile_x, CAST(y//50 AS BIGINT) AS tile_y, count(*) AS n, count_if(valid)::BIGINT AS valid FROM v GROUP BY ALL")
def tile_valid_counts(spark, d):
    return R.valid_by_tile(R.with_valid(pairs(spark, d), REF_NODATA, MON_NODATA), 50)


@query("""+b AS (SELECT kp_id, CAST(trunc(x0) AS BIGINT) AS xr, CAST(trunc(y0) AS BIGINT) AS yr, CAST(round_even(x0+dx, 0) AS BIGINT) AS xm, CAST(round_even(y0+dy, 0) AS BIGINT) AS ym FROM kp),
c AS (SELECT *, xr-28>=0 AND xr<200-28 AND yr-28>=0 AND yr<160-28 AS ref_ok, xm-28>=0 AND xm<200-28 AND ym-28>=0 AND ym<160-28 AS mon_ok FROM b)
SELECT kp_id, xr, yr, xm, ym, ref_ok, mon_ok, ref_ok AND mon_ok AS in_bounds FROM c""")
def patch_bounds(spark, d):
    return K.patch_bounds(X.key_points(spark, d), W, H).select("kp_id", "xr", "yr", "xm", "ym", "ref_ok", "mon_ok", "in_bounds")


@query("""+o AS (SELECT kp_id, round_even(dy*3, 0) AS r, round_even(dx*3, 0) AS c FROM kp), t AS (SELECT kp_id, CASE WHEN abs(r)<2 THEN 0.0::DOUBLE ELSE r END AS row_off, CASE WHEN abs(c)<2 THEN 0.0::DOUBLE ELSE c END AS col_off FROM o)
SELECT kp_id, row_off, col_off, row_off<>0 OR col_off<>0 AS applied FROM t""")
def offset_threshold(spark, d):
    o = X.key_points(spark, d).select("kp_id", F.rint(F.col("dy") * 3).alias("row_off"), F.rint(F.col("dx") * 3).alias("col_off"))
    return K.thresholded_offsets(o, 2)


@query("""SELECT 'ref' AS image, round(quantile_cont(dn::DOUBLE, 0.02), 8) AS p2, round(quantile_cont(dn::DOUBLE, 0.98), 8) AS p98, quantile_cont(dn::DOUBLE, 0.98)-quantile_cont(dn::DOUBLE, 0.02) <= 10 AS low FROM px_ref
UNION ALL SELECT 'mon', round(quantile_cont(dn::DOUBLE, 0.02), 8), round(quantile_cont(dn::DOUBLE, 0.98), 8), quantile_cont(dn::DOUBLE, 0.98)-quantile_cont(dn::DOUBLE, 0.02) <= 10 FROM px_mon""")
def dynamic_range(spark, d):
    one = lambda px, name: R.percentiles(px, 0.02, 0.98).select(F.lit(name).alias("image"), r8(F.col("p")[0]).alias("p2"), r8(F.col("p")[1]).alias("p98"), (F.col("p")[1] - F.col("p")[0] <= 10).alias("low"))
    return one(X.reference_pixels(spark, d), "ref").unionByName(one(X.monitored_pixels(spark, d), "mon"))


@query("""SELECT 'ref' AS image, count(*) AS n, round(quantile_cont(dn::DOUBLE, 0.005), 8) AS lo, round(quantile_cont(dn::DOUBLE, 0.995), 8) AS hi FROM px_ref WHERE dn NOT IN (0,100,7)
UNION ALL SELECT 'mon', count(*), round(quantile_cont(dn::DOUBLE, 0.005), 8), round(quantile_cont(dn::DOUBLE, 0.995), 8) FROM px_mon WHERE dn NOT IN (0,100,9) AND (x+y)%7 <> 0""")
def overview_contrast(spark, d):
    one = lambda pool, name: pool.agg(F.count("*").alias("n"), F.percentile("dn", F.array(F.lit(0.005), F.lit(0.995))).alias("p")).select(F.lit(name).alias("image"), "n", r8(F.col("p")[0]).alias("lo"), r8(F.col("p")[1]).alias("hi"))
    ref = R.contrast_pool(X.reference_pixels(spark, d), None, NO_VALUES, REF_NODATA)
    return one(ref, "ref").unionByName(one(R.contrast_pool(X.monitored_pixels(spark, d), mask_a(spark, d), NO_VALUES, MON_NODATA), "mon"))


# --- joins


@query(_DN + " SELECT kp_id, ref_dn, mon_dn FROM j")
def kp_dn_join(spark, d):
    return K.with_dn(X.key_points(spark, d), X.reference_pixels(spark, d), X.monitored_pixels(spark, d)).select("kp_id", "ref_dn", "mon_dn")


def kp_alt(spark, d):
    kp = X.key_points(spark, d).withColumn("x", F.col("x0").cast("long")).withColumn("y", F.col("y0").cast("long"))
    return kp.join(X.elevation(spark, d), ["x", "y"])


_ALT = "+ka AS (SELECT kp.*, alt FROM kp JOIN dem ON x = CAST(trunc(x0) AS BIGINT) AND y = CAST(trunc(y0) AS BIGINT))"


@query(_ALT + " SELECT kp_id, alt FROM ka")
def kp_alt_join(spark, d):
    return kp_alt(spark, d).select("kp_id", "alt")


@query("""SELECT kp_id, count(*) AS n, CAST(sum(dn) AS BIGINT) AS total FROM kp JOIN px_ref ON x BETWEEN CAST(trunc(x0) AS BIGINT)-2 AND CAST(trunc(x0) AS BIGINT)+2 AND y BETWEEN CAST(trunc(y0) AS BIGINT)-2 AND CAST(trunc(y0) AS BIGINT)+2 GROUP BY kp_id""")
def patch_join(spark, d):
    return Y.patch_sums(X.key_points(spark, d), X.reference_pixels(spark, d), 2)


@query("""SELECT count(*) AS total, count_if((x+y)%7<>0)::BIGINT AS raster_valid, count_if(x BETWEEN 20 AND 180 AND y BETWEEN 20 AND 140)::BIGINT AS vector_valid, count_if((x+y)%7<>0 AND x BETWEEN 20 AND 180 AND y BETWEEN 20 AND 140)::BIGINT AS both_valid FROM px_ref""")
def mask_and(spark, d):
    return R.combined(mask_a(spark, d), mask_b(spark, d))


def _ring_sql() -> str:
    ring = RINGS[0]
    edges = list(zip(ring, ring[1:] + ring[:1], strict=True))
    values = ", ".join(f"({ax}::DOUBLE, {ay}::DOUBLE, {bx}::DOUBLE, {by}::DOUBLE)" for (ax, ay), (bx, by) in edges)
    return f"""+e(ax, ay, bx, b_y) AS (VALUES {values}),
t AS (SELECT x, y, sum(CASE WHEN (ay > y+0.5) <> (b_y > y+0.5) AND x+0.5 < ax + (y+0.5-ay)*(bx-ax)/nullif(b_y-ay, 0) THEN 1 ELSE 0 END) AS crossings,
 max(CASE WHEN greatest(0, CASE WHEN bx<>ax THEN least((x-ax)/(bx-ax), (x+1-ax)/(bx-ax)) ELSE 0 END, CASE WHEN b_y<>ay THEN least((y-ay)/(b_y-ay), (y+1-ay)/(b_y-ay)) ELSE 0 END)
  < least(1, CASE WHEN bx<>ax THEN greatest((x-ax)/(bx-ax), (x+1-ax)/(bx-ax)) WHEN ax < x OR ax > x+1 THEN -1 ELSE 1 END, CASE WHEN b_y<>ay THEN greatest((y-ay)/(b_y-ay), (y+1-ay)/(b_y-ay)) WHEN ay < y OR ay > y+1 THEN -1 ELSE 1 END) THEN 1 ELSE 0 END) AS touched
 FROM px_ref, e GROUP BY x, y)
SELECT x, y, CAST(crossings % 2 = 1 OR touched = 1 AS INT) AS m FROM t"""


@query(_ring_sql())
def rasterize_mask(spark, d):
    return R.rasterized(X.reference_pixels(spark, d), [RINGS])


@query("+k(v) AS (VALUES (3),(5),(7),(9),(11)) SELECT a.v AS mon_k, b.v AS ref_k FROM k a, k b")
def ksize_grid(spark, d):
    k = spark.range(3, 13, 2).select(F.col("id").cast("int").alias("v"))
    return k.select(F.col("v").alias("mon_k")).crossJoin(F.broadcast(k.select(F.col("v").alias("ref_k"))))


_KNN = """+p AS (SELECT a.vec_id AS q, b.vec_id AS t, sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE), 2)))) AS dist FROM embeddings a, embeddings b WHERE a.vec_id%2=0 AND b.vec_id%2=1),
f AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, t) AS rank FROM p), g AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY dist, q) AS rank FROM p),
best AS (SELECT a.q, a.t, a.dist FROM f a JOIN f b ON a.q=b.q AND a.rank=1 AND b.rank=2 WHERE a.dist < CAST(0.97 AS DOUBLE)*b.dist)"""


@query(_KNN + " SELECT q, t, round(dist, 8) AS dist, CAST(rank AS INT) AS rank FROM f WHERE rank <= 2")
def knn_top2(spark, d):
    return rounded(D.nearest(*X.descriptors(spark, d)))


@query(_KNN + " SELECT q, t, round(dist, 8) AS dist FROM best")
def knn_ratio(spark, d):
    return rounded(D.ratio_test(D.nearest(*X.descriptors(spark, d)), 0.97))


@query(_KNN + " SELECT b.q, b.t, round(b.dist, 8) AS dist FROM best b JOIN g ON g.q=b.q AND g.t=b.t AND g.rank=1")
def knn_mutual(spark, d):
    mon, ref = X.descriptors(spark, d)
    return rounded(D.mutual(D.ratio_test(D.nearest(mon, ref), 0.97), D.nearest(ref, mon, 1)))


@query("""+c AS (SELECT CAST(trunc(x0) AS BIGINT) AS x, CAST(trunc(y0) AS BIGINT) AS y, max_by(dx, kp_id) AS dx, max_by(dy, kp_id) AS dy, max_by(score, kp_id) AS score FROM conf GROUP BY ALL),
f AS (SELECT x, y, 'chips/REF_' || x || '_' || y || '.png' AS path FROM px_ref WHERE (x*7+y)%5=0),
j AS (SELECT path, f.x, f.y, coalesce(dx, 0) AS dx, coalesce(dy, 0) AS dy, score FROM f LEFT JOIN c ON c.x=f.x AND c.y=f.y)
SELECT path, x, y, round(dx, 8) AS dx, round(dy, 8) AS dy, score, round(dx*dx+dy*dy, 8) AS dist, round(greatest(2, least(112, 57-2*dx)), 8) AS cross_x, round(greatest(2, least(112, 57-2*dy)), 8) AS cross_y FROM j""")
def chip_cards(spark, d):
    files = X.reference_pixels(spark, d).where("(x*7+y)%5=0").select(F.concat(F.lit("chips/REF_"), "x", F.lit("_"), "y", F.lit(".png")).alias("path"))
    return rounded(S.chip_cards(files, K.confident(X.key_points(spark, d), 0.4)))


# --- statistics


@query("""+p AS (SELECT count(*) FILTER (score > 0.4) * 100.0 / 32000 AS pct FROM kp),
m AS (SELECT 'x' AS direction, min(dx) AS a, max(dx) AS b, avg(dx) AS c, stddev_pop(dx) AS s, median(dx) AS e FROM conf
UNION ALL SELECT 'y', min(-dy), max(-dy), avg(-dy), stddev_pop(-dy), median(-dy) FROM conf)
SELECT direction, concat(' Conf_Value :', CASE direction WHEN 'x' THEN ' ' ELSE '' END, '0.40', chr(10), '  %Conf Px   :', printf('%.2f', pct), '%', chr(10), ' Minimum    : ', printf('%.2f', a*10), chr(10), ' Maximum   : ', printf('%.2f', b*10), chr(10),
' Mean          : ', printf('%.2f', c*10), chr(10), ' Std Dev      : ', printf('%.2f', s*10), chr(10), ' Median       : ', printf('%.2f', e*10)) AS block FROM m, p""")
def stat_block(spark, d):
    valid = X.reference_pixels(spark, d).agg(F.count("*").alias("valid_pixels"))
    kp = X.key_points(spark, d)
    return T.stat_block(T.geometric(kp), T.percentages(kp, valid), 10.0)


@query("""+e AS (SELECT sqrt((x0 - (1.01*(x0+dx) + 0.02*(y0+dy) + 1.5))**2 + (y0 - (-0.015*(x0+dx) + 0.99*(y0+dy) - 2.25))**2) AS e FROM kp)
SELECT round(median(e), 8) AS median, round(min(e), 8) AS least, round(max(e), 8) AS largest FROM e""")
def prior_match_error(spark, d):
    matches = X.key_points(spark, d).select((F.col("x0") + F.col("dx")).alias("x_mon"), (F.col("y0") + F.col("dy")).alias("y_mon"), F.col("x0").alias("x_ref"), F.col("y0").alias("y_ref"))
    return rounded(T.prior_errors(matches, HOMOGRAPHY))


def _five(c: str, e: str) -> str:
    return f"round(min({e}), 8) AS min_{c}, round(max({e}), 8) AS max_{c}, round(median({e}), 8) AS median_{c}, round(avg({e}), 8) AS mean_{c}, round(stddev_pop({e}), 8) AS std_{c}"


@query(f"SELECT count(*) AS n, {_five('dx', 'dx')}, {_five('dy', '-dy')}, {_five('score', 'score')} FROM conf")
def geometric_stats(spark, d):
    return rounded(T.geometric(X.key_points(spark, d)))


_PIX = "SELECT count_if(dn<>0 AND (x+y)%7<>0)::BIGINT AS valid_pixels, count(*) AS total_pixels FROM px_mon"


@query(_PIX)
def valid_pixels(spark, d):
    return R.valid_count(X.monitored_pixels(spark, d), mask_a(spark, d))


@query(f"+v AS ({_PIX}), s AS (SELECT (SELECT count(*) FROM conf) AS n, (SELECT count(*) FROM kp) AS t) SELECT n AS sample_pixel, t AS total_kp, valid_pixels, round(100.0::DOUBLE*n/t, 8) AS pct_match, round(100.0::DOUBLE*n/valid_pixels, 8) AS pct_pixel FROM s, v")
def sample_percentages(spark, d):
    return T.percentages(X.key_points(spark, d), valid_pixels(spark, d).select("valid_pixels"))


def _ce_sql(p: str, out: str) -> str:
    return f"""r AS (SELECT sqrt(dx*dx+dy*dy) AS v, row_number() OVER (ORDER BY sqrt(dx*dx+dy*dy)) AS i, count(*) OVER () AS n FROM conf),
k AS (SELECT max(n)*CAST({p} AS DOUBLE) AS pos, CAST(floor(max(n)*CAST({p} AS DOUBLE)) AS BIGINT) AS k FROM r),
ce AS (SELECT max(CASE WHEN i=greatest(k,1) THEN v END) + (max(pos)-max(k))*(max(CASE WHEN i=least(k+1,n) THEN v END) - max(CASE WHEN i=greatest(k,1) THEN v END)) AS ce FROM r, k) {out}"""


@query("+" + _ce_sql("0.9", "SELECT round(ce, 8) AS ce FROM ce"))
def ce90(spark, d):
    return rounded(T.circular_error(X.key_points(spark, d), 0.9))


@query("+" + _ce_sql("0.95", "SELECT round(ce, 8) AS ce FROM ce"))
def ce95(spark, d):
    return rounded(T.circular_error(X.key_points(spark, d), 0.95))


@query("+" + _ce_sql("0.9", "SELECT k::INT AS k, round(ce*cos(k*2*pi()/109), 8) + 0 AS x, round(ce*sin(k*2*pi()/109), 8) + 0 AS y FROM ce, range(110) t(k)").replace("k AS (SELECT max(n)", "kk AS (SELECT max(n)").replace("FROM r, k)", "FROM r, kk)"))
def ce_circle(spark, d):
    return rounded(T.circle(T.circular_error(X.key_points(spark, d), 0.9)))


@query("""+m AS (SELECT sqrt(avg(dx)*avg(dx)+stddev_pop(dx)*stddev_pop(dx)) AS a, sqrt(avg(dy)*avg(dy)+stddev_pop(dy)*stddev_pop(dy)) AS b FROM conf) SELECT round(a, 8) AS rmse_x, round(b, 8) AS rmse_y, round(sqrt(a*a+b*b), 8) AS rmse FROM m""")
def rmse(spark, d):
    return rounded(T.rmse(X.key_points(spark, d)))


def _hist(c: str) -> str:
    return f"""+m AS (SELECT count(*) AS cnt, greatest(abs(max({c})), abs(min({c}))) AS vmax, max({c})-min({c}) AS ptp FROM conf),
nb AS (SELECT vmax, CAST(CASE WHEN ptp > 0 THEN ceil(2*vmax/(ptp/sqrt(cnt))) ELSE 1 END AS BIGINT) AS nb FROM m), w AS (SELECT vmax, nb, 2*vmax/nb AS w FROM nb),
h AS (SELECT least(CAST(floor(({c}+vmax)/w) AS BIGINT), nb-1) AS bin, count(*) AS n FROM conf, w GROUP BY 1),
hist AS (SELECT CAST(g.bin AS BIGINT) AS bin, g.bin*w-vmax AS lo, (g.bin+1)*w-vmax AS hi, coalesce(n, 0) AS n FROM w, range(nb) g(bin) LEFT JOIN h ON h.bin=g.bin)"""


@query(_hist("dx") + " SELECT bin, round(lo, 8) AS lo, round(hi, 8) AS hi, n FROM hist")
def hist_dx(spark, d):
    return rounded(T.histogram(K.confident(X.key_points(spark, d), 0.4), "dx"))


@query(_hist("dy") + " SELECT bin, round(lo, 8) AS lo, round(hi, 8) AS hi, n FROM hist")
def hist_dy(spark, d):
    return rounded(T.histogram(K.confident(X.key_points(spark, d), 0.4), "dy"))


_NORMAL = T.NORMALITY.strip().replace("SELECT n, z1*z1 + z2*z2 AS k2, exp(-(z1*z1 + z2*z2)/2) AS p,", "SELECT n, round(z1*z1 + z2*z2, 8) AS k2, round(exp(-(z1*z1 + z2*z2)/2), 8) AS p,")


@query(_hist("dx") + ", c AS (SELECT n::DOUBLE AS v, n-(SELECT avg(n) FROM hist) AS c FROM hist), moments AS (SELECT count(*)::DOUBLE AS n, avg(c*c*c)/pow(avg(c*c), 1.5) AS g1, avg(c*c*c*c)/(avg(c*c)*avg(c*c)) AS b2 FROM c) " + _NORMAL)
def normality_test(spark, d):
    return rounded(T.normality(T.histogram(K.confident(X.key_points(spark, d), 0.4), "dx")))


@query("""+m AS (SELECT min(dx) AS a1, max(dx) AS b1, min(dy) AS a2, max(dy) AS b2, count(*) AS t FROM conf)
SELECT least(CAST(floor((dx-a1)*10/(b1-a1)) AS BIGINT), 9) AS bx, least(CAST(floor((dy-a2)*10/(b2-a2)) AS BIGINT), 9) AS by, count(*) AS n, round(count(*)/(max(t)*(max(b1)-max(a1))*(max(b2)-max(a2))/100), 8) AS density FROM conf, m GROUP BY 1, 2""")
def density_2d(spark, d):
    return rounded(T.density(K.confident(X.key_points(spark, d), 0.4)))


@query(_hist("dx") + """, e AS (SELECT bin AS k, lo AS edge FROM hist UNION ALL SELECT max(bin)+1, max(hi) FROM hist), s AS (SELECT avg(dx) AS mu, stddev_pop(dx) AS s FROM conf), g AS (SELECT k, edge, exp(-(edge-mu)*(edge-mu)/(2*s*s))/(s*sqrt(2*pi())) AS g FROM e, s)
SELECT k, round(edge, 8) AS edge, round(g/(SELECT sum(g) FROM g)*(SELECT sum(n) FROM hist), 8) AS y FROM g""")
def gauss_curve(spark, d):
    c = K.confident(X.key_points(spark, d), 0.4)
    return rounded(T.gauss(T.histogram(c, "dx"), c, "dx"))


@query("+r AS (SELECT sqrt(dx*dx+dy*dy) AS r FROM conf) SELECT row_number() OVER (ORDER BY r) AS i, round(100.0::DOUBLE*(row_number() OVER (ORDER BY r)-1)/(count(*) OVER ()-1), 8) AS pct, round(r, 8) AS r FROM r")
def radial_cdf(spark, d):
    return rounded(T.radial_cdf(K.confident(X.key_points(spark, d), 0.4)))


def _limits(c: str) -> str:
    lo, hi = f"{c}_lo", f"{c}_hi"
    return f"round(CASE WHEN {lo}>0 THEN 0 ELSE {lo} END, 8) AS {c}_vmin, round(CASE WHEN {hi}>0 AND {lo}<0 THEN 0 WHEN {lo}>0 THEN {lo} WHEN {hi}<0 THEN {hi} END, 8) AS {c}_centre, round(CASE WHEN {hi}<0 THEN 0 ELSE {hi} END, 8) AS {c}_vmax"


@query(f"""+m AS (SELECT avg(dx)-3*stddev(dx) AS dx_lo, avg(dx)+3*stddev(dx) AS dx_hi, avg(dy)-3*stddev(dy) AS dy_lo, avg(dy)+3*stddev(dy) AS dy_hi, avg(sqrt(dx*dx+dy*dy))+3*stddev(sqrt(dx*dx+dy*dy)) AS r_hi FROM kp)
SELECT {_limits('dx')}, {_limits('dy')}, round(r_hi, 8) AS radial_vmax, round(r_hi/2, 8) AS radial_centre FROM m""")
def color_limits(spark, d):
    return rounded(T.color_limits(X.key_points(spark, d)))


@query("SELECT CAST(floor(least(min(dx), min(dy), min(sqrt(dx*dx+dy*dy)))) AS BIGINT) AS lo, CAST(ceil(greatest(max(dx), max(dy), max(sqrt(dx*dx+dy*dy)))) AS BIGINT) AS hi FROM kp")
def dem_axis_limits(spark, d):
    return T.axis_limits(X.key_points(spark, d))


_TRIALS = X.TRIALS_SQL
_RATIO = "SELECT {k}, count_if(inlier)::BIGINT AS inliers, count(*) AS n, {r} AS ratio FROM trial GROUP BY {k}"
_EXACT, _SHOWN = "count_if(inlier)::DOUBLE/count(*)", "round(count_if(inlier)::DOUBLE/count(*), 8)"
_BEST = "+r AS (" + _RATIO.format(k="tile, mon_k, ref_k", r=_EXACT) + "), b AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY ratio DESC, mon_k, ref_k) AS rn FROM r)"


@query(_RATIO.format(k="tile, polarity", r=_SHOWN), _TRIALS)
def inlier_ratio(spark, d):
    return rounded(T.inlier_ratios(X.trials(spark, d), "tile", "polarity"))


@query(_BEST + " SELECT tile, mon_k, ref_k, inliers, n, round(ratio, 8) AS ratio FROM b WHERE rn=1", _TRIALS)
def best_ksize(spark, d):
    return rounded(S.best_pair(T.inlier_ratios(X.trials(spark, d), "tile", "mon_k", "ref_k")))


@query("+r AS (" + _RATIO.format(k="tile, polarity", r=_EXACT) + "), b AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY ratio DESC, polarity DESC) AS rn FROM r) SELECT tile, polarity, inliers, n, round(ratio, 8) AS ratio FROM b WHERE rn=1", _TRIALS)
def best_polarity(spark, d):
    return rounded(S.best_polarity(T.inlier_ratios(X.trials(spark, d), "tile", "polarity")))


@query(_BEST + " SELECT mon_k, ref_k, count(*) AS votes, min(tile) AS first FROM b WHERE rn=1 GROUP BY 1, 2 ORDER BY votes DESC, first LIMIT 1", _TRIALS)
def mode_vote(spark, d):
    return T.mode(S.best_pair(T.inlier_ratios(X.trials(spark, d), "tile", "mon_k", "ref_k")), ["mon_k", "ref_k"], "tile")


@query("SELECT CAST(floor(x0/50) AS BIGINT) AS tile_x, CAST(floor(y0/50) AS BIGINT) AS tile_y, count(*) AS n, round(avg(dx), 8) AS mean_dx, round(stddev(dx), 8) AS std_dx, round(avg(dy), 8) AS mean_dy, round(stddev(dy), 8) AS std_dy FROM kp GROUP BY 1, 2")
def tile_stats(spark, d):
    return rounded(T.tile_stats(X.key_points(spark, d), 50))


# --- profiles


def _profile(v: str, p: str, size: int, table: str = "kp") -> str:
    return f"prof AS (SELECT CAST(floor({p}/{size}) AS BIGINT)*{size}+{size // 2} AS pos, count({v}) AS n, avg({v}) AS mean, stddev({v}) AS std FROM {table} GROUP BY 1)"


_SHOW_PROFILE = " SELECT pos, n, round(mean, 8) AS mean, round(std, 8) AS std FROM prof"


@query("+" + _profile("dx", "x0", 20) + _SHOW_PROFILE)
def profile_dx_by_col(spark, d):
    return rounded(P.mean_profile(X.key_points(spark, d), "dx", "x0", 20))


@query("+" + _profile("dx", "x0", 20) + " SELECT CAST(floor(max(abs(mean))) AS BIGINT) + 1 AS mean_limit, max(n) AS most FROM prof")
def profile_axis_limits(spark, d):
    return P.axis_limits(P.mean_profile(X.key_points(spark, d), "dx", "x0", 20))


@query("+" + _profile("dx", "y0", 20) + _SHOW_PROFILE)
def profile_dx_by_row(spark, d):
    return rounded(P.mean_profile(X.key_points(spark, d), "dx", "y0", 20))


@query("+" + _profile("dy", "x0", 20) + _SHOW_PROFILE)
def profile_dy_by_col(spark, d):
    return rounded(P.mean_profile(X.key_points(spark, d), "dy", "x0", 20))


@query("+" + _profile("dy", "y0", 20) + _SHOW_PROFILE)
def profile_dy_by_row(spark, d):
    return rounded(P.mean_profile(X.key_points(spark, d), "dy", "y0", 20))


@query("+" + _profile("dx", "x0", 20) + """, g AS (SELECT *, pos-avg(pos) OVER () AS c, count(*) OVER () AS cnt FROM prof), s AS (SELECT *, sum(c*c) OVER () AS ss FROM g)
SELECT pos, n, round(mean, 8) AS mean, round(std, 8) AS std, round(mean-std*sqrt(1.0/cnt+c*c/nullif(ss, 0)), 8) AS lo, round(mean+std*sqrt(1.0/cnt+c*c/nullif(ss, 0)), 8) AS hi FROM s""")
def profile_std_band(spark, d):
    return rounded(P.std_band(P.mean_profile(X.key_points(spark, d), "dx", "x0", 20)))


@query(_ALT + ", " + _profile("dx", "alt", 100, "ka") + " SELECT pos, n, round(mean, 8) AS mean, round(std, 8) AS std, round(sqrt(mean*mean+std*std), 8) AS rmse FROM prof")
def profile_by_alt(spark, d):
    return rounded(P.by_altitude(kp_alt(spark, d), "dx"))


@query(_ALT + """, q AS (SELECT CAST(floor(alt/100) AS BIGINT) AS b, quantile_cont(dx, 0.25) AS q1, quantile_cont(dx, 0.5) AS med, quantile_cont(dx, 0.75) AS q3 FROM ka GROUP BY 1),
j AS (SELECT q.*, dx, dx >= q1-1.5*(q3-q1) AND dx <= q3+1.5*(q3-q1) AS inside FROM ka JOIN q ON q.b=CAST(floor(alt/100) AS BIGINT))
SELECT b*100+50 AS pos, round(q1, 8) AS q1, round(med, 8) AS med, round(q3, 8) AS q3, round(least(min(CASE WHEN inside THEN dx END), q1), 8) AS whisker_lo, round(greatest(max(CASE WHEN inside THEN dx END), q3), 8) AS whisker_hi, count_if(NOT inside)::BIGINT AS fliers FROM j GROUP BY b, q1, med, q3""")
def boxplot_by_alt(spark, d):
    return rounded(P.boxes(kp_alt(spark, d), "dx", "alt", 100))


# --- selection

_CELL = """+cell AS (SELECT *, CAST(greatest(0, least(4, floor(y0/32)))*5 + greatest(0, least(4, floor(x0/40))) AS BIGINT) AS cell FROM kp WHERE score >= CAST(0.4 AS DOUBLE)),
dist AS (SELECT *, (cell%5)*40.0::DOUBLE AS xs, (cell//5)*32.0::DOUBLE AS ys, sqrt(pow(x0-((cell%5)*40+20), 2)+pow(y0-((cell//5)*32+16), 2)) AS dist FROM cell),
centre AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY dist, score DESC, kp_id) AS rn FROM dist) WHERE rn=1),
rest AS (SELECT * FROM dist WHERE kp_id NOT IN (SELECT kp_id FROM centre)),
quart AS (SELECT rest.*, q FROM rest, range(4) t(q) WHERE (x0 >= xs+20*(q%2) AND x0 < xs+20+20*(q%2) AND y0 >= ys+16*(q//2) AND y0 < ys+16+16*(q//2)) OR (q%2=1 AND x0=xs+40) OR (q>=2 AND y0=ys+32)),
med AS (SELECT *, median(dist) OVER (PARTITION BY cell, q) AS m FROM quart),
qpick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell, q ORDER BY abs(dist-m), score DESC, kp_id) AS rn2 FROM med) WHERE rn2=1)"""
_CENTRE = "SELECT cell, -1 AS quarter, kp_id, x0, y0, score, round(dist, 8) AS dist FROM centre"
_QUART = "SELECT cell, CAST(q AS INT) AS quarter, kp_id, x0, y0, score, round(dist, 8) AS dist FROM qpick"


def _chip_points(spark, d):
    return K.candidates(X.key_points(spark, d), 0.4)


@query(_CELL + " SELECT cell, count(*) AS n FROM cell GROUP BY cell")
def grid_cell_count(spark, d):
    return S.cell_counts(_chip_points(spark, d), W, H)


@query(f"{_CELL} {_CENTRE}")
def chip_center(spark, d):
    return rounded(S.centres(_chip_points(spark, d), W, H))


@query(f"{_CELL} {_QUART}")
def chip_quarters(spark, d):
    return rounded(S.quarters(_chip_points(spark, d), W, H))


@query(f"{_CELL} {_CENTRE} UNION ALL {_QUART}")
def chip_select(spark, d):
    return rounded(S.select(_chip_points(spark, d), W, H))


@query(_CELL + " SELECT cell, kp_id, score, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY score DESC, kp_id) AS rn FROM cell) WHERE rn <= 4")
def chip_top4(spark, d):
    return S.top_by_score(_chip_points(spark, d), W, H).select("cell", "kp_id", "score", "rank")


# --- similarity


@query("""+b AS (SELECT kp_id, CAST(trunc(x0) AS BIGINT) AS xr, CAST(trunc(y0) AS BIGINT) AS yr, CAST(round_even(x0+dx, 0) AS BIGINT) AS xm, CAST(round_even(y0+dy, 0) AS BIGINT) AS ym FROM kp WHERE score >= CAST(0.4 AS DOUBLE)),
c AS (SELECT * FROM b WHERE xr>=28 AND xr<172 AND yr>=28 AND yr<132 AND xm>=28 AND xm<172 AND ym>=28 AND ym<132),
o AS (SELECT kp_id, xr+i AS x, yr+j AS y, xm+i AS u, ym+j AS v FROM c, range(-21, 22) a(i), range(-21, 22) b(j)),
s AS (SELECT kp_id, corr(r.dn::DOUBLE, m.dn::DOUBLE) AS z FROM o JOIN px_ref r ON r.x=o.x AND r.y=o.y JOIN px_mon m ON m.x=o.u AND m.y=o.v GROUP BY kp_id)
SELECT kp.kp_id, round(z, 8) AS zncc FROM kp LEFT JOIN s ON s.kp_id=kp.kp_id""")
def zncc(spark, d):
    return rounded(Y.patch_scores(X.key_points(spark, d), pairs(spark, d), W, H), "kp_id", "zncc")


_NMI = """+b AS (SELECT kp_id, CAST(trunc(x0) AS BIGINT) AS xr, CAST(trunc(y0) AS BIGINT) AS yr, CAST(round_even(x0+dx, 0) AS BIGINT) AS xm, CAST(round_even(y0+dy, 0) AS BIGINT) AS ym FROM kp WHERE score >= CAST(0.4 AS DOUBLE)),
c AS (SELECT * FROM b WHERE xr>=28 AND xr<172 AND yr>=28 AND yr<132 AND xm>=28 AND xm<172 AND ym>=28 AND ym<132),
w AS (SELECT kp_id, xr+i AS x, yr+j AS y, xm+i AS u, ym+j AS v FROM c, range(-28, 29) a(i), range(-28, 29) b(j)),
o AS MATERIALIZED (SELECT kp_id, r.dn AS r, m.dn AS m FROM w JOIN px_ref r ON r.x=w.x AND r.y=w.y JOIN px_mon m ON m.x=w.u AND m.y=w.v),
e AS (SELECT kp_id, min(r) AS r0, max(r) AS r1, min(m) AS m0, max(m) AS m1 FROM o GROUP BY 1),
h AS MATERIALIZED (SELECT o.kp_id, least(CAST(floor((r-r0)*32.0::DOUBLE/(r1-r0)) AS INT), 31) AS a, least(CAST(floor((m-m0)*32.0::DOUBLE/(m1-m0)) AS INT), 31) AS b, count(*)/3249.0::DOUBLE AS p FROM o JOIN e ON e.kp_id=o.kp_id GROUP BY 1, 2, 3),
hx AS (SELECT kp_id, -sum(p*ln(p)) AS h FROM (SELECT kp_id, a, sum(p) AS p FROM h GROUP BY 1, 2) GROUP BY 1), hy AS (SELECT kp_id, -sum(p*ln(p)) AS h FROM (SELECT kp_id, b, sum(p) AS p FROM h GROUP BY 1, 2) GROUP BY 1),
hxy AS (SELECT kp_id, -sum(p*ln(p)) AS h FROM h GROUP BY 1), n AS (SELECT hx.kp_id, hx.h AS x, hy.h AS y, hxy.h AS xy FROM hx JOIN hy ON hx.kp_id=hy.kp_id JOIN hxy ON hxy.kp_id=hx.kp_id)"""


@query(_NMI + " SELECT kp.kp_id, round(2*(x+y-xy)/nullif(x+y, 0), 8) AS nmi_sum FROM kp LEFT JOIN n ON n.kp_id=kp.kp_id")
def nmi_sum(spark, d):
    return rounded(Y.patch_scores(X.key_points(spark, d), pairs(spark, d), W, H), "kp_id", "nmi_sum")


@query(_NMI + " SELECT kp.kp_id, round((x+y)/nullif(xy, 0), 8) AS nmi_studholme FROM kp LEFT JOIN n ON n.kp_id=kp.kp_id")
def nmi_studholme(spark, d):
    return rounded(Y.patch_scores(X.key_points(spark, d), pairs(spark, d), W, H), "kp_id", "nmi_studholme")


# --- raster algebra


@query("+m AS (SELECT x//50 AS tx, y//50 AS ty, min(dn) AS a, max(dn) AS b FROM px_ref GROUP BY 1, 2) SELECT x, y, CAST(coalesce(floor((dn-a)::DOUBLE/nullif(b-a, 0)*255), 0) AS BIGINT) AS u8 FROM px_ref JOIN m ON tx=x//50 AND ty=y//50")
def stretch_minmax(spark, d):
    return R.minmax_stretch(X.reference_pixels(spark, d), 50)


_STRETCH = "p AS (SELECT quantile_cont(dn::DOUBLE, 0.02) AS a, quantile_cont(dn::DOUBLE, 0.98) AS b FROM px_ref), u AS (SELECT x, y, CAST(coalesce(floor((greatest(least(dn::DOUBLE, b), a)-a)/nullif(b-a, 0)*255), 0) AS BIGINT) AS u8 FROM px_ref, p)"


@query(f"+{_STRETCH} SELECT x, y, u8 FROM u")
def stretch_percentile(spark, d):
    return R.percentile_stretch(X.reference_pixels(spark, d))


@query(f"+{_STRETCH} SELECT x, y, 255-u8 AS u8 FROM u")
def polarity_invert(spark, d):
    return R.inverted(R.percentile_stretch(X.reference_pixels(spark, d)))


@query("SELECT g.x, g.y, coalesce(s.dn, 0) AS dn FROM px_mon g LEFT JOIN px_mon s ON s.x=g.x+2 AND s.y=g.y+3")
def shift_image(spark, d):
    return R.shifted(X.monitored_pixels(spark, d), 2, 3)


def _stencil_sql(table: str, value: str, **kernels: list) -> str:
    """Mirrored neighbours by equal coordinates, for each place and offset."""
    sums = ", ".join(f"sum(CASE {' '.join(f'WHEN i={i} AND j={j} THEN {w}' for i, j, w in k)} ELSE 0 END * {value})::DOUBLE AS {name}" for name, k in kernels.items())
    return f"""st AS (SELECT g.x, g.y, {sums} FROM (SELECT x, y, i, j, CASE WHEN x+i<0 THEN 1 WHEN x+i>199 THEN 198 ELSE x+i END AS u, CASE WHEN y+j<0 THEN 1 WHEN y+j>159 THEN 158 ELSE y+j END AS v FROM px_ref, range(-1, 2) a(i), range(-1, 2) b(j)) g JOIN {table} s ON s.x=g.u AND s.y=g.v GROUP BY 1, 2)"""


_SOBEL = _stencil_sql("px_ref", "dn", gx=R.SOBEL_X, gy=R.SOBEL_Y)


@query("+" + _stencil_sql("px_ref", "dn", lap=R.LAPLACIAN3) + " SELECT x, y, CAST(greatest(0, least(255, lap)) AS BIGINT) AS lap FROM st")
def laplacian3(spark, d):
    return R.laplacian3(X.reference_pixels(spark, d), W, H)


@query(f"+{_SOBEL} SELECT x, y, round(sqrt(gx*gx+gy*gy)/(SELECT max(sqrt(gx*gx+gy*gy)) FROM st), 8) AS mag FROM st")
def sobel_magnitude(spark, d):
    return rounded(R.sobel_magnitude(X.reference_pixels(spark, d), W, H))


@query(f"+{_SOBEL}, c AS (SELECT g.x, g.y, sum(gx*gx) AS a, sum(gx*gy) AS b, sum(gy*gy) AS c FROM px_ref g JOIN st ON st.x BETWEEN g.x-1 AND g.x+1 AND st.y BETWEEN g.y-1 AND g.y+1 WHERE g.x BETWEEN 1 AND 198 AND g.y BETWEEN 1 AND 158 GROUP BY 1, 2) SELECT x, y, round((a+c)/2-sqrt((a-c)*(a-c)/4+b*b), 8) AS response FROM c")
def min_eig_response(spark, d):
    return rounded(R.min_eigenvalue(X.reference_pixels(spark, d), W, H))


@query(f"""+{_STRETCH}, h AS (SELECT CAST(floor(x*8/200) AS BIGINT) AS block_x, CAST(floor(y*8/160) AS BIGINT) AS block_y, u8 AS dn, count(*) AS n FROM u GROUP BY 1, 2, 3),
a AS (SELECT *, sum(n) OVER (PARTITION BY block_x, block_y) AS area FROM h), l AS (SELECT *, least(n, greatest(1, floor(area*2.0::DOUBLE/256))) AS cut FROM a),
s AS (SELECT *, (area-sum(cut) OVER (PARTITION BY block_x, block_y))/256.0::DOUBLE AS spread, sum(cut) OVER (PARTITION BY block_x, block_y ORDER BY dn) AS cum FROM l)
SELECT block_x, block_y, dn, CAST(round_even((cum+(dn+1)*spread)*255/area, 0) AS BIGINT) AS lut FROM s""")
def clahe_lut(spark, d):
    return R.clahe_tables(R.percentile_stretch(X.reference_pixels(spark, d)), W, H)


_UV = f"uv AS (SELECT x, y, ({HOMOGRAPHY[0][0]}::DOUBLE*x+{HOMOGRAPHY[0][1]}::DOUBLE*y+{HOMOGRAPHY[0][2]}::DOUBLE)/z AS u, ({HOMOGRAPHY[1][0]}::DOUBLE*x+{HOMOGRAPHY[1][1]}::DOUBLE*y+{HOMOGRAPHY[1][2]}::DOUBLE)/z AS v FROM (SELECT x, y, 1e-5::DOUBLE*x-2e-5::DOUBLE*y+1 AS z FROM px_mon))"


@query(f"+{_UV} SELECT uv.x, uv.y, coalesce(s.dn, 0)::DOUBLE AS dn FROM uv LEFT JOIN px_mon s ON s.x=CAST(round_even(u, 0) AS BIGINT) AND s.y=CAST(round_even(v, 0) AS BIGINT)")
def warp_nearest(spark, d):
    return R.warp(X.monitored_pixels(spark, d), W, H, HOMOGRAPHY, bilinear=False)


@query(f"""+{_UV}, k AS (SELECT x, y, CAST(floor(u) AS BIGINT)+i AS sx, CAST(floor(v) AS BIGINT)+j AS sy, (CASE WHEN i=1 THEN u-floor(u) ELSE 1-(u-floor(u)) END)*(CASE WHEN j=1 THEN v-floor(v) ELSE 1-(v-floor(v)) END) AS w FROM uv, range(2) a(i), range(2) b(j))
SELECT k.x, k.y, round(sum(w*coalesce(s.dn, 0)), 8) AS dn FROM k LEFT JOIN px_mon s ON s.x=sx AND s.y=sy GROUP BY 1, 2""")
def warp_bilinear(spark, d):
    return rounded(R.warp(X.monitored_pixels(spark, d), W, H, HOMOGRAPHY, bilinear=True))


@query("SELECT kp_id, x0, y0 FROM kp WHERE score > CAST(0.7 AS DOUBLE) UNION ALL SELECT kp_id, x0, y0 FROM kp WHERE score <= CAST(0.3 AS DOUBLE)")
def tile_union(spark, d):
    kp = X.key_points(spark, d).select("kp_id", "x0", "y0", "score")
    return R.from_tiles(kp.where("score > 0.7D"), kp.where("score <= 0.3D")).drop("score")


# --- georeferencing and products

_XY = "x0*10.0::DOUBLE+y0*0.5::DOUBLE+500000.0::DOUBLE AS e, x0*0.25::DOUBLE-y0*10.0::DOUBLE+4000000.0::DOUBLE AS n"


@query(f"SELECT kp_id, round(e, 8) AS easting, round(n, 8) AS northing FROM (SELECT kp_id, {_XY} FROM kp)")
def kp_geo(spark, d):
    return rounded(G.to_crs(X.key_points(spark, d), GT), "kp_id", "easting", "northing")


def _headers(spark, d, mon: bool) -> DataFrame:
    s = X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("pair_id"))
    k = F.col("pair_id").cast("double")
    gt = [F.lit(500000.0) + k * 10, F.lit(10.0) + k % 3, F.lit(0.0), F.lit(4000000.0) - k * 5, F.lit(0.0), -(F.lit(10.0) + k % 3)] if mon else [F.lit(500000.0), F.lit(10.0), F.lit(0.0), F.lit(4000000.0), F.lit(0.0), F.lit(-10.0)]
    return s.select("pair_id", F.array(*gt).alias("gt"), F.when(F.col("pair_id") % 4 != 0, F.lit("EPSG:32612")).alias("srs"))


_PRIOR = "+h AS (SELECT s_suppkey AS pair_id, (10+s_suppkey%3)/10.0::DOUBLE AS sx, s_suppkey*10/10.0::DOUBLE AS tx, (-s_suppkey*5)/(-10.0::DOUBLE) AS ty FROM supplier)"


@query(_PRIOR + " SELECT pair_id, round(sx, 8) AS m00, round(tx, 8) AS m02, round(sx, 8) AS m11, round(ty, 8) AS m12 FROM h")
def georef_prior(spark, d):
    h = G.prior(_headers(spark, d, True), _headers(spark, d, False))
    return rounded(h.select("pair_id", F.col("h")[0].alias("m00"), F.col("h")[2].alias("m02"), F.col("h")[4].alias("m11"), F.col("h")[5].alias("m12")))


@query(_PRIOR + " SELECT pair_id, 0.0::DOUBLE AS rotation, round(sx, 8) AS scale_x, round(sx, 8) AS scale_y, round(tx, 8) AS tx, round(ty, 8) AS ty, 0.0::DOUBLE AS perspective FROM h")
def homography_decompose(spark, d):
    return rounded(G.decomposed(G.prior(_headers(spark, d, True), _headers(spark, d, False))))


@query("SELECT s_suppkey AS pair_id, s_suppkey = 0 AS compatible FROM supplier")
def grid_compatible(spark, d):
    size = lambda h: h.withColumn("x_size", F.lit(200)).withColumn("y_size", F.lit(160))
    return G.compatible(size(_headers(spark, d, True)), size(_headers(spark, d, False)))


@query("SELECT DISTINCT CAST(trunc(x0) AS BIGINT) AS x, CAST(trunc(y0) AS BIGINT) AS y FROM kp")
def kp_mask(spark, d):
    return G.kp_mask(X.key_points(spark, d))


@query("SELECT CAST(trunc(x0) AS BIGINT) AS x, CAST(trunc(y0) AS BIGINT) AS y, round(max_by(dx, kp_id), 8) AS dx, round(max_by(dy, kp_id), 8) AS dy FROM kp GROUP BY 1, 2")
def kp_delta_raster(spark, d):
    return rounded(G.kp_delta(X.key_points(spark, d)))


@query(f"""SELECT kp_id, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || e || ',' || n || ']}},"properties":{{"score":' || score || '}}}}' AS feature FROM (SELECT kp_id, score, round(x0*10.0::DOUBLE+500000.0::DOUBLE, 8) AS e, round(4000000.0::DOUBLE-y0*10.0::DOUBLE, 8) AS n FROM kp)""")
def kp_geojson(spark, d):
    f = G.feature(X.key_points(spark, d), [500000.0, 10.0, 0.0, 4000000.0, 0.0, -10.0], ["score"])
    return f.select("kp_id", F.regexp_replace("feature", r"4\.0E6", "4000000.0").alias("feature")).select("kp_id", _plain_numbers("feature").alias("feature"))


def _plain_numbers(c: str):
    """Numbers of a million and more without an exponent, as SQL prints them."""
    m = F.regexp_extract(c, r",(\d)\.(\d+)E6\]", 1)
    frac = F.rpad(F.regexp_extract(c, r",(\d)\.(\d+)E6\]", 2), 6, "0")
    return F.when(m != "", F.concat(F.regexp_extract(c, r"^(.*,)\d\.\d+E6\]", 1), m, frac, F.lit(".0"), F.regexp_extract(c, r"E6(\].*)$", 1))).otherwise(F.col(c))


@query(f"""+v AS ({_PIX}), s AS (SELECT count(*) AS n, {_five('dx', 'dx')}, {_five('dy', '-dy')} FROM conf)
SELECT 'ref.tif mon.tif ' || valid_pixels || ' ' || n || ' 0.4 ' || {" || ' ' || ".join(f"printf('%.3f', {k}_{c})" for c in ('dx', 'dy') for k in ('min', 'max', 'median', 'mean', 'std'))} AS line FROM s, v""")
def stat_line(spark, d):
    return T.stat_line(signed(T.geometric(X.key_points(spark, d))), "ref.tif", "mon.tif", valid_pixels(spark, d), digits=3)


_NAMES = "+n AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'kp_mask.tif' WHEN 1 THEN 'kp_delta.json' WHEN 2 THEN 'kp_delta.tif' ELSE p_name || '.tif' END AS name FROM part)"


@query(_NAMES + " SELECT id, CASE WHEN contains(name, 'mask') THEN 'Mask (GeoTIFF)' WHEN ends_with(name, '.json') THEN 'Vector (GeoJSON)' ELSE 'Raster (GeoTIFF)' END AS kind FROM n", "")
def product_types(spark, d):
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, "kp_mask.tif").when(k == 1, "kp_delta.json").when(k == 2, "kp_delta.tif").otherwise(F.concat("p_name", F.lit(".tif")))
    return X.table(spark, d, "part").select(F.col("p_partkey").alias("id"), product_type(name).alias("kind"))


@query("SELECT p_partkey AS id, regexp_replace(regexp_replace(' ' || p_name || ' / ' || p_brand || '#', '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS name FROM part", "")
def safe_names(spark, d):
    return X.table(spark, d, "part").select(F.col("p_partkey").alias("id"), safe_name(F.concat(F.lit(" "), "p_name", F.lit(" / "), "p_brand", F.lit("#"))).alias("name"))


# --- kernels, which SQL has no form of


@query()
def klt_match(spark, d):
    """Key points that the tracker finds between the two images."""
    return rounded(M.match(pairs(spark, d), W, H, M.Settings(tile_size=256, max_corners=500, quality=0.05, min_distance=5, window=15, block=7, ksize=(3, 3))))


@query()
def phase_offset(spark, d):
    """The offset (row, column) of the monitored image by phase correlation."""
    return M.phase_offset(pairs(spark, d), W, H)


@query()
def homography_ransac(spark, d):
    """The homography that most matched points agree on."""
    return rounded(M.ransac(klt_match(spark, d)))


@query()
def ecc_refine(spark, d):
    """The refined homography and its correlation."""
    return rounded(M.ecc(pairs(spark, d), W, H))


@query()
def sift_match(spark, d):
    """Matches of scale-invariant features between the two images."""
    return rounded(M.sift_matches(pairs(spark, d), W, H))

