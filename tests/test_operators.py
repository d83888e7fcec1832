import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.expressions import cents, decimals
from plumbline.functions.ranking import quantile_type4
from plumbline.operators import descriptors, geo, keypoints, profiles, raster, selection, similarity, stats


def kps(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "kp_id long, x0 double, y0 double, dx double, dy double, score double")


def test_dn_filter_facts(spark):
    kp = kps(spark, [(k, k, 0, 0, 1) for k in range(1, 5)])
    grid = [(x, y, 5) for x in range(10) for y in range(10)]
    ref = spark.createDataFrame([(x, y, 0 if (x, y) in ((2, 2), (4, 4)) else v) for x, y, v in grid], "x long, y long, dn long")
    mon = spark.createDataFrame([(x, y, 0 if (x, y) in ((1, 1), (2, 2)) else v) for x, y, v in grid], "x long, y long, dn long")
    full = spark.createDataFrame(grid, "x long, y long, dn long")
    at = lambda df: sorted(int(r["x0"]) for r in df.collect())
    assert at(keypoints.without_values(kp, ref, full, [0])) == [1, 3]
    assert at(keypoints.without_values(kp, ref, mon, [0])) == [3]
    assert at(keypoints.without_values(kp, full, mon, [0])) == [3, 4]
    assert at(keypoints.without_values(kp, ref, mon, None)) == at(keypoints.without_values(kp, ref, mon, [])) == [1, 2, 3, 4]
    assert at(keypoints.without_values(kp, ref, full, None, ref_nodata=0)) == [1, 3]


@pytest.mark.parametrize("n", [0, 1, 2, 7, 40])
@pytest.mark.parametrize("p", [0.02, 0.5, 0.9, 1.0])
def test_quantile(spark, n, p):
    v = np.round(np.random.default_rng(n).normal(size=n), 1).tolist()
    got = quantile_type4(spark.createDataFrame([(x,) for x in [*v, None]], "v double"), "v", p).first()["q"]
    if not n:
        assert got is None
        return
    s, at = sorted(v), p * n
    k = int(at)
    want = s[0] if k < 1 else s[-1] if k >= n else s[k - 1] + (at - k) * (s[k] - s[k - 1])
    assert got == pytest.approx(want)


def test_empty_tables_give_rows_without_values(spark):
    kp = kps(spark, [])
    assert stats.geometric(kp).first()["n"] == 0
    assert stats.circular_error(kp, 0.9).first()["ce"] is None
    assert stats.histogram(kp, "dx").count() == 0
    assert keypoints.without_outliers(kp).count() == 0
    assert selection.select(kp, 100, 100).count() == 0
    assert profiles.std_band(profiles.mean_profile(kp, "dx", "x0", 20)).count() == 0


def test_threshold_is_strict_for_statistics_only(spark):
    kp = kps(spark, [(0, 0, 1, 1, 0.4), (0, 0, 1, 1, 0.5)])
    assert keypoints.confident(kp, 0.4).count() == 1
    assert keypoints.candidates(kp, 0.4).count() == 2
    assert keypoints.confident(kp, None).count() == 2


def test_outliers(spark):
    same = kps(spark, [(0, 0, 1, 1, 1)] * 4)
    assert keypoints.without_outliers(same).count() == 0
    rng = np.random.default_rng(1)
    some = kps(spark, [(0, 0, *rng.normal(size=2), 1) for _ in range(100)] + [(0, 0, 90, 0, 1)])
    left = keypoints.without_outliers(some)
    assert 90 < left.count() < 101 and left.agg(F.max("dx")).first()[0] < 20


def test_profile_of_one_bin_has_no_band(spark):
    p = profiles.std_band(profiles.mean_profile(kps(spark, [(1, 1, 2, 0, 1), (2, 1, 4, 0, 1)]), "dx", "x0", 20)).first()
    assert (p["pos"], p["n"], p["mean"], p["lo"]) == (10, 2, 3.0, None)


def test_point_on_the_right_edge_is_in_two_quarters(spark):
    kp = kps(spark, [(50, 50, 0, 0, 1), (100, 30, 0, 0, 1)])
    q = selection.quarters(kp, 100, 100, 1).collect()
    assert sorted((r["quarter"], r["kp_id"]) for r in q) == [(1, 1), (3, 1)]


def test_ties_go_to_the_higher_score(spark):
    kp = kps(spark, [(4, 5, 0, 0, 0.2), (6, 5, 0, 0, 0.9)])
    assert selection.centres(kp, 10, 10, 1).first()["kp_id"] == 1


def test_shift_gold(spark):
    px = spark.createDataFrame([(x, y, 3 * y + x + 1) for x in range(3) for y in range(3)], "x long, y long, dn long")
    got = np.zeros((3, 3), int)
    for r in raster.shifted(px, 1, 1).collect():
        got[r["y"], r["x"]] = r["dn"]
    assert got.tolist() == [[5, 6, 0], [8, 9, 0], [0, 0, 0]]


def test_patch_scores_by_brute_force(spark):
    rng = np.random.default_rng(5)
    ref = rng.integers(0, 200, (150, 140))
    mon = rng.integers(0, 200, (150, 140))
    pairs = spark.createDataFrame([(x, y, int(ref[y, x]), int(mon[y, x])) for x in range(140) for y in range(150)], "x long, y long, ref long, mon long")
    kp = kps(spark, [(60, 60, 1, 1, 1), (110, 100, 0.5, 1.5, 1), (139, 60, 0, 0, 1), (60, 70, 0, 0, 0.1)])
    got = {r["kp_id"]: r for r in similarity.patch_scores(kp, pairs, 140, 150, 0.4, size=64).collect()}
    for i, (x, y, u, v) in enumerate([(60, 60, 61, 61), (110, 100, 110, 102)]):
        cut = lambda im, a, b, h: im[b - h : b + h + 1, a - h : a + h + 1]
        assert got[i]["zncc"] == pytest.approx(similarity.zncc(cut(ref, x, y, 21), cut(mon, u, v, 21)))
        assert got[i]["nmi_sum"] == pytest.approx(similarity.nmi_sum(cut(ref, x, y, 28), cut(mon, u, v, 28)))
    assert got[2]["zncc"] is None and got[3]["zncc"] is None


def test_nearest_by_brute_force(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    q, t = df.where("vec_id % 2 = 0"), df.where("vec_id % 2 = 1")
    got = {(r["q"], r["rank"]): (r["t"], r["dist"]) for r in descriptors.nearest(q, t, 2, block=7).collect()}
    for i in range(0, 60, 2):
        d = sorted((np.linalg.norm(v[i] - v[j]), j) for j in range(1, 60, 2))
        for k in (0, 1):
            assert got[i, k + 1][0] == d[k][1] and got[i, k + 1][1] == pytest.approx(d[k][0])


def test_features_write_nan_as_null(spark):
    kp = kps(spark, [(1, 2, float("nan"), 1, 1)]).withColumn("radial_error", F.lit(2.0))
    f = geo.feature(kp, [0.0, 1.0, 0.0, 0.0, 0.0, -1.0], ["dx", "radial_error"]).first()["feature"]
    assert '"dx":null' in f and '"radial error":2.0' in f and '"coordinates":[1.0,-2.0]' in f


def test_compatible_without_a_reference_system(spark):
    h = spark.createDataFrame([(1, [0.0, 1.0, 0.0, 0.0, 0.0, -1.0], None, 5, 5)], "pair_id long, gt array<double>, srs string, x_size int, y_size int")
    assert geo.compatible(h, h).first()["compatible"]
    assert not geo.compatible(h, h.withColumn("x_size", F.lit(6))).first()["compatible"]


def test_two_decimals_of_the_value_itself(spark):
    rng = np.random.default_rng(3)
    some = [107.505, 0.125, 0.375, 0.005, 1.005, 2.675, -2.675, -0.001, 0.0, 1e6 + 0.015, 0.995, 99.995, *(rng.integers(-40_000, 40_000, 3000) / 200).tolist(), *rng.normal(0, 50, 500).tolist()]
    df = spark.createDataFrame([(v,) for v in some], "v double").select("v", F.format_string("%.2f", cents("v")).alias("shown"))
    for r in df.collect():
        assert r["shown"] == f"{r['v']:.2f}", r["v"]


def test_patch_sums_never_broadcast_windows(spark):
    rng = np.random.default_rng(4)
    dn = rng.integers(0, 200, (12, 15))
    px = spark.createDataFrame([(x, y, int(dn[y, x])) for x in range(15) for y in range(12)], "x long, y long, dn long")
    places = [(5, 5), (5, 5), (0, 0), (14, 11), (7.9, 3.2), (-2, 4), (40, 40)]
    got = similarity.patch_sums(kps(spark, [(x, y, 0, 0, 1) for x, y in places]), px, 2)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    cut = [dn[max(int(y) - 2, 0) : max(int(y) + 3, 0), max(int(x) - 2, 0) : max(int(x) + 3, 0)] for x, y in places]
    assert {r["kp_id"]: (r["n"], r["total"]) for r in got.collect()} == {i: (c.size, c.sum()) for i, c in enumerate(cut) if c.size}
    chip = similarity.chips(kps(spark, [(x, y, 0, 0, 1) for x, y in places]), px, 2)
    assert "Broadcast" not in chip._jdf.queryExecution().executedPlan().toString()
    assert {r["kp_id"]: r["chip"] for r in chip.collect()} == {i: c.ravel().tolist() for i, c in enumerate(cut) if c.size == 25}


def test_zero_keeps_its_sign(spark):
    some = [-0.0, 0.0, -1e-12, -0.0004, 0.0004, -0.6365, -0.6375, 12.0005, 0.0625, 1.0005, 107.505]
    df = spark.createDataFrame([(v,) for v in some], "v double").select("v", *[F.format_string(f"%.{k}f", decimals("v", k)).alias(f"d{k}") for k in (2, 3)])
    for r in df.collect():
        assert (r["d2"], r["d3"]) == (f"{r['v']:.2f}", f"{r['v']:.3f}"), r["v"]


@pytest.mark.parametrize("name", ["stat_block", "stat_line"])
def test_statistics_print_a_northing_of_zero_as_sql(spark, data, tmp_path, name):
    import duckdb

    from plumbline.plans import catalog

    zero = [i for i in range(6611) if (i * 53) % 601 == 300 and (i * 29) % 11 > 4]  # no shift to the north
    events = [(i, 34.54) for i in [*zero[:3], zero[0] + 11]]
    spark.createDataFrame(events, "event_id long, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    spark.read.parquet(f"{data}/part.parquet").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    for t in ("events", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = sorted(tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect())
    assert got == sorted(con.sql(catalog.ORACLES[name]).fetchall()) and "-0.0" in str(got)


def test_patch_scores_are_dealt_over_groups(spark):
    rng = np.random.default_rng(6)
    ref, mon = rng.integers(0, 200, (2, 150, 140))
    pairs = spark.createDataFrame([(x, y, int(ref[y, x]), int(mon[y, x])) for x in range(140) for y in range(150)], "x long, y long, ref long, mon long")
    kp = [(x, y, dx, dy, s) for x in (30, 60, 100) for y in (30, 70, 115) for dx, dy, s in ((0, 0, 1), (40, -40, 1), (-70, 80, 0.5), (2, 1, 0.1))] * 3
    seen = set()
    got = {r["kp_id"]: r for r in similarity.patch_scores(kps(spark, kp), pairs, 140, 150, 0.4, size=64, most=2).collect()}
    assert len(got) == len(kp)
    for i, (x, y, dx, dy, s) in enumerate(kp):
        u, v = x + dx, y + dy
        if s >= 0.4 and 28 <= u < 112 and 28 <= v < 122 and 28 <= x < 112 and 28 <= y < 122:
            cut = lambda im, a, b, h: im[b - h : b + h + 1, a - h : a + h + 1]
            seen.add((x, y))
            assert got[i]["zncc"] == pytest.approx(similarity.zncc(cut(ref, x, y, 21), cut(mon, u, v, 21)))
            assert got[i]["nmi_sum"] == pytest.approx(similarity.nmi_sum(cut(ref, x, y, 28), cut(mon, u, v, 28)))
            assert got[i]["nmi_studholme"] == pytest.approx(similarity.nmi_studholme(cut(ref, x, y, 28), cut(mon, u, v, 28)))
        else:
            assert got[i]["zncc"] is None and got[i]["nmi_sum"] is None
    assert len(seen) > 3


def test_nearest_of_many_equal_vectors_are_the_least_ids(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(4, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v[i * 7 % 4]]) for i in range(120)], "vec_id long, embedding array<float>")
    q, t = df.where("vec_id % 2 = 0"), df.where("vec_id % 2 = 1")
    near = descriptors.nearest(q, t, 2, block=16)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Broadcast" not in plan
    got = {(r["q"], r["rank"]): r["t"] for r in near.collect()}
    f = v.astype(float)
    for i in range(0, 120, 2):
        d = sorted((np.linalg.norm(f[i * 7 % 4] - f[j * 7 % 4]), j) for j in range(1, 120, 2))
        assert (got[i, 1], got[i, 2]) == (d[0][1], d[1][1])
