import json
import struct

import numpy as np
import pytest

from plumbline import cli
from plumbline.config import KLTConfiguration, ProcessingConfiguration, RuntimeConfiguration
from plumbline.errors import ConfigurationError, RasterError
from plumbline.kernels import images as I
from plumbline.plans import pipeline
from plumbline.operators import matching, profiles, raster, stats
from plumbline.sources import geotiff, tables
from plumbline.streaming.pairs import process_stream, stream_pairs

GT = [500000.0, 10.0, 0.0, 4000000.0, 0.0, -10.0]


def image(seed=1, size=180):
    base = I.correlate(np.random.default_rng(seed).normal(size=(size, size)), I.PYRAMID, I.PYRAMID)
    return (I.stretch(base).astype("uint16") + 1) * 20


@pytest.fixture
def pair(tmp_path):
    ref = image()
    geotiff.write(str(tmp_path / "ref.tif"), [ref], GT, 32612, 0)
    geotiff.write(str(tmp_path / "mon.tif"), [np.roll(ref, (3, 2), (0, 1))], GT, 32612, 0)
    return str(tmp_path / "mon.tif"), str(tmp_path / "ref.tif")


@pytest.fixture
def conf():
    c = ProcessingConfiguration()
    c.klt = KLTConfiguration(minDistance=5, blocksize=7, maxCorners=150, matching_winsize=15, qualityLevel=0.05, tile_size=180, laplacian_kernel_size=3)
    return c


def test_geotiff_round_trip(tmp_path):
    a = np.random.default_rng(0).integers(0, 60000, (70, 51)).astype("uint16")
    p = str(tmp_path / "a.tif")
    geotiff.write(p, [a], GT, 32612, 0)
    h = geotiff.Header.read(p)
    assert (h.gt, h.epsg, h.nodata, h.shape) == (GT, 32612, 0.0, (70, 51))
    assert (h.window(1, 5, 7, 20, 30) == a[7:37, 5:25]).all()
    with pytest.raises(RasterError):
        h.window(1, 40, 0, 20, 5)
    with pytest.raises(RasterError):
        geotiff.Header.read(str(tmp_path / "none.tif"))


def test_lzw():
    # clear, the bytes of "ABABABA", end: written by hand as 9-bit codes
    codes, bits = [256, 65, 66, 258, 260, 257], ""
    for c in codes:
        bits += f"{c:09b}"
    raw = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert geotiff.unlzw(raw) == b"ABABABA"


def test_source_reads_a_window(spark, pair):
    geotiff.register(spark)
    a = geotiff.Header.read(pair[1]).window(1, 0, 0, 180, 180)
    r = spark.read.format("geotiff").option("tile_size", 64)
    assert r.load(pair[1]).agg({"dn": "sum"}).first()[0] == a.sum()
    assert r.option("x_from", 10).option("x_to", 100).option("y_to", 70).load(pair[1]).agg({"dn": "sum"}).first()[0] == a[:70, 10:100].sum()
    assert spark.read.format("geotiff").option("mode", "meta").load(pair[1]).first()["epsg"] == 32612


def test_process(spark, pair, conf, tmp_path):
    vector = tmp_path / "mask.geojson"
    ring = [[500050, 3999950], [501750, 3999950], [501750, 3998250], [500050, 3998250], [500050, 3999950]]
    vector.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring]}}]}))
    dem = str(tmp_path / "dem.tif")
    geotiff.write(dem, [np.tile(np.arange(180, dtype="float32") * 5, (180, 1))], GT, 32612)
    run = RuntimeConfiguration(tmp_path / "out", True, True, True, no_values=[20], title_prefix="a test", dem_description="a ramp")
    flow = pipeline.Workflow(spark, conf, run)
    found, acc, made = flow.process(*pair, dem=dem, vector=str(vector))
    assert acc.row["n"] > 20 and abs(acc.row["median_dx"] - 2) < 0.1 and abs(acc.row["median_dy"] + 3) < 0.1
    assert acc.row["ce90"] == pytest.approx(np.hypot(2, 3) * 10, rel=0.05)
    d = json.loads((tmp_path / "out" / "kp_delta.json").read_text())
    assert d["crs"]["properties"]["name"].endswith("32612") and any(f["properties"]["zncc_score"] is not None for f in d["features"])
    assert {"kp_mask.tif", "kp_delta.tif", "kp_delta.json", "dem_dx.svg"} <= set(made)
    mask = geotiff.Header.read(geotiff.files(str(tmp_path / "out" / "kp_mask.tif"))[0]).window(1, 0, 0, 180, 180)
    kp = found.key_points.toPandas()
    assert mask.sum() == len(set(zip(kp["x0"], kp["y0"], strict=True)))
    assert (tmp_path / "out" / "report.html").exists() and (tmp_path / "out" / "chips" / "chips.csv").exists()
    assert len((tmp_path / "out" / "correl_res.txt").read_text().splitlines()) == 2
    out = tmp_path / "out"
    assert {"map_dx.svg", "map_theta.svg", "circular_error.svg", "dem_dx_boxes.svg", "mon_laplacian_k3_0_0_180_180.tif", "ref_laplacian_k3_0_0_180_180.tif"} <= set(made)
    assert geotiff.Header.read(str(out / "ref_laplacian_k3_0_0_180_180.tif")).shape == (180, 180)
    assert "kp_mask.tif" in (out / "products.html").read_text() and (out / "chips.html").read_text().count("data-zncc") > 3
    assert (out / "circular_error.svg").read_text().count("<ellipse") == 2 and "chips.html" in (out / "report.html").read_text()
    again = pipeline.Workflow(spark, conf, run).match(*pair, resume=True)
    assert again.key_points.count() == found.key_points.count()


def test_large_shift(spark, conf, tmp_path):
    ref = image(2)
    geotiff.write(str(tmp_path / "r.tif"), [ref], GT, 32612)
    geotiff.write(str(tmp_path / "m.tif"), [np.roll(ref, (30, -25), (0, 1))], GT, 32612)
    flow = pipeline.Workflow(spark, conf, RuntimeConfiguration(tmp_path / "o", enable_large_shift_detection=True))
    kp = flow.match(str(tmp_path / "m.tif"), str(tmp_path / "r.tif")).key_points.toPandas()
    assert abs(kp["dx"].median() + 25) < 0.2 and abs(kp["dy"].median() - 30) < 0.2
    moved = geotiff.Header.read(geotiff.files(str(tmp_path / "o" / "m_shifted.tif"))[0])
    assert moved.dtype == np.uint16 and (moved.window(1, 30, 40, 60, 60) == ref[40:100, 30:90]).all()
    assert kp["radial_error"].median() < 1 and kp["zncc_score"].isna().all()


def test_grids_must_fit(spark, pair, conf, tmp_path):
    other = str(tmp_path / "other.tif")
    geotiff.write(other, [image(3)], [0, 10, 0, 0, 0, -10], 32612)
    with pytest.raises(RasterError):
        pipeline.Workflow(spark, conf, RuntimeConfiguration(tmp_path / "o")).match(pair[0], other)


def test_align(pair, tmp_path):
    got = pipeline.align(*pair, str(tmp_path / "aligned"))
    h = np.array(got["matrix"])
    assert abs(h[0, 2] - 2) < 0.3 and abs(h[1, 2] - 3) < 0.3 and got["files"]
    assert cli.main(["align", *pair, "--out", str(tmp_path / "b"), "--no-log-file"]) == 0
    assert cli.main(["align", "none.tif", pair[1], "--out", str(tmp_path / "c"), "--no-log-file"]) == 1


def test_resolution(spark, tmp_path):
    def one(name, gt, epsg):
        geotiff.write(str(tmp_path / name), [np.zeros((3, 3), "uint8")], gt, epsg)
        return pipeline.Image(geotiff.Header.read(str(tmp_path / name)), None)

    geo, flat = one("g.tif", GT, 32612), one("f.tif", None, None)
    assert pipeline.resolution(geo, geo) == 10 and pipeline.resolution(geo, geo, 5) == 10
    assert pipeline.resolution(flat, flat, 15) == 15 and pipeline.resolution(flat, flat) is None


def test_configuration(tmp_path):
    with pytest.raises(ConfigurationError):
        ProcessingConfiguration.from_file(tmp_path / "none.json")
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(ConfigurationError):
        ProcessingConfiguration.from_file(tmp_path / "bad.json")
    with pytest.raises(ConfigurationError):
        ProcessingConfiguration.from_dict({"processing_configuration": {}})
    d = ProcessingConfiguration().to_dict()
    d["processing_configuration"]["klt_matching"]["laplacian_kernel_size"] = {"mon": 3, "ref": 5}
    d["processing_configuration"]["input_products"] = {"not": "read"}
    c = ProcessingConfiguration.from_dict(d)
    assert c.klt.settings().ksize == (3, 5)
    d["processing_configuration"]["klt_matching"]["laplacian_kernel_size"] = "auto"
    assert ProcessingConfiguration.from_dict(d).klt.settings().ksize == "auto"
    d["processing_configuration"]["klt_matching"]["unknown"] = 1
    with pytest.raises(ConfigurationError):
        ProcessingConfiguration.from_dict(d)
    with pytest.raises(ValueError):
        RuntimeConfiguration("x", title_prefix="t" * 27).check()


def test_stream_of_pairs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"pair_id": "1", "monitored": "m", "reference": "r"}\n{"pair_id": "2", "monitored": "m", "reference": "r"}\n')
    seen = []
    run = lambda: process_stream(stream_pairs(spark, str(tmp_path / "in")), lambda i, m, r: seen.append(i), str(tmp_path / "ck")).awaitTermination()
    run()
    run()
    assert sorted(seen) == ["1", "2"]


def test_shapefile(tmp_path):
    ring = [(1.0, 2.0), (5.0, 2.0), (5.0, 6.0), (1.0, 2.0)]
    body = struct.pack("<I4dII", 5, 1, 2, 5, 6, 1, len(ring)) + struct.pack("<I", 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    (tmp_path / "a.shp").write_bytes(b"\0" * 100 + struct.pack(">II", 1, len(body) // 2) + body)
    assert tables.polygons(str(tmp_path / "a.shp")) == [[ring[:-1]]]
    (tmp_path / "b.shp").write_bytes(b"\0" * 100)
    with pytest.raises(RasterError):
        tables.polygons(str(tmp_path / "b.shp"))


def test_broken_vector_layer(tmp_path):
    (tmp_path / "x.geojson").write_text("no json")
    with pytest.raises(RasterError):
        tables.polygons(str(tmp_path / "x.geojson"))


def test_holes_are_not_filled(spark, tmp_path):
    outer, hole = [[1, 1], [9, 1], [9, 9], [1, 9], [1, 1]], [[3, 3], [7, 3], [7, 7], [3, 7], [3, 3]]
    (tmp_path / "h.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [outer, hole]}}]}))
    grid = spark.range(100).selectExpr("id % 10 as x", "id div 10 as y")
    got = {(r["x"], r["y"]): r["m"] for r in raster.rasterized(grid, tables.polygons(str(tmp_path / "h.geojson"))).collect()}
    assert got[(1, 1)] == got[(2, 5)] == 1 and got[(4, 4)] == got[(5, 5)] == got[(6, 6)] == 0 and got[(0, 0)] == 0


def test_required_columns_and_exports(spark):
    import plumbline

    assert plumbline.Workflow.__name__ == "Workflow" and plumbline.RuntimeConfiguration
    with pytest.raises(ValueError, match="score"):
        stats.geometric(spark.createDataFrame([(1.0, 2.0)], "dx double, dy double"))


def test_what_most_tiles_settled_on(spark, conf, tmp_path):
    row = "tile_x int, tile_y int, mon_k int, ref_k int, polarity string"
    votes = [(0, 0, 3, 5, "normal")] * 9 + [(1, 0, 7, 5, "inverted"), (0, 1, 7, 5, "inverted"), (1, 1, 3, 5, "inverted")]
    assert matching.settled(spark.createDataFrame(votes, row)) == ((3, 5), True)  # a tile has one vote; of equal ones the first tile's
    assert matching.settled(spark.createDataFrame([], row)) is None
    conf.klt.laplacian_kernel_size, conf.klt.laplacian_invert_polarity = "auto", "auto"
    flow = pipeline.Workflow(spark, conf, RuntimeConfiguration(tmp_path / "o"))
    klt = lambda *chosen: flow.resolved(pipeline.Match(None, None, None, None, ksize=chosen[0], inverted=chosen[1]))["processing_configuration"]["klt_matching"]
    assert klt((3, 5), True)["laplacian_kernel_size"] == {"mon": 3, "ref": 5} and klt((3, 5), True)["laplacian_invert_polarity"] is True
    assert klt(None, None)["laplacian_kernel_size"] == "auto"


def test_profiles_know_their_directions(spark):
    with pytest.raises(ValueError, match="dz"):
        profiles.shift_profile(spark.range(0), "dz", "col", 20)
