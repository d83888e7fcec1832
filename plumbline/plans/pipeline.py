"""The whole workflow: match a pair, measure its accuracy, write reports and products; align a pair."""

from __future__ import annotations

import json
import logging
from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ProcessingConfiguration, RuntimeConfiguration
from ..errors import RasterError
from ..functions.expressions import product_type
from ..kernels import alignment as A
from ..kernels import images as I
from ..operators import geo, keypoints, matching, profiles, raster, selection, similarity, stats
from ..sources import geotiff, tables
from . import report

log = logging.getLogger(__name__)


@dataclass
class Image:
    """A raster: its header, and its pixels (x, y, dn) as a table."""

    header: geotiff.Header
    pixels: DataFrame

    @classmethod
    def open(cls, spark: SparkSession, path: str, tile_size: int = 1024) -> Image:
        geotiff.register(spark)
        px = spark.read.format("geotiff").option("tile_size", tile_size).load(str(path)).select("x", "y", "dn")
        return cls(geotiff.Header.read(str(path)), px)

    @property
    def name(self) -> str:
        return Path(self.header.path).stem

    @property
    def width(self) -> int:
        return self.header.shape[1]

    @property
    def height(self) -> int:
        return self.header.shape[0]

    def fits(self, other: Image) -> bool:
        """The same reference system, or none, the same geotransform and size."""
        a, b = self.header, other.header
        return a.epsg == b.epsg and a.gt == b.gt and a.shape == b.shape

    def array(self) -> np.ndarray:
        return self.header.window(1, 0, 0, self.width, self.height)


def resolution(mon: Image, ref: Image, default: float | None = None) -> float | None:
    """The monitored pixel size where there is a reference system, else the given one."""
    return mon.header.gt[1] if mon.header.epsg is not None and mon.header.gt else default


@dataclass
class Match:
    monitored: Image
    reference: Image
    key_points: DataFrame
    mask: DataFrame | None
    shift: tuple[float, float] | None = None  # (x, y) of a large shift that was taken out
    written: list[str] = field(default_factory=list)
    tiles: DataFrame | None = None  # raw key points with the choices of their tiles
    ksize: tuple[int, int] | None = None  # (monitored, reference), as most tiles have it; None if no tile has a key point
    inverted: bool | None = None


@dataclass
class Accuracy:
    row: dict
    valid_pixels: int
    total_pixels: int


class Workflow:
    """Steps on pairs of images. It keeps nothing between pairs but its configuration."""

    def __init__(self, spark: SparkSession, processing: ProcessingConfiguration, runtime: RuntimeConfiguration):
        self.spark, self.processing, self.runtime = spark, processing, runtime
        self.out = Path(runtime.output_directory)
        if self.out.exists():
            log.warning("%s exists", self.out)
        self.out.mkdir(parents=True, exist_ok=True)

    def _mask(self, mon: Image, mask: str | None, vector: str | None) -> DataFrame | None:
        found = []
        if mask:
            m = Image.open(self.spark, mask)
            if not m.fits(mon):
                raise RasterError(f"{mask} does not share the grid of {mon.header.path}")
            found.append(m.pixels.select("x", "y", (F.col("dn") != 0).cast("int").alias("m")))
        if vector:
            gt = mon.header.gt or [0, 1, 0, 0, 0, 1]
            found.append(raster.rasterized(mon.pixels, [[tables.to_pixels(r, gt) for r in p] for p in tables.polygons(vector)]))
        if len(found) == 2:
            a, b = found
            return a.join(b.withColumnRenamed("m", "_b"), ["x", "y"]).select("x", "y", (F.col("m") * F.col("_b")).alias("m"))
        return found[0] if found else None

    def _csv(self, mon: Image, ref: Image) -> str:
        return str(self.out / f"KLT_matcher_{mon.name}_{ref.name}.csv")

    def _stored(self, path: str) -> bool:
        """Whether a path is there in the file system that Spark writes to."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _sink(self, df: DataFrame, grid: Image, name: str, kind: str, nodata: float | None) -> None:
        """A table of pixels as a raster on an image's grid; the values keep their type."""
        w = df.coalesce(1).write.format("geotiff").mode("append").option("width", grid.width).option("height", grid.height).option("dtype", kind)
        gt, epsg = grid.header.gt, grid.header.epsg
        for k, v in (("gt", ",".join(map(str, gt)) if gt else None), ("epsg", epsg), ("nodata", nodata)):
            w = w.option(k, v) if v is not None else w
        w.save(str(self.out / name))

    def match(self, monitored: str, reference: str, mask: str | None = None, vector: str | None = None, resume: bool = False) -> Match:
        """Key points of a pair. resume takes those of an earlier run's file if it is there."""
        mon, ref = Image.open(self.spark, monitored), Image.open(self.spark, reference)
        if not mon.fits(ref):
            raise RasterError("the images do not share a grid")
        for what, image in (("monitored", mon), ("reference", ref)):
            low, high = image.pixels.where("not isnan(cast(dn as double))").agg(F.percentile("dn", [0.02, 0.98]).alias("p")).first()["p"] or (0, 0)
            if high - low <= 10:
                log.warning("low dynamic range of the %s image: results can be poor", what)
        r, klt = self.runtime, self.processing.klt
        m = self._mask(mon, mask, vector)
        pairs = raster.zipped(ref.pixels, mon.pixels)
        shift = None
        if r.enable_large_shift_detection:
            o = matching.phase_offset(pairs, mon.width, mon.height)
            got = keypoints.thresholded_offsets(o.select(F.col("row_off").cast("double"), F.col("col_off").cast("double")), self.processing.shift.bias_correction_min_threshold).first()
            if got["applied"]:
                shift = (got["col_off"], got["row_off"])
                moved = raster.shifted(mon.pixels, int(shift[0]), int(shift[1]))
                self._sink(moved, mon, f"{mon.name}_shifted.tif", mon.header.dtype.newbyteorder("=").name, mon.header.nodata)
                pairs = raster.zipped(ref.pixels, moved)
        path = self._csv(mon, ref)
        raw = f"{path}.tiles"
        if not (resume and self._stored(path)):
            kp = matching.match(pairs, mon.width, mon.height, klt.settings(), m, ref.header.nodata, mon.header.nodata, (ref.header.dtype.name, mon.header.dtype.name))
            kp.write.mode("overwrite").parquet(raw)  # tiles are matched once: scores, file and choices read this
            kp = keypoints.enrich(self.spark.read.parquet(raw).withColumn("kp_id", F.xxhash64("x0", "y0")))
            if shift is None:
                t = self.processing.accuracy.confidence_threshold
                scores = similarity.patch_scores(kp, pairs, mon.width, mon.height, t)
                kp = kp.join(scores.select("kp_id", F.col("zncc").alias("zncc_score"), F.col("nmi_studholme").alias("mutual_info_score"), F.col("nmi_sum").alias("mi_score")), "kp_id", "left")
            tables.write_key_points(kp, path)
        kp = tables.read_key_points(self.spark, path)
        if shift is not None:
            kp = keypoints.corrected(kp, *shift)
        kp = keypoints.without_values(kp, ref.pixels, mon.pixels, r.no_values, ref.header.nodata if r.no_values is not None else None, mon.header.nodata if r.no_values is not None else None)
        tiles = self.spark.read.parquet(raw) if self._stored(raw) else None
        chosen = matching.settled(tiles) if tiles is not None else None
        fixed = klt.settings()
        ksize = fixed.ksize if fixed.ksize != "auto" else chosen and chosen[0]
        inverted = fixed.invert if fixed.invert != "auto" else chosen and chosen[1]
        return Match(mon, ref, kp, m, shift, [path], tiles, ksize, inverted)

    def resolved(self, found: Match) -> dict:
        """The configuration with what an automatic search settled on in place of `auto`."""
        got = self.processing.to_dict()
        klt = got["processing_configuration"]["klt_matching"]
        if klt["laplacian_kernel_size"] == "auto" and found.ksize is not None:
            klt["laplacian_kernel_size"] = dict(zip(("mon", "ref"), found.ksize, strict=True))
        if klt["laplacian_invert_polarity"] == "auto" and found.inverted is not None:
            klt["laplacian_invert_polarity"] = found.inverted
        return got

    def accuracy(self, found: Match) -> Accuracy:
        """Statistics of confident points; a line is added to correl_res.txt."""
        factor = resolution(found.monitored, found.reference, self.runtime.pixel_size) or 1.0
        t = self.processing.accuracy.confidence_threshold
        mask = found.mask if found.mask is not None else self.spark.createDataFrame([], "x long, y long, m int")
        valid = raster.valid_count(found.monitored.pixels, mask)
        up = found.reference.header.epsg is not None  # northing grows upwards where there is a reference system
        row = stats.accuracy(found.key_points, t, factor, up).first().asDict()
        px = valid.first()
        line = stats.stat_line(stats.geometric(found.key_points, t, up), found.reference.name, found.monitored.name, valid, t, None).first()["line"]
        path = self.out / "correl_res.txt"
        head = "" if path.exists() else "refImg secImg total_valid_pixel sample_pixel confidence_th " + " ".join(f"{k}_{c}" for c in "xy" for k in ("min", "max", "median", "mean", "std")) + "\n"
        with path.open("a", encoding="utf-8") as f:
            f.write(head + line + "\n")
        return Accuracy(row, px["valid_pixels"], px["total_pixels"])

    def products(self, found: Match) -> list[str]:
        """Masks and displacements as rasters if asked for, and GeoJSON where the reference has a known system."""
        r, ref, out = self.runtime, found.reference, []
        gt, epsg = ref.header.gt, ref.header.epsg

        def sink(df: DataFrame, name: str, kind: str, nodata: float | None) -> None:
            self._sink(df, ref, name, kind, nodata)
            out.append(name)

        if r.gen_kp_mask:
            sink(geo.kp_mask(found.key_points).withColumn("m", F.lit(1)), "kp_mask.tif", "uint8", None)
        if r.gen_delta_raster:
            sink(geo.kp_delta(found.key_points), "kp_delta.tif", "float32", float("nan"))
            if found.tiles is not None:
                mon = found.monitored.header
                if found.shift is not None:
                    mon = geotiff.Header.read(geotiff.files(str(self.out / f"{found.monitored.name}_shifted.tif"))[0])
                names = matching.write_laplacians(matching.tile_choices(found.tiles), ref.header, mon, self.processing.klt.tile_size, str(self.out.resolve()))
                out += sorted(r["name"] for r in names.collect())
        if epsg is not None and gt:
            columns = ["dx", "dy", "score", "radial_error", "angle", "zncc_score", "mutual_info_score"]
            features = [x["feature"] for x in geo.feature(found.key_points, gt, columns).orderBy("kp_id").toLocalIterator()]
            crs = {"type": "name", "properties": {"name": f"urn:ogc:def:crs:EPSG::{epsg}"}}
            with (self.out / "kp_delta.json").open("w", encoding="utf-8") as f:
                f.write(f'{{"type": "FeatureCollection", "crs": {json.dumps(crs)}, "features": [\n')
                f.writelines(("" if k == 0 else ",\n") + x for k, x in enumerate(features))
                f.write("\n]}\n")
            out.append("kp_delta.json")
        return out

    def chips(self, found: Match) -> list[str]:
        """Windows of both images, and of their Laplacians, around points spread over the image; chips.csv names them."""
        t = self.processing.accuracy.confidence_threshold
        kp = keypoints.candidates(found.key_points, t)
        picked = selection.select(kp, found.monitored.width, found.monitored.height).select("kp_id").distinct()
        pts = kp.join(F.broadcast(picked), "kp_id").toPandas()  # at most five for each of 25 cells
        half, out = keypoints.HALF_CHIP, []
        for name, image in (("REF", found.reference), ("MON", found.monitored)):
            (self.out / "chips" / name).mkdir(parents=True, exist_ok=True)
            for p in pts.itertuples(index=False):
                x, y = (int(p.x0), int(p.y0)) if name == "REF" else (round(p.x0 + p.dx), round(p.y0 + p.dy))
                if min(x, y) < half or x >= image.width - half or y >= image.height - half:
                    continue
                v = image.header.window(1, x - half, y - half, 2 * half + 1, 2 * half + 1)
                stem = self.out / "chips" / name / f"{name}_{int(p.x0)}_{int(p.y0)}"
                gt = image.header.gt
                at = [gt[0] + (x - half) * gt[1], gt[1], 0, gt[3] + (y - half) * gt[5], 0, gt[5]] if gt else None
                geotiff.write(f"{stem}.tif", [v], at, image.header.epsg, image.header.nodata)
                report.png(f"{stem}.png", I.stretch(v))
                if found.ksize is not None:
                    report.png(f"{stem}_laplacian.png", I.laplacian(I.stretch(v), found.ksize[0 if name == "MON" else 1]))
                out.append(f"{stem}.tif")
            report.vrt(self.out / "chips" / name / "chips.vrt", sorted(p for p in out if Path(p).parent.name == name))
        names = [c.split(" double")[0].strip("`") for c in tables.KEY_POINTS.split(", ")]
        pts.rename(columns={"radial_error": "radial error"}).reindex(columns=names).to_csv(self.out / "chips" / "chips.csv", sep=";", index=False)
        files = [(f"chips/REF/{Path(p).stem}.png",) for p in out if Path(p).parent.name == "REF" and (self.out / "chips" / "MON" / f"MON_{Path(p).stem[4:]}.tif").exists()]
        facts = self.spark.createDataFrame([(int(p.kp_id), float(p.x0), float(p.y0), float(p.dx), float(p.dy), float(p.score)) for p in pts.itertuples(index=False)], "kp_id long, x0 double, y0 double, dx double, dy double, score double")
        cards = selection.chip_cards(self.spark.createDataFrame(files, "path string"), facts).toPandas().rename(columns={"path": "name"})
        scores = pts.assign(x=pts["x0"].astype(int), y=pts["y0"].astype(int), zncc=pts["zncc_score"].astype(float), nmi=pts["mutual_info_score"].astype(float)).drop_duplicates(["x", "y"])
        report.chips_page(self.out / "chips.html", "Chips", cards.merge(scores[["x", "y", "zncc", "nmi"]], on=["x", "y"], how="left"))
        return out

    def reports(self, found: Match, acc: Accuracy, dem: str | None = None) -> list[str]:
        """Plot tables as SVG, and an HTML summary."""
        kp, t = found.key_points, self.processing.accuracy.confidence_threshold
        c = keypoints.confident(kp, t)
        figures = {}
        for d in ("dx", "dy"):
            for axis in ("col", "row"):
                figures[f"{d}_by_{axis}"] = profiles.shift_profile(c, d, axis, self.processing.shift_plot.histo_mean_bin_size)
            figures[f"hist_{d}"] = stats.histogram(c, d).select(F.col("lo").alias("pos"), F.col("n").alias("mean"))
        figures["ce"] = stats.radial_cdf(c).select(F.col("pct").alias("pos"), F.col("r").alias("mean")).where(F.pmod("i", F.greatest(F.lit(1), F.floor(F.lit(acc.row["n"] or 0) / 1000))) == 0)
        boxes = {}
        if dem:
            e = Image.open(self.spark, dem)
            if not e.fits(found.reference):
                raise RasterError(f"{dem} does not share the reference's grid")
            at = c.withColumn("x", F.col("x0").cast("long")).withColumn("y", F.col("y0").cast("long")).join(e.pixels.withColumnRenamed("dn", "alt"), ["x", "y"])
            for d in ("dx", "dy", "radial_error"):
                figures[f"dem_{d}"] = profiles.std_band(profiles.by_altitude(at, d, self.processing.dem_plot.histo_mean_bin_size))
                boxes[f"dem_{d}_boxes"] = profiles.boxes(at, d, "alt", self.processing.dem_plot.histo_mean_bin_size)
        out = self._overview(found, c, acc)
        for k, df in boxes.items():
            report.box_chart(self.out / f"{k}.svg", f"{self.runtime.title_prefix or ''} {k}".strip(), df.orderBy("pos").toPandas())
            out.append(f"{k}.svg")
        for k, df in figures.items():
            rows = df.orderBy("pos").toPandas()
            report.line_chart(self.out / f"{k}.svg", f"{self.runtime.title_prefix or ''} {k}".strip(), rows)
            out.append(f"{k}.svg")
        return out

    def _overview(self, found: Match, c: DataFrame, acc: Accuracy) -> list[str]:
        """Maps of the mean shift over the image, and the cloud of shifts with the circular errors: cells, however many points there are."""
        out, cells, ref = [], 48, found.reference
        grid = profiles.by_cell(c, ref.width, ref.height, cells).toPandas()
        limits = stats.color_limits(c).first().asDict()
        span = lambda lo, hi: (lo, hi) if lo is not None and hi is not None and lo < hi else None
        scales = {"dx": span(limits["dx_vmin"], limits["dx_vmax"]), "dy": span(limits["dy_vmin"], limits["dy_vmax"]), "radial_error": span(0.0, limits["radial_vmax"]), "theta": (-180.0, 180.0)}
        for name, scale in scales.items():
            report.cell_chart(self.out / f"map_{name}.svg", f"{self.runtime.title_prefix or ''} {name}".strip(), grid, name, cells, (0, 0, ref.width, ref.height), cyclic=name == "theta", limits=scale)
            out.append(f"map_{name}.svg")
        most = stats.axis_limits(c).first()
        if most["hi"] is not None:
            reach = float(max(abs(most["lo"]), abs(most["hi"]), 1))
            factor = resolution(found.monitored, found.reference, self.runtime.pixel_size) or 1.0
            circles = tuple(acc.row[k] / factor for k in ("ce90", "ce95") if acc.row.get(k) is not None)
            report.cell_chart(self.out / "circular_error.svg", f"{self.runtime.title_prefix or ''} shifts, ce90, ce95".strip(), profiles.by_shift(c, -reach, reach, cells).toPandas(), "n", cells, (-reach, -reach, reach, reach), circles)
            out.append("circular_error.svg")
        return out

    def process(self, monitored: str, reference: str, mask: str | None = None, dem: str | None = None, vector: str | None = None, resume: bool = False) -> tuple[Match, Accuracy, list[str]]:
        self.runtime.check(dem)
        found = self.match(monitored, reference, mask, vector, resume)
        acc = self.accuracy(found)
        made = self.products(found)
        if self.runtime.generate_kp_chips and found.shift is None:
            made += [str(Path(p).relative_to(self.out)) for p in self.chips(found)]
        figures = self.reports(found, acc, dem)
        kinds = self.spark.createDataFrame([(m,) for m in made] or [("none",)], "name string").select("name", product_type("name").alias("kind")).collect()
        if made:
            report.products_page(self.out / "products.html", "Products", [(k["name"], k["kind"]) for k in kinds])
        report.summary(self.out / "report.html", self.runtime.title_prefix or "Geometric accuracy", acc.row, figures, [(k["name"], k["kind"]) for k in kinds] if made else [], self.resolved(found))
        (self.out / "configuration.json").write_text(json.dumps(self.resolved(found), indent=2), encoding="utf-8")
        return found, acc, made + figures


def align(monitored: str, reference: str, out: str, mask: str | None = None) -> dict:
    """Warps the monitored image onto the reference's grid by the best of the refined homographies; writes all of them."""
    mon, ref = geotiff.Header.read(monitored), geotiff.Header.read(reference)
    m, r = (h.window(1, 0, 0, h.shape[1], h.shape[0]) for h in (mon, ref))
    m8, r8 = I.equalized(I.stretch_percentile(m)), I.equalized(I.stretch_percentile(r))
    (pm, dm), (pr, dr) = A.sift(m8), A.sift(r8)
    pairs = A.match(dm, dr)
    starts: dict[str, np.ndarray] = {}
    inliers = 0
    if len(pairs) >= 4:
        h, ok = A.ransac(pr[pairs[:, 1]], pm[pairs[:, 0]])
        if h is not None:
            starts["ransac"], inliers = h, int(ok.sum())
    if mon.gt and ref.gt and mon.epsg == ref.epsg:
        prior = np.array([[mon.gt[1] / ref.gt[1], 0, (mon.gt[0] - ref.gt[0]) / ref.gt[1]], [0, mon.gt[5] / ref.gt[5], (mon.gt[3] - ref.gt[3]) / ref.gt[5]], [0, 0, 1]])
        starts["prior"] = np.linalg.inv(prior)
    if not starts:
        raise RasterError("too few matches to align the images")
    refined = {}
    for name, h in starts.items():
        got, rho = A.ecc(m8.astype(float), r8.astype(float), h)
        if got is not None:
            refined[name] = (got, rho)
    best = max(refined, key=lambda k: refined[k][1]) if refined else next(iter(starts))
    chosen = {**{k: (h, 0.0) for k, h in starts.items()}, **refined}
    where = Path(out)
    where.mkdir(parents=True, exist_ok=True)
    paths = {}
    for name, (h, rho) in chosen.items():
        if name != best and np.allclose(h, chosen[best][0]):
            continue
        path = where / (f"{Path(monitored).stem}_aligned.tif" if name == best else f"{Path(monitored).stem}_aligned__{name}_ecc{rho:.3f}.tif")
        warped = A.warp(m.astype(float), h, r.shape, border=mon.nodata or 0.0)
        kind = m.dtype
        geotiff.write(str(path), [(np.clip(np.rint(warped), np.iinfo(kind).min, np.iinfo(kind).max) if kind.kind in "ui" else warped).astype(kind)], ref.gt, ref.epsg, mon.nodata)
        paths[name] = str(path)
    if mask:
        k = geotiff.Header.read(mask)
        warped = A.warp(k.window(1, 0, 0, k.shape[1], k.shape[0]), chosen[best][0], r.shape, nearest=True)
        geotiff.write(str(where / f"{Path(mask).stem}_aligned.tif"), [warped.astype(np.uint8)], ref.gt, ref.epsg)
    h = chosen[best][0]
    return {"start": best, "matrix": h.tolist(), "ecc": chosen[best][1], "n_inliers": inliers, "n_matches": len(pairs), "rotation": float(np.degrees(np.arctan2(h[1, 0], h[0, 0]))), "scale": [float(np.hypot(h[0, 0], h[1, 0])), float(np.hypot(h[0, 1], h[1, 1]))], "files": paths}


def batch(workflow_of, pairs: Sequence[tuple[str, str]]) -> list[Accuracy]:
    """Many pairs, one after the other; each pair's job is distributed over its tiles."""
    return [workflow_of(m, r).process(m, r)[1] for m, r in pairs]
