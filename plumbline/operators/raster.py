"""Raster algebra on pixels (x, y, dn)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import ratio

#: The 3 x 3 kernels as (dx, dy, weight).
LAPLACIAN3 = [(-1, -1, 2), (1, -1, 2), (-1, 1, 2), (1, 1, 2), (0, 0, -8)]
SOBEL_X = [(-1, -1, -1), (1, -1, 1), (-1, 0, -2), (1, 0, 2), (-1, 1, -1), (1, 1, 1)]
SOBEL_Y = [(-1, -1, -1), (0, -1, -2), (1, -1, -1), (-1, 1, 1), (0, 1, 2), (1, 1, 1)]


def tile_of(size: int) -> list[Column]:
    return [F.floor(F.col(c) / size).cast("long").alias(f"tile_{c}") for c in ("x", "y")]


def zipped(ref: DataFrame, mon: DataFrame) -> DataFrame:
    """Both images' values at each pixel: x, y, ref, mon."""
    return ref.withColumnRenamed("dn", "ref").join(mon.withColumnRenamed("dn", "mon"), ["x", "y"])


def with_valid(pairs: DataFrame, ref_nodata: float | None, mon_nodata: float | None) -> DataFrame:
    """Whether both values are finite, not zero and not no-data."""
    def ok(c: str, nodata: float | None) -> Column:
        v = F.col(c).cast("double")
        good = (v != 0) & ~F.isnan(v) & (F.abs(v) != float("inf"))
        return F.coalesce(good & (v != nodata) if nodata is not None else good, F.lit(False))

    return pairs.withColumn("valid", ok("ref", ref_nodata) & ok("mon", mon_nodata))


def valid_by_tile(pairs: DataFrame, size: int) -> DataFrame:
    """Valid pixels of each tile; tiles without any are skipped by matching."""
    return pairs.groupBy(*tile_of(size)).agg(F.count("*").alias("n"), F.count_if("valid").alias("valid"))


def valid_count(mon: DataFrame, mask: DataFrame) -> DataFrame:
    """One row: pixels of the monitored image that are not zero and not masked, and all pixels."""
    got = mon.join(mask, ["x", "y"], "left").agg(F.count_if((F.col("dn") != 0) & F.coalesce(F.col("m") != 0, F.lit(True))).alias("valid_pixels"), F.count("*").alias("total_pixels"))
    return got


def combined(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: counts of valid cells of two masks (x, y, m) and of both."""
    return a.withColumnRenamed("m", "a").join(b.withColumnRenamed("m", "b"), ["x", "y"]).agg(F.count("*").alias("total"), F.count_if(F.col("a") != 0).alias("raster_valid"), F.count_if(F.col("b") != 0).alias("vector_valid"), F.count_if((F.col("a") != 0) & (F.col("b") != 0)).alias("both_valid"))


def rasterized(grid: DataFrame, polygons: list[list[list[tuple[float, float]]]]) -> DataFrame:
    """m = 1 for each cell of grid (x, y) that a polygon touches: its unit square meets the polygon.

    A polygon is a list of rings, outer ones and holes. A cell is touched if its centre is inside an odd number of a polygon's
    rings, or a vertex or an edge of one is in it. Rings are few and become conditions of the plan; there is no join.
    """
    hit: Column = F.lit(False)
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    for rings in polygons:
        edges = [e for ring in rings for e in zip(ring, ring[1:] + ring[:1], strict=True)]
        points = [p for ring in rings for p in ring]
        inside: Column = F.lit(0)
        touch: Column = F.lit(False)
        for (ax, ay), (bx, by) in edges:
            if ay != by:
                at = F.lit(ax) + (y + 0.5 - ay) * ((bx - ax) / (by - ay))
                inside = inside + (((F.lit(ay) > y + 0.5) != (F.lit(by) > y + 0.5)) & (x + 0.5 < at)).cast("int")
            # Liang-Barsky: the part of the edge within the cell
            lo, hi = F.lit(0.0), F.lit(1.0)
            for p, d, c in ((ax, bx - ax, x), (ay, by - ay, y)):
                if d:
                    t1, t2 = (c - p) / d, (c + 1 - p) / d
                    lo, hi = F.greatest(lo, F.least(t1, t2)), F.least(hi, F.greatest(t1, t2))
                else:
                    hi = F.when((F.lit(p) < c) | (F.lit(p) >= c + 1), F.lit(-1.0)).otherwise(hi)
            touch = touch | (lo < hi)
        box = (x + 1 > min(p[0] for p in points)) & (x < max(p[0] for p in points)) & (y + 1 > min(p[1] for p in points)) & (y < max(p[1] for p in points))
        hit = hit | (box & ((inside % 2 == 1) | touch))
    return grid.select("x", "y", hit.cast("int").alias("m"))


def minmax_stretch(px: DataFrame, size: int) -> DataFrame:
    """Eight-bit values by the least and largest of each tile; a constant tile is zero."""
    t = px.withColumns(dict(zip(("tile_x", "tile_y"), tile_of(size), strict=True)))
    m = t.groupBy("tile_x", "tile_y").agg(F.min("dn").alias("a"), F.max("dn").alias("b"))
    return t.join(m, ["tile_x", "tile_y"]).select("x", "y", F.coalesce(F.floor(F.try_divide((F.col("dn") - F.col("a")).cast("double"), (F.col("b") - F.col("a")).cast("double")) * 255), F.lit(0)).cast("long").alias("u8"))


def percentile_stretch(px: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Eight-bit values between two percentiles, clipped; an image without spread is zero."""
    p = px.agg(F.percentile("dn", F.array(F.lit(low), F.lit(high))).alias("p")).select(F.col("p")[0].alias("a"), F.col("p")[1].alias("b"))
    v = F.try_divide(F.greatest(F.least(F.col("dn").cast("double"), F.col("b")), F.col("a")) - F.col("a"), F.col("b") - F.col("a"))
    return px.crossJoin(F.broadcast(p)).select("x", "y", F.coalesce(F.floor(v * 255), F.lit(0)).cast("long").alias("u8"))


def percentiles(px: DataFrame, *ps: float) -> DataFrame:
    return px.agg(F.percentile("dn", F.array(*[F.lit(p) for p in ps])).alias("p"))


def inverted(u8: DataFrame) -> DataFrame:
    return u8.withColumn("u8", 255 - F.col("u8"))


def shifted(px: DataFrame, x_off: int, y_off: int) -> DataFrame:
    """out(x, y) = in(x + x_off, y + y_off), zero outside."""
    moved = px.select((F.col("x") - x_off).alias("x"), (F.col("y") - y_off).alias("y"), F.col("dn").alias("_v"))
    return px.select("x", "y").join(moved, ["x", "y"], "left").select("x", "y", F.coalesce("_v", F.lit(0)).alias("dn"))


def stencils(px: DataFrame, width: int, height: int, **kernels: list[tuple[int, int, int]]) -> DataFrame:
    """Sums of weighted neighbours for each kernel, borders mirrored without the edge itself.

    Each pixel is sent to the places that read it, a mirrored one to more than one, so that a single aggregate by place
    does all kernels; there is no join.
    """
    offsets = sorted({(i, j) for k in kernels.values() for i, j, _ in k})

    def readers(c: str, d: int, size: int) -> Column:
        """The places along an axis that read this one at distance d."""
        places = [F.col(c) - d]
        if d:
            edge, inner = (0, 1) if d < 0 else (size - 1, size - 2)
            mirrored = F.when(F.col(c) == inner, F.lit(edge))
            places = [F.when((F.col(c) - d >= 0) & (F.col(c) - d < size), F.col(c) - d), mirrored]
        return F.array_compact(F.array(*places))

    sent = px.select("x", "y", F.col("dn").cast("double").alias("_v"), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), readers("x", i, width).alias("xs"), readers("y", j, height).alias("ys")) for i, j in offsets])).alias("o"))
    at = sent.select("_v", "o.i", "o.j", F.explode("o.xs").alias("x"), F.col("o.ys").alias("ys")).select("_v", "i", "j", "x", F.explode("ys").alias("y"))
    total = {name: F.sum(F.coalesce(sum_weights(k) * F.col("_v"), F.lit(0.0))).alias(name) for name, k in kernels.items()}
    return at.groupBy("x", "y").agg(*total.values())


def sum_weights(kernel: list[tuple[int, int, int]]) -> Column:
    out = None
    for i, j, w in kernel:
        c = (F.col("i") == i) & (F.col("j") == j)
        out = F.when(c, F.lit(float(w))) if out is None else out.when(c, F.lit(float(w)))
    return out


def laplacian3(px: DataFrame, width: int, height: int) -> DataFrame:
    """The 3 x 3 Laplacian, cut to 0..255."""
    s = stencils(px, width, height, lap=LAPLACIAN3)
    return s.select("x", "y", F.greatest(F.lit(0), F.least(F.lit(255), F.col("lap").cast("long"))).alias("lap"))


def sobel_magnitude(px: DataFrame, width: int, height: int) -> DataFrame:
    """The gradient's length over the largest one."""
    s = stencils(px, width, height, gx=SOBEL_X, gy=SOBEL_Y).withColumn("mag", F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2))
    return s.crossJoin(F.broadcast(s.agg(F.max("mag").alias("top")))).select("x", "y", F.coalesce(ratio(F.col("mag"), F.col("top")), F.lit(0.0)).alias("mag"))


def min_eigenvalue(px: DataFrame, width: int, height: int, block: int = 3) -> DataFrame:
    """The smaller eigenvalue of the gradients' covariance over a block, inside the image."""
    g = stencils(px, width, height, gx=SOBEL_X, gy=SOBEL_Y)
    h = block // 2
    span = lambda c: F.sequence(F.col(c) - h, F.col(c) + h)
    sent = g.select("gx", "gy", F.explode(span("x")).alias("x"), span("y").alias("_ys")).select("gx", "gy", "x", F.explode("_ys").alias("y"))
    inside = sent.where((F.col("x") >= h) & (F.col("x") < width - h) & (F.col("y") >= h) & (F.col("y") < height - h))
    m = inside.groupBy("x", "y").agg(F.sum(F.col("gx") ** 2).alias("a"), F.sum(F.col("gx") * F.col("gy")).alias("b"), F.sum(F.col("gy") ** 2).alias("c"))
    return m.select("x", "y", ((F.col("a") + F.col("c")) / 2 - F.sqrt(((F.col("a") - F.col("c")) / 2) ** 2 + F.col("b") ** 2)).alias("response"))


def clahe_tables(u8: DataFrame, width: int, height: int, blocks: int = 8, clip: float = 2.0) -> DataFrame:
    """The look-up tables of limited adaptive equalisation: block_x, block_y, dn, lut, for values that a block has.

    Counts above the limit are cut; what is cut off is spread evenly over all 256 values.
    """
    bx, by = F.floor(F.col("x") * blocks / width).cast("long"), F.floor(F.col("y") * blocks / height).cast("long")
    h = u8.groupBy(bx.alias("block_x"), by.alias("block_y"), F.col("u8").alias("dn")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("block_x", "block_y")
    h = h.withColumn("area", F.sum("n").over(w)).withColumn("limit", F.greatest(F.lit(1), F.floor(F.col("area") * clip / 256)))
    h = h.withColumn("cut", F.least("n", "limit")).withColumn("spread", (F.col("area") - F.sum("cut").over(w)) / F.lit(256.0))
    cdf = F.sum("cut").over(w.orderBy("dn").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + (F.col("dn") + 1) * F.col("spread")
    return h.select("block_x", "block_y", "dn", F.rint(cdf * 255 / F.col("area")).cast("long").alias("lut"))


def warp(px: DataFrame, width: int, height: int, matrix: list[list[float]], bilinear: bool, border: float = 0.0) -> DataFrame:
    """The image on its own canvas under the map from output to input pixels."""
    (a, b, c), (d, e, f), (g, h, i) = matrix
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    z = x * g + y * h + i
    at = px.select("x", "y", F.try_divide(x * a + y * b + c, z).alias("u"), F.try_divide(x * d + y * e + f, z).alias("v"))
    src = px.select(F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("dn").cast("double").alias("_v"))
    if not bilinear:
        near = at.withColumn("sx", F.rint("u").cast("long")).withColumn("sy", F.rint("v").cast("long"))
        return near.join(src, ["sx", "sy"], "left").select("x", "y", F.coalesce("_v", F.lit(border)).alias("dn"))
    base = at.withColumn("fu", F.col("u") - F.floor("u")).withColumn("fv", F.col("v") - F.floor("v"))
    corners = F.array(*[F.struct((F.floor("u") + i).cast("long").alias("sx"), (F.floor("v") + j).cast("long").alias("sy"), ((F.col("fu") if i else 1 - F.col("fu")) * (F.col("fv") if j else 1 - F.col("fv"))).alias("w")) for i in (0, 1) for j in (0, 1)])
    four = base.select("x", "y", F.explode(corners).alias("k")).select("x", "y", "k.*")
    return four.join(src, ["sx", "sy"], "left").groupBy("x", "y").agg(F.sum(F.col("w") * F.coalesce("_v", F.lit(border))).alias("dn"))


def contrast_pool(px: DataFrame, mask: DataFrame | None, no_values: list[int], nodata: float | None) -> DataFrame:
    """Values that the display's contrast is taken from, as a table of dn."""
    bad = F.col("dn") == 0
    if no_values:
        bad = bad | F.col("dn").isin(no_values)
    if nodata is not None:
        bad = bad | (F.col("dn") == nodata)
    if mask is not None:
        px = px.join(mask, ["x", "y"], "left").where("m is null or m <> 0")
    return px.where(F.coalesce(~bad, F.lit(False))).select("dn")


def from_tiles(*tiles: DataFrame) -> DataFrame:
    """One table of the rows of all tiles."""
    out = tiles[0]
    for t in tiles[1:]:
        out = out.unionByName(t)
    return out
