"""GeoTIFF files as a data source: ``spark.read.format("geotiff")`` and ``df.write.format("geotiff")``.

mode=meta gives a header for each file, mode=pixels (the default) a row for each pixel. Files are cut into tiles, and a
tile is a partition; the options x_from, x_to, y_from and y_to (ends exclusive) give a window, outside of which nothing is
read. They are options because filters pushed to a Python reader stay with it for later queries. Strips and tiles, no compression, deflate and LZW are
read. Paths are read where the task runs, so they are on a file system that all executors mount.
"""

from __future__ import annotations

import glob
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..errors import RasterError

#: TIFF tags and field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_W, TILE_H, TILES, TILE_BYTES, FORMAT, SCALE, TIEPOINT, MATRIX, GEOKEYS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34264, 34735, 42113
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
META = "path string, file_name string, gt array<double>, x_size int, y_size int, epsg int, nodata double, dtype string, bands int"
PIXELS = "path string, band int, tile_x int, tile_y int, x long, y long, dn double"


def unlzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits from the high bit down, wider one code early."""
    table: list[bytes] = []
    out, bits, have, width, last = [], 0, 0, 9, b""
    for byte in data:
        bits, have = bits << 8 | byte, have + 8
        if have < width:
            continue
        have -= width
        code = bits >> have
        bits &= (1 << have) - 1
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code == 257:
            break
        if not table:
            table = [bytes([i]) for i in range(256)] + [b"", b""]
        if not last:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out.append(entry)
        last = entry
        width = max(9, min(12, (len(table) + 1).bit_length()))
    return b"".join(out)


@dataclass
class Header:
    path: str
    order: str
    tags: dict[int, tuple]

    @classmethod
    def read(cls, path: str) -> Header:
        try:
            with open(path, "rb") as f:
                head = f.read(8)
                order = {b"II": "<", b"MM": ">"}.get(head[:2])
                if order is None or struct.unpack(order + "H", head[2:4])[0] != 42:
                    raise RasterError(f"{path} is no TIFF file")
                f.seek(struct.unpack(order + "I", head[4:8])[0])
                n = struct.unpack(order + "H", f.read(2))[0]
                entries = f.read(12 * n)
                tags = {}
                for k in range(n):
                    tag, kind, count = struct.unpack(order + "HHI", entries[12 * k : 12 * k + 8])
                    code = TYPES.get(kind)
                    if code is None:
                        continue
                    size = struct.calcsize(order + code) * count
                    raw = entries[12 * k + 8 : 12 * k + 12]
                    if size > 4:
                        f.seek(struct.unpack(order + "I", raw)[0])
                        raw = f.read(size)
                    tags[tag] = (raw[:size].rstrip(b"\0").decode("latin-1"),) if kind == 2 else struct.unpack(order + code * count, raw[:size])
                return cls(path, order, tags)
        except (OSError, struct.error) as e:
            raise RasterError(f"cannot read {path}: {e}") from e

    def one(self, tag: int, default: int = 0) -> int:
        return self.tags.get(tag, (default,))[0]

    @property
    def shape(self) -> tuple[int, int]:
        return self.one(HEIGHT), self.one(WIDTH)

    @property
    def bands(self) -> int:
        return self.one(SAMPLES, 1)

    @property
    def dtype(self) -> np.dtype:
        kind = {1: "u", 2: "i", 3: "f"}.get(self.one(FORMAT, 1), "u")
        return np.dtype(f"{self.order}{kind}{self.one(BITS, 8) // 8}")

    @property
    def gt(self) -> list[float] | None:
        if MATRIX in self.tags:
            m = self.tags[MATRIX]
            return [m[3], m[0], m[1], m[7], m[4], m[5]]
        if SCALE in self.tags and TIEPOINT in self.tags:
            s, t = self.tags[SCALE], self.tags[TIEPOINT]
            return [t[3] - t[0] * s[0], s[0], 0.0, t[4] + t[1] * s[1], 0.0, -s[1]]
        return None

    @property
    def epsg(self) -> int | None:
        """The code of a projected system; none for a geographic one."""
        keys = self.tags.get(GEOKEYS, ())
        found = {keys[k]: keys[k + 3] for k in range(4, len(keys), 4) if keys[k + 1] == 0}
        return found.get(3072)

    @property
    def nodata(self) -> float | None:
        try:
            return float(self.tags[NODATA][0])
        except (KeyError, ValueError):
            return None

    def blocks(self) -> tuple[int, int]:
        """Width and height of a stored block."""
        return (self.one(TILE_W), self.one(TILE_H)) if TILES in self.tags else (self.shape[1], self.one(ROWS, self.shape[0]))

    def window(self, band: int, x: int, y: int, w: int, h: int) -> np.ndarray:
        """Values of a window of a band, from 1; only the blocks that it meets are read."""
        rows, columns = self.shape
        if x < 0 or y < 0 or x + w > columns or y + h > rows or not 1 <= band <= self.bands:
            raise RasterError(f"no window {x},{y},{w},{h} of band {band} in {self.path}")
        bw, bh = self.blocks()
        across = -(-columns // bw)
        per_band = across * -(-rows // bh)
        planar = self.one(PLANAR, 1) == 2
        at, sizes = self.tags.get(TILES) or self.tags[STRIPS], self.tags.get(TILE_BYTES) or self.tags[STRIP_BYTES]
        out = np.zeros((h, w), self.dtype.newbyteorder("="))
        samples = 1 if planar else self.bands
        with open(self.path, "rb") as f:
            for by in range(y // bh, (y + h - 1) // bh + 1):
                for bx in range(x // bw, (x + w - 1) // bw + 1):
                    k = by * across + bx + (band - 1) * per_band * planar
                    f.seek(at[k])
                    raw, how = f.read(sizes[k]), self.one(COMPRESSION, 1)
                    raw = raw if how == 1 else zlib.decompress(raw) if how in (8, 32946) else unlzw(raw) if how == 5 else None
                    if raw is None:
                        raise RasterError(f"compression {how} of {self.path} is not known")
                    height = bh if TILES in self.tags else min(bh, rows - by * bh)
                    block = np.frombuffer(raw, self.dtype, height * bw * samples).reshape(height, bw, samples)
                    if self.one(PREDICTOR, 1) == 2:
                        block = np.cumsum(block, 1, dtype=self.dtype.newbyteorder("="))
                    block = block[:, :, 0 if planar else band - 1]
                    x0, y0, x1, y1 = max(x, bx * bw), max(y, by * bh), min(x + w, (bx + 1) * bw), min(y + h, (by + 1) * bh)
                    out[y0 - y : y1 - y, x0 - x : x1 - x] = block[y0 - by * bh : y1 - by * bh, x0 - bx * bw : x1 - bx * bw]
        return out


def write(path: str, bands: list[np.ndarray], gt: list[float] | None = None, epsg: int | None = None, nodata: float | None = None, compress: bool = True) -> None:
    """Bands of one type and size, north up, in deflated strips."""
    kind = bands[0].dtype.newbyteorder("<")
    h, w = bands[0].shape
    rows = max(1, min(h, (1 << 16) // max(1, w * kind.itemsize)))
    strips = [np.ascontiguousarray(b[y : y + rows], kind).tobytes() for b in bands for y in range(0, h, rows)]
    strips = [zlib.compress(s) if compress else s for s in strips]
    tags: list[tuple[int, int, tuple]] = [
        (WIDTH, 4, (w,)), (HEIGHT, 4, (h,)), (BITS, 3, (kind.itemsize * 8,) * len(bands)), (COMPRESSION, 3, (8 if compress else 1,)), (PHOTOMETRIC, 3, (1,)),
        (STRIPS, 4, (0,) * len(strips)), (SAMPLES, 3, (len(bands),)), (ROWS, 4, (rows,)), (STRIP_BYTES, 4, tuple(map(len, strips))), (PLANAR, 3, (2 if len(bands) > 1 else 1,)),
        (FORMAT, 3, ({"u": 1, "i": 2, "f": 3}[kind.kind],) * len(bands)),
    ]
    if gt is not None:
        tags += [(SCALE, 12, (gt[1], -gt[5], 0.0)), (TIEPOINT, 12, (0.0, 0.0, 0.0, gt[0], gt[3], 0.0))]
    if epsg is not None:
        tags.append((GEOKEYS, 3, (1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, epsg)))
    if nodata is not None:
        tags.append((NODATA, 2, (f"{nodata:g}".encode() + b"\0",)))
    pack = lambda kind, v: v[0] if kind == 2 else struct.pack("<" + TYPES[kind] * len(v), *v)
    at = 8 + 2 + 12 * len(tags) + 4
    place, extra = {}, at
    for tag, kind_, v in tags:
        if len(pack(kind_, v)) > 4:
            place[tag] = extra
            extra += len(pack(kind_, v)) + len(pack(kind_, v)) % 2
    starts, p = [], extra
    for s in strips:
        starts.append(p)
        p += len(s)
    with open(path, "wb") as f:
        f.write(struct.pack("<2sHIH", b"II", 42, 8, len(tags)))
        body = []
        for tag, kind_, v in sorted(tags):
            raw = pack(kind_, tuple(starts) if tag == STRIPS else v)
            f.write(struct.pack("<HHI", tag, kind_, len(raw) if kind_ == 2 else len(v)) + (struct.pack("<I", place[tag]) if tag in place else raw.ljust(4, b"\0")))
            if tag in place:
                body.append((place[tag], raw))
        f.write(struct.pack("<I", 0))
        for start, raw in sorted(body):
            f.seek(start)
            f.write(raw)
        f.seek(extra)
        for s in strips:
            f.write(s)


def files(path: str) -> list[str]:
    path = path.removeprefix("file://")
    found = sorted(glob.glob(os.path.join(path, "*.tif*"))) if os.path.isdir(path) else sorted(glob.glob(path))
    if not found:
        raise RasterError(f"no file at {path}")
    return found


@dataclass
class TilePartition(InputPartition):
    path: str
    band: int
    tile_x: int
    tile_y: int
    size: int


class GeoTiffReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.mode = options["path"], options.get("mode", "pixels")
        self.size, self.band = int(options.get("tile_size", 1024)), int(options.get("band", 1))
        self.window = [int(options.get(k, d)) for k, d in (("x_from", 0), ("x_to", 1 << 62), ("y_from", 0), ("y_to", 1 << 62))]

    def _part(self, tx: int, ty: int, width: int, height: int) -> tuple[int, int, int, int]:
        """x, y, width and height of what the window takes of a tile."""
        x0, x1, y0, y1 = self.window
        x, y = max(x0, tx * self.size), max(y0, ty * self.size)
        return x, y, min(x1, (tx + 1) * self.size, width) - x, min(y1, (ty + 1) * self.size, height) - y

    def partitions(self) -> list[InputPartition]:
        if self.mode == "meta":
            return [TilePartition(p, 0, 0, 0, 0) for p in files(self.path)]
        out: list[InputPartition] = []
        for p in files(self.path):
            h, w = Header.read(p).shape
            out += [TilePartition(p, self.band, tx, ty, self.size) for tx in range(-(-w // self.size)) for ty in range(-(-h // self.size)) if min(self._part(tx, ty, w, h)[2:]) > 0]
        return out

    def read(self, partition: TilePartition) -> Iterator[pa.RecordBatch]:
        t = Header.read(partition.path)
        if self.mode == "meta":
            row = [partition.path, os.path.basename(partition.path), t.gt, t.shape[1], t.shape[0], t.epsg, t.nodata, str(t.dtype.newbyteorder("=")), t.bands]
            kinds = [pa.string(), pa.string(), pa.list_(pa.float64()), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[c.split(" ")[0] for c in META.split(", ")])
            return
        x, y, w, h = self._part(partition.tile_x, partition.tile_y, t.shape[1], t.shape[0])
        for lo in range(y, y + h, 64):  # some rows at a time
            v = t.window(partition.band, x, lo, w, min(64, y + h - lo))
            ys, xs = np.mgrid[lo : lo + v.shape[0], x : x + v.shape[1]]
            n = v.size
            same = lambda a, kind: pa.array(np.full(n, a), kind)
            yield pa.RecordBatch.from_arrays([pa.array([partition.path] * n), same(partition.band, pa.int32()), same(partition.tile_x, pa.int32()), same(partition.tile_y, pa.int32()), pa.array(xs.ravel().astype(np.int64)), pa.array(ys.ravel().astype(np.int64)), pa.array(v.ravel().astype(np.float64))], names=[c.split(" ")[0] for c in PIXELS.split(", ")])


@dataclass
class Written(WriterCommitMessage):
    path: str


class GeoTiffWriter(DataSourceArrowWriter):
    """Rows (x, y and a column for each band) as one file for each partition; options: path, width, height, gt, epsg, nodata, dtype."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.names = options, [f.name for f in schema.fields]

    def write(self, it: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        o = self.options
        w, h = int(o["width"]), int(o["height"])
        nodata = float(o["nodata"]) if "nodata" in o else None
        names = [c for c in self.names if c not in ("x", "y")]
        bands = [np.full((h, w), nodata or 0, o.get("dtype", "float32")) for _ in names]
        rows = 0
        for b in it:
            t = {c: b.column(k).to_numpy(zero_copy_only=False) for k, c in enumerate(self.names)}
            for band, c in zip(bands, names, strict=True):
                band[t["y"].astype(int), t["x"].astype(int)] = t[c]
            rows += b.num_rows
        os.makedirs(o["path"], exist_ok=True)
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        path = os.path.join(o["path"], f"part-{part:05d}.tif")
        if rows or part == 0:
            write(path, bands, [float(v) for v in o["gt"].split(",")] if o.get("gt") else None, int(o["epsg"]) if o.get("epsg") else None, nodata)
        return Written(path)


class GeoTiffSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return META if self.options.get("mode") == "meta" else PIXELS

    def reader(self, schema: StructType) -> GeoTiffReader:
        return GeoTiffReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> GeoTiffWriter:
        return GeoTiffWriter(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GeoTiffSource)
