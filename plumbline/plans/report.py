"""Files for people: PNG and SVG images, mosaics of chips, an HTML summary."""

from __future__ import annotations

import html
import struct
import zlib
from pathlib import Path

import numpy as np
import pandas as pd

from ..sources.geotiff import Header


def png(path: str | Path, gray: np.ndarray) -> None:
    h, w = gray.shape
    raw = b"".join(b"\0" + gray[y].astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    Path(path).write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def vrt(path: Path, files: list[str]) -> None:
    """A mosaic of georeferenced files of one pixel size; nothing without any."""
    heads = [Header.read(f) for f in files]
    heads = [h for h in heads if h.gt]
    if not heads:
        return
    rx, ry = heads[0].gt[1], heads[0].gt[5]
    x0, y0 = min(h.gt[0] for h in heads), max(h.gt[3] for h in heads)
    at = [(round((h.gt[0] - x0) / rx), round((h.gt[3] - y0) / ry), h) for h in heads]
    w, t = max(x + h.shape[1] for x, _, h in at), max(y + h.shape[0] for _, y, h in at)
    sources = "".join(f'<ComplexSource><SourceFilename relativeToVRT="1">{Path(h.path).name}</SourceFilename><SourceBand>1</SourceBand><SrcRect xOff="0" yOff="0" xSize="{h.shape[1]}" ySize="{h.shape[0]}"/><DstRect xOff="{x}" yOff="{y}" xSize="{h.shape[1]}" ySize="{h.shape[0]}"/><NODATA>0</NODATA></ComplexSource>' for x, y, h in at)
    path.write_text(f'<VRTDataset rasterXSize="{w}" rasterYSize="{t}"><GeoTransform>{x0}, {rx}, 0, {y0}, 0, {ry}</GeoTransform><VRTRasterBand dataType="Float32" band="1"><NoDataValue>0</NoDataValue>{sources}</VRTRasterBand></VRTDataset>', encoding="utf-8")


def line_chart(path: Path, title: str, rows: pd.DataFrame, width: int = 640, height: int = 320) -> None:
    """pos against mean, with the band from lo to hi where there is one."""
    left, top = 56, 32
    lines = [c for c in ("mean", "lo", "hi") if c in rows]
    v = rows[lines].astype(float).to_numpy() if len(rows) else np.zeros((0, len(lines)))
    body = ""
    if np.isfinite(v).any():
        x0, x1 = float(rows["pos"].min()), float(rows["pos"].max())
        y0, y1 = float(np.nanmin(v)), float(np.nanmax(v))
        sx = lambda x: left + (float(x) - x0) / ((x1 - x0) or 1) * (width - left - 16)
        sy = lambda y: height - top - (float(y) - y0) / ((y1 - y0) or 1) * (height - 2 * top)
        draw = lambda c: " ".join(f"{sx(p):.1f},{sy(q):.1f}" for p, q in zip(rows["pos"], rows[c].astype(float), strict=True) if np.isfinite(q))
        if "lo" in rows:
            body += f'<polygon points="{draw("hi")} {" ".join(reversed(draw("lo").split()))}" fill="#4878a8" opacity="0.2"/>'
        body += f'<polyline points="{draw("mean")}" fill="none" stroke="#4878a8"/>'
        body += "".join(f'<text x="4" y="{sy(y):.0f}" font-size="11">{y:.3g}</text>' for y in (y0, y1)) + "".join(f'<text x="{sx(x):.0f}" y="{height - 8}" font-size="11" text-anchor="{a}">{x:.4g}</text>' for x, a in ((x0, "start"), (x1, "end")))
    path.write_text(f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><text x="{left}" y="18" font-size="14">{html.escape(title)}</text>{body}</svg>', encoding="utf-8")


def cell_chart(path: Path, title: str, rows: pd.DataFrame, value: str, cells: int, extent: tuple[float, float, float, float], circles: tuple[float, ...] = (), cyclic: bool = False, limits: tuple[float, float] | None = None, size: int = 360) -> None:
    """Cells (x, y from the top left) in the colour of a value; extent is (left, top, right, bottom), circles are around (0, 0)."""
    left, top, step = 48, 32, size / cells
    v = rows[value].astype(float).to_numpy()
    known = v[np.isfinite(v)]
    lo, hi = limits or ((float(known.min()), float(known.max())) if len(known) else (0.0, 1.0))
    body = ""
    for x, y, z in zip(rows["x"], rows["y"], v, strict=True):
        if np.isfinite(z):
            f = min(1.0, max(0.0, (z - lo) / ((hi - lo) or 1)))
            body += f'<rect x="{left + x * step:.1f}" y="{top + y * step:.1f}" width="{step:.1f}" height="{step:.1f}" fill="hsl({f * 360 if cyclic else 250 - 200 * f:.0f},70%,50%)"/>'
    x0, y0, x1, y1 = extent
    sx, sy = size / ((x1 - x0) or 1), size / ((y1 - y0) or 1)
    body += "".join(f'<ellipse cx="{left - x0 * sx:.1f}" cy="{top - y0 * sy:.1f}" rx="{abs(r * sx):.1f}" ry="{abs(r * sy):.1f}" fill="none" stroke="#a03030"/>' for r in circles if r is not None and np.isfinite(r))
    body += f'<rect x="{left}" y="{top}" width="{size}" height="{size}" fill="none" stroke="#888"/>'
    body += f'<text x="{left}" y="{top + size + 16}" font-size="11">{x0:.4g} to {x1:.4g}, {y0:.4g} to {y1:.4g}; {html.escape(value)} {lo:.4g} to {hi:.4g}</text>'
    path.write_text(f'<svg xmlns="http://www.w3.org/2000/svg" width="{size + left + 16}" height="{size + top + 28}"><text x="{left}" y="18" font-size="14">{html.escape(title)}</text>{body}</svg>', encoding="utf-8")


def box_chart(path: Path, title: str, rows: pd.DataFrame, width: int = 640, height: int = 320) -> None:
    """Box plots by position: quartiles, median and whiskers."""
    left, top, body = 56, 32, ""
    if len(rows):
        lo, hi = float(rows["whisker_lo"].min()), float(rows["whisker_hi"].max())
        at = lambda y: height - top - (float(y) - lo) / ((hi - lo) or 1) * (height - 2 * top)
        step = (width - left - 16) / len(rows)
        for k, r in enumerate(rows.itertuples(index=False)):
            x, w = left + (k + 0.2) * step, 0.6 * step
            body += f'<path d="M{x + w / 2:.1f} {at(r.whisker_lo):.1f}V{at(r.whisker_hi):.1f}" stroke="#444"/><rect x="{x:.1f}" y="{at(r.q3):.1f}" width="{w:.1f}" height="{max(0.5, at(r.q1) - at(r.q3)):.1f}" fill="#b8cbe0" stroke="#4878a8"/><path d="M{x:.1f} {at(r.med):.1f}h{w:.1f}" stroke="#a03030"/>'
            if k % max(1, len(rows) // 8) == 0:
                body += f'<text x="{x:.0f}" y="{height - 8}" font-size="11">{r.pos}</text>'
        body += "".join(f'<text x="4" y="{at(y):.0f}" font-size="11">{y:.3g}</text>' for y in (lo, hi))
    path.write_text(f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><text x="{left}" y="18" font-size="14">{html.escape(title)}</text>{body}</svg>', encoding="utf-8")


def _page(title: str, body: str) -> str:
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{body}</body></html>"


def products_page(path: Path, title: str, products: list[tuple[str, str]]) -> None:
    """The products (name, kind) by name."""
    path.write_text(_page(title, "<ul>" + "".join(f"<li><a href='{html.escape(n)}'>{html.escape(n)}</a> {html.escape(k)}</li>" for n, k in sorted(products)) + "</ul>"), encoding="utf-8")


#: What the cards can be sorted by.
CARD_KEYS = ("idx", "dist", "zncc", "nmi")
_SORT = """<script>
const up = {};
function sorted(key) {
  up[key] = !up[key];
  const box = document.getElementById("cards"), at = c => parseFloat(c.dataset[key]);
  const known = [...box.children].filter(c => !isNaN(at(c))), rest = [...box.children].filter(c => isNaN(at(c)));
  known.sort((a, b) => up[key] ? at(a) - at(b) : at(b) - at(a));
  box.append(...known, ...rest);
}
</script>"""


def chips_page(path: Path, title: str, cards: pd.DataFrame) -> None:
    """Chips of both images side by side with the facts of their points (name, x, y, dx, dy, dist, zncc, nmi); buttons sort them, unknown values last."""
    body = _SORT + "".join(f"<button onclick=\"sorted('{k}')\">{k}</button>" for k in CARD_KEYS) + "<div id='cards'>"
    for k, c in enumerate(cards.sort_values("name").itertuples(index=False)):
        other = c.name.replace("REF", "MON")
        data = " ".join(f"data-{n}='{v}'" for n, v in zip(CARD_KEYS, (k, c.dist, c.zncc, c.nmi), strict=True))
        cross = f"<svg width='114' height='114' style='position:absolute;left:0;top:0'><path d='M{c.cross_x:.1f} {c.cross_y - 6:.1f}v12M{c.cross_x - 6:.1f} {c.cross_y:.1f}h12' stroke='red'/></svg>"
        body += f"<div {data}><span style='position:relative;display:inline-block'><img src='{html.escape(c.name)}' width='114'>{cross}</span> <img src='{html.escape(other)}' width='114'> {c.x}, {c.y}: dx {c.dx:.3f}, dy {c.dy:.3f}, zncc {c.zncc:.3f}, nmi {c.nmi:.3f}</div>"
    path.write_text(_page(title, body + "</div>"), encoding="utf-8")


def summary(path: Path, title: str, row: dict, figures: list[str], products: list[tuple[str, str]], configuration: dict) -> None:
    show = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    line = lambda *cells: "<tr>" + "".join(f"<td>{html.escape(str(c))}</td>" for c in cells) + "</tr>"
    settings = [(f"{a}.{b}.{k}", v) for a, s in configuration.items() for b, t in s.items() for k, v in t.items()]
    path.write_text(
        f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"
        f"<h2>Accuracy</h2><table>{''.join(line(k, show(v)) for k, v in row.items())}</table>"
        f"<h2>Products</h2><table>{''.join(line(*p) for p in products)}</table>"
        f"{''.join(f'<p><a href={p!r}>{p}</a></p>' for p in ('products.html', 'chips.html') if (path.parent / p).exists())}"
        f"<h2>Figures</h2>{''.join(f'<img src={f!r}>' for f in figures)}"
        f"<h2>Configuration</h2><table>{''.join(line(*s) for s in settings)}</table></body></html>", encoding="utf-8")  # fmt: skip
