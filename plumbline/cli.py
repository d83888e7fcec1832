"""Command line: ``python -m plumbline process|align``."""

from __future__ import annotations

import argparse
import json
import logging
import logging.handlers
import sys
import time
from pathlib import Path

from .config import ProcessingConfiguration, RuntimeConfiguration
from .errors import PlumblineError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plumbline")
    p.add_argument("--version", action="version", version="0.1")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("process", "align"):
        c = sub.add_parser(name)
        c.add_argument("monitored")
        c.add_argument("reference")
        c.add_argument("--out", default="results")
        c.add_argument("--debug", "-d", action="store_true")
        c.add_argument("--no-log-file", action="store_true")
        c.add_argument("--log-file-path", default="plumbline.log")
        if name == "align":
            continue
        c.add_argument("mask", nargs="?", default="-", help="a raster, or - for none")
        c.add_argument("dem", nargs="?")
        c.add_argument("--vector-mask")
        c.add_argument("--conf")
        c.add_argument("--resume", action="store_true")
        c.add_argument("--input-pixel-size", "-pxs", type=float)
        c.add_argument("--title-prefix", "-tp")
        c.add_argument("--generate-key-points-mask", "-kpm", action="store_true")
        c.add_argument("--generate-intermediate-product", "-gip", action="store_true")
        c.add_argument("--generate-kp-chips", "-gkc", action="store_true")
        c.add_argument("--no-value", type=int, action="append")
        c.add_argument("--dem-description")
        c.add_argument("--enable-large-shift-detection", action="store_true")
    return p


def configure_logging(debug: bool, path: str | None) -> None:
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if path:
        handlers.append(logging.handlers.RotatingFileHandler(path, maxBytes=1 << 20, backupCount=10))
    form = logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s")
    form.converter = time.gmtime
    for h in handlers:
        h.setFormatter(form)
    logging.basicConfig(level=logging.DEBUG if debug else logging.INFO, handlers=handlers, force=True)
    logging.getLogger("py4j").setLevel(logging.WARNING)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    configure_logging(a.debug, None if a.no_log_file else a.log_file_path)
    from .plans import pipeline

    try:
        if a.command == "align":
            print(json.dumps(pipeline.align(a.monitored, a.reference, a.out), indent=2))
            return 0
        from pyspark.sql import SparkSession

        conf = ProcessingConfiguration.from_file(a.conf) if a.conf else ProcessingConfiguration()
        where = Path(a.out) / f"{Path(a.monitored).stem}_{Path(a.reference).stem}"
        runtime = RuntimeConfiguration(where, a.generate_key_points_mask, a.generate_intermediate_product, a.generate_kp_chips, a.enable_large_shift_detection, a.no_value, a.input_pixel_size, a.title_prefix, a.dem_description)
        flow = pipeline.Workflow(SparkSession.builder.appName("plumbline").getOrCreate(), conf, runtime)
        _, acc, made = flow.process(a.monitored, a.reference, None if a.mask == "-" else a.mask, a.dem, a.vector_mask, a.resume)
        print(json.dumps({"accuracy": acc.row, "valid_pixels": acc.valid_pixels, "files": made}, indent=2, default=str))
        return 0
    except (PlumblineError, ValueError) as e:
        logging.getLogger(__name__).error("%s", e)
        return 1


if __name__ == "__main__":
    sys.exit(main())
