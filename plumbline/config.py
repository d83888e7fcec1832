"""Configuration: processing and plotting parameters from JSON, and what a run is asked for."""

from __future__ import annotations

import json
import logging
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path
from typing import Any

from .errors import ConfigurationError
from .operators.matching import Settings

log = logging.getLogger(__name__)
#: Fixed value: the longest title prefix.
TITLE_CHARS = 26


@dataclass
class ShiftConfiguration:
    bias_correction_min_threshold: int = 2


@dataclass
class KLTConfiguration:
    minDistance: int = 10
    blocksize: int = 15
    maxCorners: int = 20000
    matching_winsize: int = 25
    qualityLevel: float = 0.1
    xStart: int = 0
    tile_size: int = 20000
    laplacian_kernel_size: Any = 7
    laplacian_invert_polarity: Any = False
    outliers_filtering: bool = False

    def settings(self) -> Settings:
        """The parameters as the matcher takes them; a size is a number, {"mon", "ref"}, or "auto"."""
        k = self.laplacian_kernel_size
        if k != "auto":
            k = (int(k["mon"]), int(k["ref"])) if isinstance(k, dict) else (int(k), int(k))
        return Settings(self.tile_size, self.maxCorners, self.qualityLevel, self.minDistance, self.matching_winsize, self.blocksize, k, self.laplacian_invert_polarity, self.outliers_filtering, self.xStart)


@dataclass
class AccuracyConfiguration:
    confidence_threshold: float | None = 0.4


@dataclass
class OverviewPlotConfiguration:
    fig_size: Any = (12, 12)
    shift_colormap: str = "viridis"
    shift_auto_axes_limit: bool = True
    shift_axes_limit: float = 5
    theta_colormap: str = "hsv"


@dataclass
class ShiftPlotConfiguration:
    fig_size: Any = (12, 12)
    scatter_colormap: str = "coolwarm"
    scatter_auto_limit: bool = True
    scatter_min_limit: float = -1
    scatter_max_limit: float = 1
    histo_mean_bin_size: int = 20


@dataclass
class DemPlotConfiguration:
    fig_size: Any = (12, 6)
    show_fliers: bool = False
    histo_mean_bin_size: int = 100


@dataclass
class CePlotConfiguration:
    fig_size: Any = (12, 12)
    ce_scatter_colormap: str = "viridis"


#: Sections of the file: (path, attribute, class).
SECTIONS = (
    (("processing_configuration", "shift_image_processing"), "shift", ShiftConfiguration),
    (("processing_configuration", "klt_matching"), "klt", KLTConfiguration),
    (("processing_configuration", "accuracy_analysis"), "accuracy", AccuracyConfiguration),
    (("plot_configuration", "overview"), "overview", OverviewPlotConfiguration),
    (("plot_configuration", "shift"), "shift_plot", ShiftPlotConfiguration),
    (("plot_configuration", "dem"), "dem_plot", DemPlotConfiguration),
    (("plot_configuration", "ce"), "ce_plot", CePlotConfiguration),
)


@dataclass
class ProcessingConfiguration:
    shift: ShiftConfiguration = field(default_factory=ShiftConfiguration)
    klt: KLTConfiguration = field(default_factory=KLTConfiguration)
    accuracy: AccuracyConfiguration = field(default_factory=AccuracyConfiguration)
    overview: OverviewPlotConfiguration = field(default_factory=OverviewPlotConfiguration)
    shift_plot: ShiftPlotConfiguration = field(default_factory=ShiftPlotConfiguration)
    dem_plot: DemPlotConfiguration = field(default_factory=DemPlotConfiguration)
    ce_plot: CePlotConfiguration = field(default_factory=CePlotConfiguration)

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> ProcessingConfiguration:
        """Every named section must be there, with known fields only; other keys are not read."""
        got = {}
        for path, name, kind in SECTIONS:
            at: Any = d
            for key in path:
                if not isinstance(at, dict) or key not in at:
                    raise ConfigurationError(f"no section {'.'.join(path)}")
                at = at[key]
            if unknown := set(at) - {f.name for f in fields(kind)}:
                raise ConfigurationError(f"unknown fields in {'.'.join(path)}: {sorted(unknown)}")
            got[name] = kind(**at)
        return cls(**got)

    @classmethod
    def from_file(cls, path: str | Path) -> ProcessingConfiguration:
        try:
            return cls.from_dict(json.loads(Path(path).read_text(encoding="utf-8")))
        except OSError as e:
            raise ConfigurationError(f"cannot read {path}: {e}") from e
        except json.JSONDecodeError as e:
            raise ConfigurationError(f"{path} is no JSON: {e}") from e

    def to_dict(self) -> dict[str, Any]:
        out: dict[str, Any] = {}
        for path, name, _ in SECTIONS:
            out.setdefault(path[0], {})[path[1]] = asdict(getattr(self, name))
        return out


@dataclass
class RuntimeConfiguration:
    output_directory: str | Path
    gen_kp_mask: bool = False
    gen_delta_raster: bool = False
    generate_kp_chips: bool = False
    enable_large_shift_detection: bool = False
    no_values: list[int] | None = None
    pixel_size: float | None = None
    title_prefix: str | None = None
    dem_description: str | None = None

    def check(self, dem: str | None = None) -> None:
        if self.title_prefix and len(self.title_prefix) > TITLE_CHARS:
            raise ValueError(f"a title prefix has at most {TITLE_CHARS} characters")
        if dem and not self.dem_description:
            log.warning("a DEM is given without a description")
        if self.dem_description and not dem:
            log.warning("a DEM description is given without a DEM")
