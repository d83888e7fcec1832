"""Geometric accuracy analytics over raster and key-point tables, on Spark DataFrames."""

__all__ = ["RuntimeConfiguration", "Workflow"]


def __getattr__(name: str):
    if name == "Workflow":
        from .plans.pipeline import Workflow

        return Workflow
    if name == "RuntimeConfiguration":
        from .config import RuntimeConfiguration

        return RuntimeConfiguration
    raise AttributeError(name)
