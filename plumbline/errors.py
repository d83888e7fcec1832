"""Errors that callers can expect."""


class PlumblineError(Exception):
    """Base of this package's errors."""


class ConfigurationError(PlumblineError):
    """A configuration that cannot be used."""


class RasterError(PlumblineError):
    """A raster that cannot be read, or that does not fit another."""
