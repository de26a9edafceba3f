"""The driver's log, by Spark's own structured logger, and versions of installed packages."""

from __future__ import annotations

import logging
from importlib.metadata import PackageNotFoundError, version

from pyspark.logger import PySparkLogger


def setup(level: str = "INFO", path: str | None = None) -> PySparkLogger:
    """The package's logger: JSON lines on the console or, beside it, in a file. Keyword arguments of a call become fields."""
    log = PySparkLogger.getLogger("strandlake")
    log.setLevel(level.upper())
    if path:
        to_file = logging.FileHandler(path)
        to_file.setFormatter(log.handlers[0].formatter)
        log.addHandler(to_file)
    return log


def package_version(name: str) -> str:
    """The installed version, '' if there is none."""
    try:
        return version(name)
    except PackageNotFoundError:
        return ""
