"""The library's code for executors that do not have it installed."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to all executors, once for a session. The driver serves the archive; executors need no shared folder for it."""
    package = Path(__file__).resolve().parents[1]
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='netloom-')}/{package.name}", "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)
