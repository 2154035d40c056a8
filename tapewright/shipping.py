"""Puts this package where executors can import it, once for each Spark application."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip file, as `--py-files` would; grouped and mapped functions then resolve on every executor."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = Path(__file__).parent
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "tapewright.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f"tapewright/{f.relative_to(here)}")
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
