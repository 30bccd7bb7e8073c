"""Makes the package importable in the Python workers of every executor."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _DONE:
        return
    root = Path(__file__).resolve().parents[2]
    folder = tempfile.mkdtemp(prefix="quirewright-zip-")
    stage = Path(folder) / "stage"
    shutil.copytree(root / "quirewright", stage / "quirewright", ignore=shutil.ignore_patterns("__pycache__"))
    zipped = shutil.make_archive(os.path.join(folder, "quirewright"), "zip", stage)
    spark.sparkContext.addPyFile(zipped)
    _DONE.add(app)
