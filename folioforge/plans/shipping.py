"""Makes this package importable in Python workers that were not started beside it."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's files once, unless workers find it through PYTHONPATH or their folder."""
    found = {os.path.realpath(p or ".") for p in [".", *os.environ.get("PYTHONPATH", "").split(os.pathsep)]}
    if str(ROOT) in found or spark.sparkContext.applicationId in _sent:
        return
    _sent.add(spark.sparkContext.applicationId)
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "folioforge"), "zip", ROOT, "folioforge"))
