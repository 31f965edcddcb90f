"""Sends this package's code to the executors, for jobs that run Python there."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Adds the package as a zip file to the session, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _SENT:
        root = Path(__file__).resolve().parents[1]
        if root.is_dir():  # not when it already runs from a zip file
            target = os.path.join(tempfile.mkdtemp(prefix="chromloom-"), "chromloom_code.zip")
            with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
                for p in sorted(root.rglob("*.py")):
                    z.write(p, str(Path(root.name) / p.relative_to(root)))
            sc.addPyFile(target)
        _SENT.add(sc.applicationId)
    return spark
