"""Bring this package to the workers of a cluster, the way --py-files does."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application: a zip of the package's source goes to every executor, so that tasks can import it."""
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    root = Path(__file__).parent.parent
    target = os.path.join(tempfile.mkdtemp(prefix="colloquy-source-"), "colloquy.zip")  # read by the driver alone
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)
    _SENT.add(app)
