"""Makes the package importable in Python workers when it is not installed on them."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Send the package's modules along with the session's Python functions (once a session)."""
    context = spark.sparkContext
    listed = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if str(PACKAGE.parent) in listed or getattr(context, "_wordmill_shipped", False):
        return
    place = Path(tempfile.mkdtemp()) / f"{PACKAGE.name}.zip"
    with zipfile.ZipFile(place, "w") as archive:
        for file in sorted(PACKAGE.rglob("*.py")):
            archive.write(file, file.relative_to(PACKAGE.parent))
    context.addPyFile(str(place))
    context._wordmill_shipped = True
