"""Puts the package on the executors' Python path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors once a session, unless PYTHONPATH names it already."""
    sc = spark.sparkContext
    if str(_ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or sc.applicationId in _shipped:
        return
    path = Path(tempfile.mkdtemp()) / f"{_ROOT.name}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(_ROOT.rglob("*.py")):
            out.write(source, source.relative_to(_ROOT.parent))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)
