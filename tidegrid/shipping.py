"""Making this package importable on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once a session."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tidegrid-")) / f"{top.name}.zip"
    with zipfile.ZipFile(target, "w") as out:
        for p in sorted(top.rglob("*.py")):
            out.write(p, str(p.relative_to(top.parent)))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
