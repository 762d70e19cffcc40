"""Making this package importable in Spark's Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent.parent
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to all executors, once an application.

    The tasks' functions refer to this package by name, so that a worker keeps what it has learned (such as the ids
    of words) from task to task.  Where the package is installed on all machines this changes nothing.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    archive = Path(tempfile.mkdtemp(prefix="crawlglass-code-")) / f"crawlglass-{context.applicationId}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as file:
        for source in sorted(PACKAGE.rglob("*.py")):
            file.write(source, source.relative_to(PACKAGE.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
