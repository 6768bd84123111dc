"""Gets the package to the Python workers of a cluster where it isn't installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to all workers of the session, once, unless their PYTHONPATH names it already.

    The driver serves the archive to executors that join later too.
    """
    root = Path(__file__).resolve().parent.parent
    context = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_ionquill_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="ionquill-")) / "ionquill.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted((root / "ionquill").rglob("*.py")):
            out.write(source, source.relative_to(root))
    context.addPyFile(str(archive))
    context._ionquill_shipped = True
