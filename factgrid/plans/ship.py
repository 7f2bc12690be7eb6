"""The package on the executors: functions that run there are found by name."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Sends this package's source to the executors, once for each Spark context, wherever it is installed here."""
    context = spark.sparkContext
    if getattr(context, "_factgrid_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="factgrid-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors fetch it from the driver whenever they start
    path = Path(folder) / "factgrid.zip"
    with zipfile.ZipFile(path, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    context.addPyFile(str(path))
    context._factgrid_shipped = True
