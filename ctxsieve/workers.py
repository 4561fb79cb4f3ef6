"""Shipping of this package to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once for each Spark application."""
    sc = spark.sparkContext
    package = Path(__file__).resolve().parent
    name = f"{package.name}-workers.zip"
    if name in sc._python_includes:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="ctxsieve-"), name)
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    sc.addPyFile(path)
