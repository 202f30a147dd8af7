"""Making this package importable in the Python workers of every executor."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to every executor, once per Spark context."""
    sc = spark.sparkContext
    if not getattr(sc, "_corpusloom_shipped", False):
        top = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(prefix="corpusloom"), "corpusloom_pkg.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        sc.addPyFile(path)
        sc._corpusloom_shipped = True
    return spark
