"""Sends this package's code to the executors, as Spark sends any dependency."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once a Spark context; needed by operators that run Python in tasks."""
    sc = spark.sparkContext
    if getattr(sc, "_rankfold_shipped", False):
        return
    top = Path(__file__).resolve().parent
    fd, name = tempfile.mkstemp(prefix="rankfold-", suffix=".zip")
    with os.fdopen(fd, "wb") as f, zipfile.ZipFile(f, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(name)
    sc._rankfold_shipped = True
