"""Sessions, and shipping of the package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def local_session(cores: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Make the package importable in Python workers, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_modalflow_shipped", False):
        return spark
    path = Path(tempfile.mkdtemp()) / "modalflow.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((ROOT / "modalflow").rglob("*.py")):
            z.write(f, os.path.relpath(f, ROOT))
    sc.addPyFile(str(path))
    sc._modalflow_shipped = True
    return spark
