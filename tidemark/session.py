"""Session settings that suit the operators."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    # Dates are days in UTC whatever the machine.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # After a resample the rows are few and small but each carries a lot of computing:
    # do not merge the tasks of a stage just because their input is small.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply the settings; what the builder or the cluster sets later wins."""
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    return builder


def ship(spark: SparkSession) -> str:
    """Send the package to the executors, where it need not be installed: functions that run in
    tasks are pickled by reference and import it.  Returns the path of the zip, which the driver
    keeps in its own temporary folder; Spark copies it to every executor, also to later ones."""
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, Path(root.name) / file.relative_to(root))
    spark.sparkContext.addPyFile(str(path))
    return str(path)
