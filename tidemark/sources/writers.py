"""Writers, and the place for written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# The folder of each application, by its id and the folder that holds it.
_FOLDERS: dict[tuple[str, str], str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder the session names in ``spark.checkpoint.dir``; the file
    system deletes it when the driver ends.

    Only a local session without that setting gets a folder of this machine.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base is None and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    key = context.applicationId, base or ""
    if key not in _FOLDERS:
        base = base or tempfile.mkdtemp(prefix="tidemark-")
        folder = f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(context._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        _FOLDERS[key] = folder
    return f"{_FOLDERS[key]}/{name}-{uuid.uuid4().hex}"


def write_csv(df: DataFrame, path: str, header: bool = True, sep: str = ",") -> None:
    """One file per partition, written by the tasks."""
    df.write.option("header", header).option("sep", sep).csv(path)


def write_lines(df: DataFrame, path: str) -> None:
    """A single string column as lines of text."""
    df.write.text(path)
