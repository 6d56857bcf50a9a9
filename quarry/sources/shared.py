"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  Where it is not set, a folder of this machine in local mode, else an error: the
    machines of a cluster don't see each other's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{tempfile.gettempdir()}/checkpoints/{uuid.uuid4().hex}"


def mounted(path: str) -> str:
    """A file: URL as the plain path that open() takes."""
    return path.removeprefix("file://").removeprefix("file:") if path.startswith("file:") else path
