"""Scratch folders that the driver and all executors see."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, deleted when the driver's Python ends. Where that is unset in a local
    session (tests) it is in a local temporary folder; on a cluster that is an error, as executors would not see it."""
    shared, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not shared:
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder, as the master is {master}")
        shared = "file://" + tempfile.gettempdir()
    path = f"{shared.rstrip('/')}/lamina-{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended; what is left is scratch
        pass
