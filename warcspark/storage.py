"""The folder that driver and executors share, for archives that a query writes and reads again."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import SparkSession

_LOCAL = "file:///tmp/warcspark-shared"
_tops: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a folder of our own, but only if all runs on one machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or _LOCAL).rstrip("/")


def on_default(spark: SparkSession, path: str) -> str:
    """The path with Spark's default file system, if it has no scheme and that isn't the local one."""
    if "://" in path or path.startswith("file:"):
        return path
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return path if full.startswith("file:") else full


def forget(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may have ended; the folder is then the cluster's to clean
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below this application's part of the shared folder, removed as Python ends."""
    top = f"{shared_dir(spark)}/warcspark-{spark.sparkContext.applicationId}"
    if top not in _tops:
        _tops.add(top)
        atexit.register(forget, spark, top)
    return f"{top}/{name}-{uuid.uuid4().hex}"
