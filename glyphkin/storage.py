"""Folders that every machine of the cluster sees."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def shared_base(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is set, one of our own on a local master; else an error.

    A machine's own temporary folder on a cluster would be written by one machine and read by another.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="glyphkin-")
    return _OWN[app]


def shared_folder(spark: SparkSession, kind: str = "tables") -> str:
    """A new folder name there. Whoever reads what is written to it may remove it, with remove_folder."""
    return f"{shared_base(spark)}/{kind}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder by way of Hadoop's file systems, so wherever Spark can write; a missing one is nothing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
