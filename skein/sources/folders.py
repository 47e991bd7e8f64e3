"""Folders of any file system that Spark reads."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def glob(spark: SparkSession, pattern: str) -> list[str]:
    path, system = _path(spark, pattern)
    return [f.getPath().toString() for f in system.globStatus(path) or []]


def qualified(spark: SparkSession, name: str) -> str:
    """The folder's whole name, as Spark tells it of the files in it."""
    path, system = _path(spark, name)
    return system.makeQualified(path).toString()


def text_of(spark: SparkSession, name: str) -> str:
    """The text of one small file."""
    path, system = _path(spark, name)
    stream = system.open(path)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode(errors="replace")
    finally:
        stream.close()


def delete(spark: SparkSession, folder: str) -> None:
    path, system = _path(spark, folder)
    system.delete(path, True)


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local master may do without spark.checkpoint.dir."""
    if told := spark.conf.get("spark.checkpoint.dir", None):
        return told
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{tempfile.mkdtemp(prefix='skein-')}"
