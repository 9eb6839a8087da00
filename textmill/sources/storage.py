"""Files and folders by the session's Hadoop file systems, so that any store Spark can read is one."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, files = _at(spark, path)
    return files.exists(target)


def finished(spark: SparkSession, folder: str) -> bool:
    """Whether a Spark write to ``folder`` has come to its end."""
    return exists(spark, f"{folder.rstrip('/')}/_SUCCESS")


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob, in order."""
    target, files = _at(spark, pattern)
    return sorted(x.getPath().toString() for x in files.globStatus(target) or [])


def finished_folders(spark: SparkSession, pattern: str) -> list[str]:
    """Folders that match a glob and whose write has come to its end, in order."""
    return [p.removesuffix("/_SUCCESS") for p in matching(spark, f"{pattern.rstrip('/')}/_SUCCESS")]


def remove(spark: SparkSession, path: str) -> None:
    target, files = _at(spark, path)
    files.delete(target, True)


def move(spark: SparkSession, old: str, new: str) -> None:
    """Rename ``old``, whose new parent is made if it is missing; an error if that fails."""
    source, files = _at(spark, old)
    target, _ = _at(spark, new)
    files.mkdirs(target.getParent())
    if not files.rename(source, target):
        raise OSError(f"{old} could not be renamed to {new}")
