"""Folders and tables that a query writes and reads again."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from textmill.sources import storage


def base(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else that of ``setCheckpointDir``.

    On a local master the warehouse stands in; on a cluster, where it may be
    each machine's own, a missing folder is an error.
    """
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or (current.get() if current.isDefined() else None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = spark.conf.get("spark.sql.warehouse.dir")
    return str(named).rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share, which goes when the driver ends."""
    path = f"{base(spark)}/textmill-{name}-{uuid.uuid4().hex}"
    at, files = storage._at(spark, path)
    files.mkdirs(at)  # deleteOnExit takes no path that is not there
    files.deleteOnExit(at)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to a new shared folder and read back: without lineage, and the same for each of its readers."""
    path = f"{folder(df.sparkSession, name)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` dealt over as many partitions as a shuffle has, for costly work on the rows of few or large files."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)
