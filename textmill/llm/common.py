"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share.

    It is ``spark.checkpoint.dir``.  Where the session names none, as in local
    tests, a temporary folder is set; on a cluster that is an error, as each
    machine would write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = current.get() if current.isDefined() else None
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="textmill-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return str(named).rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The result has no lineage: it survives lost executors and is not computed
    again by each of its consumers.
    """
    path = f"{shared_dir(df.sparkSession)}/textmill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._textmill_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files behind a :func:`materialize` result that nothing reads any more."""
    path = getattr(df, "_textmill_path", None)
    if path:
        jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def extended(df: DataFrame, more: str, skip: int = 1) -> StructType:
    """The schema of ``df`` without its first ``skip`` columns and with those of the DDL string ``more``."""
    return StructType([*df.schema.fields[skip:], *StructType.fromDDL(more).fields])


def fold(column: str | Column, buckets: int) -> Column:
    """``crc32(column as text) mod buckets``, null for null."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % buckets


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(df: DataFrame, id_col: str, text_col: str) -> Column:
    """A hash of a row's id and text; with the id itself it stands for the row."""
    return F.xxhash64(df[id_col], df[text_col])


def join_on_row(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    """``docs`` joined with ``found`` ``(doc_id, row_key, ...)`` by row, null ids included; for inner joins and outer ones
    the other columns of ``found`` must not be in ``docs``."""
    one, two = fresh(docs, "found_id"), fresh(docs, "found_key")
    other = found.withColumnsRenamed({"doc_id": one, "row_key": two})
    return docs.join(other, (row_key(docs, id_col, text_col) == other[two]) & docs[id_col].eqNullSafe(other[one]), how)


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; reads no more than that plus one."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``broadcast(df)`` when its row count is within ``max_rows``, else ``df`` for a shuffled join."""
    return F.broadcast(df) if small_enough(df, max_rows) else df
