"""Files acted on when their signature changes, once for each change that an action has dealt with.

A pass compares the signatures ``(path, size, modified)`` of the files in a
folder with a ledger of those dealt with.  The signatures are fixed before the
action begins and enter the ledger only when it has succeeded: what a failed
action was given comes again in the next pass, and so does a file that changes
while the action runs.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.sources import storage

SIGNATURE = "path STRING, size LONG, modified TIMESTAMP"

Action = Callable[[DataFrame, DataFrame], None]


def signatures(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``(path, size, modified)`` of the files below ``folder``; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def dealt_with(spark: SparkSession, ledger: str) -> DataFrame:
    """The signatures of all passes that succeeded."""
    passes = storage.finished_folders(spark, f"{ledger}/passes/*")
    return spark.read.schema(SIGNATURE).parquet(*passes) if passes else spark.createDataFrame([], SIGNATURE)


def changed(spark: SparkSession, folder: str, ledger: str, pattern: str = "*") -> DataFrame:
    """Signatures that no pass has dealt with: new files, and files of another size or time than before."""
    return signatures(spark, folder, pattern).join(dealt_with(spark, ledger), ["path", "size", "modified"], "left_anti")


def run_pass(spark: SparkSession, folder: str, ledger: str, action: Action, pattern: str = "*", counts: str = "") -> int:
    """Run ``action(changed, all)`` if any file has changed, and return the number of files that have.

    With ``counts``, an expression, only the changes of files it holds for
    start the action; the others' come along.  An error of the action leaves
    the ledger as it was.  The ledger's passes may be any number of folders;
    each lists only its own changes.
    """
    pending = f"{ledger}/pending/{uuid.uuid4().hex}"
    changed(spark, folder, ledger, pattern).write.parquet(pending)
    found = spark.read.schema(SIGNATURE).parquet(pending)
    n = found.count()
    if not n or (counts and found.where(counts).isEmpty()):
        storage.remove(spark, pending)
        return 0
    try:
        action(found, signatures(spark, folder, pattern))
    except BaseException:
        storage.remove(spark, pending)
        raise
    storage.move(spark, pending, f"{ledger}/passes/{time.time_ns():020d}-{uuid.uuid4().hex}")
    return n


def poll(spark: SparkSession, folder: str, ledger: str, action: Action, passes: int, seconds: float = 0, pattern: str = "*", counts: str = "") -> list[int | Exception]:
    """Several passes with a pause between; a failed one is noted, and the next tries again."""
    out: list[int | Exception] = []
    for n in range(passes):
        if n and seconds:
            time.sleep(seconds)
        try:
            out.append(run_pass(spark, folder, ledger, action, pattern, counts))
        except Exception as error:  # noqa: BLE001  whatever failed is tried again
            out.append(error)
    return out
