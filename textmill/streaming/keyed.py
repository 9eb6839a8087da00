"""A sink of one row per key for the batches of a stream.

Rows are dealt to buckets by a hash of their key.  A batch rewrites only the
buckets it touches, into a folder of its own, and then commits a small table
that names the folder of every bucket.  Readers follow the last commit, so a
batch is there wholly or not at all; a batch that comes again after its commit
changes nothing, and one that failed before it leaves files nobody reads,
which the next commit removes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.sources import storage

BUCKETS = 16


def _commits(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    return [(int(p.rsplit("/", 1)[1]), p) for p in storage.finished_folders(spark, f"{path}/commits/*")]


def _named(spark: SparkSession, commit: str) -> dict[int, str]:
    """Folder by bucket; at most one row a bucket."""
    return {r.bucket: r.folder for r in spark.read.schema("bucket INT, folder STRING").parquet(commit).collect()}


def rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What the sink holds by its last commit."""
    done = _commits(spark, path)
    parts = [f"{path}/data/{folder}/bucket={b}" for b, folder in sorted(_named(spark, done[-1][1]).items())] if done else []
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def upsert(path: str, keys: list[str], first_by: list[str] | None = None, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` write that merges a batch into the sink by ``keys``.

    A key's row of a later batch takes the place of the one before, as the
    update mode of an aggregation wants; within a batch a key must then have
    one row.  With ``first_by`` the row that is first by those columns stays,
    whatever the order of arrival.  A sink belongs to one checkpoint, as batch
    ids are compared.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = _commits(spark, path)
        if done and done[-1][0] >= batch_id:
            return  # it has been committed
        named = _named(spark, done[-1][1]) if done else {}
        columns = batch.columns
        held = batch.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).withColumn("__batch", F.lit(batch_id)).persist()
        try:
            touched = [r[0] for r in held.select("__bucket").distinct().collect()]  # at most ``buckets``
            if touched:
                before = [f"{path}/data/{named[b]}/bucket={b}" for b in touched if b in named]
                merged = held
                if before:
                    old = spark.read.schema(batch.schema).parquet(*before)
                    old = old.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).withColumn("__batch", F.lit(batch_id - 1))
                    merged = held.unionByName(old)
                pick = F.min_by if first_by else F.max_by
                place = F.struct(*first_by, "__batch") if first_by else F.col("__batch")
                own = merged.groupBy("__bucket", *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(pick(F.struct(*columns), place).alias("r"))
                folder = f"{batch_id:020d}-{uuid.uuid4().hex}"
                own.select(F.col("__bucket").alias("bucket"), "r.*").repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/data/{folder}")
                named |= dict.fromkeys(touched, folder)
        finally:
            held.unpersist()
        commit = f"{path}/commits/{batch_id:020d}"
        spark.createDataFrame(list(named.items()), "bucket INT, folder STRING").coalesce(1).write.mode("overwrite").parquet(commit)
        _sweep(spark, path, named, done)

    return write


def _sweep(spark: SparkSession, path: str, named: dict[int, str], done: list[tuple[int, str]]) -> None:
    """Remove what neither the last commit nor the one before, which readers may still follow, names."""
    live = set(named.values()) | (set(_named(spark, done[-1][1]).values()) if done else set())
    for folder in storage.matching(spark, f"{path}/data/*"):
        if folder.rsplit("/", 1)[1] not in live:
            storage.remove(spark, folder)
    for _, commit in done[:-1]:
        storage.remove(spark, commit)
