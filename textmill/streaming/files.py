"""File streams: keep-first rows and running metrics, at least once into idempotent sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def watch(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet", files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(folder)


def keep_first_stream(rows: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """The first row seen of each key within the watermark; state older than ``delay`` goes."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(rows: DataFrame, time: str, group: str, value: str, window: str = "1 day", delay: str = "2 days") -> DataFrame:
    return rows.withWatermark(time, delay).groupBy(F.window(time, window), group).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), group, "n", "total")


def into(rows: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run what has arrived through ``write(batch, batch_id)``; a batch may come again, so the write replaces by batch id."""
    query = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()


def replace_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A write that a repeated batch overwrites."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
