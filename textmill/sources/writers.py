"""Sinks: JSON lines, partitioned Parquet, corpora, packed tokens and ledgers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from textmill.sources import storage


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_partitioned(df: DataFrame, path: str, *columns: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*columns).parquet(path)


def corpus_lines(df: DataFrame, *columns: str, one_line: bool = False) -> DataFrame:
    """One row per filled column, or one per row with columns joined by blanks; each newline becomes a blank."""
    flat = [F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "\r\n|[\r\n]", " ") for c in columns]
    if one_line:
        value = F.concat_ws(" ", *(F.when(c != "", c) for c in flat))
        return df.select(value.alias("value")).where("value <> ''")
    return df.select(F.explode(F.array(*flat)).alias("value")).where("value <> ''")


def write_text(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    lines.write.mode(mode).text(path)


def packed_tokens(docs: DataFrame, ids: Column, eos: int, vocabulary: int, *keep: str) -> DataFrame:
    """``keep`` and ``ids`` with EOS, as 16-bit values; a larger vocabulary is an error."""
    if vocabulary > 65_535:
        raise ValueError(f"a vocabulary of {vocabulary} does not fit 16 bits")
    return docs.select(*keep, F.concat(ids, F.array(F.lit(eos))).alias("ids"))


def merged(base: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """``base`` without the batch's keys, and the batch: repeating a merge changes nothing."""
    return base.join(batch.select(key).distinct(), key, "left_anti").unionByName(batch, allowMissingColumns=True)


def merge_into(spark: SparkSession, path: str, batch: DataFrame, fmt: str = "json") -> None:
    """Rebuild ``path`` from its first state and ``batch``: running again never doubles the batch.

    The first run keeps that state beside it, under ``path.base``.  A state
    whose copy came to no end is copied again: until the copy is whole
    ``path`` has not been touched.  The merged rows are written aside and
    take ``path``'s place only when they are whole.
    """
    path = path.rstrip("/")
    base, aside = f"{path}.base", f"{path}.next"
    if not storage.finished(spark, base):
        storage.remove(spark, base)
        spark.read.format(fmt).load(path).write.format(fmt).save(base)
    first = spark.read.format(fmt).load(base)
    first.unionByName(batch, allowMissingColumns=True).write.format(fmt).mode("overwrite").save(aside)
    storage.remove(spark, path)
    storage.move(spark, aside, path)


def appended(ledger: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """``ledger`` and the entries whose key it has not; of repeated entries the smallest."""
    new = entries.join(ledger.select(key), key, "left_anti").groupBy(key).agg(F.min(F.struct(*entries.columns)).alias("e")).select("e.*")
    return ledger.unionByName(new, allowMissingColumns=True)


def processed_name(path: str) -> str:
    """``v.train.jsonl`` as ``v_processed.train.jsonl``, so that no input is overwritten."""
    folder, _, name = path.rpartition("/")
    stem, dot, rest = name.partition(".")
    return f"{folder}/{stem}_processed{dot}{rest}" if folder else f"{stem}_processed{dot}{rest}"


def write_observed(df: DataFrame, path: str, metrics: list[Column], fmt: str = "json", report_path: str = "", mode: str = "overwrite") -> dict:
    """Write ``df`` and return ``metrics``, named aggregates of what was written, from the same pass over it.

    The rows are computed once: the metrics ride along with the sink's job.
    With ``report_path`` they are also written there, as one JSON line.
    """
    seen = Observation()
    df.observe(seen, *metrics).write.format(fmt).mode(mode).save(path)
    found = seen.get
    if report_path:
        df.sparkSession.createDataFrame([(json.dumps(found, ensure_ascii=False, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(report_path)
    return found


def report(spark: SparkSession, metrics: DataFrame, path: str) -> None:
    """Metrics, few rows by construction, as one JSON file."""
    metrics.coalesce(1).write.mode("overwrite").json(path)
