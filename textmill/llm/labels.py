"""A bounded, labelled sample to fit on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import fold, materialize


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, max_rows: int) -> DataFrame:
    """``(text, label)`` of at most about ``max_rows`` labelled documents outside the held-out fold, written once.

    The documents are chosen by a hash of their id, so the choice is spread
    over the table and stays the same.  Rows without an id, a label or a text
    are not used; of repeated labels of an id the largest counts, of repeated
    documents the smallest text, so an id gives one row however often it
    occurs.  The labels kept are bounded by ``max_rows``, hence broadcast.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold("doc_id", folds) != held_out))
        .groupBy(F.col("doc_id").alias("known_id"))
        .agg(F.max(label).cast("int").alias("label"))
    )
    total = known.count()
    if total > max_rows:
        known = known.where(F.pmod(F.xxhash64("known_id", F.lit("fit")), F.lit(1_000_000)) < int(1_000_000 * max_rows / total))
    texts = docs.select(F.col("doc_id").alias("own_id"), "text").where("text is not null")
    met = texts.join(F.broadcast(known), F.col("own_id") == F.col("known_id"))
    return materialize(met.groupBy("known_id", "label").agg(F.min("text").alias("text")).select("text", "label"), "labelled")


def held_out_column(docs: DataFrame, folds: int, held_out: int) -> DataFrame:
    """``docs`` with ``held_out``: crc32 of the id as text, modulo ``folds``, is ``held_out`` (false for a null id)."""
    return docs.withColumn("held_out", F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)))
