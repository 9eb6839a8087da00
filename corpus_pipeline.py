"""From raw documents to token ids: five stages, each a DataFrame to DataFrame function.

Each stage gets what its predecessor kept, written as Parquet and read again;
all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.common import materialize, table
from textmill.llm.decontaminate import drop_contaminated
from textmill.llm.langid import UNKNOWN, fit_language_model, language_folds, predict_language
from textmill.llm.line_dedup import dedup_lines
from textmill.llm.minhash_dedup import minhash_keep
from textmill.llm.sentencepiece_codec import encode_documents

#: A document is rejected if its language is unknown or less likely than this.
LEAST_LANGUAGE_SCORE = 0.5


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with a probability of ``LEAST_LANGUAGE_SCORE``.

    Null and empty texts, and those without letters, are rejected; repeated
    rows are judged alike; ties go to the first language; an empty table gives
    an empty result; all columns are kept, whatever their names.
    """
    model = fit_language_model(language_folds(docs).where("not held_out"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")
    known = predict_language(docs.select("text", row), model, keep=("__row",))
    return known.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("__row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one, exactly or nearly.

    Of equal or similar lines the one with the smallest id (null last), row
    and position stays.  A document all of whose lines go is dropped; null and
    empty texts, which have no lines, stay; rows that repeat id and text stay
    alike; an empty table gives an empty result; all columns are kept.
    """
    return dedup_lines(docs, exact_chars=1)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, the smallest id.

    Rows with a null id, and texts without words, stay; rows that repeat an id
    are one document; an empty table gives an empty result; all columns are kept.
    """
    return minhash_keep(docs, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of ``benchmark``.

    Null and empty texts contain none; null ids and repeated rows are judged
    by their text; an empty benchmark or table drops nothing; all columns are kept.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids``; each text is decoded again, and the stage fails on one that does not come back.

    A null text has null ids, an empty one none; null ids and repeated rows
    pass through; extra columns are left out; an empty table gives an empty result.
    """
    coded = encode_documents(docs, check=True)
    lost = F.raise_error(F.concat(F.lit("ids do not decode to the text of document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    ids = F.when(F.coalesce("round_trip", F.lit(True)), F.col("ids")).otherwise(lost)
    return coded.select("doc_id", "n_tokens", ids.alias("ids"))


STAGES = [
    ("language_id", keep_known_language),
    ("line_dedup", drop_repeated_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("sentencepiece", encode),
]

#: The stages learn, cluster and encode, which SQL can't express; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
