"""Scans: JSON lines, text, Parquet and nested JSON, with schemas given rather than inferred."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from textmill.sources import scratch

SAMPLE = "id STRING, input STRING, cot STRING, answer STRING, meta STRUCT<source: STRING, lang: STRING, category: STRING, date_created: STRING, has_cot: BOOLEAN, arith_style: STRING, cot_quality_score: DOUBLE, cot_status: STRING, needs_manual_review: BOOLEAN, task: STRING, kind: STRING>"
DOCUMENT = "src STRING, text STRING"
EVAL_ITEM = "id STRING, category STRING, type STRING, input STRING, behavior STRING, expected_any ARRAY<STRING>, source STRING, domain STRING"
SQUAD = "data ARRAY<STRUCT<title: STRING, paragraphs: ARRAY<STRUCT<context: STRING, qas: ARRAY<STRUCT<id: STRING, question: STRING, is_impossible: BOOLEAN, answers: ARRAY<STRUCT<text: STRING, answer_start: INT>>>>>>>>"


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped, a malformed one fails the job unless ``strict`` is off."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def nested_json(spark: SparkSession, path: str, schema: str = SQUAD) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def found_json(spark: SparkSession, folders: list[str], name: str, schema: str = SQUAD) -> DataFrame:
    """The nested JSON file called ``name`` anywhere below the first of ``folders`` that has one."""
    for folder in folders:
        reader = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name)
        try:
            found = reader.json(folder)
        except AnalysisException:  # no such folder: the next one
            continue
        if found.inputFiles():
            return found
    raise FileNotFoundError(f"{name} is in none of {', '.join(folders)}")


def source_documents(rows: DataFrame, source: str = "wiki") -> DataFrame:
    """Texts of one source; a missing source counts as ``wiki``."""
    return rows.where(F.coalesce("src", F.lit("wiki")) == source).select("text")


def line_sources(lines: DataFrame) -> DataFrame:
    """``value`` with ``src``, read from the head of a JSON line without parsing it; null for lines of another shape."""
    head = F.regexp_extract("value", r'^\{"src": "([^"]*)"', 1)
    return lines.withColumn("src", F.when(F.rlike("value", F.lit(r'^\{"src": "[^"]*"')), head))


def eval_items(spark: SparkSession, path: str, fallback: DataFrame, n: int = 0) -> DataFrame:
    """The first ``n`` items of a JSON-lines file by id (0: all), or ``fallback`` if there is no file."""
    found, _ = first_readable(spark, [path], EVAL_ITEM)
    items = fallback if found is None else found
    return items.orderBy("id").limit(n) if n else items


def text_lines(spark: SparkSession, path: str, drop_empty: bool = True) -> DataFrame:
    lines = spark.read.text(path)
    return lines.where("value <> ''") if drop_empty else lines


def resolved(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet by its suffix, else JSON lines."""
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else jsonl(spark, path, schema)


def first_readable(spark: SparkSession, paths: list[str], schema: str) -> tuple[DataFrame | None, str | None]:
    """The first path that can be read, and its name; nothing if none can."""
    for path in paths:
        try:
            return resolved(spark, path, schema), path
        except AnalysisException:  # missing or unreadable: the next candidate
            continue
    return None, None


def all_readable(spark: SparkSession, paths: list[str], schema: str) -> tuple[DataFrame | None, list[str]]:
    """Bag union of the paths that can be read, with ``path``; and the names of the others."""
    found, missing = [], []
    for path in paths:
        df, _ = first_readable(spark, [path], schema)
        found.append(df.withColumn("path", F.lit(path))) if df is not None else missing.append(path)
    return (reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found) if found else None), missing


def quarantined(spark: SparkSession, sources: dict[str, str], schema: str, most_bad: float = 0.5, record: str = "_record") -> tuple[DataFrame, DataFrame, DataFrame]:
    """JSON-lines sources as ``(rows, quarantine, summary)``, judged before any job uses them.

    ``quarantine`` is ``(source, file, record)`` of lines that are no JSON of
    the schema.  ``summary`` has ``source, n, n_bad, state``: a source that
    can't be opened is ``missing``, one with more than a share of ``most_bad``
    of such lines ``rejected``, and neither has rows; others are ``used``.
    Blank lines are no records.  Lines are parsed once and written with their
    verdict, since rows and quarantine are both read from them.
    """
    parts, missing = [], []
    fields = StructType.fromDDL(schema)
    for name, path in sources.items():
        try:
            lines = spark.read.schema(StructType([*fields, StructField(record, StringType())])).option("columnNameOfCorruptRecord", record).json(path)
        except AnalysisException:  # no such path
            missing.append(name)
            continue
        parts.append(lines.select(F.lit(name).alias("source"), F.col("_metadata.file_path").alias("file"), F.struct(*fields.names).alias("row"), record))
    tables = "source string, n long, n_bad long, state string"
    lost = spark.createDataFrame([(name, 0, 0, "missing") for name in missing], tables)
    if not parts:
        return spark.createDataFrame([], f"source string, {schema}"), spark.createDataFrame([], "source string, file string, record string"), lost
    held = scratch.kept(reduce(DataFrame.unionByName, parts), "lines")
    bad = F.col(record).isNotNull()
    state = F.when(F.col("n_bad") > most_bad * F.col("n"), "rejected").otherwise("used")
    found = held.groupBy("source").agg(F.count("*").alias("n"), F.count_if(bad).alias("n_bad")).withColumn("state", state)
    used = [r.source for r in found.where("state = 'used'").collect()]  # a row a source
    rows = held.where(~bad & F.col("source").isin(*used)).select("source", "row.*")
    return rows, held.where(bad).select("source", "file", F.col(record).alias("record")), found.unionByName(lost)


def readable_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the Parquet files in ``folder`` that can be read, and ``(file)`` of those that gave none.

    A corrupt file neither fails the scan nor hides: it is listed, as is one without rows.
    """
    rows = spark.read.option("ignoreCorruptFiles", True).parquet(folder)
    seen = rows.select(F.col("_metadata.file_path").alias("file")).distinct()
    named = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder)
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    lost = named.select("path").join(seen, base(F.col("path")) == base(F.col("file")), "left_anti")
    return rows, lost.select(F.col("path").alias("file"))


def cleaned_head(raw: DataFrame, order: str, n: int, clean: Column, text: str = "text") -> DataFrame:
    """``(order, text)`` of the first ``n`` raw rows in order that are still there once cleaned; 0 for all rows.

    The rows are counted before they are cleaned, as a bounded download is.
    """
    head = raw.orderBy(order).limit(n) if n else raw
    return head.select(order, clean.alias(text)).where(F.col(text).isNotNull())


def after_prefix(df: DataFrame, order: str, n: int) -> DataFrame:
    """Rows from the ``n``-th on in order, by a threshold instead of a sort of all rows."""
    if n <= 0:
        return df
    head = df.select(order).orderBy(order).limit(n).agg(F.max(order)).first()[0]
    return df if head is None else df.where(F.col(order) > head)


def newest_file(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Path, length and time of the file whose name is last in order; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", "length", "modificationTime", name.alias("name")).groupBy().agg(F.max_by(F.struct("path", "length", "modificationTime"), "name").alias("f")).select("f.*")


def keyword_column(df: DataFrame) -> str | None:
    """The first column of string lists whose name speaks of keywords or expected answers and that has a filled list.

    One pass over those columns alone.
    """
    named = [f.name for f in df.schema.fields if f.dataType.simpleString() == "array<string>" and re.search("word|keyword|expect|must|answer", f.name)]
    if not named:
        return None
    filled = df.agg(*(F.max((F.size(F.col(f"`{n}`")) > 0).cast("int")).alias(str(i)) for i, n in enumerate(named))).first()
    return next((n for n, some in zip(named, filled, strict=True) if some), None)
