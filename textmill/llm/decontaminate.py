"""Benchmark decontamination by size-partitioned MinHash containment, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import broadcast_if_small, join_on_row, materialize

SIZE = 5
PERCENT = 80
PERMUTATIONS = 64
ROWS = (4, 2, 1)  # rows in a band that a partition may use, most selective first
MISS = 1e-6  # a partition's bands may miss a containment at the threshold with at most this probability
#: Most benchmark shingles and band keys that are broadcast (16 bytes each); beyond, shuffled joins.
MAX_BROADCAST_ROWS = 500_000


def _words(text: str) -> str:
    """Runs of letters, marks and digits, lower-cased."""
    return f"filter(split(lower(`{text}`), '[^\\\\p{{L}}\\\\p{{M}}\\\\p{{N}}]+'), w -> w <> '')"


def _shingles(df: DataFrame, size: int, *keep: str) -> DataFrame:
    """``(keep, h)``: a row per ``size``-word shingle of ``words`` (hashes of words)."""
    placed = df.where(F.size("words") >= size).select(*keep, "words", F.explode(F.expr(f"sequence(0, size(words) - {size})")).alias("i"))
    return placed.select(*keep, F.xxhash64(F.lit(size), *(F.expr(f"words[i + {j}]") for j in range(size))).alias("h"))


def item_shingles(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """``(item_id, q, h)``: each item's distinct shingles and their number ``q``.

    An item of fewer than ``size`` words is one shingle of all its words;
    items without words are left out.  Rows that repeat an id count as one
    item of all their shingles.
    """
    hashed = benchmark.select(F.col(id_col).alias("item_id"), F.expr(f"transform({_words(text_col)}, w -> xxhash64(w))").alias("words"))
    parts = _shingles(hashed, size, "item_id").withColumn("words_in", F.lit(size))
    for n in range(1, size):
        parts = parts.unionByName(_shingles(hashed.where(F.size("words") == n), n, "item_id").withColumn("words_in", F.lit(n)))
    rows = parts.where("item_id is not null").distinct()
    counts = rows.groupBy("item_id").agg(F.count("*").alias("q"))
    return rows.join(counts, "item_id").select("item_id", "q", "h", "words_in")


def _minima(hashes: str) -> Column:
    """``PERMUTATIONS`` minima of seeded hashes of an array column."""
    return F.expr(f"transform(sequence(1, {PERMUTATIONS}), s -> array_min(transform({hashes}, x -> xxhash64(x, s))))")


def _bands(minima: str, rows: int) -> str:
    return (
        f"transform(sequence(0, {PERMUTATIONS // rows - 1}), "
        f"b -> xxhash64({rows}, b, " + ", ".join(f"{minima}[b * {rows} + {r}]" for r in range(rows)) + "))"
    )


def _rows_for(x: Column, q: Column, percent: int) -> Column:
    """Rows of a band for documents with up to ``x`` shared-vocabulary shingles and items with ``q``; 0 if bands can miss.

    At containment t the similarity is at least t*q / (x + q - t*q).
    """
    t = percent / 100
    s = F.lit(t) * q / F.greatest(x + q - F.lit(t) * q, q)
    out = F.lit(0)
    for rows in reversed(ROWS):
        out = F.when(F.pow(1 - F.pow(s, F.lit(rows)), F.lit(PERMUTATIONS // rows)) <= MISS, F.lit(rows)).otherwise(out)
    return out


def contaminations(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    size: int = SIZE,
    percent: int = PERCENT,
) -> DataFrame:
    """``(doc_id, row_key, item_id, n_item, n_shared, containment)`` of each item found in a document.

    An item is found when at least ``percent`` / 100 of its distinct shingles
    are among the document's, wherever they stand.  Only shingles of the
    benchmark's vocabulary can count, so the documents are first reduced to
    them; this loses nothing and makes short items in long documents as
    similar as the documents' other benchmark text allows.  The reduced sets
    are partitioned by size, to powers of two; each partition and item size
    uses the most selective bands that miss a containment at the threshold
    with a probability under ``MISS``, and where none does, items are found
    through each shared shingle.  Candidates are verified on the exact sets.

    Null texts and texts without words contain nothing; null ids of documents
    are allowed, rows that repeat id and text give one result; an empty
    benchmark or table gives an empty result; extra columns are ignored.
    """
    items = materialize(item_shingles(benchmark, item_id_col, item_text_col, size), "items")
    kinds = items.groupBy("words_in").agg(F.min(F.ceil(F.col("q") * percent / 100)).alias("least")).collect()  # at most ``size`` rows
    vocabulary = broadcast_if_small(items.select("h").distinct(), MAX_BROADCAST_ROWS)
    hashed = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_key"),
        F.expr(f"transform({_words(text_col)}, w -> xxhash64(w))").alias("words"),
    )
    found = None
    for kind in kinds:
        part = _shingles(hashed, kind["words_in"], "doc_id", "row_key").join(vocabulary, "h", "left_semi")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = _shingles(hashed, size, "doc_id", "row_key").limit(0)
    least = min((k["least"] for k in kinds), default=1)
    sets = (
        found.groupBy("doc_id", "row_key").agg(F.collect_set("h").alias("hits")).where(F.size("hits") >= least)
        .withColumn("x", F.expr("cast(pow(2, ceil(log2(size(hits)))) as int)"))
    )
    sets = materialize(sets, "hits")
    wanted = materialize(items.groupBy("item_id", "q").agg(F.collect_set("h").alias("wanted")), "wanted")

    sizes = [r["x"] for r in sets.select("x").distinct().collect()]  # powers of two, so no more than 32
    plan = (
        wanted.withColumn("mins", _minima("wanted"))
        .withColumn("x", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>")))
        .where(F.col("x") >= F.col("q") * percent / 100)
        .withColumn("rows", _rows_for(F.col("x"), F.col("q"), percent))
    )
    plan = materialize(plan.select("item_id", "q", "x", "rows", "mins", "wanted"), "plan")
    used = [r["rows"] for r in plan.select("rows").distinct().collect()]  # at most four values
    signed = sets.withColumn("mins", _minima("hits"))
    pairs = None
    for rows in used:
        if rows:
            left = signed.select("doc_id", "row_key", "x", F.explode(F.expr(_bands("mins", rows))).alias("key"))
            right = plan.where(F.col("rows") == rows).select("item_id", "x", F.explode(F.expr(_bands("mins", rows))).alias("key"))
        else:
            left = sets.select("doc_id", "row_key", "x", F.explode("hits").alias("key"))
            right = plan.where(F.col("rows") == 0).select("item_id", "x", F.explode("wanted").alias("key"))
        some = left.join(broadcast_if_small(right, MAX_BROADCAST_ROWS), ["x", "key"]).select("doc_id", "row_key", "item_id").distinct()
        pairs = some if pairs is None else pairs.unionByName(some)
    if pairs is None:
        pairs = sets.select("doc_id", "row_key", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id")).limit(0)
    left = sets.select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key"), "hits")
    checked = (
        pairs.join(broadcast_if_small(wanted, 20_000), "item_id")
        .join(left, (F.col("row_key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")))
        .withColumn("n_shared", F.size(F.array_intersect("hits", "wanted")).cast("long"))
        .where(F.col("n_shared") * 100 >= F.col("q") * percent)
    )
    return checked.select(
        "doc_id", "row_key", "item_id", F.col("q").cast("long").alias("n_item"), "n_shared", (F.col("n_shared") / F.col("q")).alias("containment")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that contain a benchmark item; the columns stay as they are."""
    found = contaminations(docs, benchmark, id_col, text_col, **options)
    return join_on_row(docs, found.select("doc_id", "row_key").distinct(), id_col, text_col, "left_anti")
