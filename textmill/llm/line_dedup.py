"""Fuzzy duplicate lines by MinHash of character shingles, in DataFrame functions only."""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import broadcast_if_small, discard, fresh, join_on_row, materialize, small_enough
from textmill.llm.neardup import LANES, agreeing, band_keys, components, packed, words_of

SHINGLE = 5  # characters (code points)
PERCENT = 80
MIN_CHARS = 16  # characters of a line that is compared by its shingles
CELLS, SIDE = 6, 8
BINS = CELLS * SIDE
#: Bins read by each band, a bin of each of six rows of eight.  At similarity 0.8 a pair with independent bins misses
#: all of the bands with a probability under 0.02.
BANDS = tuple(tuple(row * SIDE + (slope * row + start) % SIDE for row in range(CELLS)) for slope in range(3) for start in range(SIDE))[:18]
#: Equal minima of a pair worth verifying; at similarity 0.8 a pair has fewer with probability 0.004.
LEAST_AGREEING = 31
LEAST_SHARED = LEAST_AGREEING + -BINS % LANES  # unused lanes of a signature are equal
#: Most pairs of a bucket that are made one by one; in buckets with more, rows meet in the join itself.
MOST_MEETINGS = 4096
#: Most line keys that are broadcast (8 bytes each); beyond, a shuffled join.
MAX_BROADCAST_KEYS = 1_000_000
#: A line of ``CROWDED`` shingles or more has some in most cells of 2 ** CELL_BITS hashes; from there on, each doubling
#: halves the part of a cell that is looked at, at most ``MOST_HALVINGS`` times.
CROWDED, CELL_BITS, MOST_HALVINGS, HEAD = 192, 56, 3, 64


#: Cells of a block; a bin's cell and the cells nearest to it are all in one block.
BLOCK = 8
#: Points of a block's cells lie far apart within them, so that two bins which borrow from a third take different hashes.
CELL_STEP = random.Random(5).getrandbits(CELL_BITS) | 1
#: The fixed point of each bin, in a cell of its own; bins at the same place of two blocks have theirs at the same place of the cell.
POINTS = tuple((cell << CELL_BITS) + cell % BLOCK * CELL_STEP % (1 << CELL_BITS) for cell in range(BINS))


def _canonical(line: str) -> str:
    """SQL of a line without outer blanks; lines that have none, nearly all, are passed on unread."""
    ends = " OR ".join(f"{test}({line}, '{blank}')" for blank in (" ", "\\t", "\\r", "\\n") for test in ("startswith", "endswith"))
    return f"if({ends}, btrim({line}, ' \\t\\r\\n'), {line})"


def _row_key(id_col: str, text_col: str) -> list[Column]:
    return [F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_key")]


def _distinct_lines(docs: DataFrame, text_col: str, least_chars: int) -> DataFrame:
    """``(k, line, weight)`` of each line of ``least_chars`` characters or more, with its number of occurrences.

    Copies are combined before the shuffle.  If two lines share a key, their
    weight is 1 and the key stands for the smaller one alone.
    """
    lines = docs.select(F.explode(F.split(text_col, "\n")).alias("line")).select(F.expr(_canonical("line")).alias("line"))
    keyed = lines.where(F.length("line") >= least_chars).select(F.xxhash64("line").alias("k"), F.hash("line").alias("check"), "line")
    counts = keyed.groupBy("k").agg(F.min("line").alias("line"), F.count("*").alias("n"), F.min("check").alias("lo"), F.max("check").alias("hi"))
    return counts.select("k", "line", F.expr("if(lo = hi, n, 1)").alias("weight"))


def _minima(lines: DataFrame, min_chars: int) -> DataFrame:
    """``(k, weight, fuzzy, m0, m1, ...)`` for ``(k, line, weight)``: the shingle hash nearest to a fixed point of each bin.

    A bin's point lies in a cell of its own; a line's minimum is the distance
    (exclusive or) of its nearest hash, in the cell or else in one nearby, so
    no bin is empty.  Distances between blocks of cells do not change which of
    a block's hashes is nearest, so a hash is compared with the ``BLOCK``
    points of its own block, and only the nearest ones with all points.  Where a line has so many shingles that each cell holds
    some, only those near the cells' points can be nearest and go on to the
    aggregation: a hash that is left out changes a minimum only where its
    cell keeps none, and then for all lines of such a length alike.  The first
    ``HEAD`` shingles always go on, for lines that repeat a few shingles.

    Exploding positions keeps the hashing in generated code; in UTF-32 each
    character has four bytes and is found without a scan.  The partition id
    makes ``units`` and ``h`` non-deterministic for the optimizer, so that a
    line is encoded once, not for each shingle, and aggregates read ``h`` and
    do not hash again.
    """
    n = F.greatest(F.lit(1), F.length("line") - (SHINGLE - 1))
    units = F.expr("encode(if(spark_partition_id() < 0, '', line), 'UTF-32')")
    once = F.spark_partition_id() * 0
    steps = " ".join(f"WHEN n < {CROWDED << halved} THEN {1 << CELL_BITS - halved + 1}L" for halved in range(1, MOST_HALVINGS + 1))
    near = F.expr(f"CASE WHEN n < {CROWDED} THEN {1 << CELL_BITS}L {steps} ELSE {1 << CELL_BITS - MOST_HALVINGS}L END") + once
    sized = lines.select("k", "weight", (F.length("line") >= min_chars).alias("fuzzy"), units.alias("units"), n.alias("n"))
    sized = sized.select("*", near.alias("near"))
    placed = sized.select("k", "weight", "fuzzy", "units", "near", F.explode(F.expr("sequence(1, n)")).alias("i"))
    hashed = placed.select("k", "weight", "fuzzy", "i", "near", (F.expr(f"xxhash64(substring(units, 4 * i - 3, {4 * SHINGLE}))") + once).alias("x"))
    cell = f"shiftright((x & 255) * {BINS}, 8)"
    hashed = hashed.select("k", "weight", "fuzzy", "i", "near", (F.expr(f"shiftleft({cell}, {CELL_BITS}) | shiftrightunsigned(x, 8)") + once).alias("h"))
    hashed = hashed.where(f"i <= {HEAD} OR (h ^ shiftright(h, {CELL_BITS}) % {BLOCK} * {CELL_STEP}L) & {(1 << CELL_BITS) - 1}L < near")
    block = f"shiftright(h, {CELL_BITS + BLOCK.bit_length() - 1})"
    tagged = hashed.select("k", F.expr(f"weight * {2 * BINS // BLOCK} + {block} * 2 + int(fuzzy)").alias("tag"), "h")
    nearest = tagged.groupBy("k", "tag").agg(*(F.min(F.expr(f"h ^ {POINTS[i]}L")).alias(f"b{i}") for i in range(BLOCK)))
    line = [F.expr(f"tag div {2 * BINS // BLOCK}").alias("weight"), F.expr("tag % 2 = 1").alias("fuzzy")]
    minima = [F.min(F.expr(f"b{j % BLOCK} ^ {POINTS[j % BLOCK] ^ p}L")).alias(f"m{j}") for j, p in enumerate(POINTS)]
    return nearest.groupBy("k", *line).agg(*minima)


def line_signatures(docs: DataFrame, text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``(k, m0, m1, ...)`` for each distinct line: its ``BINS`` minima over shingles."""
    return _minima(_distinct_lines(docs, text_col, min_chars), min_chars).drop("weight", "fuzzy")


def _places(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, least_chars: int) -> DataFrame:
    """``(doc_id, row_key, pos, k, line)`` of each occurrence of a ``wanted`` ``(k, text)`` line; ``line`` is null without ``text``."""
    placed = (
        docs.select(*_row_key(id_col, text_col), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
        .withColumn("line", F.expr(_canonical("line")))
        .where(F.length("line") >= least_chars)
        .withColumn("k", F.xxhash64("line"))
    )
    found = placed.join(broadcast_if_small(wanted, MAX_BROADCAST_KEYS), "k")
    return found.select("doc_id", "row_key", "pos", "k", F.when(F.col("text"), F.col("line")).alias("line"))


def _shingle_set(line: str) -> str:
    """SQL: the distinct shingle hashes of a line; the encoded line is bound to a lambda's variable, which is passed on without a copy for each shingle."""
    each = f"xxhash64(substring(u, 4 * i - 3, {4 * SHINGLE}))"
    return f"transform(array(encode({line}, 'UTF-32')), u -> array_distinct(transform(sequence(1, greatest(1, length({line}) - {SHINGLE - 1})), i -> {each})))[0]"


def _similar(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of the ``pairs`` ``(a, b)`` whose lines' whole sets of shingles are similar enough; ``texts`` is ``(k, line)``.

    Sets are made before the joins, once for each line of a side and not for each pair.
    """

    def side(end: str, items: str) -> DataFrame:
        asked = texts.join(pairs.select(F.col(end).alias("k")).distinct(), "k", "left_semi")
        return asked.select(F.col("k").alias(end), F.expr(_shingle_set("line")).alias(items))

    met = pairs.join(side("b", "sb"), "b").join(side("a", "sa"), "a")
    return met.where(f"{100 + percent} * size(array_intersect(sa, sb)) >= {percent} * (size(sa) + size(sb))").select("a", "b")


def _linked_components(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges ``(a, b)`` between the components of linked rows ``(bucket, node, c, stray)`` of a bucket; ``sets`` is ``(node, items)``.

    Sets are intersected in the join itself, which makes a row for a link, not for a pair.
    """
    held = rows.join(sets, "node").withColumn("n", F.size("items"))
    x, y = held.where("stray").alias("x"), held.alias("y")
    met = (
        "x.bucket = y.bucket AND x.c <> y.c AND (NOT y.stray OR x.node < y.node) AND "
        f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) AND "
        f"{100 + percent} * size(array_intersect(x.items, y.items)) >= {percent} * (x.n + y.n)"
    )
    return x.join(y, F.expr(met)).select(F.expr("least(x.c, y.c) AS a"), F.expr("greatest(x.c, y.c) AS b")).distinct()


def _meetings(rows: DataFrame, signatures: DataFrame) -> DataFrame:
    """Distinct pairs ``(a, b)`` of rows ``(bucket, node, c, stray)`` of a bucket that may link two components; signatures rule out most."""
    words = words_of(signatures)
    signed = rows.join(signatures.select("node", *words), "node")
    x, y = signed.where("stray").alias("x"), signed.alias("y")
    met = f"x.bucket = y.bucket AND x.c <> y.c AND (NOT y.stray OR x.node < y.node) AND {agreeing('x', 'y', words)} >= {LEAST_SHARED}"
    return x.join(y, F.expr(met)).select(F.expr("least(x.node, y.node) AS a"), F.expr("greatest(x.node, y.node) AS b")).distinct()


def removed_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    percent: int = PERCENT,
    exact_chars: int | None = None,
) -> DataFrame:
    """``(doc_id, row_key, removed)``: positions of the lines to remove, for rows that have any.

    Lines are the parts of the text between newlines, compared without outer
    blanks, tabs and carriage returns.  Equal lines, and lines whose sets of
    ``SHINGLE``-character shingles have a similarity of ``percent`` / 100, are in
    one component, of which the first line stays: the smallest doc_id (null
    last), row key and position.  Lines under ``min_chars`` characters are
    compared by equality only, and not judged under ``exact_chars``, which is
    ``min_chars`` if not given; 1 judges every line that is not blank.  Rows
    that repeat both id and text are treated alike.  Null and empty texts have
    no lines to remove; an empty table gives an empty result.
    """
    judged = min_chars if exact_chars is None else max(1, min(exact_chars, min_chars))
    minima = _minima(_distinct_lines(docs, text_col, judged), min_chars)
    words = [F.expr(word).alias(f"s{i}") for i, word in enumerate(packed([f"m{j}" for j in range(BINS)]))]
    signatures = materialize(minima.select(F.col("k").alias("node"), "weight", "fuzzy", *words), "lines")
    repeated = signatures.where("weight > 1").select(F.col("node").alias("k"))
    placed: list[DataFrame] = []
    texts: list[DataFrame] = []

    def texts_of(nodes: DataFrame) -> DataFrame:
        """``(k, line)`` of all nodes asked for so far; each is looked up once."""
        ends = nodes.join(texts[-1].select("k"), "k", "left_anti") if texts else nodes
        wanted = ends.withColumn("text", F.lit(True))
        if not placed:  # one scan serves the repeated lines too
            wanted = wanted.unionByName(repeated.withColumn("text", F.lit(False))).groupBy("k").agg(F.max("text").alias("text"))
        wanted = materialize(wanted, "wanted")
        if texts and small_enough(wanted, 0):
            discard(wanted)
            return texts[-1]
        placed.append(materialize(_places(docs, id_col, text_col, wanted, judged), "places"))
        discard(wanted)
        found = placed[-1].where("line is not null").groupBy("k").agg(F.min("line").alias("line"))
        texts.append(texts[-1].unionByName(found) if texts else found)
        return texts[-1]

    def verify(pairs: DataFrame) -> DataFrame:
        return _similar(pairs, texts_of(pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct()), percent)

    def residual(rows: DataFrame) -> DataFrame:
        """Links of the rows of buckets that make few pairs, pair by pair; of the others, edges by :func:`_linked_components`."""
        sizes = rows.groupBy("bucket").agg((F.count("*") * F.count_if("stray") > MOST_MEETINGS).alias("crowded"))
        sized = rows.join(sizes, "bucket")
        pairs = materialize(_meetings(sized.where("not crowded"), signatures), "pairs")
        crowded = materialize(sized.where("crowded").drop("crowded"), "crowded")
        found = materialize(verify(pairs), "links")
        discard(pairs)
        return found if small_enough(crowded, 0) else found.unionByName(crowded_links(crowded))

    def crowded_links(rows: DataFrame) -> DataFrame:
        nodes = rows.select(F.col("node").alias("k")).distinct()
        sets = texts_of(nodes).join(nodes, "k", "left_semi").select(F.col("k").alias("node"), F.expr(_shingle_set("line")).alias("items"))
        return _linked_components(rows, sets, percent)

    near = components(signatures.where("fuzzy").drop("fuzzy"), band_keys(BANDS), LEAST_SHARED, verify, residual)
    ends = near.select(F.col("node").alias("k"), F.col("component").alias("c")).unionByName(
        near.select(F.col("component").alias("k"), F.col("component").alias("c"))
    )
    groups = repeated.select("k", F.col("k").alias("c"), F.lit(0).alias("fuzzy")).unionByName(ends.distinct().withColumn("fuzzy", F.lit(1)))
    groups = groups.groupBy("k").agg(F.max_by("c", "fuzzy").alias("c"))
    where = reduce(DataFrame.unionByName, placed)
    hits = materialize(where.drop("line").join(groups, "k").select("c", "doc_id", "row_key", "pos"), "hits")
    for done in (signatures, *placed):
        discard(done)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key", "pos")
    first = hits.groupBy("c").agg(F.min(place).alias("first"))
    gone = hits.join(first, "c").where(~place.eqNullSafe(F.col("first")))
    return gone.groupBy("doc_id", "row_key").agg(F.sort_array(F.collect_set("pos")).alias("removed"))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    percent: int = PERCENT,
    drop_emptied: bool = True,
    exact_chars: int | None = None,
) -> DataFrame:
    """``docs`` without the lines of :func:`removed_lines`; the columns stay as they are.

    With ``drop_emptied`` a row all of whose non-blank lines are copies of
    lines elsewhere goes; rows that had no text before stay.
    """
    gone = fresh(docs, "removed")
    found = removed_lines(docs, id_col, text_col, min_chars, percent, exact_chars).withColumnRenamed("removed", gone)
    joined = join_on_row(docs, found, id_col, text_col, "left")
    rest = F.expr(f"array_join(filter(split(`{text_col}`, '\\n'), (l, i) -> NOT array_contains(`{gone}`, i)), '\\n')")
    out = joined.withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(rest))
    if drop_emptied:
        out = out.where(F.col(gone).isNull() | (F.length(F.expr(_canonical(f"`{text_col}`"))) > 0))
    return out.select(*(f"`{c}`" for c in docs.columns))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: ``doc_id, n_lines, n_removed, removed`` (positions, ascending)."""
    gone = removed_lines(docs, id_col, text_col, **options).select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key"), "removed")
    base = docs.select(*_row_key(id_col, text_col), F.coalesce(F.size(F.split(text_col, "\n")), F.lit(0)).alias("n_lines"))
    joined = base.join(gone, (F.col("row_key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return joined.select("doc_id", F.col("n_lines").cast("long"), F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))
