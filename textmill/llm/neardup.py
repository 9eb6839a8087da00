"""From packed MinHash signatures to verified near-duplicate components."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import discard, materialize, small_enough
from textmill.llm.graph import connected_components

LANES = 7  # minima in a word of a signature, seven bits of each in a byte
_TOPS = int("80" * LANES, 16)
#: A bucket is hot if a sample of ``SAMPLE`` signatures holds ``HOT`` of its members, so hot buckets are few at any size.
SAMPLE, HOT = 200_000, 64


def packed(minima: Sequence[str]) -> list[str]:
    """SQL of the words of a signature from that of its minima."""
    lanes = [f"shiftleft({m} & 127, {8 * (i % LANES)})" for i, m in enumerate(minima)]
    return [" | ".join(lanes[i : i + LANES]) for i in range(0, len(lanes), LANES)]


def band_keys(bands: Sequence[Sequence[int]]) -> list[str]:
    """SQL of a hash of each band's minima, from the words ``s0, s1, ...``."""
    keys = []
    for number, band in enumerate(bands):
        masks: dict[int, int] = {}
        for i in band:
            masks[i // LANES] = masks.get(i // LANES, 0) | 127 << 8 * (i % LANES)
        keys.append(f"xxhash64({number}, " + ", ".join(f"s{w} & {mask}L" for w, mask in sorted(masks.items())) + ")")
    return keys


def words_of(signatures: DataFrame) -> list[str]:
    return [c for c in signatures.columns if c[0] == "s" and c[1:].isdigit()]


def agreeing(one: str, two: str, words: Sequence[str]) -> str:
    """SQL: how many minima of two signatures are equal (in the bits kept); unused lanes count as equal.

    The top bit of a byte survives the subtraction only where the bytes are equal.
    """
    return " + ".join(f"bit_count(({_TOPS}L - ({one}.{w} ^ {two}.{w})) & {_TOPS}L)" for w in words)


def verified_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` whose full sets have ``100 * |A and B| >= percent * |A or B|``.

    ``sets`` holds ``(node, items)`` with distinct items.
    """
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("ia"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("ib"))
    shared = F.size(F.array_intersect("ia", "ib"))
    scored = pairs.join(left, "a").join(right, "b").select(
        "a", "b", shared.alias("shared"), (F.size("ia") + F.size("ib")).alias("total")
    )
    return scored.where(F.col("shared") * 100 >= (F.col("total") - F.col("shared")) * percent).select("a", "b").distinct()


def likely_pairs(pairs: DataFrame, signatures: DataFrame, least: int) -> DataFrame:
    """Pairs ``(a, b)`` whose signatures agree in ``least`` minima or more."""
    words = words_of(signatures)
    left = signatures.select(F.col("node").alias("a"), *(F.col(w).alias(f"{w}_") for w in words))
    right = signatures.select(F.col("node").alias("b"), *words)
    joined = pairs.join(left, "a").join(right, "b")
    same = agreeing("x", "y", words).replace("y.", "").replace("x.", "")
    for w in words:
        same = same.replace(f"({w} ^ {w})", f"({w}_ ^ {w})")
    return joined.where(F.expr(f"{same} >= {least}")).select("a", "b")


def _place(weight: str, node: str) -> str:
    """SQL: heavier nodes first, then by some bits of their ids."""
    return f"shiftleft(least({weight}, {1 << 22}), 40) | ({node} & {(1 << 40) - 1})"


def bucket_heads(signatures: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(bucket, node, weight, head)`` of each bucket of two nodes or more; its head is its heaviest node.

    Each node goes to the buckets ``keys``, and one shuffle of them serves the
    aggregation and the join, as both sides read the same columns; heads are
    few, so the join hashes them and sorts nothing.  Hot buckets, found in a sample of bounded size,
    are left out of it: their heads come from partial aggregates and are
    broadcast, so that no task holds a hot bucket.
    """
    listed = F.explode(F.expr(f"array({', '.join(keys)})")).alias("bucket")
    members = signatures.select("node", "weight", listed)
    total = signatures.count()
    some = signatures if total <= SAMPLE else signatures.sample(SAMPLE / total, 1)
    hot = materialize(some.select(listed).groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") >= HOT).select("bucket"), "hot")

    def heads(rows: DataFrame) -> DataFrame:
        place = F.expr(_place("weight", "node"))
        found = rows.groupBy("bucket").agg(F.max_by("node", place).alias("head"), F.min("node").alias("lo"), F.max("node").alias("hi"))
        return found.where("lo < hi").select("bucket", "head")

    cold = members.join(F.broadcast(hot), "bucket", "left_anti").repartition("bucket")
    columns = ("bucket", "node", "weight", "head")
    out = cold.join(heads(cold).hint("shuffle_hash"), "bucket").select(*columns)
    crowded = members.join(F.broadcast(hot), "bucket", "left_semi")
    return out.unionByName(crowded.join(F.broadcast(heads(crowded)), "bucket").select(*columns))


def rows_with_partners(open_rows: DataFrame, signatures: DataFrame, least: int) -> DataFrame:
    """Rows ``(bucket, node, c, stray)`` of a bucket's ``(bucket, node, c)`` members that agree in ``least`` minima or more
    with a member of another component.

    One of the two is a stray, a member outside the bucket's most frequent
    component, so members of a hot bucket's main component never meet each
    other.  Signatures are compared in semi-joins, which make no pairs; a hot
    bucket's two sides can be split.
    """
    words = words_of(signatures)
    counts = open_rows.groupBy("bucket", "c").agg(F.count("*").alias("n"))
    main = counts.groupBy("bucket").agg(F.max_by("c", F.struct("n", "c")).alias("main"))
    signed = open_rows.join(signatures.select("node", *words), "node").join(main, "bucket").withColumn("stray", F.expr("c <> main"))
    met = F.expr(f"x.bucket = y.bucket AND x.c <> y.c AND {agreeing('x', 'y', words)} >= {least}")
    strays = signed.where("stray").alias("x").join(signed.alias("y"), met, "left_semi")
    members = signed.where("not stray").alias("x").join(signed.where("stray").alias("y"), met, "left_semi")
    return strays.unionByName(members).select("bucket", "node", "c", "stray")


def components(
    signatures: DataFrame,
    keys: Sequence[str],
    least: int,
    verify: Callable[[DataFrame], DataFrame],
    residual: Callable[[DataFrame], DataFrame],
    extra_edges: DataFrame | None = None,
) -> DataFrame:
    """Components ``(node, component)`` of the verified links among ``signatures`` ``(node, weight, s0, s1, ...)``.

    1. Each member of a bucket is compared with the bucket's heaviest node,
       as many pairs as members: ``verify(pairs)`` returns those that are links.
    2. Members that share a bucket but are still in different components are
       compared with each other: ``residual(rows)`` returns edges that join
       the components of all linked rows of a bucket.  Pairs within a
       component are never looked at.

    Pairs whose signatures agree in fewer than ``least`` minima are not
    compared; the comparisons are exact.
    """
    shared = materialize(bucket_heads(signatures, keys), "buckets")
    stars = shared.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    stars = materialize(likely_pairs(stars, signatures, least), "pairs")
    links = materialize(verify(stars), "links")
    discard(stars)
    known = links if extra_edges is None else links.unionByName(extra_edges.select("a", "b"))
    labels = connected_components(known)

    labelled = shared.join(labels, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("c"))
    mixed = labelled.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("bucket")
    open_rows = materialize(labelled.join(mixed, "bucket", "left_semi"), "open")
    discard(shared)
    met = materialize(rows_with_partners(open_rows, signatures, least), "met")
    discard(open_rows)
    if small_enough(met, 0):
        return labels
    found = materialize(residual(met), "links")
    discard(met)
    return connected_components(known.unionByName(found.select("a", "b")))
