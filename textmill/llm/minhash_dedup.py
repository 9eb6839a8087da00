"""MinHash near-duplicate documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import broadcast_if_small, fresh, materialize
from textmill.llm.neardup import LANES, band_keys, components, verified_pairs
from textmill.llm.shingles import chunks, mix, shingle_sets

BANDS, ROWS = 25, 5  # at similarity 0.85 a pair misses every band with probability 5e-7
PERCENT = 85
TILE_SHINGLES = 200_000  # shingles in a tile, on average; a task holds two tiles
WIDTH = 8192  # shingles compared at a time
MAX_BROADCAST_NODES = 1_000_000  # most ids (8 bytes each) that are broadcast to pick texts; beyond, a shuffled join


def _hash_functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Multiply-add hash functions modulo 2**64 with odd multipliers."""
    seeds = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:count] | np.uint64(1), seeds[count:]


def signature_words(hashes: np.ndarray, counts: np.ndarray, functions: int) -> np.ndarray:
    """``(texts with shingles, words)``: seven bits of each hash function's minimum, packed as in ``neardup``."""
    starts = np.concatenate([[0], np.cumsum(counts[counts > 0])])[:-1]
    mult, add = _hash_functions(functions)
    out = np.zeros((len(starts), -(-functions // LANES)), np.int64)
    for k in range(functions):
        minima = np.minimum.reduceat(hashes * mult[k] + add[k], starts)
        out[:, k // LANES] |= (minima & np.uint64(127)).astype(np.int64) << np.int64(8 * (k % LANES))
    return out


def _sketches(batches: Iterator[pa.RecordBatch], functions: int, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for start, held in chunks(texts):
            hashes, counts = shingle_sets(held, size)
            full = counts > 0
            n = len(held)
            hi, lo = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            words = np.zeros((n, -(-functions // LANES)), np.int64)
            if full.any():
                starts = np.concatenate([[0], np.cumsum(counts[full])])[:-1]
                hi[full] = np.add.reduceat(mix(hashes), starts)
                lo[full] = np.add.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), starts)
                words[full] = signature_words(hashes, counts, functions)
            columns = [ids.slice(start, n), counts, hi.view(np.int64), lo.view(np.int64), *words.T]
            names = ["doc_id", "n_shingles", "fp_hi", "fp_lo", *(f"s{w}" for w in range(words.shape[1]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for start, held in chunks(texts):
            hashes, counts = shingle_sets(held, size)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(start, len(held)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.view(np.int64)))],
                names=["node", "items"],
            )


def least_agreeing(functions: int, percent: int) -> int:
    """Equal minima that a pair at the threshold has but with a probability of about 0.001."""
    share = percent / 100
    return int(functions * share - 3.1 * (functions * share * (1 - share)) ** 0.5)


def _linked(left: pd.DataFrame, right: pd.DataFrame, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of rows of ``left`` and ``right`` whose sets are similar enough and whose components differ.

    Sizes of intersections are products of membership matrices over the
    shingles that both sides have, a slice of shingles at a time.
    """
    sizes = [np.array([len(x) for x in t["items"]], np.int64) for t in (left, right)]
    flat = [np.concatenate(t["items"].tolist()) for t in (left, right)]
    rows = [np.repeat(np.arange(len(n)), n) for n in sizes]
    vocabulary = np.intersect1d(flat[0], flat[1])
    at = [np.searchsorted(vocabulary, f) for f in flat]
    seen = [(p < len(vocabulary)) & (vocabulary[np.minimum(p, len(vocabulary) - 1)] == f) if len(vocabulary) else np.zeros(len(f), bool) for p, f in zip(at, flat, strict=True)]
    shared = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, len(vocabulary), WIDTH):
        sides = []
        for p, ok, r, n in zip(at, seen, rows, (len(left), len(right)), strict=True):
            take = ok & (p >= start) & (p < start + WIDTH)
            side = np.zeros((n, min(WIDTH, len(vocabulary) - start)), np.float32)
            side[r[take], p[take] - start] = 1
            sides.append(side)
        shared += sides[0] @ sides[1].T
    union = sizes[0][:, None] + sizes[1] - shared
    differ = left["c"].to_numpy()[:, None] != right["c"].to_numpy()
    return np.nonzero((shared * 100 >= union * percent) & differ)


def _compare_tiles(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between a tile of stray members and a tile of members, as one edge per member to its smallest partner and back."""
    left, right = (frame[frame["stray"] == side].sort_values("node", kind="stable").reset_index(drop=True) for side in (True, False))
    none = pd.DataFrame({"a": [], "b": []}).astype("int64")
    if not len(left) or not len(right):
        return none
    i, j = _linked(left, right, percent)
    if not len(i):
        return none
    # union within the tiles: a spanning set of edges instead of all pairs
    nodes, ends = np.unique(np.concatenate([left["node"].to_numpy()[i], right["node"].to_numpy()[j]]), return_inverse=True)
    x, y, label = ends[: len(i)], ends[len(i) :], np.arange(len(nodes))
    while True:
        before = label.copy()
        np.minimum.at(label, x, before[y])
        np.minimum.at(label, y, before[x])
        label = label[label]
        if (label == before).all():
            break
    return pd.DataFrame({"a": nodes[label], "b": nodes})


def residual_tiles(open_rows: DataFrame, sets_of, percent: int) -> DataFrame:
    """Links of a bucket's stray members with all its members; ``open_rows`` is ``(bucket, node, c, stray)``.

    Strays and members are dealt by a hash into tiles of about
    ``TILE_SHINGLES`` shingles; every pair of tiles is one task of bounded
    size that returns at most one edge per row.  Members of the largest
    component are never compared with each other.
    """
    sets = materialize(sets_of(open_rows.select("node").distinct()).withColumn("n", F.size("items")), "sets")
    rows = open_rows.join(sets.select("node", "n").distinct(), "node")
    sums = rows.groupBy("bucket").agg(F.sum("n").alias("all"), F.sum(F.expr("if(stray, n, 0)")).alias("strays"))
    tiles = sums.select(
        "bucket", F.ceil(F.col("all") / TILE_SHINGLES).cast("int").alias("na"), F.ceil(F.col("strays") / TILE_SHINGLES).cast("int").alias("ns")
    )
    rows = rows.join(tiles, "bucket")
    members = rows.select("bucket", "node", "c", F.lit(False).alias("stray"), F.expr("cast(pmod(xxhash64(node), na) as int)").alias("ta"), F.expr("explode(sequence(0, ns - 1))").alias("ts"))
    strays = rows.where("stray").select("bucket", "node", "c", "stray", F.expr("cast(pmod(xxhash64(node), ns) as int)").alias("ts"), F.expr("explode(sequence(0, na - 1))").alias("ta"))
    dealt = members.unionByName(strays.select(*members.columns)).join(sets.select("node", "items"), "node")
    return dealt.groupBy("bucket", "ta", "ts").applyInPandas(lambda frame: _compare_tiles(frame, percent), "a long, b long").where("a < b").distinct()


def minhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    A document is the set of its distinct ``size``-word shingles over text
    with A-Z lower-cased; documents are linked when their exact similarity is
    at least ``percent`` / 100, and ``component_id`` is the smallest id
    reachable.  Texts with equal sets are collapsed by a 128-bit fingerprint
    before banding, so copies cost one row each.

    Null or empty texts have no shingles and link with nothing.  Rows that
    repeat an id are one document: a link of any of its texts counts.  A row
    whose id is null links with nothing, its ``component_id`` is null and it
    is kept.  Extra columns of ``docs`` are ignored; an empty table gives an
    empty result.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    functions = bands * rows
    words = [f"s{w}" for w in range(-(-functions // LANES))]
    schema = ", ".join(f"{c} long" for c in ("doc_id", "n_shingles", "fp_hi", "fp_lo", *words))
    sketch = materialize(base.mapInArrow(lambda it: _sketches(it, functions, size), schema), "sketch")
    full = sketch.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("fp_hi", "fp_lo").agg(F.min("doc_id").alias("node"), F.count("*").alias("weight"), *(F.first(w).alias(w) for w in words))
    classes = materialize(classes, "classes")
    rows_ = full.select("doc_id", "fp_hi", "fp_lo").join(
        classes.select("fp_hi", "fp_lo", "node"), ["fp_hi", "fp_lo"]
    ).select("doc_id", "node")
    versions = rows_.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z")
    repeated = versions.join(rows_, "doc_id").where("node > a").select("a", F.col("node").alias("b"))

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = base.join(broadcast_if_small(nodes.select(F.col("node").alias("doc_id")), MAX_BROADCAST_NODES), "doc_id", "left_semi")
        return wanted.mapInArrow(lambda it: _sets(it, size), "node long, items array<long>").where("size(items) > 0")

    def verify(pairs: DataFrame) -> DataFrame:
        return verified_pairs(pairs, sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), percent)

    keys = band_keys([range(b * rows, b * rows + rows) for b in range(bands)])
    least = least_agreeing(functions, percent) + -functions % LANES
    labels = components(classes.select("node", "weight", *words), keys, least, verify, lambda rows: residual_tiles(rows, sets_of, percent), extra_edges=repeated)
    named = classes.select("fp_hi", "fp_lo", "node").join(labels, "node", "left").select(
        "fp_hi", "fp_lo", F.coalesce("component", "node").alias("class_id")
    )
    return (
        sketch.select("doc_id", "n_shingles", "fp_hi", "fp_lo")
        .join(named, ["fp_hi", "fp_lo"], "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("class_id"))).otherwise(F.col("doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def minhash_keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one with the smallest id.

    Rows without an id stay.  All columns of ``docs`` are kept as they are.
    """
    gone = fresh(docs, "gone")
    dropped = minhash_components(docs, id_col, text_col, **options).where("not kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(dropped, docs[id_col].cast("long") == dropped[gone], "left_anti")
