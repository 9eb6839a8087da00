"""Near-duplicate vectors from int8 tile products with rigorous error bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import materialize
from textmill.llm.graph import connected_components

THRESHOLD = 0.98
TILE = 2048  # vectors in a tile, on average; a task holds two tiles
BLOCK = 256  # rows of a product at a time


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``x`` by rows over a power of two, so that no square is lost or too large, and the rows' norms."""
    _, power = np.frexp(np.abs(x).max(axis=1))
    scaled = np.ldexp(x, -power[:, None])
    return scaled, np.sqrt((scaled * scaled).sum(axis=1))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes, scales and rounding errors' norms of unit vectors."""
    scale = np.abs(x).max(axis=1) / 127.0
    codes = np.rint(x / scale[:, None])
    return codes.astype(np.int8), scale, np.linalg.norm(x - codes * scale[:, None], axis=1)


Codes = tuple[np.ndarray, np.ndarray, np.ndarray]


def open_pairs(a: Codes, b: Codes, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of the pairs that may have a cosine of ``threshold`` or more, some rows of ``a`` at a time.

    With x = c + e for a unit vector, its decoded code and its rounding
    error, x.y - c.d = x.f + e.d, so the product of codes is off by at most
    |f| + |e| (1 + |f|).  ``same``: the two are one tile; each pair once.
    """
    (qa, sa, ea), (qb, sb, eb) = a, b
    exact = np.float32 if qa.shape[1] * 127 * 127 < 1 << 24 else np.float64  # sums of products stay whole numbers
    right = qb.astype(exact).T
    for start in range(0, len(qa), BLOCK):
        rows = slice(start, start + BLOCK)
        product = (qa[rows].astype(exact) @ right).astype(np.float64) * sa[rows, None] * sb
        slack = eb + ea[rows, None] * (1 + eb) + 1e-9
        i, j = np.nonzero(product + slack >= threshold)
        i += start
        yield (i[i < j], j[i < j]) if same else (i, j)


def linked_pairs(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices of rows of ``a`` and ``b`` with cosine >= ``threshold`` in double precision; only open pairs are computed from the vectors."""
    (a, na), (b, nb) = unit(a), unit(b)
    left, other = [], []
    for i, j in open_pairs(quantise(a / na[:, None]), quantise(b / nb[:, None]), threshold, same):
        for at in range(0, len(i), 1 << 16):
            x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            fine = np.einsum("ij,ij->i", a[x], b[y]) / (na[x] * nb[y]) >= threshold
            left.append(x[fine])
            other.append(y[fine])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *other])


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column's vectors, of one length in each row's group, as codes, scale and error."""
    for batch in batches:
        vectors = batch.column(batch.num_columns - 1)
        sizes = np.diff(np.asarray(vectors.offsets))
        flat, first = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
        codes: list[bytes] = [b""] * len(sizes)
        scale, error = np.zeros(len(sizes)), np.zeros(len(sizes))
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            x, norm = unit(flat[first[at][:, None] + np.arange(size)])
            q, scale[at], error[at] = quantise(x / norm[:, None])
            for k, row in zip(at, q, strict=True):
                codes[k] = row.tobytes()
        names = [*batch.schema.names[:-1], "codes", "scale", "error"]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(codes, pa.binary()), pa.array(scale), pa.array(error)], names=names)


def _sides(frame: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    """The rows of the two tiles of a task, and whether they are one tile."""
    first = (frame["tile"] == frame["lo"]).to_numpy()
    same = bool((frame["lo"] == frame["hi"]).iloc[0])
    return frame[first], frame[first] if same else frame[~first], same


def _open_rows(frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """The rows of a pair of tiles that are in an open pair, from codes alone."""
    x, y, same = _sides(frame)
    named = ["label", "dim", "lo", "hi", "tile", "node", "part"]
    if not len(x) or not len(y):
        return frame[named].iloc[:0]
    a, b = (
        (np.frombuffer(b"".join(t["codes"]), np.int8).reshape(len(t), -1), t["scale"].to_numpy(), t["error"].to_numpy()) for t in (x, y)
    )
    left, right = np.zeros(len(x), bool), np.zeros(len(y), bool)
    for i, j in open_pairs(a, b, threshold, same):
        left[i] = True
        right[j] = True
    return x[left | right][named] if same else pd.concat([x[left], y[right]])[named]


def _smallest_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, before[b])
        np.minimum.at(label, b, before[a])
        label = label[label]
        if (label == before).all():
            return label


def _tile_pair(frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    x, y, same = _sides(frame.sort_values("node", kind="stable"))
    if not len(x) or not len(y):
        return pd.DataFrame({"node": [], "n_links": [], "least": []}).astype("int64")
    a, b = (np.array(t["embedding"].tolist(), np.float64) for t in (x, y))
    i, j = linked_pairs(a, b, threshold, same)
    mine = np.concatenate([x["node"].to_numpy(), y["node"].to_numpy()])
    size = np.concatenate([x["size"].to_numpy(), y["size"].to_numpy()])
    j = j if same else j + len(x)
    links = np.bincount(i, size[j], minlength=len(mine)) + np.bincount(j, size[i], minlength=len(mine))
    order = np.argsort(mine, kind="stable")  # so that the smallest index is the smallest node
    rank = np.empty(len(mine), np.int64)
    rank[order] = np.arange(len(mine))
    least = mine[order][_smallest_reachable(len(mine), rank[i], rank[j])][rank]
    at = np.flatnonzero(links > 0)
    return pd.DataFrame({"node": mine[at], "n_links": links[at].astype("int64"), "least": least[at]})


def embedding_components(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    tile: int = TILE,
) -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept``.

    Vectors with equal labels and lengths are linked when their cosine is at
    least ``threshold``.  Equal vectors are first collapsed; the rest of a
    label is coded once and dealt into tiles of about ``tile`` vectors by a
    hash of the id; each pair of tiles is one task of bounded size that gets
    codes, an eighth of the vectors, and names the rows in pairs its bound
    leaves open.  Only those rows' vectors follow, for the exact comparison.
    Tasks return counts and their local components, never pairs.

    Null labels, and vectors that are null, empty, zero or hold null or
    non-finite components, link with nothing.  Rows that repeat an id are
    vectors of their own that share a component.  Null ids link with nothing,
    have a null component and are kept.  An empty table gives an empty result.
    """
    base = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("embedding")
    )
    sound = (
        "vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL"
        " AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
        " AND exists(embedding, x -> x <> 0)"
    )
    valid = base.where(F.expr(sound)).withColumn("embedding", F.expr("transform(embedding, x -> x + 0.0D)"))
    classes = materialize(
        valid.groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("node"), F.count("*").alias("size"))
        .withColumns({"dim": F.size("embedding"), "part": F.xxhash64("embedding")}),
        "vectors",
    )
    tiles = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"), F.count("*").alias("n")).where("n > 1")
    kind = classes.schema["label"].dataType.simpleString()
    coded = classes.select("label", "dim", "node", "part", "embedding").mapInArrow(
        _coded, f"label {kind}, dim int, node long, part long, codes binary, scale double, error double"
    )
    dealt = (
        coded.join(tiles.drop("n"), ["label", "dim"])
        .withColumn("tile", F.pmod(F.xxhash64("node", "part"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
        .withColumn("lo", F.least("tile", "other"))
        .withColumn("hi", F.greatest("tile", "other"))
    )
    pair = ["label", "dim", "lo", "hi"]
    open_rows = dealt.select(*pair, "tile", "node", "part", "codes", "scale", "error").groupBy(*pair).applyInPandas(
        lambda frame: _open_rows(frame, threshold), f"label {kind}, dim int, lo int, hi int, tile int, node long, part long"
    )
    found = materialize(
        materialize(open_rows, "open")
        .join(classes.select("label", "node", "part", "size", "embedding"), ["label", "node", "part"])
        .groupBy(*pair)
        .applyInPandas(lambda frame: _tile_pair(frame, threshold), "node long, n_links long, least long"),
        "links",
    )
    ids = valid.join(classes.select("label", "embedding", "node", "size"), ["label", "embedding"]).select("vec_id", "node", "size")
    ids = materialize(ids, "rows")
    shared = ids.groupBy("vec_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z")
    repeated = shared.join(ids, "vec_id").where("node > a").select(F.col("a"), F.col("node").alias("b"))
    edges = found.select(F.col("least").alias("a"), F.col("node").alias("b")).unionByName(repeated)
    labels = connected_components(edges)
    counts = found.groupBy("node").agg(F.sum("n_links").alias("links"))
    linked = (
        ids.join(counts, "node", "left")
        .join(labels, "node", "left")
        .select(
            "vec_id",
            (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
        )
    )
    alone = base.where(~F.coalesce(F.expr(sound), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
