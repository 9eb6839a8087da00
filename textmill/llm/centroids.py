"""Centroid clustering of integer vectors with Drake's adaptive bounds.

Each vector keeps an upper bound of the distance to its own centroid, lower
bounds of the distances to its several nearest others, and one remainder bound
for all the rest.  Centroids that move loosen the bounds by as much as they
moved.  While the upper bound stays below every lower one the vector's cluster
is certain and nothing is computed; where it does not, exactly the centroids
in doubt are measured again, and all of them only if the remainder is in doubt.
Distances are exact integers; bounds are rounded outwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import discard, materialize

CLUSTERS, ROUNDS, DIM, SCALE = 8, 10, 64, 1024
#: Components beyond this are taken as this: up to here doubles hold every integer.
MOST = 2**53
#: Numbers a task holds at once: rows times clusters times components.
HELD = 1 << 22

_WIDER, _NARROWER = 1 + 1e-15, 1 - 1e-15  # relative widening of a bound: some ulps more than its rounding errors


@dataclass(frozen=True)
class Plan:
    """Centroids of a round as exact integers, how far each has moved, and how many lower bounds to keep."""

    centroids: np.ndarray  # (k, dim) of Python integers
    moved: np.ndarray  # (k,) upper bounds of the moves; empty in the first round
    bounds: int


def _fits(*parts: np.ndarray) -> bool:
    """Whether sums of squared differences stay exact in doubles."""
    top = max((float(np.abs(p).max()) for p in parts if p.size), default=0.0)
    return 4 * parts[0].shape[-1] * top * top < MOST


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distance of each point to each centroid."""
    if _fits(points, centroids):
        c = centroids.astype(np.float64)
        return (points * points).sum(1)[:, None] - 2 * (points @ c.T) + (c * c).sum(1)
    return ((_integers(points)[:, None, :] - centroids[None]) ** 2).sum(2)


def squared_own(points: np.ndarray, centroids: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Exact squared distance of each point to the centroid named beside it."""
    if _fits(points, centroids):
        return ((points - centroids.astype(np.float64)[own]) ** 2).sum(1)
    return ((_integers(points) - centroids[own]) ** 2).sum(1)


def _integers(points: np.ndarray) -> np.ndarray:
    return np.array([int(x) for x in points.ravel()], object).reshape(points.shape)


def _root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


def scan(points: np.ndarray, plan: Plan) -> tuple[np.ndarray, ...]:
    """Cluster, upper bound, tracked centroids, their lower bounds and the remainder, from all distances."""
    d = squared(points, plan.centroids)
    order = np.argsort(d, axis=1, kind="stable")  # equal distances: the smaller number first
    root = np.take_along_axis(_root(d), order, axis=1)
    b = min(plan.bounds, len(plan.centroids) - 1)
    rest = root[:, b + 1] * _NARROWER if b + 1 < len(plan.centroids) else np.full(len(points), np.inf)
    return order[:, 0].astype(np.int32), root[:, 0] * _WIDER, order[:, 1 : b + 1].astype(np.int32), root[:, 1 : b + 1] * _NARROWER, rest


def step(points: np.ndarray, plan: Plan, state: tuple[np.ndarray, ...]) -> tuple[tuple[np.ndarray, ...], int]:
    """The state after the centroids have moved, and the most lower bounds that any vector had to look behind."""
    own, upper, tracked, lower, rest = (x.copy() for x in state)
    upper = (upper + plan.moved[own]) * _WIDER
    lower = np.maximum(lower - plan.moved[tracked], 0) * _NARROWER
    rest = np.maximum(rest - plan.moved.max(), 0) * _NARROWER

    unsure = np.flatnonzero((lower <= upper[:, None]).any(axis=1) | (rest <= upper))
    upper[unsure] = _root(squared_own(points[unsure], plan.centroids, own[unsure])) * _WIDER  # often enough by itself
    doubted = lower[unsure] <= upper[unsure, None]
    all_in_doubt = rest[unsure] <= upper[unsure]
    used = int(doubted[~all_in_doubt].sum(axis=1).max(initial=0))

    some = unsure[~all_in_doubt & doubted.any(axis=1)]
    if len(some):
        slots = np.concatenate([own[some, None], tracked[some]], axis=1)
        asked = np.concatenate([np.ones((len(some), 1), bool), lower[some] <= upper[some, None]], axis=1)
        at, slot = np.nonzero(asked)
        d = squared_own(points[some[at]], plan.centroids, slots[at, slot])
        exact = np.full(asked.shape, np.inf if d.dtype != object else float("inf"), d.dtype)
        exact[at, slot] = d
        ranked = np.lexsort((slots.ravel(), _sortable(exact).ravel(), np.repeat(np.arange(len(some)), slots.shape[1]))).reshape(slots.shape)
        best = ranked[:, 0] % slots.shape[1]
        low = np.concatenate([np.zeros((len(some), 1)), lower[some]], axis=1)
        low[at, slot] = _root(d) * _NARROWER
        row = np.arange(len(some))
        own[some], upper[some] = slots[row, best], _root(exact[row, best]) * _WIDER
        slots[row, best], low[row, best] = slots[:, 0], low[:, 0]  # the old centroid takes the place of the new one
        tracked[some], lower[some] = slots[:, 1:], low[:, 1:]

    b = min(plan.bounds, tracked.shape[1])
    if b < tracked.shape[1]:  # fewer bounds from now on: the farthest go into the remainder
        order = np.argsort(lower, axis=1, kind="stable")
        tracked, lower = np.take_along_axis(tracked, order, 1), np.take_along_axis(lower, order, 1)
        rest = np.minimum(rest, lower[:, b:].min(axis=1))
        tracked, lower = tracked[:, :b], lower[:, :b]

    every = unsure[all_in_doubt]
    if len(every):
        for x, y in zip((own, upper, tracked, lower, rest), scan(points[every], plan), strict=True):
            x[every] = y
    return (own, upper, tracked, lower, rest), used


def _sortable(d: np.ndarray) -> np.ndarray:
    """Ranks of exact distances, so that big integers sort beside infinity."""
    return d if d.dtype != object else np.unique(d.ravel(), return_inverse=True)[1].reshape(d.shape)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width) if width else np.zeros(n + 1), pa.int32()), pa.array(values.ravel(), kind))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 0))


def _sums(points: np.ndarray, own: np.ndarray, k: int) -> list[str]:
    """Sums of components by cluster, then counts, as decimal numbers."""
    whole = points.astype(np.int64) if _fits(points) else _integers(points)
    total = np.zeros((k, points.shape[1]), whole.dtype)
    np.add.at(total, own, whole)
    return [str(x) for x in (*total.ravel(), *np.bincount(own, minlength=k))]


def _parts(batches: Iterator[pa.RecordBatch], k: int, dim: int) -> Iterator[pa.RecordBatch]:
    most = max(1, HELD // (k * dim))
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


def _advance(batches: Iterator[pa.RecordBatch], plan: Plan, dim: int) -> Iterator[pa.RecordBatch]:
    k = len(plan.centroids)
    for batch in _parts(batches, k, dim):
        n = batch.num_rows
        points = _matrix(batch.column("point"), n)
        if len(plan.moved):
            held = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "rest")]
            state = (held[0], held[1], _matrix(batch.column("tracked"), n), _matrix(batch.column("lower"), n), held[2])
            (own, upper, tracked, lower, rest), used = step(points, plan, state)
        else:
            (own, upper, tracked, lower, rest), used = scan(points, plan), 0
        head = lambda value, kind: pa.array([value] + [None] * (n - 1), kind)  # noqa: E731  one row carries what the part adds up to
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("vec_id"), batch.column("point"), pa.array(own, pa.int32()), pa.array(upper), _lists(tracked, pa.int32()),
                _lists(lower, pa.float64()), pa.array(rest), head(_sums(points, own, k), pa.list_(pa.string())), head(used, pa.int32()),
            ],
            names=["vec_id", "point", "cluster", "upper", "tracked", "lower", "rest", "sums", "used"],
        )


def _settle(batches: Iterator[pa.RecordBatch], plan: Plan, dim: int) -> Iterator[pa.RecordBatch]:
    for batch in _advance(batches, plan, dim):
        own = batch.column("cluster").to_numpy()
        d = squared_own(_matrix(batch.column("point"), batch.num_rows), plan.centroids, own)
        fitting = [int(x) if x < 2**63 else None for x in d]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(fitting, pa.int64())], names=["vec_id", "cluster", "distance"])


def _moves(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    return _root(((old - new) ** 2).sum(1)) * _WIDER


def centroid_clusters(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    dim: int = DIM,
    scale: int = SCALE,
    seed: int = 3,
) -> DataFrame:
    """One row per vector kept: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    A vector is kept if it has ``dim`` components, none null or non-finite;
    others have no row.  Each component becomes ``floor(scale * x)``.  The
    first centroids are the vectors with the smallest sha256 of ``seed:id``
    (ties, as of repeated rows: the smaller components; a null id counts as an
    empty one).  Each round assigns every vector to the nearest centroid (ties:
    the smaller number) and moves each centroid that has vectors to the exact
    floor of their mean.  ``distance`` is squared, ``cluster_inertia`` and
    ``inertia`` are its sums.

    A round reads and writes the vectors once, without a shuffle; only the
    sums, ``clusters * (dim + 1)`` numbers for a part of a task, are
    aggregated, and as many in all reach the driver.  The state of a round is
    a table in the shared folder, so a lost executor costs its own tasks.  When
    no centroid moves the remaining rounds could change nothing and are left out.

    Repeated rows and null ids are vectors of their own.  With fewer vectors
    than clusters there are as many clusters as vectors.  Components beyond
    2^53 are taken as 2^53; a distance too large for 64 bits is null, and so are
    the inertias it is in.  Extra columns are ignored; an empty table gives an
    empty result.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    sound = f"size(x) = {int(dim)} AND forall(x, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity'))"
    # floor() gives a bigint, for which large values do not fit; they are whole already
    whole = f"transform(x, v -> CASE WHEN abs(v * {scale}D) >= {MOST}D THEN sign(v) * {MOST}D ELSE cast(floor(v * {scale}D) AS double) END)"
    kept = base.where(F.expr(sound)).select("vec_id", F.expr(whole).alias("point"))
    kind = kept.schema["vec_id"].dataType.simpleString()

    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.orderBy(draw, "point").limit(clusters).select("point").collect()
    result = "vec_id {0}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string".format(kind)
    if not first:
        return spark.createDataFrame([], result)
    k = len(first)
    plan = Plan(_integers(np.array([r.point for r in first])), np.zeros(0), min(k - 1, max(3, k // 4)))
    least = min(k - 1, max(1, k // 8))

    carried = f"vec_id {kind}, point array<double>, cluster int, upper double, tracked array<int>, lower array<double>, rest double, sums array<string>, used int"
    state = kept
    for n in range(rounds):
        now = materialize(state.mapInArrow(lambda batches, plan=plan: _advance(batches, plan, dim), carried), f"clusters-{n}")
        discard(state)
        state = now
        marks = state.where("used IS NOT NULL")
        total = {r.pos: int(r.total) for r in marks.select(F.posexplode("sums")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("total")).collect()}
        used = marks.agg(F.max("used")).first()[0]
        moved = plan.centroids.copy()
        for c in range(k):
            if count := total[k * dim + c]:
                moved[c] = [total[c * dim + i] // count for i in range(dim)]
        moves = _moves(plan.centroids, moved)
        bounds = plan.bounds if n == 0 else min(plan.bounds, max(least, used))
        plan = Plan(moved, moves, bounds)
        if not moves.any():
            break
    settled = materialize(state.mapInArrow(lambda batches: _settle(batches, plan, dim), f"vec_id {kind}, cluster int, distance long"), "clusters")
    discard(state)

    exact = F.when(F.count("*") == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)")))
    by = {r.cluster: r.inertia for r in settled.groupBy("cluster").agg(exact.alias("inertia")).collect()}
    fit = lambda x: int(x) if x is not None and x < 2**63 else None
    whole_sum = None if None in by.values() else sum(by.values())
    names = [(c, fit(x), fit(whole_sum), hashlib.sha256(",".join(map(str, plan.centroids[c])).encode()).hexdigest()) for c, x in by.items()]
    about = spark.createDataFrame(names, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return settled.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
