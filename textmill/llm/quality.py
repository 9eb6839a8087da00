"""Quality scores from random-indexing word vectors and a small network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import extended
from textmill.llm.labels import labelled_sample
from textmill.llm.shingles import slices
from textmill.llm.tokens import DIGIT, LETTER, OTHER, tokenize

BUCKETS, DIM, NONZERO, REACH = 1 << 14, 32, 4, 2
MAX_FIT_DOCS, HIDDEN, EPOCHS, LEAST_STEPS, SEED = 12_000, 32, 30, 600, 7
LAGS = (1, 2, 3)
FEATURES = 2 * DIM + 1 + 2 * len(LAGS)
KEEP_FROM = 0.3


@lru_cache(maxsize=1)
def index_vectors() -> np.ndarray:
    """A fixed sparse vector of +1 and -1 for each bucket of words."""
    draw = np.random.default_rng(SEED)
    out = np.zeros((BUCKETS, DIM), np.float32)
    for b in range(BUCKETS):
        out[b, draw.choice(DIM, NONZERO, replace=False)] = draw.choice([-1, 1], NONZERO)
    return out


def _buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    hashes, owner = tokenize(texts, (LETTER, DIGIT, OTHER), lower=False)
    return (hashes % np.uint64(BUCKETS)).astype(np.int64), owner


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the index vectors around each bucket's words, over the task's texts; one row per bucket."""
    index = index_vectors()
    total, count = np.zeros((BUCKETS, DIM)), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for start, end in slices(texts):
            words, owner = _buckets(texts[start:end])
            if not len(words):
                continue
            own, around = index[words], np.zeros((len(words), DIM), np.float32)
            for d in range(1, REACH + 1):
                near = (owner[d:] == owner[:-d])[:, None]
                around[d:] += own[:-d] * near
                around[:-d] += own[d:] * near
            order = np.argsort(words, kind="stable")
            first = np.flatnonzero(np.diff(words[order], prepend=-1))
            total[words[order][first]] += np.add.reduceat(around[order], first)
            count += np.bincount(words, minlength=BUCKETS)
    used = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays(
        [pa.array(used.astype(np.int32)), pa.array(count[used]), *(pa.array(total[used, k]) for k in range(DIM))],
        names=["bucket", "n", *(f"v{k}" for k in range(DIM))],
    )


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """A vector per bucket: its index vector plus the mean of those around it in all of ``docs``.

    Every task adds up its own texts, so at most one row per bucket and task
    is shuffled; the result has a fixed size.
    """
    schema = "bucket int, n long, " + ", ".join(f"v{k} double" for k in range(DIM))
    summed = (
        docs.select(F.col(text_col).alias("text"))
        .mapInArrow(_contexts, schema)
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"), *(F.sum(f"v{k}").alias(f"v{k}") for k in range(DIM)))
        .toArrow()
    )
    out = index_vectors().copy()
    at = summed["bucket"].to_numpy()
    mean = np.stack([summed[f"v{k}"].to_numpy() for k in range(DIM)], axis=1) / np.maximum(summed["n"].to_numpy(), 1)[:, None]
    out[at] += mean.astype(np.float32)
    return out


def pool(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """Pooled word vectors of each text; zeros for no words.

    Mean, spread, length, and the mean cosine of words ``LAGS`` apart, of the
    vectors and of the index vectors alone: the latter say whether words are
    repeated, which the shared contexts of the former blur.
    """
    words, owner = _buckets(texts)
    n = np.bincount(owner, minlength=len(texts))
    out = np.zeros((len(texts), FEATURES), np.float64)
    some = np.flatnonzero(n)
    if len(some):
        first = np.concatenate([[0], np.cumsum(n[some])])[:-1]
        own = vectors[words].astype(np.float64)
        mean = np.add.reduceat(own, first) / n[some, None]
        square = np.add.reduceat(own * own, first) / n[some, None]
        out[some, :DIM] = mean
        out[some, DIM : 2 * DIM] = np.sqrt(np.maximum(square - mean * mean, 0))
        out[some, 2 * DIM] = np.log1p(n[some]) / 10
        for part, rows in enumerate((own, index_vectors()[words].astype(np.float64))):
            norm = np.sqrt((rows * rows).sum(axis=1)) + 1e-9
            for k, lag in enumerate(LAGS):
                alike = np.zeros(len(words))
                near = owner[lag:] == owner[:-lag]
                alike[lag:] = np.einsum("ij,ij->i", rows[lag:], rows[:-lag]) / (norm[lag:] * norm[:-lag]) * near
                out[some, 2 * DIM + 1 + part * len(LAGS) + k] = np.add.reduceat(alike, first) / np.maximum(n[some] - lag, 1)
    return out


@dataclass(frozen=True)
class Network:
    """Standardisation, two layers and a temperature."""

    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.shift) * self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def fit_network(x: np.ndarray, y: np.ndarray, block: int = 0) -> Network:
    """Adam on the log loss of four fifths of the rows; the temperature on the rest.

    The first ``block`` features together count as much as one of the others,
    so that many dimensions of a small fit do not drown the rest.  With no
    rows, or one class, the network gives that class's smoothed share.
    """
    width = x.shape[1]
    share = (y.sum() + 1) / (len(y) + 2)
    shift, scale = (x.mean(axis=0), 1 / (x.std(axis=0) + 1e-6)) if len(x) else (np.zeros(width), np.ones(width))
    scale = scale * np.where(np.arange(width) < block, 1 / max(block, 1) ** 0.5, 1.0)
    draw = np.random.default_rng(SEED)
    p = [draw.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.array(np.log(share / (1 - share)))]
    rest = np.arange(len(y)) % 5 == 0
    if len(set(y[~rest])) == 2 and len(set(y[rest])) == 2:
        p[2] = draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN)
        z, t = (x[~rest] - shift) * scale, y[~rest].astype(np.float64)
        m, v, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
        for _ in range(max(EPOCHS, -(-LEAST_STEPS * 64 // len(z)))):
            order = draw.permutation(len(z))
            for at in range(0, len(z), 64):
                a, b = z[order[at : at + 64]], t[order[at : at + 64]]
                h = np.tanh(a @ p[0] + p[1])
                d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - b) / len(b)
                back = np.outer(d, p[2]) * (1 - h * h)
                grads = [a.T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ d + 1e-4 * p[2], d.sum()]
                step += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] = p[k] - 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(shift, scale, p[0], p[1], p[2], float(p[3]), 1.0)
    if rest.any() and len(set(y[rest])) == 2:
        logits = net.logits(x[rest])
        best = min(np.geomspace(0.1, 8, 77), key=lambda t: _loss(logits / t, y[rest]))
        net = Network(shift, scale, p[0], p[1], p[2], float(p[3]), float(best))
    return net


@dataclass(frozen=True)
class QualityModel:
    vectors: np.ndarray
    network: Network


def _pooled(batches: Iterator[pa.RecordBatch], vectors) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for start, end in slices(texts):
            x = pool(texts[start:end], vectors.value)
            offsets = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).slice(start, end - start), pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.reshape(-1)))], names=["label", "x"]
            )


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held_out: int = 0, max_docs: int = MAX_FIT_DOCS) -> QualityModel:
    """Word vectors from all documents; the network from at most about ``max_docs`` labelled ones outside the fold."""
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    rows = labelled_sample(docs, labels, label, folds, held_out, max_docs).mapInArrow(lambda it: _pooled(it, shared), "label int, x array<double>").toArrow()
    x = np.array(rows["x"].to_pylist(), np.float64).reshape(-1, FEATURES)
    y = rows["label"].to_numpy()
    order = np.lexsort([*x.T[:4], y])  # the rows' order in the cluster does not matter
    return QualityModel(vectors, fit_network(x[order], y[order], 2 * DIM))


def _scores(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for start, end in slices(texts):
            score = model.value.network.probability(pool(texts[start:end], model.value.vectors))
            yield pa.RecordBatch.from_arrays(
                [*(c.slice(start, end - start) for c in batch.columns[1:]), pa.array(score)], names=[*batch.schema.names[1:], "score"]
            )


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), keep_from: float = KEEP_FROM) -> DataFrame:
    """The ``keep`` columns of each row with ``score``, the calibrated probability of good quality, and ``predicted``.

    Only the whole text is an input.  Null and empty texts pool to zeros and
    get the score that the network gives those; repeated rows score alike; an
    empty table gives an empty result.
    """
    base = docs.select(F.col(text_col).alias("__text"), *keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = base.mapInArrow(lambda it: _scores(it, shared), extended(base, "score double"))
    return scored.withColumn("predicted", (F.col("score") >= keep_from).cast("int"))
