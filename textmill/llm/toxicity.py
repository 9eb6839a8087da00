"""Toxic passages as maximum-scoring segments of token log-odds."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import extended, materialize
from textmill.llm.labels import labelled_sample
from textmill.llm.shingles import mix, slices
from textmill.llm.tokens import LETTER, tokenize

MAX_FIT_DOCS, MAX_WORDS, LEAST_COUNT = 12_000, 50_000, 3
PRIOR_WORDS = 1000.0  # weight of the corpus's word shares against the labelled counts
CONFIDENCE = 2.0  # standard errors by which log-odds are drawn towards zero
DRIFT = 0.3  # taken from each token's score, so that ordinary text sums downwards
TOXIC_FROM = 0.7


@dataclass(frozen=True)
class ToxicityModel:
    """Scores by word hash (sorted); the extreme-value parameters; the calibration.

    A segment's significance is ``rate * score - log(size * words)``: minus
    the log of the number of such segments expected in so long an ordinary
    text.
    """

    keys: np.ndarray
    scores: np.ndarray
    rate: float
    size: float
    slope: float
    offset: float

    def token_scores(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -DRIFT)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            known = self.keys[at] == hashes
            out[known] += self.scores[at[known]]
        return out


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, score)`` of a sequence, in linear time.

    A maximal segment has a positive score, no segment within it scores more,
    and none around it has that property.  A stack holds candidates with the
    sums before and after them; one that starts lower than an earlier
    candidate and ends higher absorbs all up to it.  Segments begin and end on
    positive scores, so the loop visits only those.
    """
    after = np.cumsum(scores)
    before = after - scores
    held: list[tuple[int, int, float, float]] = []
    lower: list[int] = []  # for each held one, the nearest earlier one that starts lower
    for i in np.flatnonzero(scores > 0).tolist():
        start, low, high = i, float(before[i]), float(after[i])
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= low:
                j = lower[j]
            if j < 0 or held[j][3] >= high:
                break
            start, low = held[j][0], held[j][2]
            del held[j:], lower[j:]
        held.append((start, i + 1, low, high))
        lower.append(j)
    return [(start, end, high - low) for start, end, low, high in held]


def _rate(shares: np.ndarray, scores: np.ndarray) -> float:
    """The positive root of ``sum(share * exp(rate * score)) = 1``, which decides how fast chance scores thin out."""
    if not len(scores) or scores.max() <= 0:
        return 1.0
    low, high = 0.0, 1.0
    value = lambda x: float((shares * np.exp(np.minimum(x * scores, 500))).sum()) - 1
    while value(high) < 0 and high < 1e3:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return max(high, 1e-3)


def passages(model: ToxicityModel, hashes: np.ndarray) -> list[tuple[int, int, float]]:
    """Significant segments of one text's words: start, end and significance above zero."""
    found = []
    for start, end, score in maximal_segments(model.token_scores(hashes)):
        weight = model.rate * score - math.log(max(model.size * len(hashes), 1.0))
        if weight > 0:
            found.append((start, end, weight))
    return found


def _features(model: ToxicityModel, texts: list[str | None]) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    hashes, owner = tokenize(texts, (LETTER,), lower=True)
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    positive = np.unique(owner[model.token_scores(hashes) > 0]) if len(owner) else []
    weight, found = np.zeros(len(texts)), [[] for _ in texts]
    for d in positive:
        found[d] = passages(model, hashes[first[d] : first[d + 1]])
        weight[d] = sum(w for _, _, w in found[d])
    return weight, found


def _word_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word hash with its label and a hash of its two neighbours, once per slice."""
    for batch in batches:
        texts, labels = batch.column(0).to_pylist(), (np.array(batch.column(1).to_pylist()) > 0).astype(np.uint64)
        for start, end in slices(texts):
            hashes, owner = tokenize(texts[start:end], (LETTER,), lower=True)
            if not len(hashes):
                continue
            before, after = np.zeros_like(hashes), np.zeros_like(hashes)
            inside = owner[1:] == owner[:-1]  # neighbours are words of the same text
            before[1:][inside], after[:-1][inside] = hashes[:-1][inside], hashes[1:][inside]
            around = before * np.uint64(0x9E3779B97F4A7C15) + mix(after)
            context = (mix(around) << np.uint64(1)) | labels[start:end][owner]
            rows = np.unique(np.stack([hashes, context], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[:, 0].astype(np.uint64).view(np.int64)), pa.array(np.ascontiguousarray(rows[:, 1]).view(np.int64))], names=["h", "context"]
            )


def _corpus_counts(batches: Iterator[pa.RecordBatch], keys) -> Iterator[pa.RecordBatch]:
    """Counts of the model's words, and of all words under position -1, over the task's texts."""
    table = keys.value
    counts = np.zeros(len(table) + 1, np.int64)
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for start, end in slices(texts):
            hashes, _ = tokenize(texts[start:end], (LETTER,), lower=True)
            counts[-1] += len(hashes)
            if len(table) and len(hashes):
                at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
                counts[:-1] += np.bincount(at[table[at] == hashes], minlength=len(table))
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.where(used == len(table), -1, used).astype(np.int32)), pa.array(counts[used])], names=["at", "n"])


def _fit_features(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """Per labelled text: label, words, best segment's score and the summed significance."""
    own = model.value
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for start, end in slices(texts):
            hashes, owner = tokenize(texts[start:end], (LETTER,), lower=True)
            first = np.searchsorted(owner, np.arange(end - start + 1))
            best = [max((s for _, _, s in maximal_segments(own.token_scores(hashes[a:b]))), default=0.0) for a, b in zip(first, first[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).slice(start, end - start), pa.array(np.diff(first)), pa.array(best, pa.float64()), pa.array(_features(own, texts[start:end])[0])],
                names=["label", "words", "best", "weight"],
            )


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a penalised log-loss fit by Newton steps, halved until they help; the slope is not negative."""
    a, w = np.stack([x, np.ones(len(x))], axis=1), np.zeros(2)

    def loss(v: np.ndarray) -> float:
        z = a @ v
        return float((np.logaddexp(0, z) - y * z).sum() + 0.05 * (v @ v))

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(2), a.T @ (p - y) + 0.1 * w)
        scale = 1.0
        while scale > 1e-6 and loss(w - scale * step) > loss(w):
            scale /= 2
        w = w - scale * step
        if np.abs(scale * step).max() < 1e-8:
            break
    return max(float(w[0]), 0.0), float(w[1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held_out: int = 1, max_docs: int = MAX_FIT_DOCS) -> ToxicityModel:
    """Log-odds with an informative Dirichlet prior from all of ``docs``.

    Labels come from at most about ``max_docs`` documents outside the fold,
    and ``MAX_WORDS`` of their words with ``LEAST_COUNT`` uses or more are
    scored.  Uses are distinct pairs of neighbours, so that copies of one text
    do not make its words look toxic or harmless.  The prior of a word is its share of the whole corpus.  Log-odds
    are drawn to zero by ``CONFIDENCE`` standard errors, so that rare words
    score nothing.  Without labels of both kinds no word scores.
    """
    spark = docs.sparkSession
    sample = labelled_sample(docs, labels, label, folds, held_out, max_docs)
    counted = (
        sample.mapInArrow(_word_contexts, "h long, context long")
        .distinct()
        .groupBy("h")
        .agg(F.sum(F.expr("context & 1")).alias("yes"), F.sum(F.expr("1 - (context & 1)")).alias("no"))
    )
    counted = materialize(counted, "words")
    sums = counted.agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).first()
    n_yes, n_no = float(sums["yes"] or 0), float(sums["no"] or 0)
    top = counted.where(F.col("yes") + F.col("no") >= LEAST_COUNT).orderBy(F.desc(F.col("yes") + F.col("no")), "h").limit(MAX_WORDS).toArrow()
    keys = top["h"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    keys, yes, no = keys[order], top["yes"].to_numpy()[order].astype(float), top["no"].to_numpy()[order].astype(float)
    shared = spark.sparkContext.broadcast(keys)
    corpus = docs.select("text").mapInArrow(lambda it: _corpus_counts(it, shared), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    at, n = corpus["at"].to_numpy(), corpus["n"].to_numpy().astype(float)
    total = max(float(n[at == -1].sum()), 1.0)
    shares = np.zeros(len(keys))
    shares[at[at >= 0]] = n[at >= 0] / total
    prior = PRIOR_WORDS * np.maximum(shares, 1e-12)
    if n_yes and n_no:
        odds = lambda c, size: np.log((c + prior) / (size + PRIOR_WORDS - c - prior))
        delta = odds(yes, n_yes) - odds(no, n_no)
        error = np.sqrt(1 / (yes + prior) + 1 / (no + prior))
        # the error of a word never seen in one class is that of the counts it could have had
        error = np.minimum(error, np.sqrt(1 / (yes + 0.5) + 1 / (no + 0.5)))
        scores = np.sign(delta) * np.maximum(np.abs(delta) - CONFIDENCE * error, 0)
        scores = np.clip(scores, -4, 8)
    else:
        scores = np.zeros(len(keys))
    # chance scores of ordinary text: the corpus's shares of words, as in the texts that are not toxic
    ordinary = (no + prior) / (n_no + PRIOR_WORDS)
    rest = max(1 - ordinary.sum(), 0.0)
    rate = _rate(np.append(ordinary, rest), np.append(scores - DRIFT, -DRIFT))
    model = ToxicityModel(keys, scores, rate, 1e-3, 1.0, 0.0)

    first = spark.sparkContext.broadcast(model)
    rows = sample.mapInArrow(lambda it: _fit_features(it, first), "label int, words long, best double, weight double").toArrow()
    y, words, best = (rows["label"].to_numpy() > 0).astype(float), rows["words"].to_numpy().astype(float), rows["best"].to_numpy()
    plain = (y == 0) & (words > 0)
    # chance segments are Poisson with mean size * words * exp(-rate * score): fit ``size`` at the level half the ordinary texts stay under
    level = float(np.quantile(best[plain], 0.5)) if plain.any() else 0.0
    reached = float((best[plain] > level).mean()) if plain.any() else 0.0
    expected = float(np.mean(words[plain]) * math.exp(-rate * level)) if plain.any() else 1.0
    size = min(max(-math.log(max(1 - reached, 1e-6)) / max(expected, 1e-12), 1e-6), 1.0)
    model = ToxicityModel(keys, scores, rate, size, 1.0, 0.0)
    second = spark.sparkContext.broadcast(model)
    rows = sample.mapInArrow(lambda it: _fit_features(it, second), "label int, words long, best double, weight double").toArrow()
    y, weight = (rows["label"].to_numpy() > 0).astype(float), rows["weight"].to_numpy()
    order = np.lexsort([weight, y])
    slope, offset = _logistic(np.log1p(weight[order]), y[order]) if len(y) else (0.0, 0.0)
    return ToxicityModel(keys, scores, rate, size, slope, offset)


def _scores(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    own = model.value
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for start, end in slices(texts):
            weight, found = _features(own, texts[start:end])
            score = 1 / (1 + np.exp(-np.clip(own.slope * np.log1p(weight) + own.offset, -30, 30)))
            spans = pa.array([[{"first": a, "last": b - 1, "weight": w} for a, b, w in x] for x in found], pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("weight", pa.float64())])))
            yield pa.RecordBatch.from_arrays(
                [*(c.slice(start, end - start) for c in batch.columns[1:]), pa.array(score), spans], names=[*batch.schema.names[1:], "score", "passages"]
            )


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), toxic_from: float = TOXIC_FROM) -> DataFrame:
    """The ``keep`` columns of each row with ``score``, ``passages`` and ``predicted``.

    ``passages`` holds every significant segment: its first and last word
    (runs of letters, from 0) and its significance.  The score is a calibrated
    probability from their sum.  Null and empty texts have no passages and
    the score of such texts; ties are kept; repeated rows score alike; an
    empty table gives an empty result.
    """
    base = docs.select(F.col(text_col).alias("__text"), *keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = base.mapInArrow(lambda it: _scores(it, shared), extended(base, "score double, passages array<struct<first:int,last:int,weight:double>>"))
    return scored.withColumn("predicted", (F.col("score") >= toxic_from).cast("int"))
