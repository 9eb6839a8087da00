"""Language identification by words, with back-off to character n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import extended, fold, materialize
from textmill.llm.shingles import mix, slices, span_hashes

WORD = re.compile(r"[^\W\d_]+")
#: Bounds of the fit: labelled documents, words, n-grams kept for each length, languages.
MAX_FIT_DOCS, MAX_WORDS, MAX_GRAMS, MAX_LANGS = 10_000, 60_000, 30_000, 200
#: Documents of each language that are used however rare it is beside others; all of them if it has fewer.
LEAST_FIT_DOCS = 100
GRAMS = (5, 4, 3, 2, 1)
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    """Log frequencies per language, of words and of n-grams by length.

    A table is a pair: sorted 64-bit hashes of its keys, and a row of scores
    for each.  Key 0 of ``tables`` is the words', key n the n-grams'.
    """

    langs: tuple[str, ...]
    tables: dict[int, tuple[np.ndarray, np.ndarray]]


_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def _gram_hashes(points: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of ``n`` code points; 0 stands for a word's edge."""
    weights = mix(np.arange(n * 8 + 1, n * 9 + 1, dtype=np.uint64)) | np.uint64(1)
    count = max(0, len(points) - n + 1)
    total = np.zeros(count, np.uint64)
    for j in range(n):
        total += (points[j : j + count].astype(np.uint64) + np.uint64(1)) * weights[j]
    return mix(total)


def _word_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(points.astype(np.uint64), starts, ends)


def _lookup(table: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are in the table, and where."""
    keys = table[0]
    if not len(keys):
        return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return keys[at] == hashes, at


def _score_words(model: LanguageModel, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``(words, languages)``: a known word's log frequencies, else the mean over its longest known n-grams.

    A word not known backs off to 5-grams of the word with its edges, then to
    4 and so on down to single characters; if none is known, all languages
    score alike.
    """
    out = np.zeros((len(starts), len(model.langs)))
    known, at = _lookup(model.tables[0], _word_hashes(points, starts, ends))
    out[known] = model.tables[0][1][at[known]]
    rest = np.flatnonzero(~known)
    for n in GRAMS:
        counts = np.maximum(ends[rest] - starts[rest] + 3 - n, 0)
        if not counts.sum():
            continue
        owner = np.repeat(np.arange(len(rest)), counts)
        first = np.repeat(np.cumsum(counts) - counts, counts)
        places = starts[rest][owner] - 1 + np.arange(len(owner)) - first
        found, at = _lookup(model.tables[n], _gram_hashes(points, n)[places])
        hits = np.bincount(owner[found], minlength=len(rest))
        for k in range(len(model.langs)):
            total = np.bincount(owner[found], model.tables[n][1][at[found], k], minlength=len(rest))
            out[rest, k] += np.where(hits > 0, total / np.maximum(hits, 1), 0)
        rest = rest[hits == 0]
    return out


def predict_texts(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    held = [(t or "").lower() for t in texts]
    points = np.frombuffer(("\n" + "\n".join(held) + "\n\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[points]
    points = np.where(letter, points, 0)
    turn = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    starts, ends = turn[0::2], turn[1::2]
    lengths = np.fromiter((len(t) + 1 for t in held), np.int64, len(held))
    owner = np.searchsorted(np.cumsum(lengths), starts - 1, side="right")
    words = np.bincount(owner, minlength=len(held))
    if not len(starts) or not model.langs:
        return [UNKNOWN] * len(held), np.zeros(len(held))
    scores = _score_words(model, points, starts, ends)
    total = np.stack([np.bincount(owner, scores[:, k], minlength=len(held)) for k in range(len(model.langs))], axis=1)
    total /= np.sqrt(np.maximum(words, 1))[:, None]  # the words of a text are not independent
    best = total.argmax(axis=1)
    share = 1.0 / np.exp(np.maximum(total - total.max(axis=1, keepdims=True), -50.0)).sum(axis=1)
    return [model.langs[b] if n else UNKNOWN for b, n in zip(best, words, strict=True)], np.where(words > 0, share, 0.0)


def _log_table(size: int, keys: list[str], counts: list[list[int]], langs: int) -> tuple[np.ndarray, np.ndarray]:
    """Add-half log frequencies, centred per key so that a key's scores say only which language it favours."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros((0, langs))
    smooth = np.array(counts, np.float64) + 0.5
    logs = np.log(smooth / smooth.sum(axis=0))
    logs = np.maximum(logs - logs.max(axis=1, keepdims=True), -8.0)
    points = np.frombuffer("".join(keys).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(k) for k in keys])
    starts = ends - [len(k) for k in keys]
    if size:
        hashes = _gram_hashes(np.where(np.isin(points, [ord("<"), ord(">")]), 0, points), size)[starts]
    else:
        hashes = _word_hashes(points, starts, ends)
    order = np.argsort(hashes)
    return hashes[order], logs[order]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (size 0) and padded n-grams per language, summed within a batch."""
    for batch in batches:
        counts: dict[str, Counter] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
        rows: Counter = Counter()
        for lang, words in counts.items():
            for word, n in words.items():
                rows[(0, word, lang)] += n
                padded = f"<{word}>"
                for size in GRAMS:
                    for i in range(len(padded) - size + 1):
                        rows[(size, padded[i : i + size], lang)] += n
        keys = list(rows)
        for start in range(0, len(keys), 50_000):
            part = keys[start : start + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in part], pa.int32()), pa.array([k[1] for k in part], pa.string()), pa.array([k[2] for k in part], pa.string()), pa.array([rows[k] for k in part], pa.int64())],
                names=["size", "piece", "lang", "n"],
            )


def fit_language_model(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    max_docs: int = MAX_FIT_DOCS,
    max_words: int = MAX_WORDS,
    max_grams: int = MAX_GRAMS,
    max_langs: int = MAX_LANGS,
    least_docs: int = LEAST_FIT_DOCS,
) -> LanguageModel:
    """Fit on at most about ``max_docs`` labelled documents, and ``least_docs`` of each language.

    Documents are chosen language by language by a hash of all their columns,
    the id included, so that neither copies of one text nor a rare language
    fall out together.  Rows with a null text or language are not used; a
    language none of whose rows was chosen is not learned.  The model holds the
    ``max_langs`` most frequent languages, ``max_words`` words and
    ``max_grams`` n-grams of each length, most frequent first (ties in code
    point order), so its size does not depend on the input's.
    """
    place = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in labelled.columns if labelled.schema[c].dataType.typeName() not in ("map", "variant"))), F.lit(1_000_000))
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), place.alias("place")).where("text is not null and lang is not null")
    per_lang = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()}
    total = sum(per_lang.values())
    if not per_lang:
        return LanguageModel((), {n: _log_table(n, [], [], 0) for n in (0, *GRAMS)})
    if total > max_docs:
        upto = {lang: math.ceil(1_000_000 * max(max_docs / total, least_docs / n)) for lang, n in per_lang.items()}
        limit = F.create_map(*(F.lit(x) for pair in upto.items() for x in pair))[F.col("lang")]
    else:
        limit = F.lit(1_000_000)
    rows = materialize(rows.where(F.col("lang").isin(*per_lang) & (F.col("place") < limit)).select("text", "lang"), "fit")
    langs = tuple(sorted(r["lang"] for r in rows.select("lang").distinct().collect()))  # max_langs at most
    counted = rows.mapInArrow(_pieces, "size int, piece string, lang string, n long")
    by_lang = [F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0)) for lang in langs]
    pieces = materialize(counted.groupBy("size", "piece").agg(F.sum("n").alias("total"), F.array(*by_lang).alias("by")), "pieces")
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in (0, *GRAMS):
        top = pieces.where(F.col("size") == size).orderBy(F.desc("total"), "piece").limit(max_grams if size else max_words)
        found = top.select("piece", "by").toArrow()
        tables[size] = _log_table(size, found["piece"].to_pylist(), found["by"].to_pylist(), len(langs))
    return LanguageModel(langs, tables)


def _predict(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for start, end in slices(texts):
            langs, scores = predict_texts(model.value, texts[start:end])
            yield pa.RecordBatch.from_arrays(
                [*(c.slice(start, end - start) for c in batch.columns[1:]), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=[*batch.schema.names[1:], "lang_pred", "score"],
            )


def predict_language(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of each row with ``lang_pred`` and ``score``.

    Only the text is an input.  Whole texts are scored; a null text or one
    without letters gives ``und`` and 0, as does a model that learned no
    language.  Ties go to the first language in code point order; repeated
    rows score alike.
    """
    base = docs.select(F.col(text_col).alias("__text"), *keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return base.mapInArrow(lambda it: _predict(it, shared), extended(base, "lang_pred string, score double"))


def language_folds(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``held_out``: crc32 of the id as text, modulo 4, is 2 (false for a null id)."""
    return docs.withColumn("held_out", F.coalesce(fold(id_col, 4) == 2, F.lit(False)))
