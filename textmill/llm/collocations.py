"""Phrases whose words keep together, mined level by level.

A phrase can be frequent only if both of its overlapping parts are.  So each
level counts phrases one word longer than the last, and a task emits a phrase
only where the broadcast filter of the level below has both parts.  Scores are
computed from the tables of the levels, never from the text again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm.common import broadcast_if_small, materialize

LEAST, LONGEST, TOP, COVERED = 10, 3, 2000, 50
#: Bits of a filter for each phrase in it, and bounds of its size: 16 MB at most, however large the level below.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 27
#: Rows of a level that may be broadcast to a join.
MAX_BROADCAST = 200_000
#: Bytes of text split into words at once, longer texts being cut between words; and words of a language counted together in a task.
CHUNK, HELD = 1 << 20, 5 << 19

_CHARS = bytes(
    0x0A if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 0x09 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)
)  # A-Z lower-cased, a newline for what ends a piece, a blank for what ends a word
_BLANK, _END = 0, 1


class _Numbers(dict):
    """Numbers the words it is asked for."""

    def __init__(self) -> None:
        super().__init__({b"": _BLANK, b"\n": _END})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Filter:
    """Whether a phrase may be frequent: a fixed number of bits set by hash.

    It may say yes of a phrase that is not, which then is counted and found
    too rare; it never says no of one that is.
    """

    def __init__(self, bits: int, words: np.ndarray) -> None:
        self.bits, self.words = bits, words

    def has(self, lang: bytes, phrases: list[bytes]) -> np.ndarray:
        digest = xxhash.xxh64_intdigest
        hashed = np.fromiter((digest(lang + b"\0" + p, 42) & (self.bits - 1) for p in phrases), np.int64, len(phrases))
        return (self.words[hashed >> 6] >> (hashed & 63).astype(np.uint64)) & np.uint64(1) == 1


def frequent_filter(level: DataFrame) -> Filter:
    """The filter of a level's phrases; the driver gets one number per 64 bits, not the phrases."""
    bits = LEAST_BITS
    rows = level.count()
    while bits < min(MOST_BITS, BITS_EACH * rows):
        bits *= 2
    at = F.xxhash64(F.concat("lang", F.lit("\0"), "phrase")).bitwiseAND(F.lit(bits - 1)).alias("at")
    set_bits = level.select(at).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 AS int))").alias("bit"))
    found = set_bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return Filter(bits, words)


def _chunks(batches: Iterator[pa.RecordBatch], carry: int) -> Iterator[tuple[str, bytes]]:
    """Language and text of about ``CHUNK`` bytes with pieces ended by newlines.

    A text that is cut goes on with the last ``carry`` words, too few for a phrase by themselves.
    """
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py().translate(_CHARS)
            start, last = 0, []
            while len(text) - start > CHUNK:  # the cut is between words, and the words a phrase needs go along
                cut = max(text.rfind(end, start + 1, start + CHUNK) for end in (b" ", b"\n"))
                if cut < 0:  # one word longer than a chunk
                    cut = min((x for x in (text.find(b" ", start + CHUNK), text.find(b"\n", start + CHUNK)) if x > 0), default=len(text))
                yield lang, b" ".join([*last, text[start:cut]])
                begun = text.rfind(b"\n", start, cut) + 1
                last = [*([] if begun else last), *(w for w in text[begun or start : cut].split(b" ") if w)]
                start, last = cut, last[-carry:] if carry else []
            if start:
                yield lang, b" ".join([*last, text[start:]])
                continue
            held.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text)
            if size[lang] >= CHUNK:
                yield lang, b"\n".join(held.pop(lang))
                size[lang] = 0
    for lang, texts in held.items():
        yield lang, b"\n".join(texts)


def _coded(text: bytes, numbers: _Numbers) -> np.ndarray:
    """The numbers of the words and ends of pieces, with an end behind."""
    tokens = text.replace(b"\n", b" \n ").split(b" ")
    code = np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens))
    return np.append(code[code != _BLANK], np.int32(_END))


def _phrases(code: np.ndarray, words: list[bytes], length: int, lang: bytes, filters: list[Filter]) -> tuple[list[bytes], np.ndarray]:
    """Phrases of ``length`` words whose overlapping parts may be frequent, and their counts."""
    if length == 1:
        counts = np.bincount(code, minlength=len(words))
        own = np.flatnonzero(counts[2:]) + 2
        return [words[i] for i in own], counts[own]
    may = np.zeros(len(words), bool)
    may[2:] = filters[0].has(lang, words[2:])
    part, names = np.where(may[code], code, -1), words  # the phrase of the level below that begins at each place
    for n in range(2, length + 1):
        both = np.flatnonzero((part[:-1] >= 0) & (part[1:] >= 0))
        pairs = part[both].astype(np.int64) * len(words) + code[both + n - 1]
        if n == length:
            found, counts = np.unique(pairs, return_counts=True)
        else:
            found, which = np.unique(pairs, return_inverse=True)
        made = [names[p // len(words)] + b" " + words[p % len(words)] for p in found.tolist()]
        if n == length:
            return made, counts
        kept = filters[n - 1].has(lang, made)
        part = np.full(max(len(part) - 1, 0), -1, np.int32)
        part[both] = np.where(kept[which], which, -1)
        names = made
    raise AssertionError


def _emit(batches: Iterator[pa.RecordBatch], length: int, filters: list) -> Iterator[pa.RecordBatch]:
    told = [f.value for f in filters]
    held: dict[str, tuple[_Numbers, list[np.ndarray]]] = {}

    def counted(lang: str) -> Iterator[pa.RecordBatch]:
        numbers, codes = held.pop(lang)
        code = np.concatenate(codes)
        phrases, counts = _phrases(code, list(numbers), length, lang.encode(), told)
        if length == 1:  # a null phrase: all words
            phrases, counts = [*phrases, None], np.append(counts, (code != _END).sum())
        for at in range(0, len(phrases), 50_000):
            some = phrases[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(some), pa.string()), pa.array(some, pa.binary()), pa.array(counts[at : at + 50_000], pa.int64())], names=["lang", "phrase", "n"]
            )

    for lang, text in _chunks(batches, length - 1):
        numbers, codes = held.setdefault(lang, (_Numbers(), []))
        codes.append(_coded(text, numbers))
        if sum(map(len, codes)) >= HELD:
            yield from counted(lang)
    for lang in list(held):
        yield from counted(lang)


def phrase_levels(docs: DataFrame, text_col: str, lang_col: str, longest: int, least: int) -> tuple[list[DataFrame], DataFrame]:
    """``(lang, phrase, n)`` of the frequent phrases of 1 to ``longest`` words, and ``(lang, n)`` of all words."""
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(text_col, F.lit("")).cast("binary").alias("text"))
    levels, filters, words = [], [], None
    for length in range(1, longest + 1):
        found = texts.mapInArrow(lambda it, length=length, filters=tuple(filters): _emit(it, length, filters), "lang string, phrase binary, n long")
        counted = found.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | F.col("phrase").isNull())
        table = materialize(counted.withColumn("phrase", F.col("phrase").cast("string")), f"phrases-{length}")
        levels.append(table.where("phrase IS NOT NULL"))
        if length == 1:
            words = table.where("phrase IS NULL AND n > 0").select("lang", "n")
        if length < longest:
            filters.append(context.broadcast(frequent_filter(levels[-1])))
    return levels, words


def _score(a: str, left: str, right: str) -> Column:
    """``floor(1000000 * a * a / (left * right))`` in decimals, whose products hold counts up to 10^16."""
    d = lambda c: f"cast({c} AS decimal(19,0))"
    return F.expr(f"(1000000BD * ({d(a)} * {d(a)})) div ({d(left)} * {d(right)})")


def _scored(levels: list[DataFrame], length: int) -> DataFrame:
    """``lang, phrase, a, best`` of a level, ``best`` being the lowest-scoring cut ``(score, k, l, r)``."""
    out = levels[length - 1].withColumnRenamed("n", "a")
    for k in range(1, length):
        for name, words, count in ((f"l{k}", k, k), (f"r{k}", k - length, length - k)):
            part = levels[count - 1].select(F.col("lang").alias("in_lang"), F.col("phrase").alias("part"), F.col("n").alias(name))
            part = broadcast_if_small(part, MAX_BROADCAST)
            out = out.join(part, (F.col("lang") == F.col("in_lang")) & (F.substring_index("phrase", " ", words) == F.col("part"))).drop("in_lang", "part")
    cuts = [F.struct(_score("a", f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, length)]
    return out.select("lang", "phrase", "a", F.array_min(F.array(*cuts)).alias("best"))


def _covering(levels: list[DataFrame]) -> DataFrame | None:
    """``in_lang, part, most``: the largest count of a longer candidate around each shorter one."""
    found = None
    for length in range(3, len(levels) + 1):
        spans = [F.array_join(F.slice("w", i + 1, size), " ") for size in range(2, length) for i in range(length - size + 1)]
        inside = levels[length - 1].withColumn("w", F.split("phrase", " ")).select(F.col("lang").alias("in_lang"), F.explode(F.array(*spans)).alias("part"), "n")
        inside = inside.groupBy("in_lang", "part").agg(F.max("n").alias("most"))
        found = inside if found is None else found.unionByName(inside)
    return None if found is None else found.groupBy("in_lang", "part").agg(F.max("most").alias("most"))


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    longest: int = LONGEST,
    least: int = LEAST,
    covered: int = COVERED,
    top: int = TOP,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases of 2 to ``longest`` words.

    A-Z are lower-cased; ``.,;:!?`` and line ends part pieces, blanks and tabs
    part words.  ``n`` counts a language's words, ``a`` all places of the
    phrase within pieces, overlapping ones too; phrases with fewer than
    ``least`` are left out.  ``l`` and ``r`` are the counts of the two parts
    of the cut with the lowest ``score = floor(10^6 a^2 / (l r))``, the
    earliest of equal ones.  A phrase goes if a longer frequent one holds it
    and has ``covered`` percent of its places.  Order: score, places, then the
    phrase's bytes.

    A null language counts as ``und``; null and empty texts have no words;
    repeated rows count each; texts of any length are read in chunks; rows of
    other columns are ignored; an empty table gives an empty result.
    """
    levels, words = phrase_levels(docs, text_col, lang_col, longest, least)
    scored = _scored(levels, 2)
    for length in range(3, longest + 1):
        scored = scored.unionByName(_scored(levels, length))
    around = _covering(levels)
    if around is not None:
        held = (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("part")) & (100 * F.col("most") >= covered * F.col("a"))
        scored = scored.join(around, held, "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    first = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return first.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score")
