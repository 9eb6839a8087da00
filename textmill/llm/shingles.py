"""Word-shingle hash sets with numpy, many documents at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK_BYTES = 1 << 19  # text bytes hashed together; bounds a worker's memory

_WORD_BASE = np.uint64(0x9E3779B97F4A7C55)
_WORD_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        made = []
        for base in (_WORD_BASE, _WORD_BASE_INVERSE):
            seq = np.full(size, base, np.uint64)
            seq[0] = 1
            made.append(np.cumprod(seq, dtype=np.uint64))
        if size > 4 * CHUNK_BYTES:  # one very long document: do not keep its tables
            return made[0], made[1]
        _powers = (made[0], made[1])
    return _powers


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``symbols[start:end]`` (uint64) for each span."""
    powers, inverse = _powers_to(len(symbols))
    prefix = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum((symbols + np.uint64(1)) * powers[: len(symbols)], out=prefix[1:])
    return mix(((prefix[ends] - prefix[starts]) * inverse[starts]) ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word ``[^\\x20\\x09-\\x0D]+`` and the index of its text."""
    buf = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    space = _IS_SPACE[buf]
    turn = space[1:] != space[:-1]
    at = np.flatnonzero(turn) + 1
    starts, ends = at[0::2], at[1::2]
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    owner = np.searchsorted(np.cumsum(lengths), starts - 1, side="right")
    return span_hashes(buf.astype(np.uint64), starts, ends), owner


def shingle_sets(texts: list[bytes], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts and the count per text.

    A text with fewer than ``size`` words has its whole word sequence as one
    shingle; a text without words has none.
    """
    words, owner = word_hashes(texts)
    counts = np.bincount(owner, minlength=len(texts))
    weights = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
    n = max(0, len(words) - size + 1)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total += words[j : j + n] * weights[j]
    whole = owner[:n] == owner[size - 1 : size - 1 + n]
    hashes, docs = mix(total[whole]), owner[:n][whole]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        first = np.concatenate([[0], np.cumsum(counts)])
        extra = np.array([(words[first[d] : first[d + 1]] * weights[: counts[d]]).sum(dtype=np.uint64) for d in short])
        hashes = np.concatenate([hashes, mix(extra + counts[short].astype(np.uint64) * np.uint64(0xA0761D6478BD642F))])
        docs = np.concatenate([docs, short])
    order = np.lexsort((hashes, docs))
    hashes, docs = hashes[order], docs[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    return hashes[fresh], np.bincount(docs[fresh], minlength=len(texts))


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Consecutive slices of ``texts`` of about ``CHUNK_BYTES`` characters, one text at least."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "") + 1
        if size >= CHUNK_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """:func:`slices` of ``texts`` as bytes with A-Z lower-cased, and where each begins."""
    for start, end in slices(texts):
        yield start, [(text or "").encode("utf-8", "surrogatepass").lower() for text in texts[start:end]]
