"""Tokens of many texts as numpy hashes."""

from __future__ import annotations

import numpy as np

from textmill.llm.shingles import span_hashes

SPACE, LETTER, DIGIT, OTHER = range(4)
_kinds: np.ndarray | None = None


def kinds() -> np.ndarray:
    """The kind of each code point."""
    global _kinds
    if _kinds is None:
        chars = map(chr, range(0x110000))
        _kinds = np.fromiter((SPACE if c.isspace() else LETTER if c.isalpha() else DIGIT if c.isdigit() else OTHER for c in chars), np.int8, 0x110000)
    return _kinds


def tokenize(texts: list[str | None], wanted: tuple[int, ...], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of characters of one of the ``wanted`` kinds, and the index of its text."""
    held = [(t or "").lower() if lower else (t or "") for t in texts]
    points = np.frombuffer(("\n" + "\n".join(held) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds()[points]
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(points)]])
    take = np.isin(kind[starts], wanted)
    starts, ends = starts[take], ends[take]
    lengths = np.fromiter((len(t) + 1 for t in held), np.int64, len(held))
    owner = np.searchsorted(np.cumsum(lengths), starts - 1, side="right")
    return span_hashes(points.astype(np.uint64), starts, ends), owner
