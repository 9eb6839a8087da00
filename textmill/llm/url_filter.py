"""URL rules matched by a bit-parallel wildcard automaton."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path) of the production list: host with all its subdomains, path prefix.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Globs over ``.host|path`` that block a URL no rule decides; ``|`` stands between host and path.
BLOCK_GLOBS = (".spam-*|*", "*.cheap-pills.*|*", "*casino*|*", "*|*.exe")
DEFAULT = "allow"

SEPARATOR, ALPHABET = 256, 257  # symbols are bytes, and one that no byte equals


@dataclass(frozen=True)
class Automaton:
    """Shift-And masks of several patterns packed into 64-bit words.

    Each pattern has a start bit and one bit per symbol; ``loops`` holds the
    bits that stay set on any symbol, those before a ``*``.
    """

    symbols: np.ndarray  # (ALPHABET, words)
    loops: np.ndarray
    start: np.ndarray
    finals: tuple[int, ...]

    @staticmethod
    def build(globs: Sequence[str]) -> Automaton:
        """``*`` any run, ``?`` any one byte, ``|`` the separator, all else itself."""
        width = sum(1 + len([c for c in _tokens(g) if c != "*"]) for g in globs)
        words = max(1, -(-width // 64))
        symbols, loops, start = np.zeros((ALPHABET, words), np.uint64), np.zeros(words, np.uint64), np.zeros(words, np.uint64)
        finals, at = [], 0
        put = lambda mask, bit: mask.__setitem__(bit // 64, mask[bit // 64] | np.uint64(1 << (bit % 64)))
        for glob in globs:
            put(start, at)
            for token in _tokens(glob):
                if token == "*":
                    put(loops, at)
                    continue
                at += 1
                for symbol in range(SEPARATOR) if token == "?" else [token]:
                    put(symbols[symbol], at)
            finals.append(at)
            at += 1
        return Automaton(symbols, loops, start, tuple(finals))

    def match(self, rows: Sequence[np.ndarray]) -> np.ndarray:
        """``(len(rows), patterns)`` booleans; each row is an array of symbols.

        All rows advance together, longest first, so a step touches only the
        rows that still have symbols.
        """
        order = np.argsort([-len(r) for r in rows], kind="stable")
        lengths = np.array([len(rows[i]) for i in order])
        flat = np.concatenate([rows[i] for i in order]) if len(rows) else np.zeros(0, np.int64)
        begins = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        state = np.tile(self.start, (len(rows), 1))
        live = len(rows)
        for step in range(int(lengths[0]) if len(rows) else 0):
            while live and lengths[live - 1] <= step:
                live -= 1
            now = state[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.symbols[flat[begins[:live] + step]]) | (now & self.loops)
        out = np.zeros((len(rows), len(self.finals)), bool)
        for p, bit in enumerate(self.finals):
            out[order, p] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)
        return out


def _tokens(glob: str) -> list[int | str]:
    out: list[int | str] = []
    for c in glob:
        if c in "*?":
            out.append(c)
        else:
            out.extend([SEPARATOR] if c == "|" else c.encode("utf-8"))
    return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path; both empty for null or without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    before = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, slash, path = before.partition("/")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path


def _symbols(host: str, path: str) -> np.ndarray:
    bytes_of = lambda text: np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return np.concatenate([bytes_of("." + host), [SEPARATOR], bytes_of(path)]).astype(np.int64)


def _judge(batches: Iterator[pa.RecordBatch], rules, globs, default) -> Iterator[pa.RecordBatch]:
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))
    automaton = Automaton.build([f"*.{h}|{p}*" for _, h, p in ranked] + list(globs))
    for batch in batches:
        for start in range(0, batch.num_rows, 4096):
            part = batch.slice(start, 4096)
            split = [split_url(u) for u in part.column(1).to_pylist()]
            hits = automaton.match([_symbols(h, p) for h, p in split])
            ruled, blocked = hits[:, : len(ranked)], hits[:, len(ranked) :].any(axis=1)
            best = np.where(ruled.any(axis=1), ruled.argmax(axis=1), -1) if ranked else np.full(len(split), -1)
            columns = [
                [h for h, _ in split],
                [p for _, p in split],
                [None if b < 0 else ranked[b][1] + ranked[b][2] for b in best],
                [ranked[b][0] if b >= 0 else "block" if x else default for b, x in zip(best, blocked, strict=True)],
            ]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.string()) for c in columns)], names=["page_id", "host", "path", "rule", "verdict"])


def judge_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    block_globs: Sequence[str] = BLOCK_GLOBS,
    default: str = DEFAULT,
) -> DataFrame:
    """One row per input row: ``page_id, host, path, rule, verdict``.

    The longest rule whose host equals the URL's or is a parent domain of it,
    and whose path starts the URL's, decides; equal lengths: the longer host,
    then the smaller rule.  Else a matching glob of ``block_globs`` blocks,
    else ``default``.  All patterns run at once over each URL in a single
    pass, whole URLs of any length.  A null URL, or one without ``://``, has
    an empty host and path and no rule.  Null ids and repeated rows pass
    through; extra columns are ignored; an empty table gives an empty result.
    """
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    kind = base.schema["page_id"].dataType.simpleString()
    rules, globs = tuple(rules), tuple(block_globs)
    return base.mapInArrow(
        lambda it: _judge(it, rules, globs, default),
        f"page_id {kind}, host string, path string, rule string, verdict string",
    )
