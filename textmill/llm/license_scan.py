"""License notices found despite small edits.

Within ``edits`` errors at least one of ``edits + 1`` pieces of a notice stays
as it is, so exact searches for the pieces name every place where the notice
can stand.  The regex library's bounded-error matching then decides at each
such place and gives the span and the number of errors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: (label, notice in lower-case words) of the production list; the first four are the base.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
#: Further notices, longer ones with more edits.
NOTICES = (
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl", "mozilla public license"),
    ("epl", "eclipse public license"),
    ("bsd", "bsd license"),
    ("bsd", "redistribution and use in source and binary forms"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("cc-by", "creative commons attribution"),
    ("cc-by-nc", "cc by nc"),
    ("cc-by-sa", "cc by sa"),
    ("cc0", "cc0 1 0 universal"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: One edit for about so many characters; words of up to HEAD characters at the start are exact, as one edit makes another word of them.
CHARS_EACH, HEAD = 12, 3
#: Bytes of text searched at once, between words.
CHUNK = 1 << 20

_CHARS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))

PLACES = "places array<struct<label: string, notice: string, edits: int, first_word: bigint, last_word: bigint, start: bigint, stop: bigint>>"


@dataclass(frozen=True)
class Notice:
    """A notice, the pieces that locate it with their places in it, and its pattern."""

    label: str
    text: str
    edits: int
    head: str

    @staticmethod
    def of(label: str, text: str) -> Notice:
        words = text.split(" ")
        n = 0
        while n < len(words) and len(words[n]) <= HEAD:
            n += 1
        head = " ".join(words[:n]) + (" " if 0 < n < len(words) else "")
        return Notice(label, text, round((len(text) - len(head)) / CHARS_EACH), head)

    @property
    def pieces(self) -> list[tuple[int, bytes]]:
        """``edits + 1`` pieces of about equal length that cover the notice."""
        parts = self.edits + 1
        ends = [len(self.text) * i // parts for i in range(parts + 1)]
        return [(a, self.text[a:b].encode()) for a, b in zip(ends, ends[1:], strict=False)]

    @property
    def width(self) -> int:
        return len(self.text.encode())

    def pattern(self) -> regex.Pattern:
        rest = regex.escape(self.text[len(self.head) :])
        body = regex.escape(self.head) + (f"(?:{rest}){{e<={self.edits}}}" if self.edits else rest)
        return regex.compile(rf"(?b)(?<=\ )(?:{body})(?=\ )")  # the best match, whole words


class Scanner:
    def __init__(self, notices: Sequence[tuple[str, str]]) -> None:
        self.notices = [Notice.of(label, text) for label, text in notices]
        self.patterns = [n.pattern() for n in self.notices]
        self.seeds: dict[bytes, list[tuple[int, int]]] = {}
        for i, n in enumerate(self.notices):
            for at, piece in n.pieces:
                self.seeds.setdefault(piece, []).append((i, at))
        self.words = max((n.text.count(" ") + n.edits + 2 for n in self.notices), default=1)  # a match has no more words
        self.verify = lru_cache(maxsize=1 << 16)(self._verify)

    def _verify(self, i: int, window: str) -> tuple[int, int, int] | None:
        """Start, end and errors of the best match of notice ``i`` in a window of characters."""
        found = self.patterns[i].search(window)
        return None if found is None else (found.start(), found.end(), sum(found.fuzzy_counts))

    def search(self, line: bytes) -> list[tuple[int, int, int, int]]:
        """``(notice, start, end, errors)`` in bytes of ``line``, words with single blanks between, before and behind them.

        Places without errors are all there; of those with errors the best
        ones that overlap no better one of the same notice.
        """
        found: set[tuple[int, int, int, int]] = set()
        for seed, uses in self.seeds.items():
            at = line.find(seed)
            while at >= 0:
                for i, offset in uses:
                    n = self.notices[i]
                    slack = 4 * n.edits + 1  # an edit is a character of up to four bytes; one blank
                    lo, hi = max(0, at - offset - slack), at - offset + n.width + slack
                    raw = line[lo:hi]
                    skipped = 0
                    while skipped < len(raw) and raw[skipped] & 0xC0 == 0x80:  # the rest of a character cut in two
                        skipped += 1
                    window = raw[skipped:].decode("utf-8", "ignore")
                    tight = line[max(0, at - offset - 1) : at - offset + n.width + 1]
                    if tight == b" " + n.text.encode() + b" " and self.verify(i, f" {n.text} "):
                        found.add((i, at - offset, at - offset + n.width, 0))  # without edits, wherever others overlap it
                    elif n.edits and (place := self.verify(i, window)) is not None:
                        begin = lo + skipped + len(window[: place[0]].encode())
                        found.add((i, begin, begin + len(window[place[0] : place[1]].encode()), place[2]))
                at = line.find(seed, at + 1)
        return _settled(found)

    def scan(self, text: str | None) -> tuple[int, list[dict]]:
        """The number of words, and the places of notices with words and code points (``stop`` exclusive)."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        plain = raw.translate(_CHARS)
        total, places = 0, {}
        for words, new, start in _windows(plain, self.words):
            line = b" " + b" ".join(words) + b" "
            hits = sorted(self.search(line), key=lambda h: (h[1], h[0]))
            at, word, passed = 1, total - (len(words) - new), 0
            spans = _spans(plain, start, len(words)) if hits else []
            for i, begin, end, errors in hits:
                passed += line.count(b" ", at, begin)
                at = max(at, begin)
                last = passed + line.count(b" ", begin, end)
                places[i, spans[passed][0], spans[last][1], errors] = (word + passed, word + last)
            total += new
        kept = _settled(set(places))  # once more, for what windows share
        ends = _characters(raw, sorted({x for _, s, t, _ in kept for x in (s, t)}))
        named = self.notices
        found = [
            {"label": named[i].label, "notice": named[i].text, "edits": e, "first_word": places[i, s, t, e][0], "last_word": places[i, s, t, e][1], "start": ends[s], "stop": ends[t]}
            for i, s, t, e in sorted(kept, key=lambda h: (h[1], h[0]))
        ]
        return total, found


def _settled(found: set[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    kept, taken = [], {}
    for hit in sorted(found, key=lambda h: (h[3], h[1], h[2], h[0])):
        i, begin, end, errors = hit
        mine = taken.setdefault(i, {})
        around = [mine[c] for c in range(begin >> 6, (end >> 6) + 1) if c in mine]
        if errors and any(a < end and begin < b for cell in around for a, b in cell):
            continue
        kept.append(hit)
        for c in range(begin >> 6, (end >> 6) + 1):  # by cells of 64 bytes, so that only near ones are compared
            mine.setdefault(c, []).append((begin, end))
    return kept


def _windows(plain: bytes, carry: int) -> Iterator[tuple[list[bytes], int, int]]:
    """Words of about ``CHUNK`` bytes, the last ``carry`` of those before with them; how many are new; where the first begins."""
    start, held, held_at = 0, [], 0
    while start < len(plain) or not start:
        cut = len(plain)
        if cut - start > CHUNK:
            cut = plain.rfind(b" ", start + 1, start + CHUNK)
            if cut < 0:  # one word longer than a chunk
                cut = plain.find(b" ", start + CHUNK)
                cut = len(plain) if cut < 0 else cut
        new = plain[start:cut].split()
        yield [*held, *new], len(new), held_at if held else start
        held = [*held, *new][-carry:]
        at = cut
        for w in reversed(held):
            at = plain.rfind(w, 0, at)
        held_at, start = at, cut
        if cut == len(plain):
            return


def _spans(plain: bytes, start: int, count: int) -> list[tuple[int, int]]:
    """Where ``count`` words from ``start`` on begin and end."""
    out, at = [], start
    for _ in range(count):
        while plain[at] == 0x20:
            at += 1
        end = plain.find(b" ", at)
        end = len(plain) if end < 0 else end
        out.append((at, end))
        at = end
    return out


def _characters(raw: bytes, places: list[int]) -> dict[int, int]:
    """Code points before each byte."""
    out, last, chars = {}, 0, 0
    for p in places:
        chars += len(raw[last:p].decode("utf-8", "surrogatepass"))
        out[p], last = chars, p
    return out


def _scan_batches(batches: Iterator[pa.RecordBatch], notices, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    scanner = Scanner(notices)
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            found = [scanner.scan(t.as_py()) for t in part.column(0)]
            columns = [part.column(1), pa.array([n for n, _ in found], pa.int64()), pa.array([p for _, p in found], schema.field("places").type)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: Sequence[tuple[str, str]] = PHRASES + NOTICES) -> DataFrame:
    """One row per input row: ``doc_id, n_words, places``.

    A-Z are lower-cased; words are runs of digits, a-z and characters beyond
    ASCII.  A place has the notice's label and words, the number of edits (one
    for about ``CHARS_EACH`` characters, none in short words at its
    start), its first and last word counted from 0, and its code points,
    ``stop`` exclusive.  A notice matches whole words with one blank between.
    Places without edits are all reported; of places with edits that overlap
    another of the same notice the one with the fewest edits, then the first.
    Notices may overlap each other.

    Texts are searched whole, in windows that share enough words for any
    match.  A null text is an empty one, without words or places; null ids and
    repeated rows pass through; extra columns are ignored; an empty table
    gives an empty result.
    """
    base = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"))
    out = StructType([base.schema["doc_id"], *StructType.fromDDL(f"n_words bigint, {PLACES}").fields])
    schema, notices = to_arrow_schema(out), tuple(notices)
    return base.mapInArrow(lambda it: _scan_batches(it, notices, schema), out)


def _labels(places: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")


def license_digest(scanned: DataFrame, base: Sequence[tuple[str, str]] = PHRASES) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of :func:`scan_licenses` rows.

    The base are places of ``base`` notices without edits.  ``score`` is the
    best place's share of characters without edits, 0 without a place.
    """
    named = F.array(*(F.lit(text) for _, text in base))
    exact = F.filter("places", lambda p: (p["edits"] == 0) & F.array_contains(named, p["notice"]))
    starts = F.transform(exact, lambda p: p["first_word"])
    shares = F.transform("places", lambda p: 1 - p["edits"] / F.length(p["notice"]))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(exact).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        _labels(exact).alias("base_labels"),
        _labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(shares), F.lit(0.0)).alias("score"),
    )
