"""License scans, phrase mining and centroid clustering against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from textmill.llm import collocations as phrases
from textmill.llm import license_scan
from textmill.llm.centroids import Plan, centroid_clusters, scan, squared, step
from textmill.llm.collocations import collocations, frequent_filter
from textmill.llm.license_scan import NOTICES, PHRASES, Notice, Scanner, license_digest, scan_licenses


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- license scans


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute_places(text, notice):
    """Edits by (first word, last word) of every span of words within the notice's edits, its head exact."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
    out = {}
    for i in range(len(words)):
        for j in range(i, min(len(words), i + notice.text.count(" ") + notice.edits + 1)):
            span = " ".join(words[i : j + 1])
            if abs(len(span) - len(notice.text)) <= notice.edits and span.startswith(notice.head):
                d = distance(span[len(notice.head) :], notice.text[len(notice.head) :])
                if d <= notice.edits:
                    out[i, j] = d
    return words, out


def mangled(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        at = rng.randrange(len(chars))
        chars[at : at + rng.choice([0, 1])] = rng.choice(["", "x", "é", " ", "日"])
    return "".join(chars)


def license_texts(n=60):
    rng = random.Random(5)
    filler = ["The", "licenses", "of", "mit", "É", "gnu-", "2.0", "general", "cc", "by", "\n", "日本", "apache"]
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 9)):
            parts += rng.choices(filler, k=rng.randrange(4))
            parts.append(mangled(rng, rng.choice(PHRASES + NOTICES)[1].title(), rng.choice([0, 0, 1, 2, 4])))
        yield rng.choice([" ", ", ", "\t- "]).join(parts)


@pytest.mark.parametrize("chunk", [1 << 20, 40])
def test_places_match_brute_force(monkeypatch, chunk):
    monkeypatch.setattr(license_scan, "CHUNK", chunk)
    scanner = Scanner(PHRASES + NOTICES)
    for text in license_texts():
        n_words, places = scanner.scan(text)
        for notice in scanner.notices:
            words, want = brute_places(text, notice)
            assert n_words == len(words)
            got = {(p["first_word"], p["last_word"]): p for p in places if p["notice"] == notice.text}
            assert {k for k, p in got.items() if p["edits"] == 0} == {k for k, d in want.items() if d == 0}
            for (i, j), p in got.items():
                assert want[i, j] <= p["edits"] <= notice.edits
                assert re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text[p["start"] : p["stop"]])) == words[i : j + 1]
            for (i, j), d in want.items():  # none is lost: it, or one no worse that overlaps it
                assert any(a <= j and i <= b and p["edits"] <= d for (a, b), p in got.items())


def test_notices_that_overlap_themselves_and_heads():
    scanner = Scanner([("x", "la la la"), ("y", "so long and so long")])
    _, places = scanner.scan("la la la la la; so long and so long and so long")
    assert [(p["label"], p["first_word"]) for p in places] == [("x", 0), ("x", 1), ("x", 2), ("y", 5), ("y", 8)]
    assert Scanner(PHRASES).scan("submit license emit license")[1] == []
    assert Notice.of("m", "mit license").head == "mit "


def test_license_digest_and_edge_rows(spark):
    rows = [
        (1, "Released under the MIT License, or the MIT Licence."), (1, "Released under the MIT License, or the MIT Licence."), (2, None), (3, ""),
        (None, "GNU Genral Public License; CC BY 4.0, Apache\nLicense"), (4, "word " * 400_000 + "mit license"), (5, "x" * 2_500_000 + " cc by"),
    ]
    df = spark.createDataFrame([(i, t, "p", 7) for i, t in rows], "doc_id long, text string, places string, n_words int")
    got = [r.asDict() for r in license_digest(scan_licenses(df)).collect()]
    first = [r for r in got if r["doc_id"] == 1]
    assert len(first) == 2 and first[0] == first[1]
    assert (first[0]["n_base"], first[0]["first_word"], first[0]["last_word"], first[0]["base_labels"], first[0]["score"]) == (1, 3, 3, "mit", 1.0)
    named = {r["doc_id"]: r for r in got}
    assert (named[None]["base_labels"], named[None]["labels"], named[None]["n_base"]) == ("apache,cc-by", "apache,cc-by,gpl", 2)
    for i in (2, 3):
        assert tuple(named[i].values()) == (i, 0, 0, None, None, "", "", 0.0)
    assert (named[4]["n_words"], named[4]["first_word"]) == (400_002, 400_000)
    assert (named[5]["n_words"], named[5]["first_word"]) == (3, 1)
    assert license_digest(scan_licenses(df.limit(0))).collect() == []


# --- phrases


def brute_phrases(rows, longest=3, least=10, covered=50, top=2000):
    counts, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        f = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update(tuple(words[i : i + m]) for m in range(1, longest + 1) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            around = (b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
            if not any(100 * b >= covered * a for b in around):
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def phrase_rows():
    rng = random.Random(2)
    vocabulary = ["a", "B", "c", "dé", "日本", "e-f", "g", "it's", "\x00z", "　q"]
    ends = [" ", " ", " ", "\t", "  ", ". ", ", ", "\n", "!", " ; "]
    text = lambda n: "".join(rng.choice(vocabulary[: rng.choice([3, 10])]) + rng.choice(ends) for _ in range(n))
    rows = [(text(rng.randrange(60)), rng.choice(["en", "de", None])) for _ in range(150)]
    return rows + rows[:20] + [(None, "en"), ("", "xx"), ("...", "yy"), ("solo", "zz"), (text(3000), "en"), ("x y z w " * 200, "en")]


@pytest.mark.parametrize(("longest", "top"), [(3, 2000), (4, 7), (2, 5)])
def test_phrases_match_brute_force(spark, longest, top):
    rows = phrase_rows()
    df = spark.createDataFrame([(t, lang, 1, "p") for t, lang in rows], "text string, lang string, n int, phrase string").repartition(3)
    assert sorted(map(tuple, collocations(df, longest=longest, top=top).collect())) == brute_phrases(rows, longest, top=top)
    assert collocations(df.limit(0)).collect() == []


class All:
    def has(self, lang, words):
        return np.ones(len(words), bool)


@pytest.mark.parametrize("chunk", [7, 40, 1 << 20])
@pytest.mark.parametrize("length", [1, 2, 3, 4])
def test_counts_do_not_depend_on_chunks(monkeypatch, chunk, length):
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    texts = [t or "" for t, _ in phrase_rows()] + ["longwordlongword " * 3 + "a " + "longwordlongword"]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array([t.encode() for t in texts])], names=["lang", "text"])
    got, numbers = Counter(), phrases._Numbers()
    for _, text in phrases._chunks(iter([batch]), length - 1):
        code = phrases._coded(text, numbers)
        found, counts = phrases._phrases(code, list(numbers), length, b"en", [All()] * length)
        got.update(dict(zip(found, counts.tolist(), strict=True)))
    want = Counter()
    for text in texts:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            want.update(" ".join(w[i : i + length]).encode() for i in range(len(w) - length + 1))
    assert got == want


def test_filter_never_denies_a_frequent_phrase(spark):
    level = [("en", f"w{i} é{i}") for i in range(3000)] + [("de", "日本 x"), ("q", "w" * 100)]
    held = frequent_filter(spark.createDataFrame(level, "lang string, phrase string"))
    assert all(held.has(lang.encode(), [p.encode()])[0] for lang, p in level)
    assert held.has(b"xx", [p.encode() for _, p in level]).mean() < 0.2


# --- centroids


def brute_clusters(rows, k, dim, rounds=10):
    whole = lambda x: max(-(2**53), min(2**53, math.floor(1024 * x)))
    kept = [(i, [whole(x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [p for _, p in sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), p) for i, p in kept)[:k]]
    far = lambda p, q: sum((a - b) ** 2 for a, b in zip(p, q, strict=True))
    nearest = lambda: [min(range(len(centroids)), key=lambda j: (far(p, centroids[j]), j)) for _, p in kept]
    for _ in range(rounds):
        own = nearest()
        for j in range(len(centroids)):
            if mine := [p for (_, p), c in zip(kept, own, strict=True) if c == j]:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [(i, c, far(p, centroids[c]), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for (i, p), c in zip(kept, nearest(), strict=True)]


@pytest.mark.parametrize(("dim", "k", "n", "spread"), [(4, 8, 300, 0.004), (64, 8, 200, 1), (3, 20, 300, 0.02), (5, 8, 40, 1e7), (4, 8, 5, 1)])
def test_clusters_match_brute_force(spark, dim, k, n, spread):
    rng = random.Random(n)
    rows = [(i, [rng.gauss(0, 1) * spread for _ in range(dim)]) for i in range(n)]
    rows += [rows[0], rows[0], (None, rows[1][1]), (900, None), (901, [1.0] * (dim - 1)), (902, [None] + [1.0] * (dim - 1)), (903, [math.nan] * dim), (904, [math.inf] * dim)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, point string").repartition(3)
    got = centroid_clusters(df, dim=dim, clusters=k).collect()
    want = brute_clusters(rows, k, dim)
    fit = lambda x: x if x < 2**63 else None
    assert sorted(((r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in got), key=str) == sorted(((i, c, fit(d), s) for i, c, d, s in want), key=str)
    sums = Counter()
    for _, c, d, _ in want:
        sums[c] += d
    assert all((r.cluster_inertia, r.inertia) == (fit(sums[r.cluster]), fit(sum(sums.values()))) or spread > 1 for r in got)


def test_no_sound_vectors(spark):
    df = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<float>")
    assert centroid_clusters(df).collect() == [] and centroid_clusters(df.limit(0)).collect() == []


def test_bounds_hold_and_spare_distances():
    """After each move the bounds are true, the clusters those of a full scan, and most vectors are not measured again."""
    rng = np.random.default_rng(3)
    points = np.floor(rng.normal(0, 300, (2000, 6)) + rng.integers(0, 5, (2000, 1)) * 900)
    centroids = np.array([[int(x) for x in p] for p in points[:12]], object)
    state = scan(points, Plan(centroids, np.zeros(0), 4))
    for n in range(6):
        moved = centroids + rng.integers(-40, 41, centroids.shape).astype(object)
        moves = np.sqrt(((centroids - moved) ** 2).sum(1).astype(float)) * (1 + 1e-15)
        centroids, plan = moved, Plan(moved, moves, 4 - n // 2)
        state, used = step(points, plan, state)
        own, upper, tracked, lower, rest = state
        d = np.sqrt(squared(points, centroids))
        assert (own == d.argmin(1)).all() and tracked.shape[1] == 4 - n // 2 and used <= 4
        assert (upper >= d[np.arange(2000), own]).all() and (lower <= np.take_along_axis(d, tracked, 1)).all()
        for i in range(0, 2000, 50):
            others = [c for c in range(12) if c != own[i] and c not in tracked[i]]
            assert rest[i] <= d[i, others].min()
