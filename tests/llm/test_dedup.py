"""Near-duplicate operators against brute force, with the edge rows every operator must take."""

import random
import re

import numpy as np
import pytest

from textmill.llm.decontaminate import contaminations, drop_contaminated
from textmill.llm.embedding_dedup import embedding_components, linked_pairs, quantise
from textmill.llm.graph import connected_components
from textmill.llm.line_dedup import BANDS, BINS, BLOCK, POINTS, SHINGLE, _linked_components, dedup_lines, line_report, line_signatures
from textmill.llm.minhash_dedup import _linked, minhash_components, minhash_keep
from textmill.llm.neardup import agreeing, band_keys, bucket_heads, components, packed, rows_with_partners, verified_pairs

DOC = "doc_id long, text string, component_id string, node string, k int, __gone int"


def docs(spark, rows):
    """With extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in rows], DOC)


def union_find(n, links):
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    return [root(i) for i in range(n)]


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def noisy_copies(seed, groups, copies, words):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "ß", "日本"]
    out = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=words)
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(words)] = rng.choice(vocabulary)
            out.append(" ".join(text))
    rng.shuffle(out)
    return out


def test_minhash_matches_brute_force(spark):
    texts = noisy_copies(1, 6, 25, 120) + ["", None, " \t\n", "one", "One", "a b c d", "a b c d", "x y z w v", "X\x0bY z w v"]
    rows = list(enumerate(texts))
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = union_find(len(sets), links)
    got = {r.doc_id: r for r in minhash_components(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, component in enumerate(want):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), component, component == i)


def test_pipeline_links_documents_from_eighty_percent(spark, tmp_path):
    import corpus_pipeline

    words = [f"w{i}" for i in range(124)]  # 120 shingles
    changed = lambda *places: " ".join("other" if i in places else w for i, w in enumerate(words))
    rows = [(1, " ".join(words)), (2, changed(20, 60)), (3, changed(5, 40, 80, 100)), (4, None), (5, "none of these words")]
    sets = {i: shingles(t) for i, t in rows}
    share = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert 0.8 <= share(1, 2) < 0.85 and max(share(1, 3), share(2, 3)) < 0.8
    frame = docs(spark, rows)
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, frame, str(tmp_path)).collect()} == {1, 3, 4, 5}
    assert {r.doc_id for r in minhash_keep(frame).collect()} == {1, 2, 3, 4, 5}


def test_minhash_edges(spark):
    rows = [(5, "a b c d e f"), (5, "q r s t u v"), (3, "q r s t u v"), (None, "a b c d e f"), (None, None), (9, "a b c d e f"), (9, "a b c d e f")]
    got = minhash_components(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.component_id for r in got}
    assert by[5] == by[3] == by[9] == 3 and by[None] is None
    kept = minhash_keep(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 3), (True, 0), (True, 0)]
    assert minhash_components(docs(spark, [])).count() == 0


def test_long_text_shingles():
    from textmill.llm import shingles as s

    long = " ".join(f"w{i % 977} é{i}" for i in range(150_000)).encode()
    assert len(long) > 2 * s.CHUNK_BYTES
    _, counts = s.shingle_sets([b"a b c", long, b""])
    assert counts.tolist() == [1, len(shingles(long.decode())), 0]


def test_tile_intersections_match_sets():
    import pandas as pd

    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 60, rng.integers(1, 60))) for _ in range(40)]
    frame = pd.DataFrame({"items": rows, "c": range(40)})
    i, j = _linked(frame[:15], frame[10:].reset_index(drop=True), 40)
    got = set(zip(i.tolist(), j.tolist(), strict=True))
    want = {
        (a, b)
        for a in range(15)
        for b in range(30)
        if a != b + 10 and 100 * len(np.intersect1d(rows[a], rows[b + 10])) >= 40 * len(np.union1d(rows[a], rows[b + 10]))
    }
    assert got == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (None, 3), (101, 100), (300, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)} | {300: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_line_bands_find_most_similar_lines():
    rng = np.random.default_rng(3)
    equal = rng.random((20_000, BINS)) < 0.8
    found = np.any([equal[:, list(b)].all(axis=1) for b in BANDS], axis=0)
    assert found.mean() > 0.98


def line_set(line):
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def brute_lines(rows):
    """Positions removed per row."""
    places, lines = [], []
    for i, text in sorted(rows, key=lambda r: r[0]):
        for pos, line in enumerate((text or "").split("\n")):
            line = line.strip(" \t\r")
            if len(line) >= 16:
                places.append((i, pos))
                lines.append(line_set(line))
    links = [(a, b) for a in range(len(lines)) for b in range(a) if len(lines[a] & lines[b]) * 100 >= 80 * len(lines[a] | lines[b])]
    gone = {}
    for n, root in enumerate(union_find(len(lines), links)):
        if root != n:
            gone.setdefault(places[n][0], []).append(places[n][1])
    return gone


def test_lines_match_brute_force(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa"]
    base = [" ".join(rng.choices(words, k=rng.randrange(8, 60))) for _ in range(12)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            line = rng.choice(base)
            if rng.random() < 0.4:
                at = rng.randrange(len(line))
                line = line[:at] + "#" + line[at + 1 :]
            lines.append(rng.choice(["", " ", "\t"]) + line + rng.choice(["", " ", "\r"]))
        lines.append("short")
        rows.append((i, "\n".join(lines)))
    rows += [(100, ""), (101, None), (102, "short"), (103, "x" * 70_000), (104, "y" * 15 + "\n" + "y" * 16)]
    got = {r.doc_id: r.removed for r in line_report(docs(spark, rows)).collect()}
    assert {k: v for k, v in got.items() if v} == brute_lines(rows) and len(got) == len(rows)
    kept = {r.doc_id: r.text for r in dedup_lines(docs(spark, rows)).collect()}
    gone = brute_lines(rows)
    for i, text in rows:
        want = text if i not in gone else "\n".join(x for p, x in enumerate(text.split("\n")) if p not in gone[i])
        if i in gone and not want.strip(" \t\r"):
            assert i not in kept
        else:
            assert kept[i] == want


def sharing_a_band(spark, pairs):
    """For each pair of lines, whether their signatures agree in all bins of a band."""
    lines = sorted({line for pair in pairs for line in pair})
    keys = {r.line: r.k for r in spark.createDataFrame([(x,) for x in lines], "line string").selectExpr("line", "xxhash64(line) AS k").collect()}
    found = {r.k: [r[f"m{j}"] for j in range(BINS)] for r in line_signatures(spark.createDataFrame([(x,) for x in lines], "text string")).collect()}
    sides = [(found.get(keys[a]), found.get(keys[b])) for a, b in pairs]
    return np.array([bool(x and y) and any(all(x[j] == y[j] for j in band) for band in BANDS) for x, y in sides])


def test_line_minima_match_brute_force(spark):
    rng = random.Random(13)
    lines = sorted({"".join(rng.choices("abcdé ", k=n)).strip() + "😀" for n in (16, 17, 20, 30, 48, 60, 100, 150, 190)})
    given = spark.createDataFrame([(x,) for x in lines], "line string")
    keys = {r.k: r.line for r in given.selectExpr("xxhash64(line) AS k", "line").collect()}
    parts = sorted({line[i : i + SHINGLE] for line in lines for i in range(len(line) - SHINGLE + 1)})
    hashes = {r.s: r.h for r in spark.createDataFrame([(x,) for x in parts], "s string").selectExpr("s", f"xxhash64(encode(s, 'UTF-32')) AS x").selectExpr("s", f"shiftleft(shiftright((x & 255) * {BINS}, 8), 56) | shiftrightunsigned(x, 8) AS h").collect()}
    signatures = line_signatures(given.withColumnRenamed("line", "text"))
    for r in signatures.collect():
        line = keys[r.k]
        held = [hashes[line[i : i + SHINGLE]] for i in range(len(line) - SHINGLE + 1)]
        assert [r[f"m{j}"] for j in range(BINS)] == [min(h ^ p for h in held) for p in POINTS]
    plan = signatures._jdf.queryExecution().optimizedPlan().toString()
    of_shingles = [x for x in plan.splitlines() if "Aggregate" in x and "min((h#" in x]
    assert len(of_shingles) == 1 and of_shingles[0].count("min(") == BLOCK  # not a minimum of each bin for each shingle


def test_short_lines_that_end_differently_share_a_band(spark):
    rng = random.Random(14)
    pairs = []
    for _ in range(1200):
        line = "".join(rng.choices("abcdefghijklmnopqrst ", k=rng.randrange(40, 64))).strip()
        other = line
        while len(line_set(line) & line_set(other[:-1].strip())) >= 0.8 * len(line_set(line)):
            other = other[:-1].strip()
        pairs.append((line, other))
    assert all(x != y for x, y in pairs) and sharing_a_band(spark, pairs).mean() > 0.95


def test_lines_of_unequal_length_share_a_band(spark):
    rng = random.Random(11)
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    letters = sorted({line.strip(" \t\r") for r in real for line in (r.text or "").split("\n")})
    letters = "".join(x for line in letters for x in line)
    pairs = []
    while len(pairs) < 600:
        at = rng.randrange(len(letters) - 1300)
        line = letters[at : at + rng.randrange(300, 1300)].strip(" \t\r")
        short = line[: int(len(line) * 0.81)].strip(" \t\r")
        if 0.8 <= len(line_set(short) & line_set(line)) / len(line_set(short) | line_set(line)) < 0.83:
            pairs.append((line, short))
    assert sharing_a_band(spark, pairs).mean() > 0.97


def test_repetitive_lines_share_a_band(spark):
    rng = random.Random(12)
    phrases = ["".join(rng.choices("abcdefghij ", k=rng.randrange(20, 40))) + "." for _ in range(100)]
    pairs = [(p * 12, p * rng.randrange(40, 120)) for p in phrases]
    assert all(line_set(a.strip()) == line_set(b.strip()) for a, b in pairs)
    assert sharing_a_band(spark, [(a.strip(), b.strip()) for a, b in pairs]).all()


def test_lines_that_differ_by_a_character_are_linked(spark):
    lines = ["The quick brown fox jumps over the lazy dog, once more.", "Готово: страница обновлена пятого числа этого месяца, да."]
    rows = [(10 * n + i, line[:at] + x + line[at + 1 :]) for n, line in enumerate(lines) for i, (at, x) in enumerate([(0, line[0]), (27, "#"), (35, "7")])]
    rows += [(90, "A line that is like none of the others, in any way at all.")]
    got = {r.doc_id: r.n_removed for r in line_report(docs(spark, rows)).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 10: 0, 11: 1, 12: 1, 90: 0}


def test_short_lines_are_matched_by_equality(spark, tmp_path):
    import corpus_pipeline
    from textmill.llm.queries import op3_line_dedup

    rows = [(1, "Les.\na line of its own, not repeated\n"), (2, " Les.\r\nLes!\n \t\n"), (3, "x\nLes.\nx"), (4, "Les."), (5, "\n\n"), (6, "fifteen chars..\nfifteen chars.,"), (7, "fifteen chars..")]
    frame = docs(spark, rows)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.removed for r in op3_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: [], 2: [0], 3: [1, 2], 4: [0], 5: [], 6: [], 7: [0]}
    left = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, frame, str(tmp_path)).collect()}
    assert left == {1: rows[0][1], 2: "Les!\n \t\n", 3: "x", 5: "\n\n", 6: rows[5][1]}


def test_line_edges(spark):
    rows = [(None, "a line that is long enough"), (2, "a line that is long enough"), (2, "a line that is long enough"), (3, "a line that is long enough\nb")]
    frame = docs(spark, rows)
    assert dedup_lines(frame).columns == frame.columns
    assert sorted((r.doc_id, r.text) for r in dedup_lines(frame).collect()) == [(2, rows[1][1]), (2, rows[2][1]), (3, "b")]
    assert dedup_lines(docs(spark, [])).count() == 0 and line_report(docs(spark, [])).count() == 0
    assert line_report(docs(spark, [(1, None)])).first().n_lines == 0


def signed(spark, rows, bins):
    """Signatures ``(node, weight, s0, ...)`` of ``(node, minima)``."""
    frame = spark.createDataFrame([(n, 1, [int(x) for x in m]) for n, m in rows], "node long, weight long, m array<long>")
    return frame.selectExpr("node", "weight", *(f"{w} AS s{i}" for i, w in enumerate(packed([f"m[{j}]" for j in range(bins)]))))


def test_packed_minima_are_counted(spark):
    rng = random.Random(4)
    rows = [(i, [rng.randrange(-(1 << 40), 1 << 40) for _ in range(20)]) for i in range(8)]
    rows += [(i + 8, [x if rng.random() < 0.7 else x + 1 for x in m]) for i, (_, m) in enumerate(rows)]
    one = signed(spark, rows, 20)
    both = one.alias("x").crossJoin(one.alias("y")).selectExpr("x.node AS a", "y.node AS b", f"{agreeing('x', 'y', ['s0', 's1', 's2'])} AS n").collect()
    low = {n: [v & 127 for v in m] for n, m in rows}
    assert all(r.n == sum(p == q for p, q in zip(low[r.a], low[r.b], strict=True)) + 1 for r in both)
    keys = one.selectExpr("node", f"array({', '.join(band_keys([(0, 6, 7), (14, 19)]))}) AS k").collect()
    for r in keys:
        for q in keys:
            assert [x == y for x, y in zip(r.k, q.k, strict=True)] == [all(low[r.node][i] == low[q.node][i] for i in band) for band in ((0, 6, 7), (14, 19))]


def test_rows_with_partners_in_other_components(spark):
    rng = random.Random(9)
    base = [rng.randrange(128) for _ in range(14)]
    rows = [(i, [v if rng.random() < 0.72 else rng.randrange(128) for v in base]) for i in range(40)]
    component = {i: 0 if i < 25 else i for i in range(40)}
    frame = spark.createDataFrame([(b, i, component[i]) for b in (1, 2) for i in range(40) if (i + b) % 3], "bucket long, node long, c long")
    got = {tuple(r) for r in rows_with_partners(frame, signed(spark, rows, 14), 10).collect()}
    alike = lambda a, b: sum(x == y for x, y in zip(rows[a][1], rows[b][1], strict=True)) >= 10
    want = set()
    for b in (1, 2):
        inside = [i for i in range(40) if (i + b) % 3]
        want |= {(b, i, component[i], i >= 25) for i in inside if any(component[i] != component[j] and alike(i, j) for j in inside)}
    assert got == want and 20 < len(want) < frame.count()


def test_line_sets_link_components(spark):
    rng = random.Random(9)
    sets = [set(rng.sample(range(1 << 31), 60)) for _ in range(30)]
    for i in range(40):
        base = sorted(sets[i % 30])
        sets.append({*base[rng.randrange(1, 9) :], *rng.sample(range(1 << 31), rng.randrange(9))})
    sets += [set(range(n)) for n in (0, 1, 900, 1000)]
    frame = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "node long, items array<long>")
    rows = frame.selectExpr("1L AS bucket", "node", "node AS c", "node > 3 AS stray")
    got = {tuple(r) for r in _linked_components(rows, frame, 80).collect()}
    alike = lambda a, b: a | b and 100 * len(a & b) >= 80 * len(a | b)
    assert got == {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if alike(sets[i], sets[j])} and len(got) > 20


def test_buckets_are_shuffled_once_and_not_sorted(spark):
    rng = random.Random(3)
    rows = [(i, [rng.randrange(3) for _ in range(14)]) for i in range(60)]
    frame = signed(spark, rows, 14)
    found = bucket_heads(frame, band_keys([(0, 1, 2), (7, 8, 9)]))
    members = {}
    for node, m in rows:
        for band in ((0, 1, 2), (7, 8, 9)):
            members.setdefault((band, tuple(m[i] for i in band)), set()).add(node)
    got = {}
    for r in found.collect():
        got.setdefault((r.bucket, r.head), set()).add(r.node)
    assert sorted(map(sorted, got.values())) == sorted(sorted(m) for m in members.values() if len(m) > 1)
    assert all(head == max(nodes) for (_, head), nodes in got.items())
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin" not in plan and "ReusedExchange" in plan


@pytest.mark.parametrize("meetings", [0, 4096])
def test_crowded_buckets_give_the_same_lines(spark, monkeypatch, meetings):
    from textmill.llm import line_dedup

    monkeypatch.setattr(line_dedup, "MOST_MEETINGS", meetings)
    rng = random.Random(6)
    base = ["".join(rng.choices("abcdefgh ", k=100)).strip() for _ in range(6)]
    rows = [(i, line[:at] + x + line[at + 1 :]) for i, (line, at, x) in enumerate((rng.choice(base), rng.randrange(100), rng.choice("XYZ")) for _ in range(150))]
    rows += [(200 + i, line[3:] + "".join(rng.choices("abcdefgh", k=5))) for i, (_, line) in enumerate(rows[:60])]
    got = {r.doc_id: r.removed for r in line_report(docs(spark, rows)).collect() if r.removed}
    assert got == brute_lines(rows)


@pytest.mark.parametrize("hot", [3, 10_000])
def test_components_with_hot_and_other_buckets(spark, hot, monkeypatch):
    from textmill.llm import neardup

    monkeypatch.setattr(neardup, "HOT", hot)
    rng = random.Random(7)
    sets = [set(rng.sample(range(1000), 40)) for _ in range(12)]
    for i in range(60):
        own = sorted(sets[i % 12])
        sets.append({*own[rng.randrange(6) :], *rng.sample(range(1000), rng.randrange(6))})
    orders = [rng.sample(range(1000), 1000) for _ in range(24)]
    minima = [(n, [min(order[x] for x in s) for order in orders]) for n, s in enumerate(sets)]
    frame = spark.createDataFrame([(n, sorted(s)) for n, s in enumerate(sets)], "node long, items array<long>")
    keys = band_keys([(i, i + 1) for i in range(0, 24, 2)])
    residual = lambda rows: _linked_components(rows, frame, 80)
    found = components(signed(spark, minima, 24), keys, 12, lambda pairs: verified_pairs(pairs, frame, 80), residual)
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = union_find(len(sets), links)
    assert {r.node: r.component for r in found.collect()} == {n: c for n, c in enumerate(want) if c != n}


def bench_words(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


@pytest.mark.parametrize("noise", [0, 1])
def test_contamination_matches_brute_force(spark, noise):
    rng = random.Random(noise)
    words = [f"t{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(6, 60)))) for i in range(30)] + [(50, "Only Three words"), (51, ""), (52, None), (53, "!!")]
    rows = []
    for d in range(80):
        text = rng.choices(words, k=rng.randrange(0, 300))
        for _ in range(rng.choice([0, 0, 1, 2, 12])):
            own = rng.choice(items[:31])[1].split()
            if noise and own:
                own[rng.randrange(len(own))] = "changed"
            text += [*own, rng.choice(words)]
        rows.append((d, " ".join(text)))
    rows += [(500, None), (501, ""), (502, "only three, WORDS?"), (503, " ".join(x for _, x in items if x))]

    def cut(text, size):
        w = bench_words(text)
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}

    want = set()
    for d, text in rows:
        for i, item in items:
            n = len(bench_words(item))
            if n:
                own = cut(item, min(5, n))
                if 100 * len(own & cut(text, min(5, n))) >= 80 * len(own):
                    want.add((d, i))
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    got = contaminations(docs(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    left = drop_contaminated(docs(spark, rows), bench)
    assert left.columns == docs(spark, rows).columns
    assert {r.doc_id for r in left.collect()} == {d for d, _ in rows} - {d for d, _ in want}


def test_contamination_edges(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven"), (None, "eight nine ten eleven twelve")], "item_id long, text string")
    rows = [(None, "one two three four five six seven"), (4, "x one two three four five six seven y"), (4, "x one two three four five six seven y"), (5, "eight nine ten eleven twelve")]
    assert sorted(r.doc_id or 0 for r in contaminations(docs(spark, rows), bench).collect()) == [0, 4]
    assert [r.doc_id for r in drop_contaminated(docs(spark, rows), bench).collect()] == [5]
    assert contaminations(docs(spark, rows), bench.limit(0)).count() == 0
    assert contaminations(docs(spark, []), bench).count() == 0


def brute_vectors(rows):
    ok = [l is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, l in rows]
    links = []
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                    links.append((i, j))
    return links


@pytest.mark.parametrize("tile", [8, 1000])
def test_vectors_match_brute_force(spark, tile):
    rng = np.random.default_rng(tile)
    rows = []
    for label in range(3):
        for _ in range(12):
            base = rng.normal(size=16)
            rows += [(len(rows) + k, [float(x) for x in base + rng.normal(size=16) * 0.12 * rng.random()], label) for k in range(6)]
    rows += [(len(rows) + k, rows[3][1], 0) for k in range(5)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * 16, 0), (n + 3, [float("nan")] * 16, 0), (n + 4, rows[3][1], None), (n + 5, [1.0, None], 1), (n + 6, [2.0, 3.0], 1), (n + 7, [-0.0, 1.0], 1), (n + 8, [0.0, 1.0], 1), (n + 9, [float("inf")] * 16, 2)]
    links = brute_vectors(rows)
    want = union_find(len(rows), links)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, node string, size int")
    got = {r.vec_id: r for r in embedding_components(frame, tile=tile).collect()}
    assert len(got) == len(rows)
    for i in range(len(rows)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (sum(i in x for x in links), want[i], want[i] == i), rows[i]


def test_vector_edges(spark):
    schema = "vec_id long, embedding array<float>, label int"
    rows = [(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (4, [0.0, 1.0], 1), (2, [0.0, 1.0], 1)]
    got = embedding_components(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.vec_id or -1, r.component_id or -1, r.n_links) for r in got) == [(-1, -1, 0), (2, 2, 1), (4, 2, 0), (4, 2, 1)]
    assert embedding_components(spark.createDataFrame([], schema)).count() == 0


def test_vectors_of_any_magnitude(spark):
    rows = [(1, [1e200, 1e200], 0), (2, [1e200, 1.01e200], 0), (3, [1e-200, 1e-200], 0), (4, [5e-324, 5e-324], 0), (5, [1e200, -1e200], 0), (6, [1e308, 1.7e308], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5), 6: (0, 6)}


def test_quantisation_bound_holds():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(60, 32))
    a /= np.linalg.norm(a, axis=1)[:, None]
    q, s, e = quantise(a)
    decoded = q * s[:, None]
    off = np.abs(a @ a.T - decoded @ decoded.T)
    assert (off <= e + e[:, None] * (1 + e) + 1e-9).all()
    i, j = linked_pairs(a, a, 0.3, True)
    assert set(zip(i, j, strict=True)) == {(x, y) for x in range(60) for y in range(x + 1, 60) if a[x] @ a[y] >= 0.3}
