"""Ledgers, keyed sinks, prefix sums, cascades, token files, shuffles, quarantines and stages against plain Python."""

import json
import os
import random
import statistics

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textmill.functions import text as T
from textmill.operators import chat, imports, leakage, ordered, permutation, scoring
from textmill.plans import flows, queries
from textmill.sources import readers, scratch, stages, storage, token_files, writers
from textmill.streaming import files, keyed, ledger


def plan(df):
    return df._jdf.queryExecution().toString()


# --- folders watched by signature


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_a_failed_action_is_tried_again_and_an_unchanged_file_is_not(spark, tmp_path):
    seen, fail = [], [True]

    def act(changed, everything):
        seen.append((sorted(r.path.rsplit("/", 1)[1] for r in changed.collect()), everything.count()))
        if fail[0]:
            raise RuntimeError("no connection")

    run = lambda **more: ledger.run_pass(spark, f"{tmp_path}/w", f"{tmp_path}/l", act, "*.pt", **more)
    put(f"{tmp_path}/w/a.pt", "1")
    put(f"{tmp_path}/w/deep/b.pt", "1")
    put(f"{tmp_path}/w/log.txt", "1")
    with pytest.raises(RuntimeError):
        run()
    assert not os.listdir(f"{tmp_path}/l/pending")
    fail[0] = False
    assert (run(), run()) == (2, 0)
    put(f"{tmp_path}/w/a.pt", "longer")
    assert (run(), run()) == (1, 0)
    put(f"{tmp_path}/w/c.pt", "1")
    assert run(counts="path LIKE '%/a.pt'") == 0 and run() == 1  # a change that does not count starts nothing, and is not lost
    assert seen == [(["a.pt", "b.pt"], 2), (["a.pt", "b.pt"], 2), (["a.pt"], 2), (["c.pt"], 3)]


def test_a_file_that_changes_during_the_action_comes_again(spark, tmp_path):
    put(f"{tmp_path}/w/a.pt", "1")
    sizes = []

    def act(changed, _):
        sizes.append(changed.first()["size"])
        put(f"{tmp_path}/w/a.pt", "22")

    done = ledger.poll(spark, f"{tmp_path}/w", f"{tmp_path}/l", act, 3)
    assert sizes[:2] == [1, 2] and done[:2] == [1, 1]
    assert isinstance(ledger.poll(spark, f"{tmp_path}/none", f"{tmp_path}/l2", act, 1)[0], Exception)  # noted, not raised


# --- a row per key


SINK = "k string, n long"


def batch(spark, rows):
    return spark.createDataFrame(rows, SINK)


def held(spark, path, schema=SINK):
    return sorted(map(tuple, keyed.rows(spark, path, schema).collect()))


def test_batches_merge_by_key_once(spark, tmp_path):
    path = f"{tmp_path}/s"
    write = keyed.upsert(path, ["k"], buckets=4)
    assert held(spark, path) == []
    write(batch(spark, [("a", 1), ("b", 1), (None, 1)]), 0)
    write(batch(spark, [("a", 2), ("c", 1)]), 1)
    want = [("a", 2), ("b", 1), ("c", 1), (None, 1)]
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, keyed.rows(spark, path, SINK).collect()), key=key) == want
    write(batch(spark, [("a", 9)]), 1)  # the batch comes again
    write(batch(spark, [("a", 8)]), 0)
    assert sorted(map(tuple, keyed.rows(spark, path, SINK).collect()), key=key) == want
    write(batch(spark, []), 2)
    assert sorted(map(tuple, keyed.rows(spark, path, SINK).collect()), key=key) == want


def test_a_batch_that_fails_before_its_commit_leaves_nothing(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/s"
    write = keyed.upsert(path, ["k"], buckets=2)
    write(batch(spark, [("a", 1), ("b", 1)]), 0)
    real = spark.createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, *a, **b: (_ for _ in ()).throw(OSError("disk")) if a[1:] == ("bucket INT, folder STRING",) else real(*a, **b))
    with pytest.raises(OSError, match="disk"):
        write(real([("a", 5)], SINK), 1)
    monkeypatch.undo()
    assert held(spark, path) == [("a", 1), ("b", 1)]
    write(batch(spark, [("a", 5)]), 1)
    assert held(spark, path) == [("a", 5), ("b", 1)]
    for n in range(2, 5):
        write(batch(spark, [("a", n), ("b", n)]), n)
    assert held(spark, path) == [("a", 4), ("b", 4)]
    assert len(os.listdir(f"{path}/data")) <= 3 and len(storage.finished_folders(spark, f"{path}/commits/*")) == 2


def test_first_rows_stay_in_any_order_of_arrival(spark, tmp_path):
    rows = [[("a", 5), ("b", 2)], [("a", 3)], [("a", 4), ("b", 7)]]
    for turn, order in enumerate(([0, 1, 2], [2, 1, 0])):
        write = keyed.upsert(f"{tmp_path}/{turn}", ["k"], first_by=["n"])
        for n, i in enumerate(order):
            write(batch(spark, rows[i]), n)
        assert held(spark, f"{tmp_path}/{turn}") == [("a", 3), ("b", 2)]


def test_a_stream_of_one_file_at_a_time_counts_whole_windows(spark, tmp_path):
    schema = "k string, t timestamp, v double"
    for day, hours in ((1, (1, 2)), (2, (3,)), (1, (5, 6)), (2, (7,))):
        rows = [("a", f"2024-01-0{day} 0{h}:00:00", 1.0) for h in hours]
        spark.createDataFrame(rows, "k string, t string, v double").withColumn("t", F.col("t").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        counts = files.windowed_counts(files.watch(spark, f"{tmp_path}/in", schema, files_per_trigger=1), "t", "k", "v", delay="10 days")
        files.into(counts, f"{tmp_path}/cp", keyed.upsert(f"{tmp_path}/out", ["start", "k"]), mode="update")
    got = keyed.rows(spark, f"{tmp_path}/out", "start timestamp, k string, n long, total double").collect()
    assert sorted((r.start.day, r.n, r.total) for r in got) == [(1, 4, 4.0), (2, 2, 2.0)]


# --- prefix sums


def test_ranges_are_even_whatever_the_order_column(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(40_000)
        group = F.when(F.col("id") % 10 < 7, F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string")))
        skewed = rows.select(group.alias("g"), F.when(F.col("id") == 3, F.lit(1 << 60)).otherwise(F.col("id")).alias("o"))
        sizes = [r["count"] for r in ordered.in_ranges(skewed, ["g"], "o").groupBy("__range").count().collect()]
        assert len(sizes) == 4 and max(sizes) < 2 * statistics.median(sizes)
        got = ordered.running_total(skewed, ["g"], "o", F.lit(1)).where("g = 'hot'").agg(F.max("before"), F.count_distinct("before"), F.max_by("o", "before")).first()
        assert tuple(got) == (27_999, 28_000, 1 << 60)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_totals_match_plain_sums(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(30)]), i, rng.randrange(5)) for i in range(400)]
    got = {r.i: r.before for r in ordered.running_total(spark.createDataFrame(rows, "g string, o long, i long, v long").repartition(3), ["g"], "o", F.col("v"), ties=("i",)).collect()}
    sums = {}
    for g, _, i, v in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2])):
        assert got[i] == sums.get(g, 0)
        sums[g] = sums.get(g, 0) + v
    words = spark.createDataFrame([("b",), ("a",), ("c",)], "w string")
    assert {r.w: r.before for r in ordered.running_total(words, [], "w", F.lit(2)).collect()} == {"a": 0, "b": 2, "c": 4}


# --- cascades


def brute_import(sources, leaky):
    kept, seen = [], set()
    for name, rows, cap in sources:
        n = 0
        for _, q, a in sorted(rows, key=lambda r: r[0]):
            if q and a and len(q) <= 20 and q not in seen and q not in leaky and (not cap or n < cap):
                seen.add(q)
                kept.append((f"{name}_{n:06d}", name, q, a))
                n += 1
    return sorted(kept)


def test_ten_sources_in_turn(spark):
    rng = random.Random(6)
    sources = [(f"s{i}", [(n, f"question {rng.randrange(60)}" + "x" * rng.choice([0, 0, 30]), rng.choice(["yes", "no", ""])) for n in range(40)], rng.choice([0, 0, 5, 9])) for i in range(10)]
    frames = [(name, spark.createDataFrame(rows, "o long, q string, a string"), cap) for name, rows, cap in sources]
    leak = spark.createDataFrame([(1, "question 7"), (2, "zz")], "h long, t string")
    found = imports.imported_pairs(frames, "o", 20, 20, lambda c: c, leak, "h", "t", 0.99, val_share=0.1)
    got = found.collect()
    want = brute_import(sources, {"question 7"})
    assert sorted((r.id, r.source, r.q, r.a) for r in got) == want
    assert sum(r.split == "val" for r in got) == max(1, int(len(want) * 0.1))
    few = imports.imported_pairs(frames[:2], "o", 20, 20, lambda c: c, leak, "h", "t", 0.99)
    many = imports.imported_pairs(frames, "o", 20, 20, lambda c: c, leak, "h", "t", 0.99)
    assert plan(many).count("Exchange") == plan(few).count("Exchange")  # earlier sources are tables, not plans
    assert imports._steps([0, 0, 3, 0, 0, 2, 2, 0]) == [[0, 1], [2], [3, 4], [5], [6], [7]]


# --- texts that name entities


def test_entities_are_found_as_contains_finds_them(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choices("abcd日本 ", k=rng.randrange(n)))
    texts = [(i, word(30)) for i in range(150)] + [(150, None), (151, "aab aab aab"), (152, "aab aab aab")]
    entities = [(i, word(6)) for i in range(60)] + [(60, None), (61, "aab aab aab"), (62, "b"), (63, "b")]
    a, b = spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame(entities, "e long, name string")
    want = sorted((i, e) for i, t in texts for e, n in entities if t and n and n in t)
    for most in (500_000, 0):  # by broadcast and by shuffle
        monkeypatch.setattr(leakage, "MAX_BROADCAST_GRAMS", most)
        hits = leakage.entity_hits(a, "t", b, "name")
        assert sorted((r.id, r.e) for r in hits.collect()) == want and len(want) > 100
        assert "NestedLoop" not in plan(hits) and "CartesianProduct" not in plan(hits)
    assert leakage.entity_hits(a, "t", b.limit(0), "name").count() == 0
    with pytest.raises(ValueError):
        leakage.entity_hits(a, "t", b.withColumnRenamed("e", "id"), "name")


def test_held_out_texts_meet_without_a_nested_loop(spark):
    rows = spark.createDataFrame([(1, "abcdefgh"), (2, "abcdefgx"), (3, None), (4, "")], "id long, t string")
    held_out = spark.createDataFrame([("x", "abcdefgh"), ("y", "abcdefgh"), ("z", "qqq")], "h string, t string")
    found = leakage.leaks(rows, "id", F.col("t"), held_out, "h", F.col("t"), 0.7)
    assert sorted((r.id, r.h, round(r.similarity, 6)) for r in found.collect()) == [(1, "x", 1.0), (1, "y", 1.0), (2, "x", 0.75), (2, "y", 0.75)]
    assert "NestedLoop" not in plan(found)


def test_texts_of_few_grams_are_hardly_compared(spark, monkeypatch):
    rng = random.Random(4)
    made = lambda n: [(i, "".join(rng.choices("abcdefghijkl", k=rng.randrange(20, 60)))) for i in range(n)]
    held_out = made(300)
    rows = made(300) + [(1000 + i, t[:-2]) for i, t in held_out[:40]]
    counts, whole = {}, scratch.kept
    monkeypatch.setattr(scratch, "kept", lambda df, name: counts.setdefault(name, []).append(out := whole(df, name)) or out)
    found = leakage.leaks(spark.createDataFrame(rows, "id long, t string"), "id", F.col("t"), spark.createDataFrame(held_out, "h long, t string"), "h", F.col("t"), 0.6)
    pairs = lambda t: {t[i : i + 2] for i in range(len(t) - 1)}
    want = {(i, h) for i, t in rows for h, u in held_out if len(pairs(t) & pairs(u)) >= 0.6 * len(pairs(t) | pairs(u))}
    assert {(r.id, r.h) for r in found.collect()} == want and len(want) >= 40
    assert counts["met"][0].count() < 0.01 * len(rows) * len(held_out)  # of pairs of which nearly all have grams in common


def test_follow_ups(spark):
    known = [(0, "海とは？", "海", None), (1, "富士山の高さは？", "富士山", "高さ"), (2, "富士山の場所は？", "富士山", "場所"), (3, "富士山の場所は？", "富士山", "場所"), (4, "東京とは？", "東京", None), (5, "京都とは？", "京都", None), (6, "大阪とは？", "大阪", None)]
    questions = spark.createDataFrame(known, "pos long, question string, entity string, attribute string")
    asked = spark.createDataFrame([(1, "富士山は？", "富士山の高さは海より上"), (2, "山は？", "富士山の高さは3776m。東京、京都、大阪"), (3, None, "大阪"), (4, "x", None)], "id long, asked string, said string")
    got = [(r.id, r.place, r.question) for r in leakage.follow_ups(asked, "id", "asked", "said", questions).orderBy("id", "place").collect()]
    assert got == [(2, 1, "富士山の場所は？"), (2, 2, "東京とは？"), (2, 3, "京都とは？"), (3, 1, "大阪とは？")]
    pairs = questions.select("entity", "attribute")
    assert [r.id for r in leakage.mentions(asked, "said", pairs).orderBy("id").collect()] == [1, 2, 3]


def test_string_facts_have_guard_scores(spark):
    facts = spark.createDataFrame([("b", "海の色"), ("a", "海の音")], "fact string, t string")
    rows = spark.createDataFrame([(1, "海の色"), (2, "海の"), (3, "zz")], "id long, q string")
    got = {r.id: (round(r.score, 3), r.fact) for r in leakage.coverage(rows, "id", F.col("q"), facts, "fact", F.col("t")).collect()}
    assert got[1] == (1.0, "b") and got[2][1] == "a" and got[3] == (0.0, None)


# --- token files


BLOCKS = "group string, block long, ids array<int>"


def token_blocks(n=5):
    return [("a", i, list(range(10 * i, 10 * i + 8))) for i in range(n)] + [("a", n, [65_535])] + [("b", 0, [1, 2, 3])]


def test_token_files_read_back_as_written(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    rows = spark.createDataFrame(token_blocks(), BLOCKS)
    token_files.write_tokens(rows, path, "group", 8)
    read = lambda: sorted((r.group, r.block, list(r.ids)) for r in token_files.read_tokens(spark, path).collect())
    assert read() == token_blocks()
    told = json.load(open(f"{path}/manifest.json"))
    assert (told["block"], told["tokens"]) == (8, 44) and sum(os.path.getsize(f"{path}/{f}") for f in told["files"]) == 88
    token_files.write_tokens(spark.createDataFrame([("c", 0, [7])], BLOCKS), path, "group", 8, mode="append")
    assert read() == [*token_blocks(), ("c", 0, [7])]
    with pytest.raises(Exception, match="16 bits"):
        token_files.write_tokens(spark.createDataFrame([("d", 0, [70_000])], BLOCKS), path, "group", 8)
    assert read() == [*token_blocks(), ("c", 0, [7])]  # a failed write changes nothing
    token_files.write_tokens(spark.createDataFrame([("e", 0, [])], BLOCKS).limit(0), path, "group", 8)
    assert read() == [] and sorted(os.listdir(path)) == ["manifest.json"]


def test_a_task_that_runs_twice_doubles_no_token(tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    batches = [pa.RecordBatch.from_pylist([{"group": g, "block": b, "ids": ids}], schema=pa.schema([("group", pa.string()), ("block", pa.int64()), ("ids", pa.list_(pa.int32()))])) for g, b, ids in token_blocks()]
    writer = token_files.TokenWriter(path, 8, True)
    lost, done = writer.write(iter(batches[:2])), writer.write(iter(batches))  # the first attempt's message never comes
    writer.commit([done, None])
    assert not os.path.exists(f"{path}/_writing") and lost.file not in os.listdir(path)
    monkeypatch.setattr(token_files, "READ_TOKENS", 16)
    reader = token_files.TokenReader(path)
    parts = reader.partitions()
    assert [p.tokens for p in parts] == [16, 16, 9, 3]
    assert [(r["group"], r["block"], r["ids"]) for p in parts for b in reader.read(p) for r in b.to_pylist()] == token_blocks()
    again = token_files.TokenWriter(path, 8, True)
    again.abort([again.write(iter(batches)), None])
    assert sorted(os.listdir(f"{path}/_writing")) == [] and len(reader.partitions()) == 4
    with pytest.raises(ValueError):
        token_files.TokenWriter(path, 4, False).write(iter(batches))


# --- shuffles


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutations_are_bijective_and_turn_back(spark, n):
    rows = spark.range(n).select("id", permutation.permuted(F.col("id"), n).alias("p"), permutation.permuted(F.col("id"), n, "1").alias("q"))
    got = rows.withColumn("back", permutation.unpermuted(F.col("p"), F.lit(n))).collect()
    assert sorted(r.p for r in got) == sorted(r.q for r in got) == list(range(n))
    assert all(r.back == r.id for r in got)
    if n >= 1000:
        assert sum(r.p == r.q for r in got) < n / 50
        moved = [abs(r.p - r.id) for r in got]
        assert n / 4 < statistics.mean(moved) < n / 2.4  # a third, as of random places


def test_shuffles_of_all_rows_and_of_buffers(spark):
    rows = spark.range(5, 1005, 2)
    whole = permutation.shuffled(rows, "id")
    assert sorted(r.place for r in whole.collect()) == list(range(500)) and "Sort [rand" not in plan(whole)
    near = permutation.shuffled(rows, "id", buffer=64).collect()
    assert sorted(r.place for r in near) == list(range(500))
    assert all((r.id - 5) // 2 // 64 == r.place // 64 for r in near) and any((r.id - 5) // 2 != r.place for r in near)
    assert permutation.shuffled(rows.limit(0), "id").count() == 0


# --- writes, quarantine, failures, stages


def test_metrics_come_from_the_write_itself(spark, tmp_path):
    computed = spark.sparkContext.accumulator(0)

    def noted(batches):
        for b in batches:
            computed.add(b.num_rows)
            yield b

    rows = spark.range(100).mapInArrow(noted, "id long")
    found = writers.write_observed(rows, f"{tmp_path}/o", [F.count("*").alias("n"), F.sum("id").alias("total")], report_path=f"{tmp_path}/r")
    assert found == {"n": 100, "total": 4950} and computed.value == 100
    assert json.loads(spark.read.text(f"{tmp_path}/r").first()[0]) == found and spark.read.json(f"{tmp_path}/o").count() == 100


def test_merges_that_broke_off_begin_again(spark, tmp_path):
    path = f"{tmp_path}/m"
    spark.range(3).write.json(path)
    os.makedirs(f"{path}.base")
    put(f"{path}.base/part-0.json", '{"id": 99}')  # a copy without its end
    writers.merge_into(spark, path, spark.range(10, 12))
    assert sorted(r.id for r in spark.read.json(path).collect()) == [0, 1, 2, 10, 11]


def test_broken_lines_are_kept_apart(spark, tmp_path):
    put(f"{tmp_path}/a.jsonl", '{"src": "w", "text": "x"}\n\n{"src": \n{"text": "y"}\n')
    put(f"{tmp_path}/b.jsonl", "no\njson\n" + '{"text": "z"}\n')
    rows, lost, told = readers.quarantined(spark, {"a": f"{tmp_path}/a.jsonl", "b": f"{tmp_path}/b.jsonl", "c": f"{tmp_path}/c.jsonl"}, readers.DOCUMENT)
    assert sorted(((r.source, r.src, r.text) for r in rows.collect()), key=str) == [("a", "w", "x"), ("a", None, "y")]
    assert sorted((r.source, r.record.strip()) for r in lost.collect()) == [("a", '{"src":'), ("b", "json"), ("b", "no")]
    assert {r.source: (r.n, r.n_bad, r.state) for r in told.collect()} == {"a": (3, 1, "used"), "b": (3, 2, "rejected"), "c": (0, 0, "missing")}
    assert readers.quarantined(spark, {"c": f"{tmp_path}/c.jsonl"}, readers.DOCUMENT)[0].count() == 0


def test_one_corrupt_file_of_three_neither_fails_nor_hides(spark, tmp_path):
    for n in range(3):
        spark.range(n * 10, n * 10 + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/p")
    bad = sorted(f for f in os.listdir(f"{tmp_path}/p") if f.endswith(".parquet"))[1]
    put(f"{tmp_path}/p/{bad}", "PAR1 no more")
    os.remove(f"{tmp_path}/p/.{bad}.crc") if os.path.exists(f"{tmp_path}/p/.{bad}.crc") else None
    rows, lost = readers.readable_files(spark, f"{tmp_path}/p")
    assert rows.count() == 20 and [r.file.rsplit("/", 1)[1] for r in lost.collect()] == [bad]


def test_failures_of_each_category(spark):
    rows = [("a", i, i % 4 != 0) for i in range(20)] + [("b", 100, None), (None, 50, False), ("c", 7, True)]
    frame = spark.createDataFrame(rows, "c string, i long, ok boolean")
    first = scoring.first_failures(frame, "c", F.col("ok"), ["i"], 3)
    assert sorted((r.c or "", r.i) for r in first.collect()) == [("", 50), ("a", 0), ("a", 4), ("a", 8), ("b", 100)]
    shown = first._jdf.queryExecution().executedPlan().toString()
    assert shown.index("Exchange") < shown.rindex("WindowGroupLimit")  # below the exchange: before the shuffle
    got = {r.c if r.n != 23 else "all": r for r in scoring.checked(frame, "c", F.col("ok"), ["i"], 3).collect()}
    assert [f.i for f in got["all"].failures] == [0, 4, 8] and [f.i for f in got["a"].failures] == [0, 4, 8]
    assert (got["a"].verdict, got["b"].verdict, got["c"].failures, got[None].n) == ("weak", "bad", None, 1)


def test_stages_are_reused_made_again_and_refused(spark, tmp_path):
    line = stages.Pipeline(spark, str(tmp_path))
    twice = lambda t, by: t.select((F.col("id") * by).alias("id"))
    with pytest.raises(FileNotFoundError, match="double needs raw"):
        line.run("double", twice, ["raw"], by=2)
    spark.range(5).write.parquet(line.path("raw"))
    run = lambda by=2: [r.id for r in line.run("double", twice, ["raw"], by=by).orderBy("id").collect()]
    assert run() == run() == [0, 2, 4, 6, 8]
    assert run(3) == [0, 3, 6, 9, 12]
    spark.range(5).repartition(3).write.mode("overwrite").parquet(line.path("raw"))  # the same rows in other files
    assert run(3) == [0, 3, 6, 9, 12]
    spark.range(4).write.mode("overwrite").parquet(line.path("raw"))
    assert run(3) == [0, 3, 6, 9]
    spark.range(1).write.mode("overwrite").parquet(line.path("double"))  # somebody has changed the output
    assert run(3) == [0, 3, 6, 9]
    os.remove(f"{line.path('double')}/_SUCCESS")
    assert run(3) == [0, 3, 6, 9]
    assert [did for _, did in line.log] == ["made", "reused", "made", "reused", "made", "made", "made"]
    assert line.run("broken", lambda t: t.select("none"), ["raw"], fatal=False) is None
    with pytest.raises(FileNotFoundError):
        line.table("broken")
    same = stages.fingerprint
    assert same(spark.range(3)) == same(spark.range(3).repartition(2)) != same(spark.range(3).union(spark.range(1)))
    assert same(spark.createDataFrame([(None,)], "a int")) != same(spark.createDataFrame([(0,)], "a int"))


def test_scratch_is_shared_or_an_error(spark, monkeypatch):
    assert scratch.base(spark)
    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: None)})()
        sparkContext = type("S", (), {"master": "spark://host:7077", "_jsc": spark.sparkContext._jsc})()
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        with pytest.raises(RuntimeError):
            scratch.base(Elsewhere())


def test_coverage_of_several_priors_is_that_of_each(spark):
    facts = spark.createDataFrame([(1, "富士山の高さ"), (2, "日本の首都"), (3, "海の色")], "fact long, t string")
    rows = spark.createDataFrame([(1, "富士山", 1), (2, "日本の首都", 2), (3, "zz", None)], "id long, q string, own long")
    whole = leakage.coverages(rows, "id", F.col("q"), facts, "fact", F.col("t"), [4.0, 16.0], F.col("own")).collect()
    for prior in (4.0, 16.0):
        one = leakage.coverage(rows, "id", F.col("q"), facts, "fact", F.col("t"), prior, F.col("own")).collect()
        assert sorted((r.id, r.score, r.fact) for r in whole if r.prior == prior) == sorted((r.id, r.score, r.fact) for r in one) and len(one) == 3


def test_turns_of_several_shapes(spark):
    turn = "array<struct<role:string,from:string,text:string,content:string,value:string>>"
    user, bot, late = ("user", None, "q ", None, None), (None, "gpt", None, None, "a"), ("assistant", None, "", "b", None)
    rows = [(1, [], [user, bot], None, "i", "o"), (2, [bot, user], None, None, "i", "o"), (3, None, None, [user, user, late], "i", "o"), (4, None, None, None, " i ", "o"), (5, None, [], None, "i", None)]
    frame = spark.createDataFrame(rows, f"id long, x {turn}, y {turn}, z {turn}, i string, o string")
    got = frame.select("id", chat.pair_or_fields(chat.first_turns(F.col("x"), F.col("y"), F.col("z")), F.col("i"), F.col("o")).alias("p")).collect()
    assert {r.id: r.p and tuple(r.p) for r in got} == {1: ("q", "a"), 2: ("i", "o"), 3: ("q", "b"), 4: ("i", "o"), 5: None}


def test_reading_samples_lose_what_is_held_out(spark):
    asked = lambda i, q: {"id": i, "question": q, "is_impossible": False, "answers": [{"text": "two", "answer_start": 4}]}
    made = [{"title": t, "paragraphs": [{"context": "one two three。", "qas": [asked(f"{t}{n}", q) for n, q in enumerate(qs)]}]} for t, qs in (("A", ["富士山の高さは？", "海の色は？"]), ("B", ["日本の首都は？"]), ("C", ["山は？"]))]
    squad = spark.createDataFrame([(made,)], readers.SQUAD)
    docs = spark.createDataFrame([(1, "Lead sentence that is long enough to sum up.\n" + "Lead sentence that is long enough.\n" * 8), (2, None)], "k long, t string")
    held_out = spark.createDataFrame([(1, "海の色は?")], "h long, t string")
    got = imports.reading_samples(squad, docs, "k", "t", lambda c: F.replace(c, F.lit("？"), F.lit("?")), held_out, "h", "t", unanswerable=0.5, stop=".").collect()
    ids = {r.task: sorted(x.id for x in got if x.task == r.task) for r in got}
    assert ids["reading"] == ["A0", "B0", "C0"] and ids["summary"] == ["sum_1"]
    assert all(i.startswith("unans_") and i != "unans_A1" for i in ids.get("unanswerable", [])) and all(r.answer == chat.UNANSWERABLE for r in got if r.task == "unanswerable")


def test_reading_samples_take_every_question(spark, tmp_path):
    name = F.md5(F.col("id").cast("string")).alias("p_name")
    spark.range(26_000).select(F.col("id").alias("p_partkey"), name, F.concat(F.lit("Brand#"), F.col("id") % 50).alias("p_brand"), F.lit("STEEL").alias("p_type")).write.parquet(f"{tmp_path}/part.parquet")
    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    for table in ("nation", "benchmark", "documents"):
        os.symlink(f"/root/testdata/sf0.001/{table}.parquet", f"{tmp_path}/{table}.parquet")
        sql.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    want = sql.execute(queries.SQL["reading_samples"]).fetchall()
    assert sorted(map(tuple, flows.reading_samples(spark, str(tmp_path)).collect())) == sorted(want)


def test_reading_samples_gather_no_table_in_a_task_or_the_driver(spark, monkeypatch):
    plans, kept, plan = [], scratch.kept, lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(scratch, "kept", lambda df, name: plans.append(plan(df)) or kept(df, name))
    asked = lambda n: {"id": f"{n:03d}", "question": "海の色は？", "is_impossible": False, "answers": [{"text": "two", "answer_start": 4}]}
    made = [{"title": str(n), "paragraphs": [{"context": "one two three。", "qas": [asked(n)]}]} for n in range(40)]
    squad = spark.createDataFrame([(made,)], readers.SQUAD)
    docs = spark.range(30).select(F.col("id").alias("k"), F.lit("Lead sentence that is long enough to sum up.\n" + "Lead sentence that is long enough.\n" * 8).alias("t"))
    found = imports.reading_samples(squad, docs, "k", "t", lambda c: c, unanswerable=0.5, max_summary=7, stop=".")
    plans.append(plan(found))
    got = found.collect()
    assert sorted(r.id for r in got if r.task == "summary") == [f"sum_{n}" for n in range(7)]
    assert len([r for r in got if r.task == "unanswerable"]) == 20
    assert not [p for p in plans if "TakeOrdered" in p or "Limit" in p]
    met = [p for p in plans if "__slot" in p]
    assert met and all("SortMergeJoin" in p and "Broadcast" not in p for p in met)


def test_batches_are_padded_and_numbers_read(spark):
    rows = spark.createDataFrame([(1, [5, 6], None, [7]), (2, [5], [8], []), (3, [5, 6, 7, 8], [], [9])], "o long, p array<int>, c array<int>, a array<int>")
    got = {r.o: r for r in imports.training_batches(rows, "o", F.col("p"), F.col("c"), F.col("a"), 2, 1, 2, 0, 5).collect()}
    assert (got[1].input_ids, got[1].labels, got[1].prompt_ids) == ([1, 5, 6, 7, 2], [1, 5, 6, 7, 2], [1, 5, 6])
    assert (got[2].input_ids, got[2].labels, got[2].prompt_ids) == ([1, 5, 8, 2, 0], [1, 5, 8, 2, -100], [1, 5, 0])
    assert (got[3].input_ids, got[3].batch, got[3].prompt_ids) == ([1, 5, 6, 7, 8], 1, [1, 5, 6, 7, 8])
    numbers = spark.createDataFrame([(" 1,234.5 ",), ("x",), (None,), ("-3",)], "t string").select(T.to_number(F.col("t")).alias("n")).collect()
    assert [r.n for r in numbers] == [1234.5, None, None, -3.0]


def test_pairs_of_conversations_of_any_length(spark):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["system", "User", "assistant"]) if c else ("user" if t == 777 else "gpt" if t == 778 else "system"), f"{c} {t}") for c, n in [(0, 900), *((c, rng.randrange(1, 6)) for c in range(1, 80))] for t in range(n)]
    rng.shuffle(rows)
    want = {}
    for c, t, role, text in sorted(rows, reverse=True):
        after = next((r for r in rows if r[:2] == (c, t + 1)), None) if role.lower() == "user" else None
        if after and after[2] in ("assistant", "gpt"):
            want[c] = (text, after[3])
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    assert {r.conv_id: (r.q, r.a) for r in chat.first_pairs(frame).collect()} == want and want[0] == ("0 777", "0 778")
