"""Sources, sinks and streams on files, and the composite imports against plain Python."""

import json
import os

import pytest
from pyspark.sql import functions as F

from textmill.functions import text as T
from textmill.operators import chat, imports, leakage, mixing, ordered, scoring
from textmill.sources import readers, writers
from textmill.streaming import files


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return str(path)


def test_json_lines(spark, tmp_path):
    good = write(f"{tmp_path}/a.jsonl", '{"src": "web", "text": "日本"}\n\n{"text": "no source"}\n')
    bad = write(f"{tmp_path}/b.jsonl", '{"src": "web", "text": "x"}\n{"src": \n')
    rows = readers.jsonl(spark, good, readers.DOCUMENT)
    assert sorted(r.text for r in rows.collect()) == ["no source", "日本"]
    assert [r.text for r in readers.source_documents(rows).collect()] == ["no source"]
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.jsonl(spark, bad, readers.DOCUMENT).collect()
    assert readers.jsonl(spark, bad, readers.DOCUMENT, strict=False).count() == 1
    found, missing = readers.all_readable(spark, [good, f"{tmp_path}/none.jsonl"], readers.DOCUMENT)
    assert found.count() == 2 and missing == [f"{tmp_path}/none.jsonl"]
    assert readers.first_readable(spark, [f"{tmp_path}/none.jsonl", good], readers.DOCUMENT)[1] == good
    assert readers.first_readable(spark, [], readers.DOCUMENT) == (None, None)
    writers.write_jsonl(rows, f"{tmp_path}/out")
    text = "".join(open(f"{tmp_path}/out/{n}", encoding="utf-8").read() for n in os.listdir(f"{tmp_path}/out") if n.startswith("part"))
    assert "日本" in text
    heads = {r.value: r.src for r in readers.line_sources(readers.text_lines(spark, good)).collect()}
    assert len(heads) == 2 and set(heads.values()) == {"web", None}


def test_nested_json_and_reading_rows(spark, tmp_path):
    data = {"data": [{"title": "T", "paragraphs": [{"context": "Head [SEP] one two。three four。", "qas": [
        {"id": "a", "question": " where? ", "is_impossible": False, "answers": [{"text": "two", "answer_start": 15}]},
        {"id": "b", "question": "gone?", "is_impossible": True, "answers": []},
        {"id": "c", "question": "moved?", "is_impossible": False, "answers": [{"text": "two", "answer_start": 3}]},
    ]}]}]}
    write(f"{tmp_path}/deep/er/x.json", json.dumps(data))
    squad = readers.found_json(spark, [f"{tmp_path}/none", str(tmp_path)], "x.json")
    rows = chat.reading_rows(squad).collect()
    assert [(r.id, r.title, r.context, r.question, r.answer, r.answer_start) for r in rows] == [("a", "Head", "one two。three four。", "where?", "two", 4)]
    with pytest.raises(FileNotFoundError):
        readers.found_json(spark, [str(tmp_path)], "y.json")


def test_small_scans(spark, tmp_path):
    for n in (1, 3, 2):
        write(f"{tmp_path}/c/d{n}/ckpt_{n}.pt", "x" * n)
    assert readers.newest_file(spark, f"{tmp_path}/c", "*.pt").first().path.endswith("ckpt_3.pt")
    frame = spark.createDataFrame([("a", ["x"], "s")], "id string, expected_any array<string>, name string")
    assert readers.keyword_column(frame) == "expected_any" and readers.keyword_column(frame.drop("expected_any")) is None
    two = spark.createDataFrame([([], None), ([], ["y"])], "keywords array<string>, answers array<string>")
    assert readers.keyword_column(two) == "answers"
    raw = spark.createDataFrame([(1, " "), (2, "a"), (3, "b")], "id long, text string")
    assert [r.id for r in readers.cleaned_head(raw, "id", 2, F.when(F.trim("text") != "", F.col("text"))).collect()] == [2]
    assert [r.id for r in readers.after_prefix(spark.range(10), "id", 7).orderBy("id").collect()] == [7, 8, 9]
    assert readers.after_prefix(spark.range(3), "id", 5).count() == 0
    fallback = spark.createDataFrame([("z",), ("b",)], "id string")
    assert [r.id for r in readers.eval_items(spark, f"{tmp_path}/none.jsonl", fallback, 1).collect()] == ["b"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a\n\nb", None, "c\r\nd")], "id long, input string, cot string, answer string")
    assert [r.value for r in writers.corpus_lines(rows, "input", "cot", "answer").collect()] == ["a  b", "c d"]
    assert [r.value for r in writers.corpus_lines(rows, "input", "cot", "answer", one_line=True).collect()] == ["a  b c d"]
    writers.write_text(writers.corpus_lines(rows, "input"), f"{tmp_path}/t")
    assert readers.text_lines(spark, f"{tmp_path}/t").count() == 1
    writers.write_partitioned(rows.withColumn("split", F.lit("val")), f"{tmp_path}/p", "split")
    assert os.path.isdir(f"{tmp_path}/p/split=val")
    with pytest.raises(ValueError):
        writers.packed_tokens(rows, F.array(F.lit(1)), 2, 70_000)
    assert writers.processed_name("a/v.train.jsonl") == "a/v_processed.train.jsonl"
    writers.report(spark, rows, f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r").count() == 1
    ledger = spark.createDataFrame([("a", 1)], "k string, n long")
    new = spark.createDataFrame([("a", 9), ("xa", 5), ("xa", 3)], "k string, n long")
    assert sorted(map(tuple, writers.appended(ledger, new, "k").collect())) == [("a", 1), ("xa", 3)]


def test_merge_is_idempotent(spark, tmp_path):
    path = f"{tmp_path}/m"
    spark.range(3).write.json(path)
    for last in (12, 12, 15):
        writers.merge_into(spark, path, spark.range(10, last))
        assert sorted(r.id for r in spark.read.json(path).collect()) == [0, 1, 2, *range(10, last)]


def test_streams(spark, tmp_path):
    schema = "k string, t timestamp, v double"
    make = lambda rows: spark.createDataFrame(rows, "k string, t string, v double").withColumn("t", F.col("t").cast("timestamp"))
    make([("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-01 00:00:01", 2.0)]).coalesce(1).write.parquet(f"{tmp_path}/in")
    run = lambda: files.into(files.keep_first_stream(files.watch(spark, f"{tmp_path}/in", schema), "k", "t", "1 hour"), f"{tmp_path}/cp", files.replace_batch(f"{tmp_path}/out"))
    run()
    make([("a", "2024-01-01 00:00:02", 3.0), ("b", "2024-01-01 00:00:03", 4.0)]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    run()
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b"]
    counts = files.windowed_counts(files.watch(spark, f"{tmp_path}/in", schema), "t", "k", "v")
    files.into(counts, f"{tmp_path}/cp2", files.replace_batch(f"{tmp_path}/out2"), mode="update")
    assert {(r.k, r.n, r.total) for r in spark.read.parquet(f"{tmp_path}/out2").collect()} == {("a", 3, 6.0), ("b", 1, 4.0)}


def test_exclusions_count_kept_questions_only(spark):
    rows = [(1, "q", "http://x"), (2, "q", "fine"), (3, "q", "fine too"), (4, "", "a"), (5, "leaky", "a"), (6, "leaky", "a"), (7, None, "a")]
    found = chat.exclusion_reasons(spark.createDataFrame(rows, "o long, q string, a string"), "o", 20, 20, F.col("q") == "leaky")
    assert {r.o: r.reason for r in found.collect()} == {1: "length_or_url", 2: None, 3: "duplicate", 4: "format", 5: "leak", 6: "leak", 7: "format"}


def test_caps_do_not_make_rows_seen(spark):
    make = lambda rows: spark.createDataFrame(rows, "o long, q string, a string")
    one, two = make([(1, "a", "x"), (2, "a", "y"), (3, "b", "x"), (4, "c", "x")]), make([(1, "c", "z"), (2, "a", "z"), (3, "d" * 50, "z"), (4, "e", "z")])
    got = imports.imported_pairs([("one", one, 2), ("two", two, 0)], "o", 20, 20, lambda c: c).collect()
    assert [(r.id, r.q, r.a) for r in sorted(got, key=lambda r: r.id)] == [("one_000000", "a", "x"), ("one_000001", "b", "x"), ("two_000000", "c", "z"), ("two_000001", "e", "z")]


def grams12(t):
    return set(t) | {t[i : i + 2] for i in range(len(t) - 1)}


def brute_guard(text, facts, prior):
    import math

    index = {f: grams12(t) for f, t in facts.items()}
    exact = [f for f, t in facts.items() if t == text]
    if exact:
        return 1.0, max(exact)
    idf = lambda g: math.log((len(index) + 1) / (sum(g in s for s in index.values()) + 1)) + 1
    total = sum(map(idf, grams12(text)))
    best = max(((round(sum(idf(g) for g in grams12(text) & s) / (total + prior), 9), -f) for f, s in index.items()), default=(0, 0))
    return (best[0], -best[1]) if best[0] > 0 else (0.0, None)


def test_guard_scores_and_leave_one_out(spark):
    facts = {1: "富士山の高さ", 2: "日本の首都", 3: "海の色", 4: "日本の首都"}
    asked = [(1, "富士山の高さ", 1), (2, "日本の首都", 2), (3, "首都は海", None), (4, "zzz", None), (5, "日本の高さ", 3), (6, "日本の首都", None)]
    frame = spark.createDataFrame([(f, t, "x") for f, t in facts.items()], "fact long, t string, score string")
    rows = spark.createDataFrame(asked, "id long, q string, own long")
    got = {r.id: r for r in leakage.coverage(rows, "id", F.col("q"), frame, "fact", F.col("t"), 4.0, leave_out=F.col("own")).collect()}
    for i, text, own in asked:
        score, fact = brute_guard(text, {f: t for f, t in facts.items() if f != own}, 4.0)
        assert abs(got[i].score - score) < 1e-6 and got[i].fact == fact, (i, got[i], score, fact)


def test_tuning_takes_the_best_allowed_setting(spark):
    rows = [(p, k, s - p / 100) for p in (1.0, 2.0) for k, s in (("own", 0.9), ("own", 0.5), ("near", 0.45), ("far", 0.2), ("short", 0.1))]
    found = leakage.tuned_guard(spark.createDataFrame(rows, "prior double, kind string, score double"), "kind", "score", ["prior"], [0.1, 0.4, 0.47, 0.6])
    assert [(r.prior, r.threshold, r.own) for r in found.where("best").collect()] == [(1.0, 0.47, 1.0)] and found.count() == 8


def test_rarest_grams_lose_no_match(spark, monkeypatch):
    import random

    rng = random.Random(2)
    text = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(1, 14)))
    held, rows = [(i, text()) for i in range(60)], [(i, text()) for i in range(80)]
    rows += [(100 + i, t + rng.choice("ab")) for i, t in held[:20]]
    a, b = spark.createDataFrame(rows, "id long, t string"), spark.createDataFrame(held, "h long, t string")
    for of_held in (False, True):
        want = leakage.gram_matches(a, "id", T.bigrams(F.col("t")), b, "h", T.bigrams(F.col("t")), 0.7, of_held).collect()
        monkeypatch.setattr(leakage, "MAX_BROADCAST_GRAMS", 5)
        got = leakage.gram_matches(a, "id", T.bigrams(F.col("t")), b, "h", T.bigrams(F.col("t")), 0.7, of_held).collect()
        monkeypatch.undo()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 10


def test_checks(spark):
    questions = spark.createDataFrame([("富士山とは？",), ("色ですか？",), ("海",)], "q string")
    variants = {r.v for r in questions.select(F.explode(imports.question_variants(F.col("q"))).alias("v")).collect()}
    assert {"富士山について教えて", "富士山といえば？", "色を教えて", "海", "海？"} <= variants
    items = spark.createDataFrame([(1, "富士山とは何ですか！", "x"), (2, "色を教えて", "new_numbers"), (3, "空", "x")], "i long, t string, type string")
    assert [r.i for r in imports.trained_items(items, "t", questions, "q", F.col("type") == "new_numbers").collect()] == [1]
    bank = spark.createDataFrame([("海", p) for p in "abca"] + [("知らない", "b")], "q string, p string")
    found = {tuple(r) for r in imports.structure_problems(bank, questions, "q", "p").collect()}
    assert found == {("unknown question", "知らない"), ("few phrases", "知らない"), ("repeated phrase", "海"), ("no phrases", "富士山とは？"), ("no phrases", "色ですか？")}
    with pytest.raises(ValueError):
        imports.require_rows(items, F.col("t") == "", "items")
    assert imports.require_rows(items.limit(0), F.lit(False), "items").count() == 0
    assert [r.text for r in imports.repeated_values(spark.createDataFrame([("a",), ("a",), ("b",)], "text string"), "text").collect()] == ["a"]
    assert imports.without_private(items.withColumn("_q", F.lit(1))).columns == items.columns
    varied = imports.phrased(spark.range(400).select("id", F.lit("海").alias("q")), "q", bank, "p", "id").groupBy("q").count().collect()
    assert {r.q for r in varied} == {"海", "a", "b", "c"} and 80 < next(r["count"] for r in varied if r.q == "海") < 160


def test_small_columns(spark):
    row = spark.createDataFrame([("  a  b ", "", "r", "open_qa", "p 質問：x 質問：" + "y" * 300)], "i string, c string, r string, k string, prompt string")
    got = row.select(
        imports.document_pair(F.col("i"), F.col("c"), F.col("r"), F.col("k"), ("open_qa",)).alias("pair"),
        imports.document_pair(F.col("i"), F.lit(" z"), F.col("r"), F.col("k"), ()).alias("none"),
        imports.leak_probe(F.lit(None).cast("string"), F.col("prompt"), F.lit("ans"), F.lit("read")).alias("probe"),
        imports.leak_probe(F.lit(""), F.col("prompt"), F.lit("ans"), F.lit("summary")).alias("summary"),
    ).first()
    assert tuple(got.pair) == ("a b", "r", "qa") and got.none is None and got.probe == "y" * 200 and got.summary == "ans"


def test_blocks_hold_all_tokens_in_order(spark):
    docs = [("a", 1, list(range(7))), ("a", 2, []), ("a", 5, list(range(100, 123))), ("b", 1, [9])]
    frame = spark.createDataFrame(docs, "g string, o long, ids array<int>")
    got = {(r.g, r.block): list(r.ids) for r in imports.contiguous_blocks(frame, "g", "o", "ids", 8).collect()}
    whole = [*range(7), *range(100, 123)]
    assert got == {("a", i): whole[8 * i : 8 * i + 8] for i in range(4)} | {("b", 0): [9]}
    assert imports.contiguous_blocks(frame, "g", "o", "ids", 8, most=7).where("g = 'a'").count() == 1


def test_exact_samples(spark):
    frame = spark.range(500).withColumnRenamed("id", "k")
    order = [r.k for r in frame.orderBy(ordered.hash_order("k"), "k").collect()]
    for n in (0, 1, 37, 499, 500, 600):
        assert sorted(r.k for r in ordered.sample_exactly(frame, n, "k").collect()) == sorted(order[:n])
    split = mixing.last_share(frame, "k")
    assert split.where("split = 'val'").agg(F.min("k"), F.count("*")).first() == (450, 50)
    got = {r.i: r.k for r in mixing.oversampled(frame.where("k < 7"), 20, "k").collect()}
    first = [k for k in order if k < 7]
    assert got == {i: first[i % 7] for i in range(20)}
    assert mixing.oversampled(frame, 3, "k").count() == 3 and mixing.oversampled(frame.limit(0), 3, "k").count() == 0


def test_evaluation_takes_missing_predictions(spark):
    items = spark.createDataFrame([(1, "answer", ["10"]), (2, "answer", ["10"]), (3, "refuse", None), (4, "answer", ["東京"])], "i long, behavior string, expected_any array<string>")
    said = spark.createDataFrame([(1, "計算。 100です"), (2, "計算。 10です"), (3, None), (4, "まず。 東京")], "i long, raw string")
    got = {r.i: r for r in scoring.evaluated(items, said.where("i <> 4"), "i", "raw", F.col("i") != 2).collect()}
    assert [(got[i].model_correct, got[i].e2e_correct) for i in (1, 2, 3, 4)] == [(False, False), (True, False), (None, False), (False, False)]
    frame = scoring.evaluated(items, said, "i", "raw", F.col("i") != 2)
    assert [(r.i, r.cause) for r in scoring.failures(frame, "i", 5).collect()] == [(1, "model"), (2, "guard"), (3, "model")]
