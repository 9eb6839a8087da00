"""Generated samples, mixtures and small pipeline parts against plain Python, on empty and edge rows too."""

import hashlib

from pyspark.sql import functions as F

from textmill.functions.udfs import verify_equations
from textmill.operators import generation, mixing


def number(*parts, seed="0"):
    return int(hashlib.md5(":".join([seed, *map(str, parts)]).encode()).hexdigest()[:8], 16)


def test_generated_rows_pick_by_hash(spark):
    facts = spark.createDataFrame([("qa", 5, "b"), ("qa", 2, "a"), ("code", 9, "c"), ("other", 1, "d")], "category string, pos long, input string")
    got = generation.generated(spark, facts, "pos", {"qa": 7, "code": 2, "none": 3}).collect()
    want = {("qa", i, "ab"[number("qa", i) % 2]) for i in range(7)} | {("code", i, "c") for i in range(2)}
    assert {(r.category, r.i, r.input) for r in got} == want and len(got) == 9
    assert generation.generated(spark, facts.limit(0), "pos", {"qa": 3}).count() == 0


def test_windows_stay_within_their_source(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 500), ("c", 20), ("d", 900), (None, 900)], "source string, size long")
    rows = generation.window_mixture(spark, sizes, {"a": 3.0, "b": 1.0, "c": 5.0, "d": 0.0}, 2000, 16).collect()
    assert len(rows) == 2000 == len({r.i for r in rows}) and {r.source for r in rows} == {"a", "b"}
    assert all(0 <= r.start < {"a": 1000, "b": 500}[r.source] - 17 for r in rows)
    assert 0.7 < sum(r.source == "a" for r in rows) / 2000 < 0.8
    assert generation.window_mixture(spark, sizes.limit(0), {"a": 1.0}, 5, 16).count() == 0


def test_refusals_repeat_in_training_only(spark):
    rows = [(s, k, f"{k}{i}") for s, n in (("train", 6), ("val", 4)) for k in ("near", "far") for i in range(n)]
    got = generation.refusals(spark.createDataFrame(rows, "split string, kind string, question string"), "no", n_near=15).collect()
    of = lambda split, kind: [r.input for r in got if r.split == split and r.kind == kind]
    assert len(of("train", "near")) == 15 and len(set(of("train", "near"))) == 6
    assert len(of("train", "far")) == 6 and len(of("val", "near")) == 3 and len(of("val", "far")) == 1
    assert len({r.id for r in got}) == len(got) and {r.answer for r in got} == {"no"}


def test_whole_percentages_divide(spark):
    rows = mixing.problems(spark.range(500), whole=True).withColumn("holds", verify_equations(F.col("cot"))).collect()
    assert all(r.holds for r in rows)
    shares = [r for r in rows if r.kind == "percent"]
    assert shares and all(100 <= r.a <= 10_000 and r.a * r.b % 100 == 0 and r.value == r.a * r.b // 100 for r in shares)


def test_small_parts(spark):
    rows = spark.createDataFrame([("train_a", 2), ("train_b", 3), ("val_a", 9), (None, 1)], "k string, n long")
    assert generation.total_by_prefix(rows, "k", "n", "train_").first().total == 5
    assert generation.total_by_prefix(rows.limit(0), "k", "n", "x").first().total == 0
    rates = spark.createDataFrame([("a", 0.5245, None), (None, 1.0, 0.0)], "g string, x double, y double")
    assert sorted(r.line for r in generation.report_lines(rates, "g", "x", "y").collect()) == ["a, x 52.5%, y -", "all, x 100.0%, y 0.0%"]
    texts = spark.createDataFrame([("x",), (None,), ("x",)], "t string")
    assert [r.text for r in generation.held_out(None, "t", texts).collect()] == ["x"]
    forms = spark.createDataFrame([("add", ["{0}+{1}", "{1}"])], "kind string, forms array<string>")
    words = spark.createDataFrame([("q", ["p"])], "question string, phrases array<string>")
    assert {tuple(r) for r in generation.bank_phrases(words, forms).collect()} == {("言い換え", "p"), ("算数/add", "123+456"), ("算数/add", "456")}
    meta = spark.createDataFrame([((None, 1),), (("s", 2),), (None,)], "m struct<c: string, n: int>")
    assert [r.c for r in meta.select(generation.with_default(F.col("m"), "c", F.lit("d"))["c"].alias("c")).collect()] == ["d", "s", None]
    assert spark.range(1).select(generation.dated_id(F.lit("qa"), "20240101", F.lit(7)).alias("i")).first().i == "qa_20240101_00007"
    cots = spark.createDataFrame([(i, "x") for i in range(200)], "id long, cot string")
    kept = {r.version: r.n for r in generation.ratio_variants(cots, "id", {"a": 0.0, "b": 1.0}).groupBy("version").agg(F.count_if("has_cot").alias("n")).collect()}
    assert kept == {"a": 0, "b": 200}
