"""Text and arithmetic functions on rows with known results."""

import pytest
from pyspark.sql import functions as F

from textmill.functions import text as T
from textmill.functions import udfs as U


def test_equations():
    assert U.arithmetic_score("3 + 4 = 7", "7個") == 1.0
    assert U.arithmetic_score("3 + 4 = 7 = 7", "7") == 0.0
    assert U.arithmetic_score("2**3 = 8 7//2 = 3", "3") in (0.0, 1.0)
    assert U.arithmetic_score("9**9**9 = 1", "1") == 0.0
    assert U.arithmetic_score("2 + 2 = 5", "5") == 0.0 and U.arithmetic_score(None, "5") == 0.0
    assert U.equations_hold("17 ÷ 5 = 3余り2") and not U.equations_hold("17 ÷ 5 = 3余り1")
    assert U.left_load("200 × 3") == 1 and U.left_load("46 × 47") == 4 and U.left_load("500 ÷ 100") == 1


@pytest.mark.parametrize("a", [2, 40, 119, 305, 999])
@pytest.mark.parametrize("b", [2, 9, 10, 47, 99])
def test_steps_end_in_the_result(a, b):
    lines = U.product_steps(a, b)
    assert U.equations_hold("。".join(lines)) and lines[-1].endswith(f"= {a * b}")
    lines = U.quotient_steps(a * b, b)
    assert U.equations_hold("。".join(lines))
    with pytest.raises(ValueError):
        U.quotient_steps(a * b + 1, b)


def test_steps_of_all_small_numbers_hold():
    for a in [*range(2, 120), 1000, 1005, 2400, 99999]:
        for b in range(2, 100):
            lines = U.product_steps(a, b)
            assert U.equations_hold("。".join(lines)) and lines[-1].endswith(f"= {a * b}"), (a, b)
            assert max(U.left_load(x.partition("=")[0]) for x in lines) <= 6
    for d in range(2, 21):
        for q in [*range(1, 130), 500, 1002]:
            lines = U.quotient_steps(q * d, d)
            assert U.equations_hold("。".join(lines)) and (q < 10 or lines[-1].endswith(f"= {q}")), (q, d)
            assert lines[0].split(" ")[0] == str(q * d)[: len(lines[0].split(" ")[0])]


def test_exact_lines_of_long_arithmetic():
    assert U.product_steps(46, 47) == ["40 × 4 = 160", "6 × 4 = 24", "160 + 24 = 184", "184 × 10 = 1840", "40 × 7 = 280", "6 × 7 = 42", "280 + 42 = 322", "1840 + 322 = 2162"]
    assert U.product_steps(7, 8) == ["7 × 8 = 56"] and U.product_steps(12, 10) == ["12 × 10 = 120"]
    assert U.quotient_steps(984, 8) == ["9 ÷ 8 = 1余り1", "18 ÷ 8 = 2余り2", "24 ÷ 8 = 3余り0", "100 + 20 + 3 = 123"]
    assert U.quotient_steps(120, 4) == ["12 ÷ 4 = 3余り0", "0 ÷ 4 = 0余り0", "3 × 10 = 30"] and U.quotient_steps(6, 3) == ["6 ÷ 3 = 2余り0"]
    assert not U.equations_hold("8 × 7 = 54") and U.equations_hold("12 + 3 × 2 = 30") and U.equations_hold("nothing")
    assert U.left_load("105 + 20") == 1 and U.left_load("123 × 45") == 6 and U.left_load("5 ÷ 0 × 3") == 2 and U.left_load("") == 0


def test_corrections():
    assert U.corrected("46 × 47 = 2163。答えは2163円") == "46 × 47 = 2162。答えは2162円"
    assert U.corrected("4124 × 29 ÷ 100 = 0.29") == "4124 × 29 ÷ 100 = 1195"
    assert U.corrected("5 ÷ 0 = 1") == "5 ÷ 0 = 1"


def test_pieces_and_windows():
    text = "あ" * 30 + "。" + "い" * 50 + "<nl>" + "う" * 200
    assert "".join(U.pieces(text, 60)) == text and max(map(len, U.pieces(text, 60))) <= 60
    assert U.pieces("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5] and U.pieces("ab。" + "x" * 30, 12)[0] == "ab。" and U.pieces("a。" + "x" * 30, 12)[0] == "a。" + "x" * 10
    assert U.pieces("") == [] and U.pieces("x" * 8 + " " * 4, 8) == ["x" * 8]
    assert U.window("短い。", 0, 1, 30) == ("短い。", 0) and U.window("一。" * 40, 0, 3, 30) is None and U.window("長" * 40 + "。", 3, 2, 30) is None
    assert U.window("a。" * 10, 8, 1, 8) == ("a。a。a。a。", 2) and U.window("a。" * 10, 19, 1, 8) == ("a。a。a。a。", 7)
    found = U.window("一文目。二文目の答え。三文目。" * 20, 4, 3, 30)
    assert found is not None and found[0][found[1] : found[1] + 3] == "二文目" and len(found[0]) <= 30


def test_columns(spark):
    row = spark.createDataFrame([("まず、A。よって、答えは富士山である。 富士山", "富士山の高さはどのくらいですか？", "abcabcabcabcabc", "　全角　", None)], "a string, q string, r string, w string, n string")
    got = row.select(
        T.split_reasoning(F.col("a"))["answer"].alias("answer"),
        T.final_segment(F.lit("よって、答えは富士山である。")).alias("final"),
        T.split_entity_attribute(F.col("q")).alias("parts"),
        T.repetition(F.col("r")).alias("rep"),
        T.strip(F.col("w")).alias("strip"),
        T.collapse(F.col("n")).alias("none"),
        F.size(T.bigrams(F.lit("a"))).alias("one"),
        T.char_f1(F.lit("ab"), F.lit("bc")).alias("f1"),
        T.decode_layout(T.encode_layout(F.lit("def f():\n        return 1\n"))).alias("code"),
        T.contains_expected(F.lit("100"), F.array(F.lit("0"))).alias("zero"),
    ).first()
    assert got.answer == "富士山" and got.final == "富士山" and got.parts.entity == "富士山" and got.parts.attribute == "高さ"
    assert got.rep == 0.75 and got.strip == "全角" and got.none == "" and got.one == 1 and got.f1 == 0.5
    assert got.code == "def f():\n        return 1\n" and not got.zero


def test_cleaners(spark):
    long = "word " * 60
    got = spark.range(1).select(
        T.clean_article(F.lit("== H ==\r\n  " + long + "\n\n" + "x")).alias("a"),
        T.clean_web(F.lit(long), min_script_ratio=0).alias("b"),
        T.clean_web(F.lit(long)).alias("c"),
        T.clean_web(F.lit(long + "w" * 10), min_script_ratio=0).alias("d"),
        T.clean_code(F.lit("\tx = 1  \n\n\n\n" + "y = 2\n" * 12)).alias("e"),
        T.clean_web(F.lit(None).cast("string")).alias("f"),
    ).first()
    assert got.a.startswith("word") and got.a.endswith("\nx") and got.b == long.strip() and got.c is None and got.d is None and got.f is None
    assert got.e.startswith("    x = 1\n\ny = 2")
