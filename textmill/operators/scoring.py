"""Scores of reasoning texts, and metrics of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions import text as T
from textmill.functions.udfs import verify_arithmetic

LEAST_LOGIC, ADOPT_FROM, GATE = 0.5, 0.75, 0.80


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def rubric(rows: DataFrame, cot: Column, answer: Column, category: Column, arithmetic: bool = True) -> DataFrame:
    """``rows`` with ``logic, completeness, conciseness, score, status, needs_review``.

    Arithmetic is checked; other categories count 0.6 and go to review.  Logic
    under 0.5 rejects with that score; else the mean decides.
    """
    is_sum = category == "arithmetic"
    logic = F.when(is_sum, verify_arithmetic(cot, answer)).otherwise(0.6) if arithmetic else F.lit(0.6)
    steps = fresh(rows, "steps")
    # in a projection of its own, which the optimizer leaves alone as it is read more than once: the text is split once
    counted = rows.withColumns({steps: T.reasoning_steps(cot), "logic": logic})
    out = counted.withColumns({"completeness": T.completeness(F.col(steps)), "conciseness": T.conciseness(cot, F.col(steps))}).drop(steps)
    mean = (F.col("logic") + F.col("completeness") + F.col("conciseness")) / 3
    score = F.when(F.col("logic") < LEAST_LOGIC, F.col("logic")).otherwise(mean)
    status = F.when(F.col("logic") < LEAST_LOGIC, "reject").when(mean >= ADOPT_FROM, "adopt").otherwise("revise")
    return out.withColumns({"score": score, "status": status, "needs_review": ~F.coalesce(is_sum, F.lit(False))})


def rubric_result(score: str = "score", status: str = "status", review: str = "needs_review") -> Column:
    """Struct ``(cot_quality_score, breakdown, status, needs_manual_review)`` of :func:`rubric` columns, numbers to four places; null without a score."""
    parts = F.struct(*(F.round(p, 4).alias(p) for p in ("logic", "completeness", "conciseness")))
    whole = F.struct(F.round(score, 4).alias("cot_quality_score"), parts.alias("breakdown"), F.col(status).alias("status"), F.col(review).alias("needs_manual_review"))
    return F.when(F.col(score).isNotNull(), whole)


def rubric_stats(scored: DataFrame, has_cot: Column) -> DataFrame:
    """One row: counts per status, mean score over scored rows, and the shares of adopted rows among scored and among all."""
    n = lambda c: F.count_if(c)
    adopted, some = n(has_cot & (F.col("status") == "adopt")), n(has_cot)
    return scored.agg(
        F.count("*").alias("total"),
        adopted.alias("adopt"),
        n(has_cot & (F.col("status") == "revise")).alias("revise"),
        n(has_cot & (F.col("status") == "reject")).alias("reject"),
        n(has_cot & F.col("needs_review")).alias("manual_review"),
        F.coalesce(F.avg(F.when(has_cot, F.col("score"))), F.lit(0.0)).alias("avg_score"),
        F.coalesce(F.try_divide(adopted, some), F.lit(0.0)).alias("gate_rate"),
        F.coalesce(F.try_divide(adopted, F.count("*")), F.lit(0.0)).alias("adopt_rate"),
        (F.coalesce(F.try_divide(adopted, some), F.lit(0.0)) >= GATE).alias("gate_passed"),
    )


def evaluation_summary(results: DataFrame) -> DataFrame:
    """Rates overall, by category and by type, in one pass over grouping sets.

    ``results``: category, type, behavior, guard_pass, model_refused,
    model_correct, e2e_correct.  A rate without rows is null.
    """
    rate = lambda c, which: F.avg(F.when(F.col("behavior") == which, F.coalesce(c, F.lit(False)).cast("int")))
    grouped = results.groupingSets([(), ("category",), ("type",)], "category", "type")
    return grouped.agg(
        F.expr("grouping_id()").alias("level"),
        F.count("*").alias("n"),
        F.count_if(F.col("behavior") == "answer").alias("n_inscope"),
        rate(F.col("model_correct"), "answer").alias("model_acc"),
        rate(F.col("guard_pass"), "answer").alias("guard_pass"),
        rate(F.col("e2e_correct"), "answer").alias("e2e_acc"),
        rate(F.col("model_refused"), "answer").alias("false_refusal"),
        F.count_if(F.col("behavior") == "refuse").alias("n_refuse"),
        rate(F.col("e2e_correct"), "refuse").alias("refusal_rate"),
        rate(~F.col("guard_pass"), "refuse").alias("guard_refusal"),
        rate(F.col("model_refused"), "refuse").alias("model_refusal"),
        F.avg(F.col("e2e_correct").cast("int")).alias("overall_e2e"),
    )


def evaluated(items: DataFrame, predictions: DataFrame, item: str, raw: str, guard_pass: Column, threshold_parts: tuple[str, str] = T.REFUSAL_PARTS) -> DataFrame:
    """``items`` with ``final, guard_pass, model_refused, model_correct, e2e_correct`` for each one's prediction.

    ``items`` holds the id, ``behavior`` and ``expected_any``; ``predictions``
    the id and the raw output, joined by id.  An item without a prediction
    counts as an empty output.  Refuse items have no ``model_correct``.
    """
    joined = items.join(predictions.select(F.col(item).alias("__item"), F.coalesce(F.col(raw), F.lit("")).alias("raw")), F.col(item) == F.col("__item"), "left").drop("__item")
    cut = joined.withColumn("raw", F.coalesce("raw", F.lit(""))).withColumn("final", T.split_reasoning(F.col("raw"))["answer"]).withColumn("guard_pass", guard_pass)
    expected = F.transform("expected_any", comparable_text)
    judged = cut.withColumns({"model_refused": T.is_refusal(F.col("raw"), threshold_parts), "correct": F.coalesce(T.contains_expected(comparable_text(F.col("final")), expected), F.lit(False))})
    e2e = outcome(F.col("behavior"), F.col("correct"), F.col("guard_pass"), F.col("model_refused"))
    return judged.withColumns({"model_correct": F.when(F.col("behavior") != "refuse", F.col("correct")), "e2e_correct": e2e}).drop("correct")


def comparable_text(c: Column) -> Column:
    """Lower case without the ignored characters; for texts that are in NFKC already."""
    return T.remove_ignored(F.lower(c))


def failures(evaluated_rows: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` items that went wrong end to end, with the cause: the guard or the model."""
    cause = F.when((F.col("behavior") != "refuse") & ~F.col("guard_pass"), "guard").otherwise("model")
    return evaluated_rows.where(~F.col("e2e_correct")).withColumn("cause", cause).orderBy(order).limit(n)


def first_failures(rows: DataFrame, category: str, correct: Column, order: list[str], k: int) -> DataFrame:
    """``rows`` that went wrong with ``place``: the first ``k`` of each category in order.

    Spark keeps each task's first ``k`` of a category before the shuffle, so a
    category of any size sends that many a task.  A null ``correct`` is wrong;
    a null category is one of its own.
    """
    wrong = rows.where(~F.coalesce(correct, F.lit(False)))
    return wrong.withColumn("place", F.row_number().over(Window.partitionBy(category).orderBy(*order))).where(F.col("place") <= k)


def checked(rows: DataFrame, category: str, correct: Column, order: list[str], k: int) -> DataFrame:
    """:func:`verdicts` with ``failures``: for each category, and over all (null), its first ``k`` failures as rows."""
    named = F.struct(*(c for c in rows.columns if c != category))
    each = first_failures(rows, category, correct, order, k).select(F.col(category).alias("__c"), F.lit(0).alias("__all"), "place", named.alias("row"))
    # the first of all are among the first of their categories
    overall = first_failures(first_failures(rows, category, correct, order, k).drop("place").withColumn("__one", F.lit(1)), "__one", F.lit(False), order, k)
    overall = overall.select(F.lit(None).cast(rows.schema[category].dataType).alias("__c"), F.lit(1).alias("__all"), "place", named.alias("row"))
    listed = each.unionByName(overall).groupBy("__c", "__all").agg(F.sort_array(F.collect_list(F.struct("place", "row"))).alias("f"))  # k rows at most
    level = rows.rollup(category).agg(F.grouping(category).cast("int").alias("__level"), F.count("*").alias("n"), F.avg(F.coalesce(correct, F.lit(False)).cast("int")).alias("accuracy"))
    joined = level.join(listed, F.col(category).eqNullSafe(F.col("__c")) & (F.col("__level") == F.col("__all")), "left")
    return joined.select(category, "n", "accuracy", verdict(F.col("accuracy")).alias("verdict"), F.transform("f", lambda x: x["row"]).alias("failures"))


def verdict(accuracy: Column) -> Column:
    """Good from 0.8, weak from 0.3, else bad."""
    return F.when(accuracy >= 0.8, "good").when(accuracy >= 0.3, "weak").otherwise("bad")


def outcome(behavior: Column, correct: Column, guard_pass: Column, refused: Column) -> Column:
    """Answer items need a match and the guard; refuse items the guard or a refusal."""
    return F.when(behavior == "refuse", ~guard_pass | refused).otherwise(correct & guard_pass)


def deltas(now: DataFrame, before: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Metrics with their change from ``before`` in points; null where either is missing."""
    other = before.select(F.col(key).alias("__key"), *(F.col(m).alias(f"__{m}") for m in metrics))
    joined = now.join(other, F.col(key).eqNullSafe(F.col("__key")), "left")
    return joined.select(key, *metrics, *(((F.col(m) - F.col(f"__{m}")) * 100).alias(f"{m}_change") for m in metrics))


def match_metrics(rows: DataFrame, pred: Column, ref: Column, category: Column) -> DataFrame:
    """Exact match and character F1 over questions, exact match over arithmetic; 0 without rows."""
    asked, summed = category == "qa", category == "arithmetic"
    mean = lambda c, when: F.coalesce(F.avg(F.when(when, c)), F.lit(0.0))
    same = (pred == ref).cast("int")
    return rows.agg(mean(same, asked).alias("em"), mean(T.char_f1(pred, ref), asked).alias("f1"), mean(same, summed).alias("accuracy"))


def verdicts(rows: DataFrame, category: str, correct: Column) -> DataFrame:
    """Accuracy per category and overall with a verdict: good from 0.8, weak from 0.3, else bad."""
    share = F.avg(correct.cast("int"))
    return rows.rollup(category).agg(F.count("*").alias("n"), share.alias("accuracy")).withColumn("verdict", verdict(F.col("accuracy")))


def each_setting(prompts: DataFrame, settings: list[dict]) -> DataFrame:
    """Every prompt with every setting, a column for each of its names: rows spread in place, no cross join.  Settings share their names."""
    listed = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in setting.items())) for setting in settings))
    return prompts.withColumn("__setting", F.explode(listed)).select(*prompts.columns, "__setting.*")


def decoding_summary(rows: DataFrame, setting: str, text: Column, keywords: Column) -> DataFrame:
    """Per setting: mean repetition, count of strong repetition, hit rate where keywords exist, mean length."""
    rep = T.repetition(text)
    return rows.groupBy(setting).agg(
        F.round(F.avg(rep), 3).alias("repetition"),
        F.count_if(rep >= 0.5).alias("n_repetitive"),
        F.round(F.avg(T.keyword_hit(text, keywords).cast("int")), 3).alias("hit_rate"),
        F.round(F.avg(F.length(F.coalesce(text, F.lit("")))), 1).alias("mean_length"),
    )
