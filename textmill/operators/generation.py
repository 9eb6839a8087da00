"""Generated samples, windows of a mixture, phrase banks, and small parts of pipelines.

Choices are made by hashes of a row's place, so a lost task gives the same
rows again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.functions import text as T
from textmill.operators.mixing import keep_reasoning, oversampled
from textmill.operators.ordered import hash_number, hash_uniform, running_total, sample_exactly


def dated_id(prefix: Column, date: str, place: Column) -> Column:
    """``prefix_date_00000``; the date is a parameter, so that results can be repeated."""
    return F.concat(prefix, F.lit(f"_{date}_"), F.lpad(place.cast("string"), 5, "0"))


def with_default(struct: Column, field: str, default: Column) -> Column:
    """``struct`` with ``field`` set to ``default`` where it is null; null stays null."""
    return F.when(struct.isNotNull(), struct.withField(field, F.coalesce(struct[field], default)))


def generated(spark: SparkSession, facts: DataFrame, order: str, numbers: dict[str, int], seed: str = "0") -> DataFrame:
    """``(category, i, fact columns)``: for each category so many rows, each with a hashed fact of that category.

    ``facts`` has ``category``; ``order`` is a unique integer column.  A category without facts gives no rows.
    """
    placed = running_total(facts.where(F.col("category").isin(*numbers)), ["category"], order, F.lit(1), "__at")
    sizes = placed.groupBy("category").agg(F.count("*").alias("__size"))
    rows = reduce(DataFrame.unionByName, (spark.range(n).select(F.lit(c).alias("category"), F.col("id").alias("i")) for c, n in numbers.items()))
    asked = rows.join(sizes, "category").withColumn("__pick", hash_number("category", "i", seed=seed) % F.col("__size"))
    return asked.join(placed.withColumn("__at", F.col("__at").cast("long")).withColumnRenamed("category", "__c"), (F.col("category") == F.col("__c")) & (F.col("__pick") == F.col("__at"))).drop("__at", "__c", "__size", "__pick")


def window_mixture(spark: SparkSession, sizes: DataFrame, weights: dict[str, float], n: int, block: int, seed: str = "0") -> DataFrame:
    """``(i, source, start)``: ``n`` windows of ``block + 1`` tokens from ``(source, size)``, sources drawn by weight.

    Sources without a weight, or with no more than twice a window's tokens,
    take no part; the weights of the others are scaled to 1.
    """
    share = F.coalesce(F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))[F.col("source")], F.lit(0.0))
    usable = sizes.where(F.col("source").isin(*weights)).withColumn("__w", share).where((F.col("__w") > 0) & (F.col("size") > 2 * (block + 2)))
    # one row per weighted source: as few as the parameter has
    order = Window.orderBy("source")
    upto = F.sum("__w").over(order.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("__w").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranges = usable.select("source", "size", ((upto - F.col("__w")) / total).alias("__lo"), F.when(F.lead("source").over(order).isNull(), 1.0).otherwise(upto / total).alias("__hi"))
    drawn = spark.range(n).select(F.col("id").alias("i")).withColumn("__u", hash_uniform("i", seed=f"{seed}s"))
    met = drawn.join(F.broadcast(ranges), (F.col("__u") >= F.col("__lo")) & (F.col("__u") < F.col("__hi")))
    return met.select("i", "source", (hash_number("i", seed=f"{seed}w") % (F.col("size") - block - 1)).alias("start"))


def refusals(questions: DataFrame, answer: str, n_near: int = 0, n_far: int = 0, seed: str = "0") -> DataFrame:
    """``(id, kind, split, input, cot, answer)`` from ``(split, kind, question)``, a table of constant size.

    Training rows go round the pool of their kind, 0 for the whole pool;
    validation takes a fifth of that, one at least, without repeats.
    """
    parts = []
    for kind, asked in (("near", n_near), ("far", n_far)):
        pool = lambda split, kind=kind: questions.where((F.col("kind") == kind) & (F.col("split") == split)).select("question")
        n = asked or pool("train").count()
        val = sample_exactly(pool("val"), max(1, n // 5), "question", seed)
        held = oversampled(val, val.count(), "question", seed)
        for split, rows in (("train", oversampled(pool("train"), n, "question", seed)), ("val", held)):
            name = F.format_string(f"refusal_{split}_{kind}_%05d", "i")
            parts.append(rows.select(name.alias("id"), F.lit(kind).alias("kind"), F.lit(split).alias("split"), F.col("question").alias("input"), F.lit("").alias("cot"), F.lit(answer).alias("answer")))
    return reduce(DataFrame.unionByName, parts)


def bank_phrases(paraphrases: DataFrame, forms: DataFrame, numbers: tuple[int, int] = (123, 456), word: str = "言い換え", sums: str = "算数") -> DataFrame:
    """``(kind, phrase)`` of ``(question, phrases)`` and of ``(kind, forms)``, whose ``{0}`` and ``{1}`` are filled with numbers."""
    said = paraphrases.select(F.lit(word).alias("kind"), F.explode("phrases").alias("phrase"))
    filled = F.col("form")
    for at, number in enumerate(numbers):
        filled = F.replace(filled, F.lit(f"{{{at}}}"), F.lit(str(number)))
    asked = forms.select(F.concat_ws("/", F.lit(sums), "kind").alias("kind"), F.explode("forms").alias("form")).select("kind", filled.alias("phrase"))
    return said.unionByName(asked)


def topic_pairs(*questions: DataFrame) -> DataFrame:
    """Bag union of ``(entity, attribute)`` of the tables' first columns."""
    named = (q.select(T.split_entity_attribute(F.col(q.columns[0])).alias("p")).select("p.*") for q in questions)
    return reduce(DataFrame.unionByName, named)


def held_out(items: DataFrame | None, text: str, *lists: DataFrame) -> DataFrame:
    """Distinct held-out texts of the items, which may be missing, and of the lists' first columns."""
    parts = [d.select(F.col(d.columns[0]).alias("text")) for d in lists]
    if items is not None:
        parts.append(items.select(F.col(text).alias("text")))
    return reduce(DataFrame.unionByName, parts).where("text is not null").distinct()


def ratio_variants(rows: DataFrame, key: str, ratios: dict[str, float], seed: str = "0") -> DataFrame:
    """``rows`` once for each version, with reasoning kept at the version's ratio."""
    parts = (keep_reasoning(rows, key, ratio, seed).withColumn("version", F.lit(name)) for name, ratio in ratios.items())
    return reduce(DataFrame.unionByName, parts)


def total_by_prefix(rows: DataFrame, key: str, value: str, prefix: str) -> DataFrame:
    """One row ``total``: the sum over keys that begin with ``prefix``; 0 without any."""
    return rows.agg(F.coalesce(F.sum(F.when(F.col(key).startswith(prefix), F.col(value))), F.lit(0)).alias("total"))


def report_lines(rows: DataFrame, name: str, *rates: str) -> DataFrame:
    """``line`` per row: the name and each rate in percent with a decimal, ``-`` for a missing one."""
    shown = (F.concat(F.lit(f"{r} "), F.coalesce(F.concat(F.round(F.round(F.col(r) * 100, 6), 1).cast("decimal(18,1)").cast("string"), F.lit("%")), F.lit("-"))) for r in rates)
    return rows.select(F.concat_ws(", ", F.coalesce(F.col(name), F.lit("all")), *shown).alias("line"))
