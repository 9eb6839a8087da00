"""Operators that depend on row order, without one task per group.

A running sum over a whole group would put a large group into one task.  Here
rows are cut into ranges of about equal size by group and order together,
wherever Spark's sample of them says; each range of a group has one sum, and
the running total of these few is added to the one within each range.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.sources import scratch


def in_ranges(df: DataFrame, group: list[str], order: str, ties: tuple[str, ...] = (), name: str = "__range") -> DataFrame:
    """``df`` with ``name``, numbering ranges of rows that are consecutive by group, order and ties.

    The bounds come from a sample of the rows, so neither a large group nor an
    outlier of the order fills a range.  Only rows equal in all these columns
    can't be parted.  The rows are written, as every reader must see the same ranges.
    """
    held = df.repartitionByRange(*group, order, *ties).withColumn(name, F.spark_partition_id())
    return scratch.kept(held, "ranges")


def running_total(df: DataFrame, group: list[str], order: str, value: Column, name: str = "before", ties: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over earlier rows of the group.

    ``order`` is any column that sorts; equal values are ordered by ``ties``.
    Null groups are one group.
    """
    keys = [f"__g{i}" for i in range(len(group))]
    ranged = in_ranges(df.withColumn("__value", value.cast("double")), group, order, ties)
    sums = ranged.groupBy(*(F.col(g).alias(k) for g, k in zip(group, keys, strict=True)), F.col("__range").alias("__r")).agg(F.sum("__value").alias("__sum"))
    earlier = Window.partitionBy(*keys).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range, however large the group
    offsets = sums.select(*keys, "__r", F.coalesce(F.sum("__sum").over(earlier), F.lit(0.0)).alias("__offset"))
    within = Window.partitionBy(*group, "__range").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    same = [*(F.col(g).eqNullSafe(F.col(k)) for g, k in zip(group, keys, strict=True)), F.col("__range") == F.col("__r")]
    out = ranged.withColumn("__within", F.coalesce(F.sum("__value").over(within), F.lit(0.0))).join(offsets, reduce(and_, same))
    return out.withColumn(name, F.col("__offset") + F.col("__within")).select(*df.columns, name)


def keep_first(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row in ``order`` of each key; an aggregation, so a hot key is combined before the shuffle.

    A null key is a key of its own.
    """
    rest = F.struct(*df.columns)
    place = F.struct(*order)
    return df.groupBy(key.alias("__key")).agg(F.min_by(rest, place).alias("__row")).select("__row.*")


def within_budget(df: DataFrame, group: list[str], order: str, size: Column, budget: float) -> DataFrame:
    """Rows in order until the sizes reach ``budget``; the row that reaches it is kept."""
    return running_total(df, group, order, size, "__before").where(F.col("__before") < budget).drop("__before")


def first_n(df: DataFrame, group: list[str], order: str, n: int) -> DataFrame:
    """The first ``n`` rows of each group; 0 for all."""
    return df if n == 0 else within_budget(df, group, order, F.lit(1), n)


def numbered(df: DataFrame, group: list[str], order: str, prefix: Column, name: str = "id") -> DataFrame:
    """``df`` with an id of the prefix and the row's place in its group, six digits at least."""
    out = running_total(df, group, order, F.lit(1), "__n")
    return out.withColumn(name, F.format_string("%s_%06d", prefix, F.col("__n").cast("long"))).drop("__n")


def hash_order(*columns: str, seed: str = "0") -> Column:
    """A fixed pseudo-random order: the MD5 of the columns."""
    return F.md5(F.concat_ws(":", F.lit(seed), *(F.col(c).cast("string") for c in columns)))


def hash_number(*columns: str, seed: str = "0") -> Column:
    """A fixed pseudo-random whole number under 2 ** 32 per row."""
    return F.conv(F.substring(hash_order(*columns, seed=seed), 1, 8), 16, 10).cast("long")


def hash_uniform(*columns: str, seed: str = "0") -> Column:
    """A fixed pseudo-random number in [0, 1) per row."""
    return hash_number(*columns, seed=seed) / 4294967296.0


def sample_exactly(df: DataFrame, n: int, key: str, seed: str = "0") -> DataFrame:
    """``n`` rows without replacement, by hash order of a unique ``key``.

    Hashes are counted by their first five digits, at most 16^5 of them
    whatever the number of rows, and the digits where the ``n``-th falls are
    found by running sums; only the rows with these digits are ordered.
    """
    if n <= 0:
        return df.limit(0)
    digits = F.substring(hash_order(key, seed=seed), 1, 5)
    counts = df.groupBy(digits.alias("d"), F.substring(digits, 1, 2).alias("head")).agg(F.count("*").alias("n"))
    heads = counts.groupBy("head").agg(F.sum("n").alias("of_head"))  # 256 of them: one task sums these, 256 the rest
    before = Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(F.col("head").alias("h"), F.coalesce(F.sum("of_head").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("head").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.join(F.broadcast(heads), F.col("head") == F.col("h")).select("d", "n", (F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("upto"))
    border = placed.where((F.col("upto") < n) & (F.col("upto") + F.col("n") >= n)).first()
    if border is None:
        return df
    last = df.where(digits == border["d"]).orderBy(hash_order(key, seed=seed), key).limit(n - border["upto"])
    return df.where(digits < border["d"]).unionByName(last)


def systematic_sample(df: DataFrame, order: str, n: int) -> DataFrame:
    """``n`` rows evenly spaced in order; all rows if there are no more."""
    total = df.count()
    if total <= n:
        return df
    at = running_total(df, [], order, F.lit(1), "__at").withColumn("__at", F.col("__at").cast("long"))
    chosen = F.ceil((F.col("__at") + 1) * n / F.lit(total)) > F.ceil(F.col("__at") * n / F.lit(total))
    return at.where(chosen).drop("__at")
