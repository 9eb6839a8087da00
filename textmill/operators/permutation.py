"""Shuffles without a sort: places are permuted by a keyed Feistel network.

The new place of a row is an expression of its old one, so reordering,
cycling and drawing need no random column, no sort and no global window, and
the place a row came from can be worked out again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.operators.ordered import running_total

ROUNDS = 6
#: Most steps to come back into a range.  A table of up to STEPS^2 places needs no more; of a
#: larger one each step leaves a share under 1 / STEPS outside.
STEPS = 64


def _noise(half: Column, seed: str, n: int) -> Column:
    """A fixed pseudo-random number under 2 ** 32 of a half and a round."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{n}:"), half.cast("string"))), 1, 8), 16, 10).cast("long")


def _sides(n: Column) -> tuple[Column, Column]:
    """Two numbers whose product is ``n`` or a little more."""
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    return a, F.floor((n + a - 1) / a)


def _network(x: Column, a: Column, b: Column, seed: str, back: bool) -> Column:
    left, right = x % a, ((x - x % a) / a).cast("long")
    for n in reversed(range(ROUNDS)) if back else range(ROUNDS):
        sign = -1 if back else 1
        if n % 2:
            right = F.pmod(right + sign * _noise(left, seed, n), b)
        else:
            left = F.pmod(left + sign * _noise(right, seed, n), a)
    return left + a * right


def _walk(place: Column, n: Column, seed: str, back: bool) -> Column:
    """One step, and more while they lead beyond ``n``: the places within it are permuted among themselves."""
    a, b = _sides(n)
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(STEPS)),
        F.struct(place.cast("long").alias("x"), F.lit(False).alias("done")),
        lambda s, _: F.when(s["done"], s).otherwise(_stepped(_network(s["x"], a, b, seed, back), n)),
        lambda s: F.when(s["done"], s["x"]).otherwise(F.raise_error(F.lit("a permutation has not come back into its range"))),
    )


def _stepped(x: Column, n: Column) -> Column:
    return F.struct(x.alias("x"), (x < n).alias("done"))


def permuted(place: Column, n: Column | int, seed: str = "0") -> Column:
    """The new place, of 0 to ``n - 1``, of a row at ``place``; each place is taken once."""
    return _walk(place, F.lit(n).cast("long") if isinstance(n, int) else n.cast("long"), seed, back=False)


def unpermuted(place: Column, n: Column | int, seed: str = "0") -> Column:
    """The place that :func:`permuted` has sent to ``place``."""
    return _walk(place, F.lit(n).cast("long") if isinstance(n, int) else n.cast("long"), seed, back=True)


def shuffled(rows: DataFrame, order: str, seed: str = "0", buffer: int = 0, name: str = "place") -> DataFrame:
    """``rows`` with ``name``, their place in a fixed shuffle: of all rows, or of each ``buffer`` rows in order.

    ``order`` must be unique.  A buffered shuffle moves no row further than
    its buffer, so that a stream can be shuffled as it comes.
    """
    total = rows.count()
    placed = running_total(rows, [], order, F.lit(1), "__at")
    at = F.col("__at").cast("long")
    if not buffer:
        return placed.withColumn(name, permuted(at, max(1, total), seed)).drop("__at")
    start = at - at % buffer
    size = F.least(F.lit(buffer).cast("long"), F.lit(total).cast("long") - start)
    return placed.withColumn(name, start + permuted(at - start, size, seed)).drop("__at")
