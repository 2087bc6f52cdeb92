"""Sparse term vectors kept as sorted arrays inside a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encaje.functions.text import let


def term_counts(tokens: Column) -> Column:
    """``array<struct<term, n>>``, one entry per distinct token, terms in order.

    Sorts once and measures runs, so it needs no explode and no shuffle.
    """

    def runs(s: Column) -> Column:
        n = F.size(s)
        positions = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(
            positions,
            lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))

        def measure(st: Column) -> Column:
            return F.transform(st, lambda at, k: F.struct(
                F.get(s, at - 1).alias("term"),
                (F.coalesce(F.get(st, k + 1), n + 1) - at).cast("bigint").alias("n")))

        return let(starts, measure)

    return let(F.sort_array(tokens), runs)


def square_norm(counts: Column, weight: str = "n", zero: Column | None = None) -> Column:
    """Sum of squared weights."""
    zero = F.lit(0).cast("bigint") if zero is None else zero
    return F.aggregate(counts, zero, lambda acc, t: acc + t[weight] * t[weight])


def dot(left: Column, right: Column, key: str = "term", weight: str = "n",
        zero: Column | None = None) -> Column:
    """Dot product of two vectors: sort both together, multiply equal neighbours."""
    zero = F.lit(0).cast("bigint") if zero is None else zero

    def tag(v: Column, side: int) -> Column:
        return F.transform(v, lambda t: F.struct(
            t[key].alias("k"), F.lit(side).alias("side"), t[weight].alias("w")))

    def multiply(both: Column) -> Column:
        following = F.slice(both, 2, F.greatest(F.size(both), F.lit(1)))
        pairs = F.zip_with(both, following, lambda a, b: F.when(
            a["k"] == b["k"], a["w"] * b["w"]))
        return F.aggregate(pairs, zero, lambda acc, x: acc + F.coalesce(x, zero))

    return let(F.sort_array(F.concat(tag(left, 0), tag(right, 1))), multiply)


def cosine(product: Column, left_square: Column, right_square: Column) -> Column:
    """Cosine from integer sums, 0 if a side is empty.

    One root of the product of the squares: two separate roots would lose the
    last bit on exact halves.
    """
    squares = left_square.cast("double") * right_square.cast("double")
    return F.when(squares > 0, product.cast("double") / F.sqrt(squares)).otherwise(F.lit(0.0))


def entries(df: DataFrame, vector: str | Column, *keep: str | Column) -> DataFrame:
    """One row per entry ``t`` of a vector, with some columns kept.

    Empty vectors give no rows. An outer explode on purpose: a plain one makes
    the optimizer test the array beforehand, which computes a vector made by
    expressions three times over.
    """
    return df.select(*keep, F.explode_outer(vector).alias("t")).where(F.col("t").isNotNull())
