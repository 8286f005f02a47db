"""Length distributions that are kept and merged later: one sketch per group (KLL).

A sketch's size depends on its accuracy alone and not on the rows or distinct
values it has seen, sketches of parts merge to the sketch of the whole, and
what is stored is never read again row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKETCH_SIZE = 1024      # items a level of the sketch holds
RANK_ERROR = 0.01       # share of the rows by which a quantile's rank may be off at that size, with ample room
QUANTILES = (0.5, 0.9, 0.99)


def length_sketches(rows: DataFrame, value: str, by: Sequence[str] = (), size: int = SKETCH_SIZE) -> DataFrame:
    """``by, n, lowest, highest, sketch`` per group of the values that are not null; partial sketches merge before the shuffle."""
    known = rows.select(*by, F.col(value).cast("bigint").alias("__x")).filter(F.col("__x").isNotNull())
    return known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min("__x").alias("lowest"), F.max("__x").alias("highest"), F.kll_sketch_agg_bigint("__x", F.lit(size)).alias("sketch"))


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same columns for coarser groups, from stored sketches alone."""
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest"), F.kll_merge_agg_bigint("sketch").alias("sketch")).filter("n > 0")


def read_quantiles(sketches: DataFrame, by: Sequence[str] = (), quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """``by, n, lowest, highest, quantile, value``: a row per group and quantile."""
    each = F.array(*[F.struct(F.lit(q).alias("quantile"), F.kll_sketch_get_quantile_bigint("sketch", F.lit(q)).alias("value")) for q in quantiles])
    return sketches.select(*by, "n", "lowest", "highest", F.inline(each))


def quantile_ranks(rows: DataFrame, value: str, found: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add ``below`` and ``upto``: the exact shares of a group's values below each quantile's value and up to it.

    A check of sketches against the rows they stand for; it does read them.
    """
    known = rows.select(*by, F.col(value).cast("bigint").alias("__x")).filter(F.col("__x").isNotNull())
    counts = known.groupBy(*by, "__x").agg(F.count(F.lit(1)).alias("__n"))
    both = found.join(counts, list(by)) if by else found.join(counts, F.col("__x").isNotNull())
    share = lambda test: F.sum(F.when(test, F.col("__n")).otherwise(0)) / F.first("n")
    return both.groupBy(*by, "quantile", "value").agg(
        F.first("n").alias("n"), F.first("lowest").alias("lowest"), F.first("highest").alias("highest"),
        share(F.col("__x") < F.col("value")).alias("below"), share(F.col("__x") <= F.col("value")).alias("upto"))
