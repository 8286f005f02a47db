"""Rows cut into ranges of their key, by bounds found from the keys alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import shuffle_width


def key_ranges(df: DataFrame, key: str, parts: int | None = None) -> tuple[Column, list]:
    """A column with the number of a row's range, in order of the key, and the first key of each range.

    The bounds are approximate quantiles of the key column alone, at most as
    many as ``parts`` (the session's shuffle width). Null keys are in range 0;
    rows of one key are in one range.
    """
    parts = parts or max(2, shuffle_width(df.sparkSession))
    cuts = [i / parts for i in range(1, parts)]
    row = df.agg(F.percentile_approx(key, cuts, 20 * parts).alias("c")).first()
    bounds = sorted(set(row["c"] or []))
    if not bounds:
        return F.lit(0), bounds
    ranges = F.array(*[F.lit(b) for b in bounds])
    return F.when(F.col(key).isNull(), 0).otherwise(F.size(F.filter(ranges, lambda b: b <= F.col(key)))), bounds
