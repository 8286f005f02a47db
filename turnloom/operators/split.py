"""Train and evaluation sides of a corpus, and samples of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.config import DEFAULT_SEED, SplitConfig
from turnloom.operators.ordered import cutoff, first_n, not_after, shuffle_key, shuffled

_HASH_RANGE = float(2**60)


def held_out_count(total: Column, ratio: float) -> Column:
    """Rows held out of ``total``: the ratio rounded down, but at least one."""
    return F.greatest(F.lit(1).cast("bigint"), (total * F.lit(float(ratio))).cast("bigint"))


def exact_split(df: DataFrame, ids: Sequence[str], cfg: SplitConfig = SplitConfig()) -> DataFrame:
    """Add ``split``: the last rows in shuffled order are ``eval``.

    The exact number of rows is held out, yet no row is shuffled: each one is
    compared with a single cutoff key found from block counts.
    """
    order = shuffled(*ids, seed=cfg.seed)
    cut = cutoff(df, order, lambda total: total - held_out_count(total, cfg.eval_ratio))
    return df.withColumn("split", F.when(not_after(order, cut), "train").otherwise("eval"))


def hash_split(ids: Sequence[str], cfg: SplitConfig = SplitConfig()) -> Column:
    """Split by key threshold. Row-local, so it suits streams; the held-out
    share is only close to the ratio."""
    threshold = (1.0 - cfg.eval_ratio) * _HASH_RANGE
    key = shuffle_key(*ids, seed=cfg.seed).cast("double")
    return F.when(key < threshold, "train").otherwise("eval")


def without(df: DataFrame, held_out: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Rows whose id is not held out."""
    return df.join(held_out.select(*ids), list(ids), "left_anti")


def content_digest(text: Column) -> Column:
    """md5 of a text in lower case with runs of blanks as one blank."""
    return F.md5(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))))


def heldout_overlap(held_out: DataFrame, train: DataFrame, text: str = "text") -> DataFrame:
    """Held-out rows whose normalised text is in the training rows too.

    A semi join of digests: a text that many rows share is one digest on the
    training side, and no pair of rows is ever made. Null texts overlap nothing.
    """
    seen = train.select(content_digest(F.col(text)).alias("__digest")).distinct()
    rows = held_out.withColumn("__digest", content_digest(F.col(text)))
    return rows.join(seen, "__digest", "left_semi").drop("__digest")


def overlap_rate(held_out: DataFrame, train: DataFrame, text: str = "text", by: Sequence[str] = ()) -> DataFrame:
    """``n_held_out, n_overlap, overlap_rate``, in the table or per group."""
    digest = content_digest(F.col(text))
    seen = train.select(digest.alias("__digest")).distinct().withColumn("__seen", F.lit(1))
    rows = held_out.select(*by, digest.alias("__digest")).join(seen, "__digest", "left")
    counted = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_held_out"), F.count("__seen").alias("n_overlap"))
    return counted.withColumn("overlap_rate", F.try_divide("n_overlap", "n_held_out"))


def seeded_sample(
    df: DataFrame, ids: Sequence[str], n: int, seed: int = DEFAULT_SEED
) -> DataFrame:
    """The first ``n`` rows in shuffled order; all rows if there are fewer."""
    return first_n(df, shuffled(*ids, seed=seed), n)
