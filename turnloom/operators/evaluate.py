"""Batch scoring and generation with pluggable models, and their summaries."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.functions.schedule import perplexity
from turnloom.operators.ordered import RowOrder, by_column, cutoff, not_after, ordered_scan

# A scorer gives one mean loss per row; a generator gives response and token count.
Scorer = Callable[[pd.DataFrame], pd.Series]
Generator = Callable[[str], tuple[str, int]]


def score_rows(df: DataFrame, load: Callable[[], Scorer]) -> DataFrame:
    """Add ``loss`` to every row. ``load`` runs once per task, on the worker."""
    schema = T.StructType([*df.schema.fields, T.StructField("loss", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = load()
        for batch in batches:
            yield batch.assign(loss=score(batch).astype("float64"))

    return df.mapInPandas(run, schema)


def generate_responses(
    prompts: DataFrame,
    load: Callable[[], Generator],
    clock: Callable[[], float] = time.perf_counter,
) -> DataFrame:
    """Add ``response, tokens, latency_s, tok_per_sec`` to rows with a ``prompt``."""
    schema = T.StructType(
        [
            *prompts.schema.fields,
            T.StructField("response", T.StringType()),
            T.StructField("tokens", T.LongType()),
            T.StructField("latency_s", T.DoubleType()),
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = load()
        for batch in batches:
            made = []
            for prompt in batch["prompt"]:
                began = clock()
                response, tokens = generate(prompt)
                made.append((response, tokens, clock() - began))
            added = pd.DataFrame(made, columns=["response", "tokens", "latency_s"], index=batch.index)
            yield pd.concat([batch, added], axis=1)

    return with_speed(prompts.mapInPandas(run, schema))


def with_speed(generations: DataFrame) -> DataFrame:
    return generations.withColumn("tok_per_sec", F.try_divide("tokens", "latency_s"))


def new_tokens(ids: Column, prompt_len: Column) -> Column:
    """The generated ids behind the prompt."""
    return F.slice(ids, (prompt_len + 1).cast("int"), F.greatest(F.array_size(ids), F.lit(1)))


def preview(text: Column, length: int) -> Column:
    return F.concat(F.substring(text, 1, length), F.lit("..."))


def generation_previews(generations: DataFrame) -> DataFrame:
    return generations.withColumns(
        {
            "prompt_preview": preview(F.col("prompt"), 60),
            "response_preview": preview(F.col("response"), 200),
        }
    )


def generation_summary(generations: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Speed as the mean of per-row ratios, the ratio of sums beside it, and
    response lengths. The median's state is one counter per distinct length."""
    return generations.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("tok_per_sec").alias("avg_tok_per_sec"),
        F.try_divide(F.sum("tokens"), F.sum("latency_s")).alias("overall_tok_per_sec"),
        F.avg("tokens").alias("avg_tokens"),
        F.min("tokens").alias("min_tokens"),
        F.max("tokens").alias("max_tokens"),
        F.percentile("tokens", 0.5).alias("median_tokens"),
    )


def perplexity_summary(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``perplexity, avg_loss, total_tokens``; each loss weighs as many tokens
    as its whole sequence has."""
    tokens = F.sum("n_tokens")
    mean = F.try_divide(F.sum(F.col("loss") * F.col("n_tokens")), tokens)
    return scores.groupBy(*by).agg(
        perplexity(mean).alias("perplexity"), mean.alias("avg_loss"), tokens.alias("total_tokens")
    )


def running_perplexity(
    scores: DataFrame, *, by: Sequence[str] = ("model",), at: str = "i", every: int = 20
) -> DataFrame:
    """Perplexity over the first ``i`` samples, at every ``every``-th one."""
    weighted, tokens = F.col("loss") * F.col("n_tokens"), F.col("n_tokens")
    slim = scores.select(*by, at, "loss", "n_tokens")
    run = ordered_scan(
        slim, by_column(at), by=by, sums={"__loss": weighted, "__tokens": tokens}
    )
    seen = F.col("__tokens") + tokens
    mean = (F.col("__loss") + weighted) / seen
    return run.filter(F.col(at) % every == 0).select(
        *by, at, seen.alias("total_tokens"), perplexity(mean).alias("perplexity")
    )


def mean_loss(losses: DataFrame) -> DataFrame:
    """Plain mean of batch losses; 0.0 when there is none."""
    return losses.agg(
        F.coalesce(F.avg("loss"), F.lit(0.0)).alias("val_loss"), F.count("loss").alias("n_batches")
    )


def first_batches_mean_loss(losses: DataFrame, order: RowOrder, n_batches: int) -> DataFrame:
    """Mean over the first ``n_batches`` batches, starting over at the end.

    Repeats are weights, not rows. No batches at all give 0.0.
    """
    wanted = F.lit(n_batches).cast("bigint")
    n = losses.agg(F.count(F.lit(1)).alias("n")).scalar()
    cut = cutoff(losses, order, lambda total: F.pmod(wanted, total))
    rounds = F.floor(wanted / n).cast("bigint")
    weight = rounds + F.when(not_after(order, cut), 1).otherwise(0)
    weighted = losses.withColumn("__w", weight)
    mean = F.sum(F.col("loss") * F.col("__w")) / F.greatest(F.sum("__w"), F.lit(1))
    return weighted.agg(
        F.coalesce(mean, F.lit(0.0)).alias("val_loss"),
        F.coalesce(F.sum("__w"), F.lit(0)).cast("bigint").alias("n_batches"),
    )


def compare_models(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """``base_ppl, tuned_ppl, improvement, verdict`` of two score sets.

    Both sides shrink to one row before they meet; improvement is base - tuned.
    """
    both = base.select(F.lit("base").alias("side"), "loss", "n_tokens").unionByName(
        tuned.select(F.lit("tuned").alias("side"), "loss", "n_tokens")
    )

    def side(name: str) -> Column:
        mine = F.col("side") == name
        loss = F.sum(F.when(mine, F.col("loss") * F.col("n_tokens")))
        return perplexity(F.try_divide(loss, F.sum(F.when(mine, F.col("n_tokens")))))

    table = both.agg(side("base").alias("base_ppl"), side("tuned").alias("tuned_ppl"))
    gain = F.col("base_ppl") - F.col("tuned_ppl")
    return table.withColumns(
        {"improvement": gain, "verdict": F.when(gain > 0, "better").otherwise("worse")}
    )


def compare_samples(base: DataFrame, tuned: DataFrame, on: str = "sample_id") -> DataFrame:
    """Loss of both models beside each other for every sample.

    One that a single model scored stays, with nulls for the other and no verdict.
    """
    joined = base.select(on, F.col("loss").alias("base_loss"), F.col("n_tokens").alias("__n")).join(
        tuned.select(on, F.col("loss").alias("tuned_loss"), F.col("n_tokens").alias("__m")), on, "full"
    )
    gain = F.col("base_loss") - F.col("tuned_loss")
    return joined.select(
        on, "base_loss", F.coalesce("__n", "__m").alias("n_tokens"), "tuned_loss", gain.alias("improvement"),
        F.when(gain > 0, "better").when(gain <= 0, "worse").alias("verdict"),
    )
