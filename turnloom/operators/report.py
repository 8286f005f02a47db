"""Counts of what a preparation kept and what it skipped."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from turnloom.functions.messages import is_eligible
from turnloom.operators.examples import SKIP_REASONS


def sample_counts(examples: DataFrame, by: Sequence[str] = ("source", "split")) -> DataFrame:
    """Rows in, examples out and their tokens, per group."""
    good = F.col("skip_reason").isNull()
    return examples.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(good, 1)).alias("n_examples"),
        F.coalesce(F.sum(F.when(good, F.col("n_tokens"))), F.lit(0)).alias("n_tokens"),
        F.coalesce(F.sum(F.when(good, F.col("n_unmasked"))), F.lit(0)).alias("n_unmasked"),
    )


def skip_counts(examples: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per skip reason; ``kept`` counts the good ones."""
    reason = F.coalesce("skip_reason", F.lit("kept")).alias("skip_reason")
    return examples.groupBy(*by, reason).agg(F.count(F.lit(1)).alias("n_rows"))


@dataclass
class StageCounts:
    """Counts of the stages of one preparation, taken while its result is written.

    ``watch`` puts counters into a plan that is going to run anyway; after the
    one action that runs it, ``counts`` has the numbers, and no stage is scanned
    for them again. A watched plan must be run once: a second action counts
    again into numbers that are no longer read. Counters of a result stage count
    each task once, but those before a shuffle count a task again if its output
    is lost and made anew, so after lost executors they may be too high. Where
    that matters, count the written table.
    """

    watched: dict[str, Observation] = field(default_factory=dict)

    def watch(self, df: DataFrame, stage: str, **numbers: Column) -> DataFrame:
        """The same rows; their number and ``numbers`` are counted as ``stage``."""
        if stage in self.watched:
            raise ValueError(f"stage {stage} is watched twice")
        self.watched[stage] = Observation(f"{stage} rows")
        return df.observe(self.watched[stage], F.count(F.lit(1)).alias("n_rows"), *[c.alias(n) for n, c in numbers.items()])

    def counts(self) -> dict[str, Mapping[str, int]]:
        """Numbers of every stage; waits until the action has run."""
        return {stage: {n: v or 0 for n, v in seen.get.items()} for stage, seen in self.watched.items()}


def watch_preparation(examples: DataFrame, stages: StageCounts) -> DataFrame:
    """Examples (``build_examples``) with counts of loaded, eligible and kept rows, of every skip reason, and of tokens."""
    reason, good = F.col("skip_reason"), F.col("skip_reason").isNull()
    eligible = is_eligible(F.col("facts"))
    return stages.watch(
        examples, "prepared",
        eligible=F.count(F.when(eligible, 1)), kept=F.count(F.when(good, 1)),
        **{name: F.count(F.when(reason == name, 1)) for name in SKIP_REASONS},
        n_tokens=F.sum(F.when(good, F.col("n_tokens"))), n_unmasked=F.sum(F.when(good, F.col("n_unmasked"))),
    )


def counts_table(spark: SparkSession, counts: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """``stage, measure, n``: a handful of rows."""
    rows = [(stage, name, int(n)) for stage, numbers in counts.items() for name, n in numbers.items()]
    return spark.createDataFrame(rows, "stage string, measure string, n bigint")
