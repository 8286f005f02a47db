"""Sample, score and compare models over a corpus of instruction pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.config import DEFAULT_SEED, SCORING_MAX_SEQ_LEN
from turnloom.functions.messages import evaluation_pair
from turnloom.functions.template import ChatTemplate
from turnloom.functions.tokens import Tokenizer, WhitespaceTokenizer
from turnloom.operators.evaluate import Scorer, score_rows
from turnloom.operators.split import seeded_sample


def scoring_inputs(
    rows: DataFrame,
    template: ChatTemplate = ChatTemplate(),
    tokenizer: Tokenizer = WhitespaceTokenizer(),
    max_len: int = SCORING_MAX_SEQ_LEN,
) -> DataFrame:
    """Add ``input_ids`` and ``n_tokens`` of the rendered instruction pair, and ``skip_reason``.

    A pair of which one half is null is a ``render_error`` and has no ids, like
    a conversation with a null message.
    """
    half = F.col("instruction").isNull() | F.col("output").isNull()
    pair = evaluation_pair(F.col("instruction"), F.col("output"))
    df = rows.withColumns(
        {"skip_reason": F.when(half, "render_error"), "__text": F.when(~half, template.render(pair))}
    )
    df = tokenizer.encode(df, "__text", "input_ids", max_len, {}).drop("__text")
    return df.withColumn("n_tokens", F.array_size("input_ids").cast("bigint"))


def score_sample(
    rows: DataFrame,
    id_col: str,
    load: Callable[[], Scorer],
    n_samples: int = 100,
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """``loss`` and ``n_tokens`` of a seeded sample of instruction pairs; half pairs in it are not scored."""
    sample = seeded_sample(rows, [id_col], n_samples, seed)
    good = scoring_inputs(sample).filter(F.col("skip_reason").isNull())
    return score_rows(good, load).drop("input_ids", "skip_reason")
