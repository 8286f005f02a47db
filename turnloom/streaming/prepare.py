"""Continuous preparation of arriving conversations.

The batch operators up to the label mask are row-local and run on a stream as
they are. What needs the whole input (caps, exact splits, batches, packing,
manifests) does not; here the split goes by a key threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from turnloom.config import PrepConfig, SplitConfig
from turnloom.functions.template import ChatTemplate
from turnloom.functions.tokens import Tokenizer, WhitespaceTokenizer
from turnloom.operators.corpus import normalise
from turnloom.operators.examples import build_examples
from turnloom.operators.split import hash_split


def prepare_stream(
    rows: DataFrame,
    ids: Sequence[str],
    cfg: PrepConfig = PrepConfig(),
    split: SplitConfig = SplitConfig(),
    *,
    presence: str = "schema",
    template: ChatTemplate = ChatTemplate(),
    tokenizer: Tokenizer = WhitespaceTokenizer(),
    event_time: str | None = None,
    repeats_within: str = "1 day",
) -> DataFrame:
    """Rows with one conversation each to examples with ``skip_reason``, ``split``.

    With ``event_time`` a conversation that is delivered again (the same ``ids``)
    within ``repeats_within`` of it gives no second row, also after a restart:
    the ids are keyed state, which the watermark lets go of. Later repeats, and
    rows behind the watermark, are not told apart from new ones or are dropped
    by it, as Structured Streaming defines.
    """
    if event_time is not None:
        rows = rows.withWatermark(event_time, repeats_within).dropDuplicatesWithinWatermark(list(ids))
    examples = build_examples(normalise(rows, presence), cfg, template, tokenizer)
    return examples.withColumn("split", hash_split(ids, split))


def write_stream(examples: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Take in everything that has arrived, as Parquet with one folder per split.

    The checkpoint makes each input row count once, also after a failure.
    """
    return (
        examples.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("split")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
