"""Mixture to split, tokenised examples in one lazy plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from turnloom.config import PrepConfig, SourceSpec, SplitConfig
from turnloom.functions.template import ChatTemplate
from turnloom.functions.tokens import Tokenizer, WhitespaceTokenizer
from turnloom.operators.corpus import load_mixture
from turnloom.operators.examples import build_examples
from turnloom.operators.split import exact_split
from turnloom.sources.sinks import store


def prepare_corpus(
    spark: SparkSession,
    specs: Sequence[SourceSpec],
    cfg: PrepConfig = PrepConfig(),
    split: SplitConfig = SplitConfig(),
    *,
    template: ChatTemplate = ChatTemplate(),
    tokenizer: Tokenizer = WhitespaceTokenizer(),
    stored: bool = True,
) -> DataFrame:
    """Load and cap the sources, split, then render, tokenise and mask.

    The split comes first, so rows skipped later shrink either side. It looks at
    the mixture several times (ids only); ``stored`` writes it down once so that
    sources and caps are not worked out again each time.
    """
    mixture = load_mixture(spark, specs)
    if stored:
        mixture = store(mixture, "mixture")
    return build_examples(exact_split(mixture, ["source", "id"], split), cfg, template, tokenizer)
