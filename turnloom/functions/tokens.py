"""Tokenizers and label masks.

A tokenizer turns named text columns of a DataFrame into ids and counts. The
default one stays in the JVM.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.config import IGNORE_INDEX

TOKEN_PATTERN = r"\S+"


class Tokenizer(Protocol):
    def encode(
        self, df: DataFrame, text: str, ids: str, max_len: int | None, counts: dict[str, str]
    ) -> DataFrame:
        """Add ``ids`` for column ``text`` and, per ``counts`` entry (new column
        -> text column), the number of tokens; all cut at ``max_len``."""


def token_id(token: Column) -> Column:
    """Stable 28-bit id of a token."""
    return F.conv(F.substring(F.md5(token), 1, 7), 16, 10).cast("bigint")


class WhitespaceTokenizer:
    """Runs of non-blank characters, ids from a hash. Built-in functions only."""

    def count(self, text: Column, max_len: int | None = None) -> Column:
        """Null for a null text."""
        n = F.regexp_count(text, F.lit(TOKEN_PATTERN)).cast("bigint")
        return n if max_len is None else F.when(text.isNotNull(), F.least(n, F.lit(max_len).cast("bigint")))

    def ids(self, text: Column, max_len: int | None = None) -> Column:
        tokens = F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))
        if max_len is not None:
            tokens = F.slice(tokens, 1, max_len)
        return F.transform(tokens, token_id)

    def encode(
        self, df: DataFrame, text: str, ids: str, max_len: int | None, counts: dict[str, str]
    ) -> DataFrame:
        new = {ids: self.ids(F.col(text), max_len)}
        new |= {name: self.count(F.col(source), max_len) for name, source in counts.items()}
        return df.withColumns(new)


def prefix_labels(ids: Column, prompt_len: Column, answer_end: Column | None = None) -> Column:
    """Ids with the prompt (and, if given, what follows the answer) ignored."""

    def label(token: Column, i: Column) -> Column:
        masked = i < prompt_len
        if answer_end is not None:
            masked = masked | (i >= answer_end)
        return F.when(masked, F.lit(IGNORE_INDEX).cast("bigint")).otherwise(token)

    return F.transform(ids, label)


def suffix_labels(ids: Column, answer_len: Column) -> Column:
    """Ids with all but the last ``answer_len`` tokens ignored; null if that length is."""
    start = F.greatest(F.array_size(ids) - answer_len, F.lit(0))
    return F.when(answer_len.isNotNull(), prefix_labels(ids, start))


def attention_mask(ids: Column) -> Column:
    return F.array_repeat(F.lit(1).cast("bigint"), F.array_size(ids))


def count_unmasked(labels: Column) -> Column:
    return F.array_size(F.filter(labels, lambda x: x != IGNORE_INDEX)).cast("bigint")


def pad_to(values: Column, length: Column, fill: int) -> Column:
    missing = F.greatest(length - F.array_size(values), F.lit(0)).cast("int")
    return F.concat(values, F.array_repeat(F.lit(fill).cast("bigint"), missing))
