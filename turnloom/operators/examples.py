"""Conversations to tokenised, label-masked examples.

Rows are never dropped on the way. ``skip_reason`` says why a row gives no
example, in a fixed order of precedence, and stays null for the good ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.config import PrepConfig
from turnloom.functions.messages import (
    conversation_facts,
    has_facts,
    inject_system,
    is_eligible,
    needs_system,
)
from turnloom.functions.template import ChatTemplate, plain_answer, render_plain
from turnloom.functions.tokens import (
    Tokenizer,
    WhitespaceTokenizer,
    attention_mask,
    count_unmasked,
    prefix_labels,
    suffix_labels,
)

SKIP_REASONS = (
    "unrecognised", "missing_role", "empty", "no_assistant", "render_error", "empty_target", "too_short",
)


def with_facts(df: DataFrame) -> DataFrame:
    """Add ``facts`` unless the source already measured the whole conversation."""
    if has_facts(df):
        return df
    return df.withColumn("facts", conversation_facts(F.col("messages")))


def message_skip_reason(cfg: PrepConfig, template: ChatTemplate | None) -> Column:
    """Reason found from the messages alone, before any rendering."""
    facts = F.col("facts")
    reason = F.when(F.col("messages").isNull(), "unrecognised")
    if cfg.require_roles:
        reason = reason.when(~is_eligible(facts), "missing_role")
    reason = reason.when(facts["n_messages"] == 0, "empty")
    reason = reason.when(~facts["has_assistant"], "no_assistant")
    rejected = template.rejects(facts) if template else facts["malformed"]
    reason = reason.when(rejected, "render_error")
    if cfg.reject_empty_target:
        answer = F.get("messages", facts["last_assistant"].cast("int"))["content"]
        reason = reason.when(answer == "", "empty_target")
    return reason


def keep_eligible(df: DataFrame) -> DataFrame:
    """Only rows with a user and an assistant message, so recognised ones."""
    df = with_facts(df)
    return df.filter(is_eligible(F.col("facts")))


def prepare_messages(df: DataFrame, cfg: PrepConfig, template: ChatTemplate | None) -> DataFrame:
    """Add ``skip_reason``, the prompted messages and the answer's position."""
    df = with_facts(df).withColumn("skip_reason", message_skip_reason(cfg, template))
    facts, prompt = F.col("facts"), cfg.system_prompt
    shift = F.when(needs_system(facts["has_system"], prompt), 1).otherwise(0)
    return df.withColumns(
        {
            "formatted": inject_system(F.col("messages"), prompt, facts["has_system"]),
            "answer_at": facts["last_assistant"] + shift,
        }
    )


def render_texts(
    df: DataFrame, cfg: PrepConfig = PrepConfig(), template: ChatTemplate = ChatTemplate()
) -> DataFrame:
    """Add ``full_text`` and ``prompt_text`` (and ``answer_text`` when masking
    what follows the answer). Null on skipped rows."""
    df = prepare_messages(df, cfg, template)
    good = F.col("skip_reason").isNull()
    m, at = F.col("formatted"), F.col("answer_at")
    texts = {
        "full_text": F.when(good, template.render(m)),
        "prompt_text": F.when(good, template.render_prompt(m, at)),
    }
    if cfg.trailing == "mask":
        texts["answer_text"] = F.when(good, template.render_upto(m, at))
    return df.withColumns(texts).drop("formatted", "answer_at")


def computed_once(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same rows, with these columns behind a one-row ``inline``.

    A filter is otherwise pushed below the columns it tests by repeating their
    whole derivation, here from rendering to label counting. It stops at the
    generator, so each text is tokenised once per row.
    """
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*columns))))


def finish_examples(df: DataFrame, labels: Column, too_short: Column) -> DataFrame:
    """Labels, counts and the last skip reason of tokenised rows; what a skipped row would hold is null."""
    df = df.withColumn("labels", labels).withColumn("n_unmasked", count_unmasked(F.col("labels")))
    # A length that is not known is no length to mask by.
    failed = F.coalesce(too_short | (F.col("n_unmasked") == 0), F.lit(True))
    df = df.withColumn(
        "skip_reason", F.coalesce("skip_reason", F.when(failed, F.lit("too_short")))
    )
    made = ("skip_reason", "n_tokens", "prompt_len", "n_unmasked", "input_ids", "labels")
    df = computed_once(df, [c for c in made if c in df.columns])
    good = F.col("skip_reason").isNull()
    return df.withColumns(
        {
            "input_ids": F.when(good, F.col("input_ids")),
            "labels": F.when(good, F.col("labels")),
            "attention_mask": F.when(good, attention_mask(F.col("input_ids"))),
            "n_unmasked": F.when(good, F.col("n_unmasked")),
        }
    )


def build_examples(
    df: DataFrame,
    cfg: PrepConfig = PrepConfig(),
    template: ChatTemplate = ChatTemplate(),
    tokenizer: Tokenizer = WhitespaceTokenizer(),
) -> DataFrame:
    """Add ``input_ids, labels, attention_mask``, their counts and ``skip_reason``.

    The prompt is everything before the last assistant message. Only its length
    is used: that many leading tokens are ignored, whatever they are. With
    ``cfg.check_prefix``, ``prefix_ok`` says whether they are the prompt's own
    ids, also of rows skipped for their length; it is null where nothing is rendered.
    """
    df = render_texts(df, cfg, template)
    counts = {"prompt_len": "prompt_text"}
    if cfg.trailing == "mask":
        counts["answer_end"] = "answer_text"
    df = tokenizer.encode(df, "full_text", "input_ids", cfg.max_seq_len, counts)
    if cfg.check_prefix:
        # The mask goes by the prompt's length; a token over the border makes that length wrong.
        df = tokenizer.encode(df, "prompt_text", "__prompt_ids", cfg.max_seq_len, {})
        begin = F.slice("input_ids", F.lit(1), F.array_size("__prompt_ids"))
        df = df.withColumn("prefix_ok", begin == F.col("__prompt_ids")).drop("__prompt_ids")
    df = df.drop("full_text", "prompt_text", "answer_text")
    df = df.withColumn("n_tokens", F.array_size("input_ids").cast("bigint"))
    end = F.col("answer_end") if cfg.trailing == "mask" else None
    labels = prefix_labels(F.col("input_ids"), F.col("prompt_len"), end)
    return finish_examples(df, labels, F.col("prompt_len") >= F.col("n_tokens")).drop("answer_end")


def build_plain_examples(
    df: DataFrame,
    cfg: PrepConfig = PrepConfig(),
    tokenizer: Tokenizer = WhitespaceTokenizer(),
) -> DataFrame:
    """Examples for a tokenizer without a chat template.

    Tokens are those of ``role: content`` lines; the label mask keeps as many
    trailing tokens as the last assistant line has on its own.
    """
    df = prepare_messages(df, cfg, None)
    good = F.col("skip_reason").isNull()
    m, at = F.col("formatted"), F.col("answer_at")
    df = df.withColumns(
        {
            "full_text": F.when(good, render_plain(m)),
            "answer_text": F.when(good, plain_answer(m, at)),
        }
    ).drop("formatted", "answer_at")
    counts = {"answer_len": "answer_text"}
    df = tokenizer.encode(df, "full_text", "input_ids", cfg.max_seq_len, counts)
    df = df.drop("full_text", "answer_text")
    df = df.withColumn("n_tokens", F.array_size("input_ids").cast("bigint"))
    labels = suffix_labels(F.col("input_ids"), F.col("answer_len"))
    return finish_examples(df, labels, F.lit(False)).drop("answer_len")


def kept(examples: DataFrame) -> DataFrame:
    return examples.filter(F.col("skip_reason").isNull())
