"""Turn tables straight to examples, by token budget.

A whole conversation is never put together. Turns are tokenised where they are
read, numbers and ids meet in blocks of turns, and a block hands on the ids that
fit the budget. Prefix sums over the blocks' token counts say which blocks reach
into the first ``max_seq_len`` tokens, and the prompt's length comes from the
counts alone. So a conversation of any number of turns takes no task that holds
more than one block of turns and one budget of tokens.

This needs tokens that end where messages end, which is checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnloom.config import PrepConfig
from turnloom.functions.messages import needs_system
from turnloom.functions.template import ChatTemplate
from turnloom.functions.tokens import WhitespaceTokenizer, prefix_labels, suffix_labels
from turnloom.operators.examples import finish_examples, message_skip_reason
from turnloom.sources.turns import assemble_turns, number_turns

TURNS_PER_BLOCK = 12    # bits


def _blocks(turns: DataFrame, key: str, text: Column, max_len: int, busy: bool, bits: int, tokenizer: WhitespaceTokenizer) -> DataFrame:
    """``key, block, n, before, answer, blank, ids`` of every block of turns.

    ``n`` counts its tokens, ``before`` those before its last answer, ``answer``
    those of it, and ``blank`` says that it is empty, all null without one; ``ids`` are the first
    ``max_len`` of the block. ``busy`` says that every turn has a token, so that
    turns from number ``max_len`` on move no ids.
    """
    is_answer = F.col("__role").eqNullSafe("assistant")
    rows = turns.select(F.col(key), F.col("__turn"), is_answer.alias("__answer"), (F.col("__content") == "").alias("__blank"), text.alias("__text"))
    rows = tokenizer.encode(rows, "__text", "__ids", max_len, {"__n": "__text"})
    within = F.col("__turn") < max_len if busy else F.lit(True)
    turn = F.struct(
        F.col("__turn").alias("turn"), F.coalesce("__n", F.lit(0)).cast("bigint").alias("n"), F.col("__answer").alias("answer"),
        F.col("__blank").alias("blank"), F.when(within, F.col("__ids")).alias("ids"),
    )
    gathered = rows.groupBy(key, F.shiftright("__turn", bits).alias("block")).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    zero, nothing = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    start = F.struct(zero.alias("n"), nothing.alias("before"), nothing.alias("answer"), F.lit(None).cast("boolean").alias("blank"), F.lit(0).alias("used"))

    def count(acc: Column, t: Column) -> Column:
        return F.struct(
            (acc["n"] + t["n"]).alias("n"),
            F.when(t["answer"], acc["n"]).otherwise(acc["before"]).alias("before"),
            F.when(t["answer"], t["n"]).otherwise(acc["answer"]).alias("answer"),
            F.when(t["answer"], t["blank"]).otherwise(acc["blank"]).alias("blank"),
            F.when(acc["n"] < max_len, acc["used"] + 1).otherwise(acc["used"]).alias("used"),    # turns that begin within the budget
        )

    counted = gathered.select(key, "block", "t", F.inline(F.array(F.aggregate("t", start, count))))
    ids = F.flatten(F.transform(F.slice("t", F.lit(1), F.col("used")), lambda t: F.coalesce(t["ids"], F.array().cast("array<bigint>"))))
    return counted.select(key, "block", "n", "before", "answer", "blank", F.slice(ids, 1, max_len).alias("ids"))


def _gathered(turns: DataFrame, key: str, text: Column, max_len: int, busy: bool, bits: int, tokenizer: WhitespaceTokenizer) -> DataFrame:
    """``key, __ids, __before, __answer, __blank``: the first ``max_len`` ids, and what is known of the last answer."""
    blocks = _blocks(turns, key, text, max_len, busy, bits, tokenizer)
    earlier = W.partitionBy(key).orderBy("block").rowsBetween(W.unboundedPreceding, -1)      # one row per block, not per turn
    placed = blocks.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    room = F.greatest(F.lit(max_len) - F.col("start"), F.lit(0)).cast("int")
    part = F.when((room > 0) & (F.array_size("ids") > 0), F.struct("block", F.slice("ids", F.lit(1), room).alias("ids")))
    answered = F.when(F.col("before").isNotNull(), F.col("block"))
    return placed.groupBy(key).agg(
        F.array_sort(F.collect_list(part)).alias("__parts"),     # null, so not gathered, beyond the budget
        F.max_by(F.struct((F.col("start") + F.col("before")).alias("before"), "answer", "blank"), answered).alias("__last"),
    ).select(
        key, F.flatten(F.transform("__parts", lambda p: p["ids"])).alias("__ids"),
        F.col("__last.before").alias("__before"), F.col("__last.answer").alias("__answer"), F.col("__last.blank").alias("__blank"),
    )


def _prepared(turns: DataFrame, key: str, order: str, role: str, content: str, dense: bool) -> tuple[DataFrame, DataFrame]:
    """Turns under working names, numbered 0, 1, 2, ..., and the facts of each conversation."""
    if not dense:
        turns, order = number_turns(turns, key, order, "__number"), "__number"
    facts = assemble_turns(turns, key=key, order=order, role=role, content=content, dense=True).select(key, "facts")
    named = turns.select(F.col(key), F.col(order).cast("bigint").alias("__turn"), F.col(role).alias("__role"), F.col(content).alias("__content"))
    return named, facts


def _with_reason(df: DataFrame, cfg: PrepConfig, template: ChatTemplate | None) -> DataFrame:
    """``skip_reason`` from the facts; in a turn table every conversation has a message."""
    reason = message_skip_reason(PrepConfig(require_roles=cfg.require_roles), template)
    if cfg.reject_empty_target:
        reason = F.coalesce(reason, F.when(F.col("__blank"), F.lit("empty_target")))
    return df.withColumn("messages", F.array()).withColumn("skip_reason", reason).drop("messages", "__blank")


def _with_facts(facts: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Both sides of every conversation, that of a null key too."""
    return facts.join(found.withColumnRenamed(key, "__key"), F.col(key).eqNullSafe(F.col("__key"))).drop("__key")


def build_turn_examples(
    turns: DataFrame,
    cfg: PrepConfig = PrepConfig(),
    template: ChatTemplate = ChatTemplate(),
    tokenizer: WhitespaceTokenizer = WhitespaceTokenizer(),
    *,
    key: str = "conv_id",
    order: str = "turn",
    role: str = "role",
    content: str = "text",
    dense: bool = False,
    turns_per_block: int = TURNS_PER_BLOCK,
) -> DataFrame:
    """What ``build_examples(assemble_turns(turns))`` gives, without the messages.

    ``key, facts, skip_reason, n_tokens, prompt_len, n_unmasked, input_ids,
    labels, attention_mask`` per conversation. ``turns_per_block`` is a number of
    bits; ``dense`` means what it does in ``assemble_turns``. The template must
    begin or end every message with a blank, so that no token goes over a border.
    """
    if not template.parts_messages():
        raise ValueError("the template lets tokens go over the border of two messages")
    named, facts = _prepared(turns, key, order, role, content, dense)
    message = F.struct(F.col("__role").alias("role"), F.col("__content").alias("content"))
    max_len = cfg.max_seq_len
    found = _gathered(named, key, template.render_message(message), max_len, template.has_token(), turns_per_block, tokenizer)
    df = _with_reason(_with_facts(facts, found, key), cfg, template)
    system = template.render_message(F.struct(F.lit("system").alias("role"), F.lit(cfg.system_prompt).alias("content")))
    added = needs_system(F.col("facts")["has_system"], cfg.system_prompt)
    lead, n_lead = F.when(added, tokenizer.ids(system)).otherwise(F.array().cast("array<bigint>")), F.when(added, tokenizer.count(system)).otherwise(0)
    n_generation = tokenizer.count(F.lit(template.generation))
    limit = F.lit(max_len).cast("bigint")
    good = F.col("skip_reason").isNull()
    df = df.withColumns({
        "input_ids": F.when(good, F.slice(F.concat(lead, F.col("__ids")), 1, max_len)),
        "prompt_len": F.when(good, F.least(n_lead + F.col("__before") + n_generation, limit)),
        "__end": F.when(good, F.least(n_lead + F.col("__before") + F.col("__answer"), limit)),
    })
    df = df.withColumn("n_tokens", F.array_size("input_ids").cast("bigint"))
    labels = prefix_labels(F.col("input_ids"), F.col("prompt_len"), F.col("__end") if cfg.trailing == "mask" else None)
    return finish_examples(df, labels, F.col("prompt_len") >= F.col("n_tokens")).drop("__ids", "__before", "__answer", "__end")


def build_turn_plain_examples(
    turns: DataFrame,
    cfg: PrepConfig = PrepConfig(),
    tokenizer: WhitespaceTokenizer = WhitespaceTokenizer(),
    *,
    key: str = "conv_id",
    order: str = "turn",
    role: str = "role",
    content: str = "text",
    dense: bool = False,
    turns_per_block: int = TURNS_PER_BLOCK,
) -> DataFrame:
    """What ``build_plain_examples(assemble_turns(turns))`` gives, without the messages."""
    named, facts = _prepared(turns, key, order, role, content, dense)
    line = F.concat(F.col("__role"), F.lit(": "), F.col("__content"))
    max_len = cfg.max_seq_len
    found = _gathered(named, key, line, max_len, True, turns_per_block, tokenizer)
    df = _with_reason(_with_facts(facts, found, key), cfg, None)
    added = needs_system(F.col("facts")["has_system"], cfg.system_prompt)
    lead = F.when(added, tokenizer.ids(F.lit(f"system: {cfg.system_prompt}"))).otherwise(F.array().cast("array<bigint>"))
    good = F.col("skip_reason").isNull()
    df = df.withColumns({
        "input_ids": F.when(good, F.slice(F.concat(lead, F.col("__ids")), 1, max_len)),
        "__answer": F.when(good, F.least(F.col("__answer"), F.lit(max_len).cast("bigint"))),
    })
    df = df.withColumn("n_tokens", F.array_size("input_ids").cast("bigint"))
    return finish_examples(df, suffix_labels(F.col("input_ids"), F.col("__answer")), F.lit(False)).drop("__ids", "__before", "__answer")
