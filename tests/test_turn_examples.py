"""Examples by token budget against the plain path, and a conversation no task could hold."""

import pytest
from pyspark.sql import functions as F

from turnloom.config import PrepConfig
from turnloom.functions.template import ChatTemplate
from turnloom.operators.examples import build_examples, build_plain_examples
from turnloom.operators.turn_examples import build_turn_examples, build_turn_plain_examples
from turnloom.sources.turns import assemble_turns

TURNS = [
    (1, 0, "user", "one two"), (1, 1, "assistant", "three"), (1, 2, "user", "four five six"), (1, 3, "assistant", "seven eight"), (1, 4, "user", "nine"),
    (2, 0, "system", "be brief"), (2, 1, "user", "a"), (2, 2, "assistant", "b c d"),
    (3, 0, "user", "no answer"),
    (4, 0, "user", None), (4, 1, "assistant", "x"),
    (5, 0, "user", "q"), (5, 1, "assistant", ""),
    (6, 0, "assistant", "starts"), (6, 1, None, "who"), (6, 2, "user", "u"),
    (7, 0, "user", "word " * 40), (7, 1, "assistant", "late"),
    (8, 0, "user", "  "), (8, 1, "assistant", "   spaced   out \n"), (8, 2, "tool", ""),
    *[(9, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(50)],
    (None, 0, "user", "null"), (None, 1, "assistant", "key"),
]
COLUMNS = ["conv_id", "skip_reason", "n_tokens", "prompt_len", "n_unmasked", "input_ids", "labels", "attention_mask"]


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(c) for c in ("block", "n", "ids", "facts")}).repartition(4)


def rows(df):
    names = [c for c in COLUMNS if c in df.columns]
    return sorted((tuple(r) for r in df.select(names).collect()), key=lambda r: (r[0] is not None, r[0]))


@pytest.mark.parametrize("bits", [0, 1, 3, 12])
@pytest.mark.parametrize("cfg", [
    PrepConfig(max_seq_len=1024), PrepConfig(max_seq_len=16), PrepConfig(max_seq_len=1), PrepConfig(max_seq_len=60, trailing="mask"),
    PrepConfig(max_seq_len=25, fast_prompt="", require_roles=False, reject_empty_target=True),
])
def test_equals_the_plain_path(turns, cfg, bits):
    slim = turns.select("conv_id", "turn", "role", "text")
    assert rows(build_turn_examples(turns, cfg, dense=True, turns_per_block=bits)) == rows(build_examples(assemble_turns(slim, dense=True), cfg))


def test_plain_layout_gaps_and_other_templates(turns):
    slim = turns.select("conv_id", "turn", "role", "text")
    cfg = PrepConfig(max_seq_len=20)
    for bits in (0, 12):
        assert rows(build_turn_plain_examples(slim, cfg, dense=True, turns_per_block=bits)) == rows(build_plain_examples(assemble_turns(slim, dense=True), cfg))
    gaps = slim.withColumn("turn", F.col("turn") * 7 - 3)
    template = ChatTemplate(prefix=" [{role}] ", suffix="</s>", generation=" go:", markers={"user": ("\n>", "")}, strict_alternation=True)
    assert template.parts_messages() and not ChatTemplate(prefix="\n", suffix="").has_token()
    assert rows(build_turn_examples(gaps, cfg, template, turns_per_block=1)) == rows(build_examples(assemble_turns(gaps), cfg, template))
    with pytest.raises(ValueError, match="border"):
        build_turn_examples(slim, cfg, ChatTemplate(suffix="</s>"))


def test_nothing(turns):
    assert rows(build_turn_examples(turns.where("conv_id = 99"))) == []


def test_one_conversation_of_very_many_turns(spark):
    """Almost every turn lies behind the budget; the answer is the last but one."""
    def turns(n):
        text = F.concat(F.lit("turn "), F.col("id").cast("string"), F.repeat(F.lit(" x"), 20))
        role = F.when(F.col("id") % 2 == 0, "user").otherwise("assistant")
        return spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), text.alias("text"))

    n = 20_000     # all of it within the budget: 24 tokens a turn, and 7 of the system message
    got = build_turn_examples(turns(n), PrepConfig(max_seq_len=1 << 20), dense=True).select("prompt_len", "n_tokens", "skip_reason").first()
    assert tuple(got) == (24 * (n - 1) + 7 + 1, 24 * n + 7, None)
    n = 400_000     # nearly all of it behind the budget
    got = build_turn_examples(turns(n), PrepConfig(max_seq_len=512), dense=True).first()
    assert got.skip_reason == "too_short" and got.facts["n_messages"] == n and got.prompt_len == 512
