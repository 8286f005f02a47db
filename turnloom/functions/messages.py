"""Column functions on ``ARRAY<STRUCT<role, content>>``.

Role tests use null-safe equality, so a null role is simply "not that role".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGE_TYPE = T.StructType(
    [T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]
)
MESSAGES_TYPE = T.ArrayType(MESSAGE_TYPE)

# Speaker names of turn-style corpora and the role each one means.
ROLE_MAP = {
    "human": "user",
    "user": "user",
    "gpt": "assistant",
    "assistant": "assistant",
    "system": "system",
    "tool": "tool",
}


def message(role: Column | str, content: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), content.alias("content"))


def is_role(element: Column, role: str) -> Column:
    return element["role"].eqNullSafe(role)


def has_role(messages: Column, role: str) -> Column:
    return F.exists(messages, lambda m: is_role(m, role))


def map_role(role: Column) -> Column:
    """Known speaker names become roles; anything else passes through."""
    pairs = [F.lit(v) for kv in ROLE_MAP.items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), role), role)


def last_assistant_index(messages: Column) -> Column:
    """0-based position of the last assistant message, -1 if there is none."""
    hits = F.transform(
        messages, lambda m, i: F.when(is_role(m, "assistant"), i).otherwise(F.lit(-1))
    )
    return F.coalesce(F.array_max(hits), F.lit(-1)).cast("bigint")


def is_malformed(messages: Column) -> Column:
    """A null message, role or content cannot be rendered."""
    return F.exists(
        messages, lambda m: m.isNull() | m["role"].isNull() | m["content"].isNull()
    )


def alternates(messages: Column) -> Column:
    """After one optional leading system message: user, assistant, user, ..."""
    lead = F.when(is_role(F.get(messages, F.lit(0)), "system"), F.lit(1)).otherwise(F.lit(0))

    def in_turn(m: Column, i: Column) -> Column:
        expected = F.when((i - lead) % 2 == 0, F.lit("user")).otherwise(F.lit("assistant"))
        return (i < lead) | m["role"].eqNullSafe(expected)

    return F.forall(F.transform(messages, in_turn), lambda ok: ok)


def conversation_facts(messages: Column) -> Column:
    """What the later filters need to know about one whole conversation."""
    return F.struct(
        F.when(messages.isNull(), F.lit(0)).otherwise(F.array_size(messages)).cast("bigint").alias("n_messages"),
        F.coalesce(has_role(messages, "user"), F.lit(False)).alias("has_user"),
        F.coalesce(has_role(messages, "assistant"), F.lit(False)).alias("has_assistant"),
        F.coalesce(has_role(messages, "system"), F.lit(False)).alias("has_system"),
        last_assistant_index(messages).alias("last_assistant"),
        F.coalesce(is_malformed(messages), F.lit(False)).alias("malformed"),
        F.coalesce(alternates(messages), F.lit(True)).alias("alternates"),
    )


_FACTS = ("n_messages", "has_user", "has_assistant", "has_system", "last_assistant", "malformed", "alternates")


def has_facts(df: DataFrame) -> bool:
    """Whether a table brings facts measured here, and not just a column of that name."""
    kind = df.schema["facts"].dataType if "facts" in df.columns else None
    return isinstance(kind, T.StructType) and tuple(kind.fieldNames()) == _FACTS


def pair_facts(has_null_text: Column) -> Column:
    """Facts of one user message followed by one assistant message."""
    return F.struct(
        F.lit(2).cast("bigint").alias("n_messages"),
        F.lit(True).alias("has_user"),
        F.lit(True).alias("has_assistant"),
        F.lit(False).alias("has_system"),
        F.lit(1).cast("bigint").alias("last_assistant"),
        has_null_text.alias("malformed"),
        F.lit(True).alias("alternates"),
    )


def is_eligible(facts: Column) -> Column:
    """At least one user and one assistant message; empty content passes."""
    return facts["has_user"] & facts["has_assistant"]


def prepend_system(messages: Column, prompt: Column | str) -> Column:
    """Put a system message in front whatever the conversation already holds."""
    prompt = F.lit(prompt) if isinstance(prompt, str) else prompt
    return F.concat(F.array(message("system", prompt)), messages)


def needs_system(has_system: Column, prompt: Column | str) -> Column:
    prompt = F.lit(prompt) if isinstance(prompt, str) else prompt
    return ~has_system & (F.coalesce(prompt, F.lit("")) != "")


def inject_system(
    messages: Column, prompt: Column | str, has_system: Column | None = None
) -> Column:
    """Prepend the prompt unless it is empty or a system message is anywhere."""
    has_system = has_role(messages, "system") if has_system is None else has_system
    return F.when(
        needs_system(has_system, prompt), prepend_system(messages, prompt)
    ).otherwise(messages)


def select_prompt(thinking: Column | bool, thinking_prompt: str, fast_prompt: str) -> Column:
    """System prompt by flag, either one flag for the job or one per row."""
    if isinstance(thinking, bool):
        return F.lit(thinking_prompt if thinking else fast_prompt)
    return F.when(thinking, F.lit(thinking_prompt)).otherwise(F.lit(fast_prompt))


def from_sharegpt(turns: Column, fields: list[str]) -> Column:
    """``from``/``value`` turns, falling back to ``role``/``content``.

    A field that is null in a row counts as missing there.
    """

    def pick(turn: Column, names: tuple[str, ...]) -> Column:
        return F.coalesce(*[turn[n] for n in names if n in fields], F.lit(""))

    return F.transform(
        turns,
        lambda t: message(map_role(pick(t, ("from", "role"))), pick(t, ("value", "content"))),
    )


def from_prompt_completion(prompt: Column, completion: Column) -> Column:
    return F.array(message("user", prompt), message("assistant", completion))


def from_instruction(
    instruction: Column, extra: Column | None = None, output: Column | None = None
) -> Column:
    """Instruction, then a blank line and the extra input where there is one."""
    output = F.lit("") if output is None else output
    ask = instruction
    if extra is not None:
        ask = F.when(
            F.coalesce(extra, F.lit("")) != "", F.concat(instruction, F.lit("\n\n"), extra)
        ).otherwise(instruction)
    return F.array(message("user", ask), message("assistant", output))


def evaluation_pair(instruction: Column, output: Column) -> Column:
    """The pair that is scored: no extra input and no system prompt."""
    return F.array(message("user", instruction), message("assistant", output))
