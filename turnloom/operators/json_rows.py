"""JSON objects whose keys say what a row is: missing, null and mistyped are three things.

A schema reads a missing key and a null one alike, and a value of another type as
null too. Here every line is parsed once to a VARIANT, which keeps all three
apart. Lines that are no JSON, repeat a key or exceed the size of a VARIANT are
not parsed; they stay as rows without a layout.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions.messages import MESSAGES_TYPE, conversation_facts, from_instruction, from_prompt_completion, map_role, message
from turnloom.operators.examples import computed_once

MISSING, NULL, MISTYPED, GIVEN = "missing", "null", "mistyped", "given"
TEXT, LIST, WHOLE_NUMBER, NUMBER = "text", "list", "whole number", "number"
# The kind a key must be of, by the beginning of its type in a VARIANT.
_TYPES = {TEXT: ("STRING",), LIST: ("ARRAY",), WHOLE_NUMBER: ("BIGINT", "INT", "SMALLINT", "TINYINT"),
          NUMBER: ("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT", "DECIMAL")}

ROW_KEYS = {"messages": LIST, "conversations": LIST, "prompt": TEXT, "completion": TEXT, "instruction": TEXT, "input": TEXT, "output": TEXT}


def child(v: Column, key: str) -> Column:
    """The value of a key as a VARIANT; null where the key is missing or the row no object."""
    return F.try_variant_get(v, f"$.{key}", "variant")


def key_state(v: Column, key: str, kind: str) -> Column:
    """Whether a key is missing, null, of another type than ``kind``, or given."""
    value = child(v, key)
    of = F.schema_of_variant(value)
    fits = F.lit(False)
    for name in _TYPES[kind]:
        fits = fits | of.startswith(name)
    return F.when(value.isNull(), MISSING).when(F.is_variant_null(value), NULL).when(fits, GIVEN).otherwise(MISTYPED)


def typed(v: Column, key: str, kind: str, state: Column) -> Column:
    """The value of a key that is given; null otherwise."""
    target = {TEXT: "string", LIST: "array<variant>", WHOLE_NUMBER: "bigint", NUMBER: "double"}[kind]
    return F.when(state == GIVEN, F.try_variant_get(v, f"$.{key}", target))


def parse_objects(lines: DataFrame, keys: Mapping[str, str], column: str = "value", parsed: str = "parsed", states: str = "key_states") -> DataFrame:
    """Add ``parsed`` (whether a line is a JSON object), ``states`` (a struct with the state of each key) and ``__v``, the VARIANT."""
    df = lines.withColumn("__v", F.try_parse_json(F.col(column)))
    is_object = F.coalesce(F.schema_of_variant("__v").startswith("OBJECT"), F.lit(False))
    df = computed_once(df.withColumn(parsed, is_object), ["__v", parsed])
    state = F.struct(*[key_state(F.col("__v"), k, kind).alias(k) for k, kind in keys.items()])
    return computed_once(df.withColumn(states, state), [states])


def _turn_text(turn: Column, *keys: str) -> Column:
    """The first of the keys that is there, whatever it holds; no text counts as null, no key as empty."""
    out = F.lit("")
    for key in reversed(keys):
        value = child(turn, key)
        text = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(turn, f"$.{key}", "string"))
        out = F.when(value.isNotNull(), text).otherwise(out)
    return out


def normalise_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Add ``messages, format, facts, parsed, key_states`` to lines of JSON.

    A list layout needs a list under its key, a flat one only the keys: messages,
    then conversations, then prompt with completion, then instruction. A flat key
    that is null or no text gives a null content, which is malformed and later a
    render error; only a missing ``output`` counts as empty, and an ``input``
    that is missing, null or empty counts as none. In a list of turns the same
    holds for each turn.
    """
    df = parse_objects(lines, ROW_KEYS, column)
    v, state = F.col("__v"), F.col("key_states")
    there = lambda key: state[key] != MISSING
    value = {k: typed(v, k, kind, state[k]) for k, kind in ROW_KEYS.items()}
    own = F.transform(value["messages"], lambda m: message(_turn_text(m, "role"), _turn_text(m, "content")))
    shared = F.transform(value["conversations"], lambda m: message(map_role(_turn_text(m, "from", "role")), _turn_text(m, "value", "content")))
    output = F.when(there("output"), value["output"]).otherwise("")
    layouts = [
        ("messages", state["messages"] == GIVEN, own),
        ("conversations", state["conversations"] == GIVEN, shared),
        ("prompt", there("prompt") & there("completion"), from_prompt_completion(value["prompt"], value["completion"])),
        ("instruction", there("instruction"), from_instruction(value["instruction"], value["input"], output)),
    ]
    chosen, made = F.lit(None).cast("string"), F.lit(None).cast(MESSAGES_TYPE)
    for name, fits, messages in reversed(layouts):
        chosen, made = F.when(fits, name).otherwise(chosen), F.when(fits, messages.cast(MESSAGES_TYPE)).otherwise(made)
    df = computed_once(df.withColumns({"format": chosen, "messages": made}), ["format", "messages"])
    return df.withColumn("facts", conversation_facts(F.col("messages"))).drop("__v")
