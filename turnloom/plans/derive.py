"""Inputs in the layouts the operators take, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.config import EVAL_EVERY, ScheduleConfig
from turnloom.functions.schedule import learning_rate, scaled_rate
from turnloom.functions.tokens import WhitespaceTokenizer
from turnloom.operators.chatlog import CHAT, CHAT_STREAM, GENERATE, chunk_line, request_body
from turnloom.operators.ordered import by_column, global_index, shuffled
from turnloom.operators.runlog import every_nth_step
from turnloom.plans.registry import Tables
from turnloom.sources.turns import assemble_turns

MODELS = ("base", "tuned")


def conversations(t: Tables) -> DataFrame:
    return assemble_turns(t.conversations, dense=True)


def head_and_rest(text: Column) -> tuple[Column, Column]:
    """First line of a text, and what follows it."""
    head = F.substring_index(text, "\n", 1)
    return head, F.substr(text, F.length(head) + 2)


def prompt_rows(docs: DataFrame) -> DataFrame:
    """doc_id, source, prompt, completion."""
    prompt, completion = head_and_rest(F.col("text"))
    return docs.select("doc_id", "source", prompt.alias("prompt"), completion.alias("completion"))


def instruction_rows(docs: DataFrame) -> DataFrame:
    """doc_id, source, instruction, input (blank for every third id), output."""
    instruction, rest = head_and_rest(F.col("text"))
    extra, output = head_and_rest(rest)
    return docs.select(
        "doc_id",
        "source",
        instruction.alias("instruction"),
        F.when(F.col("doc_id") % 3 == 0, "").otherwise(extra).alias("input"),
        output.alias("output"),
    )


def both_layouts(docs: DataFrame) -> DataFrame:
    """doc_id with the columns of prompt rows and of instruction rows, from one row each."""
    prompt, rest = head_and_rest(F.col("text"))
    extra, output = head_and_rest(rest)
    return docs.select(
        "doc_id", prompt.alias("prompt"), rest.alias("completion"), prompt.alias("instruction"),
        F.when(F.col("doc_id") % 3 == 0, "").otherwise(extra).alias("input"), output.alias("output"),
    )


def sharegpt_rows(t: Tables) -> DataFrame:
    """Turns as from/value in even conversations and role/content in odd ones,
    with ``system`` speakers renamed to one no role map knows."""
    even = F.col("conv_id") % 2 == 0

    def turn(m: Column) -> Column:
        speaker = (
            F.when(m["role"] == "user", "human")
            .when(m["role"] == "assistant", "gpt")
            .otherwise("narrator")
        )
        return F.struct(
            F.when(even, speaker).alias("from"),
            F.when(even, m["content"]).alias("value"),
            F.when(~even, m["role"]).alias("role"),
            F.when(~even, m["content"]).alias("content"),
        )

    return conversations(t).select("conv_id", F.transform("messages", turn).alias("conversations"))


def scores(t: Tables, numbered: bool = False) -> DataFrame:
    """model, sample_id, loss, n_tokens; with i, the 1-based shuffled position."""
    docs = t.spread("documents", "doc_id", "text").select(
        F.col("doc_id").alias("sample_id"),
        WhitespaceTokenizer().count(F.col("text")).alias("n_tokens"),
    )
    at = []
    if numbered:
        docs = global_index(docs, shuffled("sample_id"), name="__i")
        at = [(F.col("__i") + 1).alias("i")]
    both = docs.withColumn("model", F.explode(F.array(*[F.lit(m) for m in MODELS])))
    return both.select("model", "sample_id", *at, hashed_loss().alias("loss"), "n_tokens")


def hashed_loss() -> Column:
    """Loss in [0, 4] that depends on model and sample only."""
    digest = F.md5(F.concat_ws(":", "model", F.col("sample_id").cast("string")))
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("bigint") / 65535.0 * 4


def epoch_seconds(name: str) -> Column:
    """Seconds since 1970 of a timestamp column, with or without a time zone."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp")
    return F.timestamp_diff("MICROSECOND", start, F.col(name).cast("timestamp")) / 1e6


def _numbered_events(t: Tables, *columns: str) -> DataFrame:
    """Events with run_id and their 0-based position in the run."""
    events = t.events.select("event_id", (F.col("user_id") % 3).cast("string").alias("run_id"), *columns)
    return global_index(events, by_column("event_id"), by=["run_id"], name="__i")


def run_log(t: Tables) -> DataFrame:
    """Step log: one event is one step; error events logged a rate 5% off."""
    steps = _numbered_events(t, "value", "ts", "event_type")
    step = F.col("__i") + 1
    off = F.when(F.col("event_type") == "error", 1.05).otherwise(1.0)
    rate = learning_rate(F.col("__i"), ScheduleConfig()) * off
    return steps.select(
        "run_id",
        step.alias("step"),
        F.col("value").alias("loss"),
        rate.alias("lr"),
        scaled_rate(rate).alias("muon_lr"),
        (F.col("value") / 10).alias("grad_norm"),
        epoch_seconds("ts").alias("ts"),
    )


def micro_log(t: Tables) -> DataFrame:
    """Micro-batch losses: two events in a row make one step."""
    rows = _numbered_events(t, "value")
    i = F.col("__i")
    return rows.select(
        "run_id",
        (F.floor(i / 2) + 1).cast("bigint").alias("step"),
        F.pmod(i, F.lit(2)).alias("micro"),
        F.col("value").alias("loss"),
    )


def eval_log(steps: DataFrame) -> DataFrame:
    """Validation loss at every evaluation step of a step log."""
    val_loss = F.col("loss") * 0.5 + 1
    return every_nth_step(steps, EVAL_EVERY).select(
        "run_id", "step", val_loss.alias("val_loss"), (F.col("loss") - val_loss).alias("train_val_gap")
    )


def generations(t: Tables) -> DataFrame:
    """doc_id, prompt, response, tokens, latency_s."""
    return prompt_rows(t.spread("documents", "doc_id", "source", "text")).select(
        "doc_id",
        "prompt",
        F.col("completion").alias("response"),
        WhitespaceTokenizer().count(F.col("completion")).alias("tokens"),
        (F.col("doc_id") % 7 + 1).cast("double").alias("latency_s"),
    )


def requests(t: Tables) -> DataFrame:
    """One request per conversation, over the three endpoints in turn."""
    kind, messages = F.col("conv_id") % 3, F.col("messages")
    first = F.get(messages, F.lit(0))["content"]
    body = (
        F.when(kind == 0, F.to_json(F.struct(first.alias("message"))))
        .when(kind == 1, request_body(messages, max_tokens=F.lit(128)))
        .otherwise(request_body(messages, temperature=F.lit(0.25)))
    )
    endpoint = F.when(kind == 0, GENERATE).when(kind == 1, CHAT).otherwise(CHAT_STREAM)
    return conversations(t).select(
        F.col("conv_id").alias("request_id"), endpoint.alias("endpoint"), body.alias("body")
    )


def chunks(t: Tables) -> DataFrame:
    """Assistant turns as streamed chunks, a word each with the blanks after it.

    An empty chunk comes first. Turns of even conversations end with the end
    marker and a stray chunk behind it. A broken line comes before the end in
    every other pair of conversations, and every third one repeats a chunk.
    """
    words = F.regexp_extract_all("text", F.lit(r"\S+\s*"), F.lit(0))
    lines = F.transform(F.concat(F.array(F.lit("")), words), chunk_line)
    end = F.array(F.lit("data: [DONE]"), F.lit('data: {"content":"late"}'))
    broken = F.array(F.lit('data: {"content": "cut o'))
    lines = F.when((F.col("conv_id") % 4).isin(1, 2), F.concat(lines, broken)).otherwise(lines)
    lines = F.when(F.col("conv_id") % 2 == 0, F.concat(lines, end)).otherwise(lines)
    turns = t.spread("conversations", "conv_id", "turn", "role", "text")
    turns = turns.filter(F.col("role") == "assistant")
    sent = turns.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"),
        (F.col("conv_id") % 3 == 0).alias("twice"),
        F.posexplode(lines).alias("seq", "raw"),
    )
    copies = F.when(F.col("twice") & (F.col("seq") == 1), 2).otherwise(1)
    return sent.select(
        "request_id", F.col("seq").cast("bigint").alias("seq"), "raw", F.explode(F.array_repeat(F.lit(0), copies)).alias("__copy")
    ).drop("__copy")


def mixed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, value: JSON lines of all layouts, with missing, null and mistyped keys, and broken ones."""
    head, rest = head_and_rest(F.col("text"))
    nothing = F.lit(None).cast("string")

    def line(**keys: Column) -> Column:
        return F.to_json(F.struct(*[c.alias(n) for n, c in keys.items()]), {"ignoreNullFields": "false"})

    # Turns are written one by one, since those of one list differ in their keys.
    turn = lambda **keys: line(**{k.rstrip("_"): c for k, c in keys.items()})
    listed = lambda *turns: F.concat(F.lit("["), F.concat_ws(",", *turns), F.lit("]"))
    shared = listed(turn(from_=F.lit("human"), value=head), turn(role=F.lit("gpt"), content=rest),
                    F.when(F.col("doc_id") % 16 < 8, turn(from_=nothing, role=F.lit("user"), value=F.lit("x"))))
    own = listed(turn(role=F.lit("user"), content=head), turn(role=F.lit("assistant"), content=rest), F.when(F.col("doc_id") % 3 == 0, turn(role=F.lit("user"), content=F.lit(5))))
    lines = [
        line(prompt=head, completion=rest), line(prompt=head, completion=nothing), line(prompt=head, instruction=head, output=rest),
        line(instruction=head, input=nothing, output=nothing), line(instruction=head, input=F.lit("more")),
        F.concat(F.lit('{"messages":"none","conversations":'), shared, F.lit("}")), F.concat(F.lit('{"prompt":"p","completion":"c","messages":'), own, F.lit("}")),
        F.lit('{"prompt": "cut'),
    ]
    value = lines[-1]
    for i, made in enumerate(lines[:-1]):
        value = F.when(F.col("doc_id") % len(lines) == i, made).otherwise(value)
    return docs.select("doc_id", value.alias("value"))


def keyed_requests(t: Tables) -> DataFrame:
    """One request per conversation whose keys are missing, null, mistyped or given in turn."""
    kind, first = F.col("conv_id") % 6, F.get("messages", F.lit(0))["content"]
    body = (
        F.when(kind == 0, F.to_json(F.struct(first.alias("message"))))
        .when(kind == 1, F.lit('{"message": null, "max_tokens": null}'))
        .when(kind == 2, request_body(F.col("messages"), max_tokens=F.lit(128)))
        .when(kind == 3, F.lit('{"messages": "none", "max_tokens": "12", "temperature": 1}'))
        .when(kind == 4, F.lit('{"messages": [{"role": "user"}, {"content": null, "role": "tool"}], "temperature": null}'))
        .otherwise(F.when(F.col("conv_id") % 12 == 5, "{}").otherwise("[1]"))
    )
    endpoint = F.when(kind < 2, GENERATE).when(F.col("conv_id") % 2 == 0, CHAT).otherwise(CHAT_STREAM)
    return conversations(t).select(F.col("conv_id").alias("request_id"), endpoint.alias("endpoint"), body.alias("body"))
