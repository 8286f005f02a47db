"""Request and response logs of a chat service, back to conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.config import (
    DEFAULT_MAX_TOKENS,
    DEFAULT_SYSTEM_PROMPT,
    DEFAULT_TEMPERATURE,
    STREAM_MAX_TOKENS,
)
from turnloom.functions.messages import MESSAGES_TYPE, message, prepend_system
from turnloom.operators.json_rows import LIST, MISSING, NUMBER, TEXT, WHOLE_NUMBER, parse_objects, typed

# Endpoints and the framing of streamed chunks.
GENERATE, CHAT, CHAT_STREAM = "/generate", "/chat", "/chat/stream"
CHUNK_PREFIX = "data: "
STREAM_END = "[DONE]"

REQUEST_TYPE = T.StructType(
    [
        T.StructField("message", T.StringType()),
        T.StructField("messages", MESSAGES_TYPE),
        T.StructField("max_tokens", T.LongType()),
        T.StructField("temperature", T.DoubleType()),
    ]
)
_CHUNK_TYPE = T.StructType([T.StructField("content", T.StringType())])
_SEQ_PER_BLOCK = 12  # bits: at most 4,096 chunks are gathered at a time


def read_requests(requests: DataFrame, system_prompt: str = DEFAULT_SYSTEM_PROMPT) -> DataFrame:
    """Add ``valid, messages, max_tokens, temperature`` to ``endpoint, body`` rows.

    A field that is missing or null takes its default. The system prompt goes in
    front always, even of a conversation that brings its own. ``valid`` is false
    where the body is not a JSON object.
    """
    body, endpoint = F.col("__r"), F.col("endpoint")
    single = F.array(message("user", F.coalesce(body["message"], F.lit(""))))
    given = F.coalesce(body["messages"], F.array().cast(MESSAGES_TYPE))
    asked = F.when(endpoint == GENERATE, single).otherwise(given)
    limit = F.when(endpoint == CHAT_STREAM, STREAM_MAX_TOKENS).otherwise(DEFAULT_MAX_TOKENS)
    parsed = requests.withColumn("__r", F.from_json("body", REQUEST_TYPE))
    valid = F.coalesce(F.col("body").rlike(r"^\s*\{"), F.lit(False)) & F.get_json_object("body", "$").isNotNull()
    return (
        parsed.withColumn("valid", valid)
        .withColumns(
            {
                "messages": F.when(F.col("valid"), prepend_system(asked, system_prompt)),
                "max_tokens": F.when(F.col("valid"), F.coalesce(body["max_tokens"], limit.cast("bigint"))),
                "temperature": F.when(
                    F.col("valid"), F.coalesce(body["temperature"], F.lit(DEFAULT_TEMPERATURE))
                ),
            }
        )
        .drop("__r")
    )


REQUEST_KEYS = {"message": TEXT, "messages": LIST, "max_tokens": WHOLE_NUMBER, "temperature": NUMBER}


def read_requests_by_key(requests: DataFrame, system_prompt: str = DEFAULT_SYSTEM_PROMPT) -> DataFrame:
    """Like ``read_requests``, with defaults for missing keys only, and ``key_states``.

    A key that is there keeps what it holds: null stays null, and so does a value
    of another type, which ``key_states`` tells apart (missing, null, mistyped,
    given). A null or mistyped message is a message without content, and null
    messages are no messages at all.
    """
    df = parse_objects(requests, REQUEST_KEYS, "body", parsed="valid")
    v, state, endpoint = F.col("__v"), F.col("key_states"), F.col("endpoint")

    def value(key: str, default: Column) -> Column:
        return F.when(state[key] == MISSING, default).otherwise(typed(v, key, REQUEST_KEYS[key], state[key]))

    turns = F.transform(typed(v, "messages", LIST, state["messages"]), lambda m: message(
        F.try_variant_get(m, "$.role", "string"), F.try_variant_get(m, "$.content", "string")))
    given = F.when(state["messages"] == MISSING, F.array().cast(MESSAGES_TYPE)).otherwise(turns.cast(MESSAGES_TYPE))
    asked = F.when(endpoint == GENERATE, F.array(message("user", value("message", F.lit("")))).cast(MESSAGES_TYPE)).otherwise(given)
    limit = F.when(endpoint == CHAT_STREAM, STREAM_MAX_TOKENS).otherwise(DEFAULT_MAX_TOKENS)
    made = {
        "messages": prepend_system(asked, system_prompt),
        "max_tokens": value("max_tokens", limit.cast("bigint")),
        "temperature": value("temperature", F.lit(DEFAULT_TEMPERATURE)),
    }
    return df.withColumns({n: F.when(F.col("valid"), c) for n, c in made.items()}).drop("__v")


def request_body(messages: Column, **options: Column) -> Column:
    """JSON body of a chat request."""
    return F.to_json(F.struct(messages.alias("messages"), *[c.alias(n) for n, c in options.items()]))


def chunk_line(content: Column) -> Column:
    """One streamed chunk."""
    return F.concat(F.lit(CHUNK_PREFIX), F.to_json(F.struct(content.alias("content"))))


def parse_chunks(chunks: DataFrame, *also: str) -> DataFrame:
    """``request_id, seq, end, content, bad`` of streamed lines: the end marker, the content, or a payload that is no JSON."""
    line = F.rtrim("raw", F.lit(" \r\n"))
    payload = F.when(line.startswith(CHUNK_PREFIX), F.substring(line, len(CHUNK_PREFIX) + 1, 2**31 - 1))
    return chunks.select(
        "request_id",
        "seq",
        *also,
        F.coalesce(payload == STREAM_END, F.lit(False)).alias("end"),
        F.coalesce(F.from_json(payload, _CHUNK_TYPE)["content"], F.lit("")).alias("content"),
        F.coalesce((payload != STREAM_END) & F.get_json_object(payload, "$").isNull(), F.lit(False)).alias("bad"),
    )


def reassemble_responses(chunks: DataFrame) -> DataFrame:
    """``request_id, response, n_chunks, n_malformed, complete`` from ``request_id, seq, raw``.

    Joins the contents in order up to the end marker; empty ones do not count,
    and of chunks of one sequence number one counts (a readable one if there is).
    A payload that is no JSON is malformed, and then a response is not complete.
    Chunks are joined in blocks of sequence numbers first, so that a request
    with very many of them is spread, and only its block texts meet at the end.
    """
    parsed = parse_chunks(chunks).withColumn("block", F.shiftright("seq", _SEQ_PER_BLOCK))
    used = (F.col("content") != "") | F.col("bad")
    blocks = parsed.groupBy("request_id", "block").agg(
        F.array_sort(F.collect_list(F.when(used, F.struct("seq", "bad", "content")))).alias("sorted"),
        F.min(F.when(F.col("end"), F.col("seq"))).alias("end_at"),
    )
    once = F.filter("sorted", lambda p, i: (i == 0) | (F.get("sorted", i - 1)["seq"] != p["seq"]))
    before_end = F.filter(once, lambda p: F.col("end_at").isNull() | (p["seq"] < F.col("end_at")))
    blocks = blocks.select("request_id", "block", "end_at", before_end.alias("parts"))
    good = F.filter("parts", lambda p: ~p["bad"])
    texts = blocks.select(
        "request_id",
        "block",
        F.col("end_at").isNotNull().alias("ended"),
        F.array_join(F.transform(good, lambda p: p["content"]), "").alias("text"),
        F.array_size(good).cast("bigint").alias("n"),
        F.array_size(F.filter("parts", lambda p: p["bad"])).cast("bigint").alias("n_bad"),
    )
    gathered = texts.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("block", "text", "n", "n_bad"))).alias("blocks"),
        F.min(F.when(F.col("ended"), F.col("block"))).alias("last"),
    )
    live = F.filter("blocks", lambda b: F.col("last").isNull() | (b["block"] <= F.col("last")))
    return gathered.select(
        "request_id",
        F.array_join(F.transform(live, lambda b: b["text"]), "").alias("response"),
        F.aggregate(live, F.lit(0).cast("bigint"), lambda acc, b: acc + b["n"]).alias("n_chunks"),
        F.aggregate(live, F.lit(0).cast("bigint"), lambda acc, b: acc + b["n_bad"]).alias("n_malformed"),
        F.col("last").isNotNull().alias("complete"),
    ).withColumn("complete", F.col("complete") & (F.col("n_malformed") == 0))
