"""Responses put together from a stream in any order, and rows that are delivered again."""

import pytest
from pyspark.sql import functions as F

from turnloom.operators.chatlog import reassemble_responses
from turnloom.sources.sinks import new_folder
from turnloom.streaming.responses import LATE, RESPONSE, RESULT, reassemble_stream

SCHEMA = "request_id string, seq bigint, raw string, ts timestamp"


def data(text):
    return f'data: {{"content": "{text}"}}'


CHUNKS = [
    ("whole", 0, data("")), ("whole", 1, data("a ")), ("whole", 2, data("b")), ("whole", 3, "data: [DONE]"), ("whole", 4, data("late")),
    ("open", 0, data("x")), ("open", 2, data("z")),
    ("broken", 0, data("x")), ("broken", 1, 'data: {"content": "cut'), ("broken", 2, "data: [DONE]"),
    ("mended", 0, 'data: {"content": "cut'), ("mended", 0, data("whole")), ("mended", 1, "data: [DONE]"),
    ("empty", 0, "data: [DONE]"), ("noise", 0, "event: ping"), ("twice", 0, data("t")), ("twice", 0, data("t")), ("twice", 1, "data: [DONE]\r\n"),
]


@pytest.mark.parametrize("order", [1, -1, 7])
def test_any_order_gives_the_batch_result(spark, order):
    folder, path, state = (new_folder(spark, name) for name in ("chunks", "out", "state"))
    chunks = sorted(CHUNKS, key=lambda c: hash_of(c, order))
    for at in range(0, len(chunks), 5):
        rows = [(*c, 1_700_000_000 + c[1]) for c in chunks[at : at + 5]]
        spark.createDataFrame(rows, "request_id string, seq bigint, raw string, s long").select("request_id", "seq", "raw", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").json(folder)
    last = spark.range(1).select(F.lit("last").alias("request_id"), F.lit(0).alias("seq"), F.lit("x").alias("raw"), F.timestamp_seconds(F.lit(1_700_100_000)).alias("ts"))
    last.coalesce(1).write.mode("append").json(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(folder)
    made = reassemble_stream(stream, delay="1 hour", lifetime="10 minutes")
    made.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(RESULT).parquet(path).where("request_id <> 'last'")
    responses = out.where(F.col("kind") == RESPONSE)
    names = ["request_id", "response", "n_chunks", "n_malformed", "complete"]
    batch = reassemble_responses(spark.createDataFrame(CHUNKS, "request_id string, seq bigint, raw string")).select(names)
    assert sorted(map(tuple, responses.select(names).collect())) == sorted(map(tuple, batch.collect()))
    late = {r.request_id: r.n_late for r in out.where(F.col("kind") == LATE).collect()}
    assert set(late) <= {"whole", "twice", "mended"}


def hash_of(chunk, order):
    return (order * (CHUNKS.index(chunk) + 1)) % 31 if order == 7 else order * CHUNKS.index(chunk)


def test_requests_that_share_a_state(spark):
    """One is closed while others of its state get chunks; a null request is one too."""
    folder, path, state = (new_folder(spark, name) for name in ("chunks", "out", "state"))
    day = 86_400
    files = [[("old", 0, data("a"), 0), ("done", 0, "data: [DONE]", 0), (None, 0, data("n"), 0)], [("done", 1, data("late"), 60)],
             [("new", 0, data("b"), day)], [("new", 1, "data: [DONE]", day), ("end", 0, data("x"), 3 * day)]]
    for rows in files:
        made = spark.createDataFrame([(*r[:3], 1_700_000_000 + r[3]) for r in rows], "request_id string, seq bigint, raw string, s long")
        made.select("request_id", "seq", "raw", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").json(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(folder)
    out = reassemble_stream(stream, delay="1 hour", lifetime="10 minutes", buckets=1)
    out.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    got = {(r.request_id, r.kind): (r.response, r.complete, r.n_late) for r in spark.read.schema(RESULT).parquet(path).collect()}
    assert got == {("old", RESPONSE): ("a", False, 0), ("done", RESPONSE): ("", True, 0), (None, RESPONSE): ("n", False, 0),
                   ("done", LATE): (None, None, 1), ("new", RESPONSE): ("b", True, 0)}
