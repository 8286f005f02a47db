"""Keys that are missing, null or mistyped; length sketches; counts taken while writing."""

import json

import pytest
from pyspark.sql import functions as F

from turnloom.config import PrepConfig
from turnloom.operators.chatlog import CHAT, CHAT_STREAM, GENERATE, read_requests, read_requests_by_key
from turnloom.operators.examples import build_examples, kept
from turnloom.operators.json_rows import normalise_lines
from turnloom.operators.quantiles import RANK_ERROR, length_sketches, merge_sketches, quantile_ranks, read_quantiles
from turnloom.operators.report import StageCounts, counts_table, watch_preparation
from turnloom.plans import derive
from turnloom.plans.registry import Tables
from turnloom.sources.sinks import new_folder


def turns_of(row):
    return None if row.messages is None else [(m.role, m.content) for m in row.messages]


LINES = [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}, {"content": "c"}, {"role": 3, "content": "d"}]}, "messages",
     [("user", "a"), ("assistant", None), ("", "c"), (None, "d")]),
    ({"messages": None, "conversations": [{"from": "human", "value": "a"}, {"from": None, "role": "gpt", "value": "b"}, {"role": "gpt", "content": "c"}, {}]}, "conversations",
     [("user", "a"), (None, "b"), ("assistant", "c"), ("", "")]),
    ({"messages": {}, "prompt": "p", "completion": None}, "prompt", [("user", "p"), ("assistant", None)]),
    ({"prompt": "p", "instruction": "i"}, "instruction", [("user", "i"), ("assistant", "")]),
    ({"instruction": "i", "input": "", "output": None}, "instruction", [("user", "i"), ("assistant", None)]),
    ({"instruction": "i", "input": "more", "output": "o"}, "instruction", [("user", "i\n\nmore"), ("assistant", "o")]),
    ({"instruction": None}, "instruction", [("user", None), ("assistant", "")]),
    ({"instruction": 7, "output": "o"}, "instruction", [("user", None), ("assistant", "o")]),
    ({"messages": []}, "messages", []),
    ({"text": "other"}, None, None),
    ({}, None, None),
]


def test_layouts_by_key(spark):
    rows = [(i, json.dumps(line)) for i, (line, _, _) in enumerate(LINES)] + [(90, "[1]"), (91, '{"prompt": "cut'), (92, ""), (93, None), (94, '"text"'), (95, "null")]
    got = {r.id: r for r in normalise_lines(spark.createDataFrame(rows, "id long, value string")).collect()}
    for i, (_, layout, turns) in enumerate(LINES):
        assert (got[i].format, turns_of(got[i]), got[i].parsed) == (layout, turns, True), LINES[i]
    for i in range(90, 96):
        assert (got[i].format, got[i].messages, got[i].parsed, got[i].facts.n_messages) == (None, None, False, 0)
    assert got[1].key_states.messages == "null" and got[2].key_states.messages == "mistyped" and got[3].key_states.completion == "missing"
    assert got[7].key_states.instruction == "mistyped" and got[6].key_states.instruction == "null" and got[5].key_states.input == "given"
    reasons = build_examples(normalise_lines(spark.createDataFrame(rows, "id long, value string"))).select("id", "skip_reason").collect()
    assert {r.skip_reason for r in reasons if r.id >= 90 or r.id in (9, 10)} == {"unrecognised"}
    assert {r.skip_reason for r in reasons if r.id in (2, 4, 6, 7)} == {"render_error"}


def test_requests_by_key(spark):
    bodies = [
        (1, GENERATE, '{"message": "hi", "max_tokens": 9, "temperature": 1.5}'), (2, GENERATE, '{"message": null}'), (3, GENERATE, "{}"), (4, CHAT, "{}"),
        (5, CHAT, '{"messages": null, "temperature": null}'), (6, CHAT_STREAM, '{"messages": [{"role": "user", "content": "x"}], "max_tokens": "5"}'),
        (7, CHAT, '{"messages": 3}'), (8, CHAT, "oops"), (9, CHAT, None), (10, GENERATE, '{"message": 5, "max_tokens": 1.5}'),
    ]
    df = spark.createDataFrame(bodies, "request_id long, endpoint string, body string")
    got = {r.request_id: r for r in read_requests_by_key(df, "s").collect()}
    summary = {i: (turns_of(r), r.max_tokens, r.temperature) for i, r in got.items()}
    system = ("system", "s")
    assert summary == {
        1: ([system, ("user", "hi")], 9, 1.5), 2: ([system, ("user", None)], 256, 0.7), 3: ([system, ("user", "")], 256, 0.7), 4: ([system], 256, 0.7),
        5: (None, 256, None), 6: ([system, ("user", "x")], None, 0.7), 7: (None, 256, 0.7), 8: (None, None, None), 9: (None, None, None), 10: ([system, ("user", None)], None, 0.7)}
    assert [got[i].valid for i in (7, 8, 9)] == [True, False, False]
    assert got[6].key_states.max_tokens == got[7].key_states.messages == got[10].key_states.message == "mistyped" and got[5].key_states.temperature == "null"
    whole = read_requests(df, "s").where("request_id IN (1, 3, 4)").collect()      # nothing null: both ways agree
    assert {r.request_id: (turns_of(r), r.max_tokens, r.temperature) for r in whole} == {i: summary[i] for i in (1, 3, 4)}


def test_sketches_merge_and_stay_small(spark):
    values = spark.range(300_000).select((F.col("id") % 3).cast("string").alias("g"), F.when(F.col("id") % 1000 != 7, F.col("id") * F.col("id")).alias("x"))
    parts = length_sketches(values.repartition(9), "x", ["g"])
    whole = merge_sketches(parts)
    assert parts.agg(F.max(F.octet_length("sketch"))).first()[0] < 100_000 and whole.first().n == 299_700
    found = read_quantiles(whole.select(F.lit("all").alias("g"), "n", "lowest", "highest", "sketch"), ["g"], (0.01, 0.5, 0.999))
    for r in quantile_ranks(values.withColumn("g", F.lit("all")), "x", found, ["g"]).collect():
        assert r.below <= r.quantile + RANK_ERROR and r.upto >= r.quantile - RANK_ERROR and (r.lowest, r.highest) == (0, 299_999**2)
    assert length_sketches(values.limit(0), "x").where("n > 0").count() == 0 and merge_sketches(parts.limit(0)).count() == 0


def test_counts_of_one_pass(spark, tiny):
    rows = derive.conversations(Tables(spark, tiny))
    stages = StageCounts()
    made = watch_preparation(build_examples(stages.watch(rows, "loaded"), PrepConfig(max_seq_len=256)), stages)
    path = new_folder(spark, "counted")
    stages.watch(kept(made), "written").select("conv_id", "input_ids").write.parquet(path)
    counts = stages.counts()
    again = build_examples(rows, PrepConfig(max_seq_len=256))
    reasons = {r.skip_reason: r["count"] for r in again.groupBy("skip_reason").count().collect()}
    assert counts["loaded"]["n_rows"] == counts["prepared"]["n_rows"] == again.count()
    assert counts["written"]["n_rows"] == counts["prepared"]["kept"] == reasons[None] == spark.read.parquet(path).count()
    assert counts["prepared"]["too_short"] == reasons["too_short"] and counts["prepared"]["render_error"] == 0
    plan = kept(made)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and plan.count("CollectMetrics") == 2
    assert counts_table(spark, counts).where("measure = 'too_short'").first().n == reasons["too_short"]
    with pytest.raises(ValueError, match="twice"):
        stages.watch(rows, "loaded")
