"""Normalisation, roles, prompts and skip reasons on hand-written rows."""

import json

import pytest
from pyspark.sql import functions as F

from turnloom.config import PrepConfig, SourceSpec
from turnloom.functions.messages import MESSAGES_TYPE, inject_system, prepend_system
from turnloom.functions.template import ChatTemplate
from turnloom.operators.corpus import (
    cap_per_group,
    concatenate,
    load_mixture,
    normalise,
    prepare_source,
)
from turnloom.operators.examples import build_examples, build_plain_examples, kept
from turnloom.operators.ordered import by_column
from turnloom.operators.report import skip_counts

U, A, S = "user", "assistant", "system"


def rows(spark, *message_lists):
    data = [(i, m) for i, m in enumerate(message_lists)]
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("messages", MESSAGES_TYPE)])
    return spark.createDataFrame(data, schema)


def reasons(df):
    return {r["id"]: r["skip_reason"] for r in df.select("id", "skip_reason").collect()}


def messages_of(df, key="id"):
    return {r[key]: [tuple(m) for m in r["messages"]] if r["messages"] is not None else None
            for r in df.select(key, "messages").collect()}


def test_skip_reasons_and_their_precedence(spark):
    df = rows(
        spark,
        [(U, "a b"), (A, "c")],
        None,
        [],
        [(U, "a")],
        [(A, "a")],
        [(U, None), (A, "x")],
        [(None, "a"), (U, "a"), (A, "x")],
        [(U, "w " * 300), (A, "x")],
        [(U, "a"), (A, "")],
    )
    got = reasons(build_examples(df, PrepConfig(max_seq_len=64)))
    assert got == {
        0: None, 1: "unrecognised", 2: "missing_role", 3: "missing_role", 4: "missing_role",
        5: "render_error", 6: "render_error", 7: "too_short", 8: None,
    }
    loose = reasons(build_examples(df, PrepConfig(max_seq_len=64, require_roles=False)))
    assert loose == got | {2: "empty", 3: "no_assistant", 4: None}
    counted = {r[0]: r[1] for r in skip_counts(build_examples(df, PrepConfig(max_seq_len=64))).collect()}
    assert counted == {"kept": 2, "unrecognised": 1, "missing_role": 3, "render_error": 2, "too_short": 1}


def test_prompt_that_fills_the_window_exactly_is_dropped(spark):
    # system (9 tokens) + user (2 markers + n words) + start marker
    for words, expected in ((5, None), (6, "too_short")):
        df = rows(spark, [(U, "w " * words), (A, "x")])
        cfg = PrepConfig(max_seq_len=9 - 2 + 2 + 5 + 1 + 1)
        out = build_examples(df, cfg).first()
        assert out["skip_reason"] == expected, out
        if expected is None:
            assert (out["n_tokens"], out["n_unmasked"]) == (cfg.max_seq_len, out["n_tokens"] - out["prompt_len"])


def test_only_the_last_assistant_turn_is_the_boundary(spark):
    chat = [(U, "q1"), (A, "a1"), (U, "q2"), (A, "a2"), (U, "tail")]
    df = rows(spark, chat)
    both = build_examples(df).first()
    masked = build_examples(df, PrepConfig(trailing="mask")).first()
    ids, labels = both["input_ids"], both["labels"]
    assert labels == [-100] * both["prompt_len"] + ids[both["prompt_len"]:]
    assert both["n_unmasked"] == 2 + 3  # a2, end; marker, tail, end
    assert masked["n_unmasked"] == 2
    assert masked["labels"][-3:] == [-100] * 3
    assert both["attention_mask"] == [1] * len(ids)


def test_plain_examples_unmask_the_length_of_the_answer(spark):
    chat = [(S, "be kind"), (U, "q one"), (A, "old"), (U, "q"), (A, "the answer"), (U, "bye now")]
    out = build_plain_examples(rows(spark, chat)).first()
    assert out["n_unmasked"] == 3 and out["labels"][-3:] == out["input_ids"][-3:]
    assert set(out["labels"][:-3]) == {-100}
    assert reasons(build_plain_examples(rows(spark, [(U, "a")]), PrepConfig(require_roles=False))) == {0: "no_assistant"}


def test_system_prompts(spark):
    df = rows(spark, [(U, "a"), (A, "b")], [(U, "a"), (S, "mine"), (A, "b")], [(None, "a")])
    got = messages_of(df.withColumn("messages", inject_system(F.col("messages"), "P")))
    assert got[0][0] == (S, "P") and len(got[0]) == 3
    assert got[1] == [(U, "a"), (S, "mine"), (A, "b")]
    assert got[2] == [(S, "P"), (None, "a")]
    none = messages_of(df.withColumn("messages", inject_system(F.col("messages"), "")))
    assert len(none[0]) == 2
    twice = messages_of(df.withColumn("messages", prepend_system(F.col("messages"), "P")))
    assert [m[0] for m in twice[1]] == [S, U, S, A]


def test_strict_alternation_and_role_markers(spark):
    df = rows(
        spark, [(U, "a"), (A, "b")], [(S, "s"), (U, "a"), (A, "b")], [(U, "a"), (U, "b"), (A, "c")],
        [(A, "a"), (U, "b")], [(U, "a"), (S, "s"), (A, "c")],
    )
    strict = ChatTemplate(strict_alternation=True)
    assert reasons(build_examples(df, template=strict)) == {
        0: None, 1: None, 2: "render_error", 3: "render_error", 4: "render_error"
    }
    model = ChatTemplate(markers={A: ("<model>", "</model>")})
    text = df.filter("id = 0").select(model.render(F.col("messages"))).first()[0]
    assert text == "<|user|>\na\n<|end|>\n<model>b</model>"


def test_turn_style_layout(spark):
    lines = [
        {"id": 0, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"id": 1, "conversations": [{"role": "user", "content": "q"}, {"role": "narrator", "content": "n"}]},
        {"id": 2, "conversations": [{"from": "tool", "value": "t"}, {}]},
    ]
    df = spark.read.json(spark.sparkContext.parallelize([json.dumps(x) for x in lines]))
    assert messages_of(normalise(df)) == {
        0: [(U, "q"), (A, "a")], 1: [(U, "q"), ("narrator", "n")], 2: [("tool", "t"), ("", "")]
    }


def test_presence_by_schema_and_by_value(spark):
    lines = [
        {"id": 0, "messages": [{"role": U, "content": "m"}, {"role": A, "content": "x"}], "prompt": "ignored"},
        {"id": 1, "prompt": "p", "completion": "c"},
        {"id": 2, "instruction": "i", "input": "", "output": "o"},
        {"id": 3, "instruction": "i", "input": "more", "output": "o"},
        {"id": 4, "other": 1},
    ]
    df = spark.read.json(spark.sparkContext.parallelize([json.dumps(x) for x in lines]))
    by_value = normalise(df, "value")
    assert messages_of(by_value) == {
        0: [(U, "m"), (A, "x")], 1: [(U, "p"), (A, "c")], 2: [(U, "i"), (A, "o")],
        3: [(U, "i\n\nmore"), (A, "o")], 4: None,
    }
    formats = {r["id"]: r["format"] for r in by_value.collect()}
    assert formats == {0: "messages", 1: "prompt", 2: "instruction", 3: "instruction", 4: None}
    # By schema the union of columns makes every other row a prompt row.
    formats = {r["id"]: r["format"] for r in normalise(df).collect()}
    assert formats == {0: "messages", 1: "prompt", 2: "prompt", 3: "prompt", 4: "prompt"}
    assert reasons(build_examples(normalise(df)))[2] == "render_error"
    assert reasons(build_examples(by_value)) == {0: None, 1: None, 2: None, 3: None, 4: "unrecognised"}


def test_instruction_without_output_and_with_null_instruction(spark):
    df = spark.createDataFrame([(0, "i"), (1, None)], "id long, instruction string")
    out = build_examples(normalise(df))
    assert messages_of(out)[0] == [(U, "i"), (A, "")]
    assert reasons(out) == {0: None, 1: "render_error"}
    lost = spark.createDataFrame([(0, 5)], "id long, other int")
    assert reasons(build_examples(normalise(lost))) == {0: "unrecognised"}
    with pytest.raises(ValueError):
        normalise(df, "guess")


def test_cap_counts_eligible_rows_in_order(spark):
    lists = [[(U, "only")] if i % 2 else [(U, "q"), (A, "a")] for i in range(40)]
    df = rows(spark, *lists).repartition(5)
    kept_ids = [r["id"] for r in prepare_source(df, SourceSpec("s", cap=7, order_by="id")).orderBy("id").collect()]
    assert kept_ids == [0, 2, 4, 6, 8, 10, 12]
    assert prepare_source(df, SourceSpec("s", cap=0, order_by="id")).count() == 20
    assert prepare_source(df, SourceSpec("s", cap=99, order_by="id")).count() == 20


def test_cap_per_group_with_one_hot_group(spark):
    ids = [(i * 3_000_017, "hot" if i % 3 else f"cold{i % 5}") for i in range(600)]
    ids += [(7, None), (8, None)]
    df = spark.createDataFrame(ids, "id long, source string").repartition(6)
    got = cap_per_group(df, "source", by_column("id"), 25).collect()
    want = []
    for source in {s for _, s in ids}:
        want += [(i, source) for i in sorted(i for i, s in ids if s == source)[:25]]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert cap_per_group(df, "source", by_column("id"), 0).count() == 602


def test_mixture_from_files(spark, tmp_path):
    pairs = spark.createDataFrame([(i, f"p{i}", "c") for i in range(9)], "id long, prompt string, completion string")
    pairs.write.json(str(tmp_path / "pairs" / "train"))
    chats = rows(spark, [(U, "q"), (A, "a")], [(U, "q")]).withColumn("split", F.lit("train"))
    other = rows(spark, [(U, "z"), (A, "z")]).withColumn("split", F.lit("test"))
    concatenate([chats, other]).write.parquet(str(tmp_path / "chats"))
    specs = [
        SourceSpec("pairs", str(tmp_path / "pairs" / "{split}"), cap=4, category="instruction", file_format="json"),
        SourceSpec("chats", str(tmp_path / "chats"), category="conversation"),
    ]
    got = load_mixture(spark, specs)
    assert sorted((r["source"], r["id"], r["category"], r["format"]) for r in got.collect()) == [
        ("chats", 0, "conversation", "messages"),
        *[("pairs", i, "instruction", "prompt") for i in range(4)],
    ]
    assert kept(build_examples(got)).count() == 5
    with pytest.raises(ValueError):
        load_mixture(spark, [])


def test_cap_per_group_with_ties_and_nulls(spark):
    rows = [("a", i) for i in (1, 2, 2, 2, None, None)] + [(None, i) for i in (5, None, 4)] + [("b", 9)]
    df = spark.createDataFrame(rows, "source string, id long")
    got = sorted(map(tuple, cap_per_group(df, "source", by_column("id"), 3).collect()), key=str)
    assert got == sorted([("a", 1), ("a", 2), ("a", 2), (None, 4), (None, 5), (None, None), ("b", 9)], key=str)


def test_a_column_named_facts_is_not_trusted(spark):
    df = spark.createDataFrame([("q", "a", 5)], "prompt string, completion string, facts int")
    assert normalise(df).first()["facts"]["n_messages"] == 2
