"""Golden counts, sinks, streaming, and what the physical plans must not hold."""

import re

import pytest
from pyspark.sql import functions as F

from turnloom.config import PrepConfig, SourceSpec
from turnloom.operators.corpus import prepare_source
from turnloom.operators.examples import build_examples, kept
from turnloom.operators.ordered import by_column, global_index
from turnloom.operators.runlog import parse_console
from turnloom.operators.split import exact_split
from turnloom.plans import derive
from turnloom.plans.catalog import QUERIES
from turnloom.plans.prepare import prepare_corpus
from turnloom.plans.registry import Tables
from turnloom.sources.sinks import new_folder, shared_folder, write_examples
from turnloom.streaming.prepare import prepare_stream, write_stream


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "sf, length, eligible, n_kept, tokens, unmasked",
    [
        ("0.001", 256, 16, 10, 2259, 972), ("0.001", 512, 16, 15, 5368, 2347), ("0.001", 1024, 16, 16, 6517, 2725),
        ("0.01", 256, 98, 42, 9871, 4894), ("0.01", 512, 98, 81, 32072, 12575), ("0.01", 1024, 98, 98, 48351, 18552),
        ("0.1", 512, 958, 802, 294663, 120583),
    ],
)
def test_golden_counts(spark, sf, length, eligible, n_kept, tokens, unmasked):
    t = Tables(spark, f"/root/testdata/sf{sf}")
    made = build_examples(derive.conversations(t), PrepConfig(max_seq_len=length))
    row = made.agg(
        F.count(F.when(F.col("skip_reason").isNull() | (F.col("skip_reason") != "missing_role"), 1)),
        F.count(F.when(F.col("skip_reason").isNull(), 1)), F.sum(F.size("input_ids")), F.sum("n_unmasked"),
    ).first()
    assert tuple(row) == (eligible, n_kept, tokens, unmasked)


def test_example_invariants(spark, tiny):
    made = kept(build_examples(derive.conversations(Tables(spark, tiny)))).collect()
    for r in made:
        ids, labels = r["input_ids"], r["labels"]
        assert len(ids) == len(labels) == len(r["attention_mask"]) == r["n_tokens"]
        assert all(b in (-100, a) for a, b in zip(ids, labels))
        assert labels.count(-100) == r["prompt_len"] and r["n_unmasked"] == r["n_tokens"] - r["prompt_len"]


def test_preparation_has_one_shuffle_and_no_python(spark, tiny):
    text = plan(QUERIES["sft_examples"](spark, tiny))
    assert text.count("Exchange ") == 1
    assert not re.search(r"Python|ArrowEval|Window", text)
    # Tokens once for the ids and once to count the prompt, despite the filter.
    assert text.count("regexp_extract_all") == 2


def test_capping_a_flat_source_reads_no_text(spark, tiny):
    rows = prepare_source(derive.prompt_rows(Tables(spark, tiny).documents).drop("source"), SourceSpec("s", cap=5, order_by="doc_id"))
    text = plan(rows.select("id"))
    assert "text" not in "".join(re.findall(r"ReadSchema: (\S+)", text))
    assert "PushedFilters: [IsNotNull(doc_id), LessThan(doc_id" in text


def test_split_does_not_shuffle_the_rows(spark, tiny):
    text = plan(exact_split(Tables(spark, tiny).documents, ["doc_id"]))
    outer = text.split("Subquery")[0]
    assert "Exchange" not in outer and "text#" in outer


def test_positions_sort_only_inside_blocks(spark, tiny):
    text = plan(global_index(Tables(spark, tiny).documents.select("doc_id", "text"), by_column("doc_id")))
    windows = [w for w in text.splitlines() if "Window [" in w]
    assert windows and "__b0" in windows[0]
    # The one window without a partition sees block totals only.
    assert all("text" not in w.split("],")[0] for w in windows)


def test_sink_partitions_by_split(spark, tiny, tmp_path):
    made = kept(build_examples(exact_split(derive.conversations(Tables(spark, tiny)), ["conv_id"])))
    path = str(tmp_path / "out")
    write_examples(made.select("conv_id", "split", "input_ids", "labels", "attention_mask"), path, even_files=True)
    back = spark.read.parquet(path)
    assert back.count() == made.count()
    assert "PartitionFilters: [isnotnull(split" in plan(back.filter("split = 'eval'"))
    with pytest.raises(Exception, match="already exists"):
        write_examples(made.select("conv_id", "split", "input_ids"), path)


class FakeSession:
    """As much of a session as the shared folder is found by."""

    def __init__(self, setting=None):
        self.setting = setting
        self.conf = self

    def get(self, name, default):
        assert name == "spark.checkpoint.dir"
        return self.setting or default


def test_shared_folder_is_the_session_s(spark):
    assert shared_folder(FakeSession("hdfs://c/tmp/")) == "hdfs://c/tmp"
    with pytest.raises(ValueError):
        shared_folder(FakeSession())
    assert new_folder(spark, "x") != new_folder(spark, "x")


def scans(df):
    return len(re.findall(r"^\(?\d*\)?.*?FileScan|FileScan parquet", plan(df)))


def test_slim_inputs_are_stored_before_they_are_read_again(spark, tiny):
    for name, most in (("mixture_union", 9), ("eligible_cap", 2), ("exact_split", 2), ("eval_first_batches", 4), ("step_times", 9), ("format_dispatch", 1)):
        assert scans(QUERIES[name](spark, tiny)) <= most, name


def test_console_lines_are_matched_once(spark):
    df = parse_console(spark.createDataFrame([("x",)], "value string")).select("step", "loss", "lr", "val_loss")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 2  # one per kind of line


def test_top_window_is_narrow_for_hashed_ids(spark):
    """Block totals that meet in the window without a partition, for 63-bit ids."""
    ids = spark.range(20_000).select(F.shiftrightunsigned(F.xxhash64("id"), 1).alias("id"))
    order = by_column("id")
    tops = ids.select(F.shiftright("id", order.shifts[-1]).alias("b")).distinct().count()
    assert tops <= 1 << 15 and all(b - a <= 16 for a, b in zip((0, *order.shifts), order.shifts))
    got = global_index(ids, order).orderBy("id").collect()
    assert [r["position"] for r in got] == list(range(20_000))


def test_prepare_corpus(spark, tiny, tmp_path):
    t = Tables(spark, tiny)
    derive.conversations(t).select(F.col("conv_id").alias("id"), "messages").write.parquet(str(tmp_path / "chats"))
    derive.prompt_rows(t.documents).select(F.col("doc_id").alias("id"), "prompt", "completion").write.json(str(tmp_path / "pairs"))
    specs = [SourceSpec("chats", str(tmp_path / "chats")), SourceSpec("pairs", str(tmp_path / "pairs"), cap=64, file_format="json")]
    for stored in (True, False):
        made = prepare_corpus(spark, specs, stored=stored)
        per_split = {r[0]: r[1] for r in made.groupBy("split").count().collect()}
        assert per_split == {"train": 76, "eval": 4}


def test_stream_equals_batch_and_takes_each_file_once(spark, tiny, tmp_path):
    t = Tables(spark, tiny)
    chats = derive.conversations(t).select("conv_id", "messages")
    inbox, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def drain():
        stream = spark.readStream.schema(chats.schema).parquet(inbox)
        made = kept(prepare_stream(stream, ["conv_id"])).drop("messages", "facts", "format")
        write_stream(made, out, state).awaitTermination()
        return spark.read.parquet(out)

    chats.filter("conv_id < 9").write.parquet(inbox)
    drain()
    chats.filter("conv_id >= 9").write.mode("append").parquet(inbox)
    got = drain()
    assert drain().count() == got.count()
    cols = ["conv_id", "split", "input_ids", "labels", "attention_mask"]
    want = kept(prepare_stream(chats, ["conv_id"]))
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
