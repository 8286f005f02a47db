"""Batches, packing and manifests against plain loops."""

import pytest
from pyspark.sql import functions as F

from turnloom.functions.tokens import WhitespaceTokenizer
from turnloom.operators.examples import build_examples
from turnloom.operators.ordered import by_column, global_index, shuffled
from turnloom.operators.packing import pack_documents, pad_batches, training_manifest


@pytest.fixture(scope="module")
def docs(spark):
    texts = [" ".join(f"t{i}_{k}" for k in range((i * 7) % 23)) for i in range(60)]
    texts[10] = " ".join(f"big{k}" for k in range(900))
    return spark.createDataFrame([(i * 5000, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("length, stride, tail", [(16, None, False), (16, 17, False), (16, 5, True), (1, 1, False), (2000, 2000, True)])
def test_packing_equals_a_loop(spark, docs, length, stride, tail):
    ids = docs.select("doc_id", WhitespaceTokenizer().ids(F.col("text")).alias("ids")).collect()
    flat = []
    for r in sorted(ids, key=lambda r: r["doc_id"]):
        flat += r["ids"] + [-1]
    step = stride or length
    want = {}
    for c in range(0, len(flat) // step + 1):
        chunk = flat[c * step: c * step + length + 1]
        if len(chunk) == length + 1 or (tail and len(chunk) > 1):
            want[c] = (chunk[:-1], chunk[1:])
    got = pack_documents(docs, by_column("doc_id"), chunk_len=length, stride=stride, keep_tail=tail)
    assert {r["chunk_id"]: (r["input_ids"], r["labels"]) for r in got.collect()} == want


@pytest.mark.parametrize("bits", [10, 13, 16])
@pytest.mark.parametrize("length, stride, tail", [(16, None, False), (16, 17, True), (700, 90, True)])
def test_packing_over_borders_of_blocks(spark, docs, length, stride, tail, bits):
    """Blocks of one document, of a few, and of many give the same chunks; null and empty texts too."""
    more = docs.unionByName(spark.createDataFrame([(7, None), (9, ""), (-5, "a b"), (1 << 40, "c d e")], "doc_id long, text string"))
    got = [
        {(r["chunk_id"], tuple(r["input_ids"]), tuple(r["labels"])) for r in
         pack_documents(more, by_column("doc_id", bits=b), chunk_len=length, stride=stride, keep_tail=tail).collect()}
        for b in (bits, 40)
    ]
    assert got[0] == got[1] and got[0]
    assert pack_documents(more.limit(0), by_column("doc_id", bits=bits), chunk_len=length, keep_tail=tail).isEmpty()


def test_packing_moves_tokens_once(spark, docs):
    """One exchange carries whole documents' ids; the other one pieces at borders only."""
    plan = pack_documents(docs, by_column("doc_id", bits=10), chunk_len=16)
    plan.write.format("noop").mode("overwrite").save()
    inner = plan._jdf.queryExecution().executedPlan().toString().split(":- ")[1].split("Window [min(")[0]
    assert "ObjectHashAggregate(keys=[__block" in inner and "Exchange" not in inner


def test_packing_rejects_gaps_between_chunks(docs):
    with pytest.raises(ValueError):
        pack_documents(docs, by_column("doc_id"), chunk_len=8, stride=10)


def test_batches_are_padded_to_their_longest_row(spark, docs):
    made = docs.select(
        "doc_id",
        F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")),
                F.struct(F.lit("assistant").alias("role"), F.lit("x").alias("content"))).alias("messages"),
    )
    ex = build_examples(made).drop("messages", "facts")
    got = pad_batches(ex, ["doc_id"], shuffled("doc_id"), 7).collect()
    plain = {r["doc_id"]: r for r in ex.collect()}
    order = [r["doc_id"] for r in global_index(docs.select("doc_id"), shuffled("doc_id")).orderBy("position").collect()]
    assert len(got) == 60 and max(r["batch_id"] for r in got) == 8
    for r in got:
        assert order[r["batch_id"] * 7 + r["row_in_batch"]] == r["doc_id"]
        mates = [g["doc_id"] for g in got if g["batch_id"] == r["batch_id"]]
        longest = max(plain[m]["n_tokens"] for m in mates)
        n = plain[r["doc_id"]]["n_tokens"]
        assert r["input_ids"] == plain[r["doc_id"]]["input_ids"] + [0] * (longest - n)
        assert r["labels"] == plain[r["doc_id"]]["labels"] + [-100] * (longest - n)
        assert r["attention_mask"] == [1] * n + [0] * (longest - n)
    single = pad_batches(ex, ["doc_id"], shuffled("doc_id"), 1).collect()
    assert all(len(r["input_ids"]) == r["n_tokens"] for r in single)


def test_manifest_reshuffles_every_epoch(spark):
    got = training_manifest(spark.range(10), "id", max_steps=13, per_step=2).orderBy("step", "slot").collect()
    assert [(r["step"], r["slot"]) for r in got] == [(i // 2, i % 2) for i in range(26)]
    epochs = [[r["id"] for r in got[i: i + 10]] for i in (0, 10, 20)]
    assert sorted(epochs[0]) == sorted(epochs[1]) == list(range(10)) and epochs[0] != epochs[1]
    assert [r["epoch"] for r in got] == [0] * 10 + [1] * 10 + [2] * 6
    assert training_manifest(spark.range(0), "id", max_steps=3, per_step=2).count() == 0
    with pytest.raises(ValueError):
        training_manifest(spark.range(3), "id", max_steps=0, per_step=2)


def test_bucketed_arrays_do_not_move(spark, tiny):
    """Without a broadcast: the side with the arrays is read as it lies, and only the batches are shuffled."""
    from turnloom.sources.sinks import store_bucketed

    rows = spark.range(200).select(F.col("id").alias("conv_id"), (F.col("id") % 7 + 1).alias("n_tokens"), F.array_repeat(F.col("id"), 3).alias("input_ids"))
    rows = rows.withColumns({"labels": F.col("input_ids"), "attention_mask": F.col("input_ids")})
    stored = store_bucketed(rows, "examples", "conv_id", 8)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        padded = pad_batches(stored, ["conv_id"], shuffled("conv_id"), 4)
        plan = padded._jdf.queryExecution().executedPlan().toString()
        assert padded.count() == 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    left = plan[plan.index("SortMergeJoin"):].split("\n   ")
    arrays = next(i for i, line in enumerate(left) if "FileScan" in line and "input_ids" in line)
    assert "Bucketed: true" in left[arrays] and not any("Exchange" in line for line in left[:arrays])
