"""Order-dependent operators against plain loops, with one hot group."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnloom.config import SplitConfig
from turnloom.operators.ordered import (
    RowOrder,
    by_column,
    first_n,
    order_of,
    global_index,
    last_of_each,
    ordered_scan,
    shuffled,
)
from turnloom.operators.split import exact_split, hash_split, seeded_sample, without
from turnloom.sources.turns import assemble_turns, number_turns


def sparse_rows(n=400, seed=3):
    rng = random.Random(seed)
    ids = rng.sample(range(-(2**20), 2**62, 2**33 + 1), n // 2) + list(range(n - n // 2))
    return [(i, "hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), rng.randint(-5, 9)) for i in set(ids)]


@pytest.mark.parametrize("shifts", [(12, 36), (2, 5), (44,), (3, 9, 30)])
def test_scan_equals_a_loop(spark, shifts):
    data = sparse_rows()
    df = spark.createDataFrame(data, "id long, g string, v long").repartition(7)
    got = ordered_scan(
        df, RowOrder(F.col("id"), (), shifts), by=["g"],
        sums={"before": F.col("v")}, lags={"prev": F.col("v"), "prev_id": F.col("id")}, totals={"all": F.col("v")},
    )
    seen, want = {}, {}
    for i, g, v in sorted(data, key=lambda r: r[0]):
        total, last, last_id = seen.get(g, (0, None, None))
        want[i] = (total, last, last_id)
        seen[g] = (total + v, v, i)
    rows = got.collect()
    assert len(rows) == len(data)
    assert {r["id"]: (r["before"], r["prev"], r["prev_id"]) for r in rows} == want
    assert all(r["all"] == seen[r["g"]][0] for r in rows)


def test_lag_of_a_null_value_is_null(spark):
    df = spark.createDataFrame([(0, 1.0), (1, None), (5000, 2.0)], "id long, v double")
    got = ordered_scan(df, by_column("id"), lags={"prev": F.col("v")})
    assert {r["id"]: r["prev"] for r in got.collect()} == {0: None, 1: 1.0, 5000: None}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ids=st.sets(st.integers(0, 2**50), max_size=40), n=st.integers(0, 45))
def test_first_n_is_exact(spark, ids, n):
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    assert sorted(r[0] for r in first_n(df, by_column("id"), n).collect()) == sorted(ids)[:n]
    if n:
        assert seeded_sample(df, ["id"], n).count() == min(n, len(ids))


@pytest.mark.parametrize("n, n_eval", [(0, 0), (1, 1), (2, 1), (40, 2), (119, 5), (100, 5)])
def test_split_holds_out_the_exact_number(spark, n, n_eval):
    df = spark.range(n).repartition(4)
    got = {r["id"]: r["split"] for r in exact_split(df, ["id"]).collect()}
    assert len(got) == n and sum(v == "eval" for v in got.values()) == n_eval
    order = [r["id"] for r in global_index(df, shuffled("id")).orderBy("position").collect()]
    assert {i for i, s in got.items() if s == "eval"} == set(order[n - n_eval:])


def test_split_is_seeded_and_train_is_all_minus_eval(spark):
    df = spark.range(500)
    a = exact_split(df, ["id"], SplitConfig(0.1, 1))
    held = a.filter("split = 'eval'")
    assert held.count() == 50
    assert {r[0] for r in without(df, held, ["id"]).collect()} == {r[0] for r in a.filter("split = 'train'").select("id").collect()}
    other = exact_split(df, ["id"], SplitConfig(0.1, 2)).filter("split = 'eval'")
    assert {r[0] for r in held.select("id").collect()} != {r[0] for r in other.select("id").collect()}
    share = df.select(hash_split(["id"], SplitConfig(0.1, 1)).alias("s")).filter("s = 'eval'").count()
    assert 20 < share < 90


def test_positions_are_a_permutation(spark):
    got = global_index(spark.range(1000).repartition(9), shuffled("id", seed=9), total="n").collect()
    assert sorted(r["position"] for r in got) == list(range(1000)) and {r["n"] for r in got} == {1000}


def test_last_attempt_of_each_step(spark):
    df = spark.createDataFrame([("r", 1, 5.0, 10.0), ("r", 1, 6.0, 11.0), ("r", 2, 7.0, 1.0)], "run string, step long, loss double, ts double")
    assert sorted(map(tuple, last_of_each(df, ["run", "step"], ["ts"]).collect())) == [("r", 1, 6.0, 11.0), ("r", 2, 7.0, 1.0)]


def turns(spark, data):
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(5)


def test_gaps_fail_unless_turns_are_renumbered(spark):
    gappy = turns(spark, [(1, 0, "user", "a"), (1, 7, "assistant", "b"), (2, -3, "user", "c"), (2, 2**40, "assistant", "d")])
    got = {r["conv_id"]: [tuple(m) for m in r["messages"]] for r in assemble_turns(gappy).collect()}
    assert got == {1: [("user", "a"), ("assistant", "b")], 2: [("user", "c"), ("assistant", "d")]}
    with pytest.raises(Exception, match="not numbered"):
        assemble_turns(gappy, dense=True).collect()
    twice = turns(spark, [(1, 0, "user", "a"), (1, 0, "user", "b"), (1, 2, "assistant", "b")])
    with pytest.raises(Exception, match="not numbered"):
        assemble_turns(twice, dense=True).collect()
    assert sorted(r["turn"] for r in number_turns(gappy).collect()) == [0, 0, 1, 1]


def test_a_huge_conversation_keeps_all_turns(spark):
    from turnloom.config import PrepConfig
    from turnloom.functions.template import ChatTemplate
    from turnloom.operators.examples import build_examples, build_plain_examples

    n = 3000
    long = [(1, i, "user" if i % 2 == 0 else "assistant", f"w{i}") for i in range(n)]
    late = [(2, 0, "user", "q"), (2, 1, "assistant", "a")] + [(2, i, "tool", "x") for i in range(2, n)]
    last = [(3, 0, "user", "q"), (3, 1, "user", "b"), (3, 2, "system", "late"), (3, 3, "assistant", "an answer")]
    df = turns(spark, long + late + last)
    whole = assemble_turns(df, dense=True)
    rows = {r["conv_id"]: r for r in whole.collect()}
    assert {i: len(r["messages"]) for i, r in rows.items()} == {1: n, 2: n, 3: 4}
    assert [m["content"] for m in rows[1]["messages"]] == [f"w{i}" for i in range(n)]
    assert rows[1]["facts"]["last_assistant"] == n - 1 and rows[1]["facts"]["alternates"] and not rows[2]["facts"]["alternates"]
    cfg = PrepConfig(max_seq_len=48)
    got = {r["conv_id"]: r for r in build_examples(whole, cfg).collect()}
    assert [got[i]["skip_reason"] for i in (1, 2, 3)] == ["too_short", None, None]
    # Messages without blanks between them: thousands of turns are one token.
    tight = build_examples(whole, cfg, ChatTemplate(prefix="<{role}>", suffix="</>", generation="<assistant>")).collect()
    assert {r["conv_id"]: (r["skip_reason"], r["n_tokens"]) for r in tight}[3] == (None, 2)
    plain = {r["conv_id"]: r for r in build_plain_examples(whole, cfg).collect()}
    assert plain[1]["n_unmasked"] == 2 and plain[3]["n_unmasked"] == 3


def test_numbering_is_checked_even_if_only_facts_are_read(spark):
    for bad in ([0, 7], [0, 0, 3, 3], [1, 2], [0, None]):
        df = turns(spark, [(1, i, "user", "a") for i in bad])
        with pytest.raises(Exception, match="not numbered"):
            assemble_turns(df, dense=True).select("facts.n_messages").collect()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 99])
def test_first_n_with_ties_nulls_and_text_keys(spark, n):
    df = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "id long")
    assert sorted((r[0] for r in first_n(df, by_column("id"), n).collect()), key=str) == sorted([1, 2, 2, 3, None][:n], key=str)
    assert first_n(df.withColumn("id", F.col("id").cast("string")), order_of(df.withColumn("id", F.col("id").cast("string")), "id"), n).count() == min(n, 5)
