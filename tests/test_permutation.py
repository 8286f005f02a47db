"""A keyed permutation of row numbers, in Python and in Spark, there and back."""

import pytest
from pyspark.sql import functions as F

from turnloom.operators.permutation import EpochOrder, examples_of_steps, halves, number_examples, permuted, steps_of_examples


def test_bijection_of_every_size():
    for n in range(1, 2001):
        order = EpochOrder(n, n % 3)
        a, b = halves(n)
        assert n <= a * b
        image = [order(x) for x in range(n)]
        assert sorted(image) == list(range(n))
        assert all(order(y, back=True) == x for x, y in enumerate(image))


def test_few_values_lie_beyond():
    for n in (10**6 + 3, 10**9 + 7, 10**12 + 39, 2**50 - 1):
        a, b = halves(n)
        assert 0 <= a * b - n <= a // 256 and EpochOrder(n, 0).walks() <= 3


@pytest.mark.parametrize("n, seed", [(1, 42), (2, 42), (7, 1), (97, 42), (1000, 7), (1999, 42)])
def test_columns_equal_python(spark, n, seed):
    orders = [EpochOrder(n, e, seed) for e in range(3)]
    walks = max(o.walks() for o in orders)
    df = spark.range(n).select(F.col("id").alias("x"), F.explode(F.array(*[F.lit(e).cast("bigint") for e in range(3)])).alias("epoch"))
    df = df.withColumn("y", permuted(F.col("x"), F.col("epoch"), n, walks, seed))
    for r in df.withColumn("back", permuted(F.col("y"), F.col("epoch"), n, walks, seed, back=True)).collect():
        assert (r.y, r.back) == (orders[r.epoch](r.x), r.x)


def test_large_numbers(spark):
    n = 10**12 + 39
    order = EpochOrder(n, 5)
    xs = [0, 1, n - 1, n // 2, 123_456_789_012]
    df = spark.createDataFrame([(x,) for x in xs], "x long").select("x", permuted(F.col("x"), F.lit(5), n, order.walks()).alias("y"))
    assert {r.x: r.y for r in df.collect()} == {x: order(x) for x in xs}


def test_steps_both_ways(spark):
    examples = spark.createDataFrame([(f"e{i}", "text") for i in range(13)], "id string, text string")
    index = number_examples(examples, "id")
    for first, last, per_step in ((0, 20, 2), (5, 6, 3), (30, 31, 4), (4, 4, 1)):
        one = examples_of_steps(index, 13, "id", first_step=first, last_step=last, per_step=per_step)
        other = steps_of_examples(index, 13, "id", first_step=first, last_step=last, per_step=per_step)
        assert one.columns == other.columns == ["step", "slot", "epoch", "id"]
        rows = sorted(map(tuple, one.collect()))
        assert rows == sorted(map(tuple, other.collect()))
        assert [(s, k) for s, k, _, _ in rows] == [(s, k) for s in range(first, last) for k in range(per_step)]
    whole = examples_of_steps(index, 13, "id", first_step=0, last_step=39, per_step=1).groupBy("epoch").agg(F.count_distinct("id").alias("n")).collect()
    assert sorted((r.epoch, r.n) for r in whole) == [(0, 13), (1, 13), (2, 13)]
    assert examples_of_steps(index.limit(0), 0, "id", first_step=0, last_step=9, per_step=1).count() == 0
    assert steps_of_examples(index.limit(0), 0, "id", first_step=0, last_step=9, per_step=1).count() == 0
    with pytest.raises(ValueError):
        examples_of_steps(index, 13, "id", first_step=3, last_step=2, per_step=1)


def test_the_scan_moves_nothing(spark, tiny):
    index = spark.read.parquet(f"{tiny}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("row"))
    plan = steps_of_examples(index, 1500, "id", first_step=0, last_step=400, per_step=4)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and plan.count("md5") <= 4
