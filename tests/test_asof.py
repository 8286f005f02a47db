"""The last record at or before an evaluation."""

import bisect

from pyspark.sql import functions as F

from turnloom.operators.ordered import by_column, ordered_scan
from turnloom.operators.runlog import train_val_gap

STEPS = [("a", 10, 1.0), ("a", 20, 2.0), ("a", 1 << 40, 3.0), ("b", 5, 4.0), (None, 1, 9.0), ("c", None, 9.0), ("d", 7, None)]
EVALS = [("a", 5, 0.5), ("a", 10, 0.5), ("a", 15, 0.5), ("a", 15, 0.25), ("a", 20, 0.5), ("a", 999_999, 0.5), ("a", 1 << 41, 0.5), ("b", 5, None),
         ("c", 3, 0.5), ("z", 3, 0.5), (None, 3, 0.5), ("a", None, 0.5), ("d", 8, 0.5)]


def frames(spark):
    steps = spark.createDataFrame(STEPS, "run_id string, step long, loss double")
    evals = spark.createDataFrame(EVALS, "run_id string, step long, val_loss double")
    return [df.withColumn("note", F.lit("x")).repartition(3) for df in (steps, evals)]


def test_every_evaluation_has_a_row(spark):
    got = train_val_gap(*frames(spark))
    assert got.columns == ["run_id", "step", "loss_step", "loss", "val_loss", "train_val_gap"]
    known = {("a", 10): (10, 1.0), ("a", 15): (10, 1.0), ("a", 20): (20, 2.0), ("a", 999_999): (20, 2.0), ("a", 1 << 41): (1 << 40, 3.0), ("b", 5): (5, 4.0), ("d", 8): (7, None)}
    want = [(run, step, *known.get((run, step), (None, None)), val) for run, step, val in EVALS]
    want = [(*w, None if w[3] is None or w[4] is None else w[3] - w[4]) for w in want]
    order = lambda r: [(v is not None, v) for v in r]
    assert sorted((tuple(r) for r in got.collect()), key=order) == sorted(want, key=order)
    none, one = frames(spark)[0].limit(0), frames(spark)[1]
    assert train_val_gap(none, one).where("loss IS NULL AND loss_step IS NULL").count() == len(EVALS)
    assert train_val_gap(frames(spark)[0], one.limit(0)).count() == 0


def test_a_run_over_many_blocks(spark):
    """One run of records far apart; evaluations whose record lies blocks behind."""
    steps = spark.range(3000).select(F.lit("hot").alias("run_id"), (F.col("id") * 70_001 + 3).alias("step"), F.col("id").cast("double").alias("loss"))
    evals = spark.range(2500).select(F.lit("hot").alias("run_id"), (F.col("id") * 83_017).alias("step"), F.lit(0.0).alias("val_loss"))
    logged = [i * 70_001 + 3 for i in range(3000)]
    for r in train_val_gap(steps, evals).collect():
        at = bisect.bisect_right(logged, r.step) - 1
        assert (r.loss_step, r.loss) == ((logged[at], float(at)) if at >= 0 else (None, None))
    plan = train_val_gap(steps, evals)._jdf.queryExecution().optimizedPlan().toString()
    assert "SortMergeJoin" not in plan and "RangeJoin" not in plan


def test_latest_beside_sums_and_lags(spark):
    df = spark.createDataFrame([(1, 5, None), (1, 70_000, 2), (1, 70_001, None), (1, 140_000, None), (1, 140_001, 3), (1, 1 << 50, None)], "g long, k long, v long")
    got = ordered_scan(df, by_column("k"), by=["g"], sums={"s": F.coalesce("v", F.lit(0))}, lags={"before": F.col("v")}, latest={"known": F.col("v")}).orderBy("k").collect()
    assert [(r.s, r.before, r.known) for r in got] == [(0, None, None), (0, None, None), (2, 2, 2), (2, None, 2), (2, None, 2), (5, 3, 3)]
