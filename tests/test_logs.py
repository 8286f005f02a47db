"""Run logs, schedule, evaluation, chat logs: known answers and edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from turnloom.config import LogSettings, ScheduleConfig
from turnloom.functions.schedule import learning_rate
from turnloom.operators.chatlog import read_requests, reassemble_responses
from turnloom.operators.evaluate import (
    compare_models,
    compare_samples,
    first_batches_mean_loss,
    generate_responses,
    generation_previews,
    generation_summary,
    mean_loss,
    perplexity_summary,
    running_perplexity,
)
from turnloom.operators.ordered import by_column
from turnloom.operators.runlog import (
    audit_learning_rate,
    console_steps,
    every_nth_step,
    format_eval_line,
    format_step_line,
    loss_at_steps,
    parse_console,
    run_summary,
    step_losses,
    step_times,
    train_val_gap,
)
from turnloom.plans.evaluate import score_sample, scoring_inputs
from turnloom.sources.readers import read_console


def rates(spark, steps, cfg):
    df = spark.createDataFrame([(s,) for s in steps], "step long")
    return [r[0] for r in df.select("step", learning_rate(F.col("step"), cfg).alias("lr")).orderBy("step").select("lr").collect()]


def test_schedule_known_answers(spark):
    got = rates(spark, [0, 49, 50, 1000, 1025, 1999, 2000, 2500], ScheduleConfig())
    want = [4e-06, 2e-4, 2e-4, 0.000108825264, 0.000105, 1.0000123e-05, 1e-05, 1e-05]
    assert [round(x, 12) for x in got] == want


def test_schedule_properties(spark):
    cfg = ScheduleConfig(max_steps=1000, warmup_steps=100, lr=3e-4)
    first, peak, middle, last = rates(spark, [0, 100, 500, 999], cfg)
    assert first > 0 and abs(peak - 3e-4) < 1e-6 and peak > middle > last
    assert rates(spark, [0, 5, 10], ScheduleConfig(max_steps=10, warmup_steps=0, lr=1.0, min_lr=0.0)) == [1.0, 0.5, 0.0]
    assert rates(spark, [0, 9, 10], ScheduleConfig(max_steps=10, warmup_steps=10, lr=1.0, min_lr=0.0)) == pytest.approx([0.1, 1.0, 0.0])


def test_audit_compares_with_the_step_before(spark):
    df = spark.createDataFrame([("r", 1, 4e-6, 8e-8), ("r", 51, 2e-4, 4e-6), ("r", 60, 2e-4, 4e-6), ("r", 70, None, 1.0)],
                               "run_id string, step long, lr double, muon_lr double")
    assert {r["step"]: r["lr_ok"] for r in audit_learning_rate(df).collect()} == {1: True, 51: True, 60: False, 70: False}
    loose = audit_learning_rate(df.drop("muon_lr"), rel_tol=0.01)
    assert {r["step"]: r["lr_ok"] for r in loose.collect()} == {1: True, 51: True, 60: True, 70: False}


def test_console_lines(spark):
    lines = [
        "Step     10 | Loss 3.8200 | LR 4.00e-06 | GradNorm 1.2500 | 117 tok/s | 17500 ms/step",
        "Step 123456 | Loss nan | LR 2.00e-04 | GradNorm inf | 0 tok/s | 1 ms/step",
        "  └─ Eval @ step 500: val_loss=1.0400, train_val_gap=-0.4700",
        "[checkpoint] saved", "", None, "Step x | Loss",
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = parse_console(df).collect()
    assert [r["kind"] for r in got] == ["step", "step", "eval", "other", "other", "other", "other"]
    a, b, c = got[:3]
    assert (a["step"], a["loss"], a["lr"], a["grad_norm"], a["tokens_per_sec"], a["step_time_ms"]) == (10, 3.82, 4e-6, 1.25, 117.0, 17500.0)
    assert b["step"] == 123456 and math.isnan(b["loss"]) and b["grad_norm"] == math.inf
    assert (c["step"], c["val_loss"], c["train_val_gap"], c["loss"]) == (500, 1.04, -0.47, None)
    one = spark.range(1)
    assert one.select(format_step_line(F.lit(10).cast("bigint"), F.lit(3.82), F.lit(4e-6), F.lit(1.25), F.lit(117.0), F.lit(17500.0))).first()[0] == lines[0]
    assert one.select(format_eval_line(F.lit(500).cast("bigint"), F.lit(1.04), F.lit(-0.47))).first()[0] == lines[2]


def test_published_run(spark):
    losses = {0: 3.82, 100: 0.92, 300: 0.66, 700: 0.37, 930: 0.26, 1000: 0.88, 1500: 1.67, 1780: 0.038, 2000: 0.57}
    log = spark.createDataFrame([("r", s, v) for s, v in losses.items()], "run_id string, step long, loss double")
    s = run_summary(log).first()
    assert (s["best_loss"], s["best_step"], s["first_loss"], s["last_loss"], s["last_step"]) == (0.038, 1780, 3.82, 0.57, 2000)
    evals = spark.createDataFrame([("r", 2000, 1.04)], "run_id string, step long, val_loss double")
    assert round(train_val_gap(log, evals).first()["train_val_gap"], 2) == -0.47
    assert [r["loss"] for r in loss_at_steps(log, [930, 0, 5]).collect()] == [3.82, 0.26]
    ties = spark.createDataFrame([("r", 5, 1.0), ("r", 2, 1.0)], "run_id string, step long, loss double")
    assert run_summary(ties).first()["best_step"] == 2


def test_step_times(spark):
    log = spark.createDataFrame([("a", s, 17.5 * s, 700) for s in range(1, 102)] + [("b", 7, 3.0, 1)], "run_id string, step long, ts double, n_tokens long")
    cfg = LogSettings(pause_every=(100, 50))
    rows = {(r["run_id"], r["step"]): r for r in step_times(log, cfg).collect()}
    assert rows["a", 1]["step_time_s"] is None and rows["b", 7]["nominal_tok_s"] is None
    assert round(rows["a", 2]["nominal_tok_s"]) == 117 and rows["a", 2]["actual_tok_s"] == 40.0
    assert [s for (run, s), r in rows.items() if r["after_pause"]] == [51, 101] or {s for (run, s), r in rows.items() if r["after_pause"]} == {51, 101}
    starts = spark.createDataFrame([("a", 0, 0.0)], "run_id string, step long, ts double")
    rows = {(r["run_id"], r["step"]): r for r in step_times(log, cfg, starts).collect()}
    assert len(rows) == 102 and rows["a", 1]["step_time_s"] == 17.5
    every_tenth = {r["step"]: r for r in step_times(log.filter("run_id = 'a' AND step % 10 = 0"), cfg).collect()}
    assert {(r["steps_elapsed"], r["step_time_s"], round(r["nominal_tok_s"]), r["actual_tok_s"]) for s, r in every_tenth.items() if s > 10} == {(10, 17.5, 117, 40.0)}
    assert [s for s, r in sorted(every_tenth.items()) if r["after_pause"]] == [60]
    same = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 1.0)], "run_id string, step long, ts double")
    assert {r["nominal_tok_s"] for r in step_times(same).collect()} == {None}


def test_step_losses_and_decimation(spark):
    micro = spark.createDataFrame([("r", 1, 0, 2.0), ("r", 1, 1, 4.0), ("r", 2, 0, 1.0)], "run_id string, step long, micro long, loss double")
    assert {r["step"]: r["loss"] for r in step_losses(micro).collect()} == {1: 3.0, 2: 0.5}
    assert every_nth_step(spark.range(1, 31).withColumnRenamed("id", "step"), 10).count() == 3
    assert every_nth_step(micro, 0).count() == 0


def scores(spark, data, model=None):
    return spark.createDataFrame(data, "sample_id long, loss double, n_tokens long")


def test_perplexity_weighs_tokens(spark):
    df = scores(spark, [(1, 1.0, 30), (2, 3.0, 10)])
    got = perplexity_summary(df).first()
    assert got["avg_loss"] == 1.5 and got["perplexity"] == pytest.approx(math.exp(1.5)) and got["total_tokens"] == 40
    assert perplexity_summary(df.limit(0)).first()["perplexity"] is None
    better = compare_models(df, scores(spark, [(1, 1.0, 30)])).first()
    assert better["verdict"] == "better" and better["improvement"] == pytest.approx(math.exp(1.5) - math.e)
    assert compare_models(df, df).first()["verdict"] == "worse"
    both = {r["sample_id"]: (r["improvement"], r["verdict"], r["n_tokens"]) for r in compare_samples(df, scores(spark, [(2, 4.0, 10), (9, 0.0, 1)])).collect()}
    assert both == {1: (None, None, 30), 2: (-1.0, "worse", 10), 9: (None, None, 1)}


def test_running_perplexity_equals_a_loop(spark):
    data = [("m" if i % 4 else "n", i, (i * 37 % 11) / 3, i % 9 + 1) for i in range(1, 9000)]
    df = spark.createDataFrame(data, "model string, i long, loss double, n_tokens long").repartition(6)
    got = {(r["model"], r["i"]): r["perplexity"] for r in running_perplexity(df, every=1000).collect()}
    want = {}
    for model in ("m", "n"):
        num = den = 0
        for _, i, loss, n in (d for d in data if d[0] == model):
            num, den = num + loss * n, den + n
            if i % 1000 == 0:
                want[model, i] = math.exp(num / den)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_mean_losses(spark):
    df = scores(spark, [(i, float(i), 1) for i in range(7)])
    assert tuple(mean_loss(df).first()) == (3.0, 7) and tuple(mean_loss(df.limit(0)).first()) == (0.0, 0)
    for k in (1, 3, 7, 10, 20):
        want = sum(i % 7 for i in range(k)) / k
        got = first_batches_mean_loss(df, by_column("sample_id"), k).first()
        assert got["val_loss"] == pytest.approx(want) and got["n_batches"] == k
    assert tuple(first_batches_mean_loss(df.limit(0), by_column("sample_id"), 5).first()) == (0.0, 0)


def test_generation(spark):
    def load():
        def generate(prompt):
            return prompt * 2, len(prompt)

        return generate

    prompts = spark.createDataFrame([("ab",), ("abcd",)], "prompt string").coalesce(1)
    got = generate_responses(prompts, load, clock=counting_clock())
    assert {r["prompt"]: (r["response"], r["tokens"], r["latency_s"], r["tok_per_sec"]) for r in got.collect()} == {
        "ab": ("abab", 2, 2.0, 1.0), "abcd": ("abcdabcd", 4, 2.0, 2.0)
    }
    s = generation_summary(got).first()
    assert (s["n"], s["avg_tok_per_sec"], s["overall_tok_per_sec"], s["median_tokens"]) == (2, 1.5, 1.5, 3.0)
    long = spark.createDataFrame([("p" * 70, "r" * 300)], "prompt string, response string")
    r = generation_previews(long).first()
    assert (r["prompt_preview"], r["response_preview"]) == ("p" * 60 + "...", "r" * 200 + "...")


def counting_clock():
    """Each reading is two seconds after the one before."""
    now = [0.0]

    def clock():
        now[0] += 2.0
        return now[0]

    return clock


def test_score_sample(spark):
    rows = spark.range(300).select(F.col("id").alias("sample_id"), F.lit("do it").alias("instruction"), F.lit("done").alias("output"))
    got = score_sample(rows, "sample_id", lambda: (lambda batch: batch["n_tokens"] * 0 + 1.5), n_samples=40)
    assert got.count() == 40 and got.filter("n_tokens = 7 AND loss BETWEEN 0 AND 4").count() == 40


def test_half_pairs_are_not_scored(spark):
    rows = spark.createDataFrame([(1, "do", "done"), (2, "do", None), (3, None, "done")], "sample_id long, instruction string, output string")
    got = {r["sample_id"]: (r["skip_reason"], r["n_tokens"]) for r in scoring_inputs(rows).collect()}
    assert got == {1: (None, 6), 2: ("render_error", None), 3: ("render_error", None)}


def test_run_id_of_console_files(spark, tmp_path):
    for run in ("alpha", "beta-2"):
        spark.createDataFrame([("Step      1 | Loss 2.0000 | LR 4.00e-06 | GradNorm 1.0000 | 117 tok/s | 17500 ms/step",)], "value string").coalesce(1).write.text(str(tmp_path / run))
    got = console_steps(parse_console(read_console(spark, str(tmp_path / "*"), r"/([^/]+)/[^/]*$")))
    assert {(r["run_id"], r["step"], r["loss"]) for r in got.collect()} == {("alpha", 1, 2.0), ("beta-2", 1, 2.0)}


def test_requests_take_defaults(spark):
    bodies = [
        (0, "/generate", '{"message": "hi"}'), (1, "/generate", "{}"), (2, "/chat", '{"max_tokens": 9, "temperature": 0}'),
        (3, "/chat/stream", '{"messages": [{"role": "system", "content": "x"}], "max_tokens": null}'),
        (4, "/chat", "not json"), (5, "/chat", None), (6, "/chat", '{"messages": '),
    ]
    df = spark.createDataFrame(bodies, "request_id long, endpoint string, body string")
    got = {r["request_id"]: r for r in read_requests(df, "P").collect()}
    show = lambda i: ([tuple(m) for m in got[i]["messages"]], got[i]["max_tokens"], got[i]["temperature"])
    assert show(0) == ([("system", "P"), ("user", "hi")], 256, 0.7)
    assert show(1) == ([("system", "P"), ("user", "")], 256, 0.7)
    assert show(2) == ([("system", "P")], 9, 0.0)
    assert show(3) == ([("system", "P"), ("system", "x")], 512, 0.7)
    assert [got[i]["valid"] for i in range(7)] == [True] * 4 + [False] * 3
    assert got[4]["messages"] is None and got[4]["max_tokens"] is None


def test_chunks(spark):
    def line(text):
        return 'data: {"content": "%s"}\n\n' % text

    data = [(1, i, line(f"w{i} ")) for i in range(9000)] + [(1, 9000, "data: [DONE]\n\n"), (1, 9001, line("late")), (1, 20000, line("later"))]
    data += [(2, 0, line("a")), (2, 1, line("")), (2, 2, "data: {}"), (2, 3, ": comment"), (2, 4, line("b"))]
    data += [(3, 0, "data: [DONE]"), (4, 5, None)]
    data += [(5, 0, line("a")), (5, 1, 'data: {"content": "b'), (5, 2, line("c")), (5, 2, line("c")), (5, 3, "data: [DONE]")]
    data += [(6, 0, line("a")), (6, 1, "data: x"), (6, 1, line("b")), (6, 2, "data: [DONE]"), (6, 3, "data: x")]
    df = spark.createDataFrame(data, "request_id long, seq long, raw string").repartition(6)
    got = {r["request_id"]: (r["response"], r["n_chunks"], r["n_malformed"], r["complete"]) for r in reassemble_responses(df).collect()}
    assert got == {1: ("".join(f"w{i} " for i in range(9000)), 9000, 0, True), 2: ("ab", 2, 0, False), 3: ("", 0, 0, True), 4: ("", 0, 0, False),
                   5: ("ac", 2, 1, False), 6: ("ab", 2, 0, True)}
