"""Training-run logs: reading console output, timing, schedule and loss checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.config import LogSettings, ScheduleConfig
from turnloom.functions.schedule import learning_rate, scaled_rate
from turnloom.operators.examples import computed_once
from turnloom.operators.ordered import by_column, last_of_each, ordered_scan

# The layout of console lines.
_NUMBER = r"([-+]?(?:\d+\.?\d*(?:[eE][-+]?\d+)?|nan|inf))"
STEP_LINE = (
    rf"^Step\s+(\d+) \| Loss {_NUMBER} \| LR {_NUMBER} \| GradNorm {_NUMBER}"
    rf" \| {_NUMBER} tok/s \| {_NUMBER} ms/step$"
)
EVAL_LINE = rf"Eval @ step (\d+): val_loss={_NUMBER}, train_val_gap={_NUMBER}"
STEP_LAYOUT = "Step %6d | Loss %.4f | LR %.2e | GradNorm %.4f | %.0f tok/s | %.0f ms/step"
EVAL_LAYOUT = "  └─ Eval @ step %d: val_loss=%.4f, train_val_gap=%+.4f"
STEP_FIELDS = ("step", "loss", "lr", "grad_norm", "tokens_per_sec", "step_time_ms")
EVAL_FIELDS = ("step", "val_loss", "train_val_gap")


def _groups(line: Column, pattern: str, n: int) -> Column:
    """All groups of a matching line from one pass of its pattern."""
    groups = ",".join(f"${i}" for i in range(1, n + 1))
    return F.split(F.regexp_replace(line, f"^.*?{pattern.removeprefix('^')}.*$", groups), ",")


def parse_console(lines: DataFrame, line: str = "value") -> DataFrame:
    """Add ``kind`` (step, eval or other) and the numbers of each line.

    Lines of neither layout keep null numbers; none is dropped.
    """
    text = F.col(line)
    is_step, is_eval = F.rlike(text, F.lit(STEP_LINE)), F.rlike(text, F.lit(EVAL_LINE))
    kind = F.when(is_step, "step").when(is_eval, "eval").otherwise("other")
    # One array per line, worked out once however many fields are read from it.
    step, evaluation = F.col("kind") == "step", F.col("kind") == "eval"
    parts = F.when(step, _groups(text, STEP_LINE, len(STEP_FIELDS))).when(evaluation, _groups(text, EVAL_LINE, len(EVAL_FIELDS)))
    out = computed_once(computed_once(lines.withColumn("kind", kind), ["kind"]).withColumn("__parts", parts), ["__parts"])

    def field(names: Sequence[str], name: str) -> Column:
        return F.get("__parts", F.lit(names.index(name))).try_cast("bigint" if name == "step" else "double")

    fields = {n: F.when(step, field(STEP_FIELDS, n)) for n in STEP_FIELDS}
    for name in EVAL_FIELDS:
        value = F.when(evaluation, field(EVAL_FIELDS, name))
        fields[name] = F.coalesce(fields[name], value) if name in fields else value
    return out.withColumns(fields).drop("__parts")


def console_steps(parsed: DataFrame) -> DataFrame:
    rest = [c for c in parsed.columns if c not in ("kind", "value", *EVAL_FIELDS, *STEP_FIELDS)]
    return parsed.filter(F.col("kind") == "step").select(*rest, *STEP_FIELDS)


def console_evals(parsed: DataFrame) -> DataFrame:
    rest = [c for c in parsed.columns if c not in ("kind", "value", *EVAL_FIELDS, *STEP_FIELDS)]
    return parsed.filter(F.col("kind") == "eval").select(*rest, *EVAL_FIELDS)


def format_step_line(step: Column, loss: Column, lr: Column, grad_norm: Column,
                     tokens_per_sec: Column, step_time_ms: Column) -> Column:
    """One console line of a step record."""
    return F.format_string(STEP_LAYOUT, step, loss, lr, grad_norm, tokens_per_sec, step_time_ms)


def format_eval_line(step: Column, val_loss: Column, gap: Column) -> Column:
    """One console line of an evaluation."""
    return F.format_string(EVAL_LAYOUT, step, val_loss, gap)


def latest_attempts(log: DataFrame, version: Sequence[str] = ("ts",)) -> DataFrame:
    """One record per run and step: a resumed run repeats steps, the last counts."""
    return last_of_each(log, ("run_id", "step"), version)


def step_losses(micro_log: DataFrame, run: LogSettings = LogSettings()) -> DataFrame:
    """Step loss as the sum of micro-batch losses over the accumulation count."""
    share = F.col("loss") / F.lit(float(run.accumulation))
    return micro_log.groupBy("run_id", "step").agg(F.sum(share).alias("loss"))


def step_times(
    log: DataFrame, run: LogSettings = LogSettings(), starts: DataFrame | None = None
) -> DataFrame:
    """Add ``prev_step, steps_elapsed, step_time_s, nominal_tok_s, after_pause``.

    Time runs from the previous record of the run, and is that of one step on
    average where the log leaves steps out; the first record has none unless
    ``starts`` (``run_id, step, ts``) tells when the loop began. Throughput is
    nominal: full sequences, whatever they held; with an ``n_tokens`` column
    (tokens of a step) ``actual_tok_s`` is added. ``after_pause`` marks records
    that are charged with an evaluation or checkpoint, which follows any of the
    steps from the previous record on.
    """
    rows = log
    if starts is not None:
        rows = log.withColumn("__start", F.lit(False)).unionByName(
            starts.select("run_id", "step", "ts", F.lit(True).alias("__start")),
            allowMissingColumns=True,
        )
    timed = ordered_scan(
        rows,
        by_column("step"),
        by=["run_id"],
        lags={"prev_step": F.col("step"), "__prev_ts": F.col("ts")},
    )
    if starts is not None:
        timed = timed.filter(~F.col("__start")).drop("__start")
    elapsed = F.col("step") - F.col("prev_step")
    seconds = F.try_divide(F.col("ts") - F.col("__prev_ts"), elapsed)
    paused = F.lit(False)
    for interval in (k for k in run.pause_every if k > 0):
        # A multiple among prev_step .. step - 1, step 0 aside.
        first, last = F.greatest(F.col("prev_step"), F.lit(1)) - 1, F.col("step") - 1
        paused = paused | (F.floor(last / interval) > F.floor(first / interval))
    timed = timed.withColumns({"steps_elapsed": elapsed, "step_time_s": seconds}).withColumns(
        {
            "nominal_tok_s": F.try_divide(F.lit(float(run.tokens_per_step)), F.col("step_time_s")),
            "after_pause": F.coalesce(paused & F.col("prev_step").isNotNull(), F.lit(False)),
        }
    )
    if "n_tokens" in log.columns:
        timed = timed.withColumn("actual_tok_s", F.try_divide("n_tokens", "step_time_s"))
    return timed.drop("__prev_ts")


def every_nth_step(log: DataFrame, every: int, step: str = "step") -> DataFrame:
    """Records whose step is a multiple of ``every``; 0 or less gives none."""
    return log.filter(F.col(step) % every == 0) if every > 0 else log.limit(0)


def train_val_gap(step_log: DataFrame, eval_log: DataFrame) -> DataFrame:
    """``run_id, step, loss_step, loss, val_loss, train_val_gap`` of every evaluation.

    The loss is that of the run's last record at or before the evaluation, and
    ``loss_step`` the step of it: logs leave steps out. Before the first record,
    in a run without one, and where the run or the step is not known (null), both
    are null. Of several records of one step any may be taken, so hand in
    ``latest_attempts``. The gap is train minus validation: negative means
    validation is worse.

    One scan over both logs in order of step; no run is ever in one window.
    """
    record = F.when(F.col("step").isNotNull(), F.struct(F.col("step").alias("loss_step"), "loss"))
    steps = step_log.filter("run_id IS NOT NULL").select("run_id", "step", F.lit(0).alias("__kind"), F.lit(None).cast("double").alias("val_loss"), record.alias("__record"))
    evals = eval_log.select("run_id", "step", F.lit(1).alias("__kind"), F.col("val_loss").cast("double").alias("val_loss"), F.lit(None).cast(steps.schema["__record"].dataType).alias("__record"))
    both = ordered_scan(steps.unionByName(evals), by_column("step", "__kind"), by=["run_id"], latest={"__at": F.col("__record")})
    found = both.filter("__kind = 1").select("run_id", "step", "__at.loss_step", "__at.loss", "val_loss")
    return found.withColumn("train_val_gap", F.col("loss") - F.col("val_loss"))


def run_summary(log: DataFrame) -> DataFrame:
    """Best, first and last loss of each run; the earliest step wins a tie."""
    return log.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.min("loss").alias("best_loss"),
        F.min_by("step", F.struct("loss", "step")).alias("best_step"),
        F.min_by("loss", "step").alias("first_loss"),
        F.max_by("loss", "step").alias("last_loss"),
        F.max("step").alias("last_step"),
    )


def audit_learning_rate(
    log: DataFrame, cfg: ScheduleConfig = ScheduleConfig(), rel_tol: float = 1e-6
) -> DataFrame:
    """Add ``expected_lr, expected_muon_lr, lr_ok``.

    A record tagged with step k was made with the rate of the 0-based step k-1.
    Rates read from console lines are rounded, so allow about 1% there.
    """
    expected = learning_rate(F.col("step") - 1, cfg)
    log = log.withColumns({"expected_lr": expected, "expected_muon_lr": scaled_rate(expected, cfg)})

    def close(name: str) -> Column:
        target = F.col(f"expected_{name}")
        return F.coalesce(F.abs(F.col(name) - target) <= F.abs(target) * rel_tol, F.lit(False))

    ok = close("lr")
    if "muon_lr" in log.columns:
        ok = ok & close("muon_lr")
    return log.withColumn("lr_ok", ok)


def loss_at_steps(log: DataFrame, steps: Sequence[int]) -> DataFrame:
    """Loss at chosen steps, in step order."""
    chosen = log.filter(F.col("step").isin([int(s) for s in steps]))
    return chosen.select("run_id", "step", "loss").orderBy("run_id", "step")
