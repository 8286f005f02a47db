"""Queries on training-run logs and on request and response logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.config import DEFAULT_SYSTEM_PROMPT, LOG_EVERY
from turnloom.operators.chatlog import read_requests, read_requests_by_key, reassemble_responses
from turnloom.operators.runlog import (
    audit_learning_rate,
    console_evals,
    console_steps,
    every_nth_step,
    format_eval_line,
    format_step_line,
    latest_attempts,
    loss_at_steps,
    parse_console,
    run_summary,
    step_losses,
    step_times,
    train_val_gap,
)
from turnloom.plans import derive, sql
from turnloom.plans.registry import Tables, query
from turnloom.sources.readers import read_console, read_eval_log, read_step_log
from turnloom.sources.sinks import new_folder, store
from turnloom.streaming.responses import RESPONSE, RESULT, reassemble_stream

TRAJECTORY = (1, 100, 300, 700, 930, 1000, 1500, 1780, 2000)


def _console_lines(t: Tables):
    """Console output of all runs: a step line each, evaluations, and chatter."""
    steps = store(derive.run_log(t), "run-log")
    step_line = format_step_line(
        F.col("step"), F.col("loss"), F.col("lr"), F.col("grad_norm"), F.lit(117.0), F.lit(17500.0)
    )
    evals = derive.eval_log(steps)
    return (
        steps.select(step_line.alias("value"))
        .unionByName(evals.select(format_eval_line(F.col("step"), F.col("val_loss"), F.col("train_val_gap")).alias("value")))
        .unionByName(evals.select(F.format_string("[checkpoint] step %d", "step").alias("value")))
    )


@query(
    "console_log",
    f"""WITH {sql.RUN_LOG}, {sql.EVAL_LOG}
        SELECT 'step' AS kind, count(*) AS n_lines, sum(step)::BIGINT AS steps, round(sum(loss), 3) AS losses FROM run_log
        UNION ALL SELECT 'eval', count(*), coalesce(sum(step), 0)::BIGINT, round(coalesce(sum(round(val_loss, 4)), 0), 3) FROM eval_log
        UNION ALL SELECT 'other', count(*), 0, 0.0 FROM eval_log HAVING count(*) > 0""",
)
def console_log(t: Tables):
    path = new_folder(t.spark, "console")
    _console_lines(t).write.text(path)
    parsed = parse_console(read_console(t.spark, path))
    loss = F.coalesce("loss", "val_loss")
    per_kind = parsed.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.coalesce(F.sum("step"), F.lit(0)).alias("steps"),
        F.round(F.coalesce(F.sum(loss), F.lit(0.0)), 3).alias("losses"),
    )
    return per_kind


@query(
    "console_records",
    f"""WITH {sql.RUN_LOG}, {sql.EVAL_LOG}
        SELECT 'step' AS kind, step, round(loss, 4) AS value, round(grad_norm, 4) AS other FROM run_log
        UNION ALL SELECT 'eval', step, round(val_loss, 4), round(train_val_gap, 4) FROM eval_log""",
)
def console_records(t: Tables):
    parsed = parse_console(_console_lines(t))
    steps = console_steps(parsed).select(F.lit("step").alias("kind"), "step", F.col("loss").alias("value"), F.col("grad_norm").alias("other"))
    evals = console_evals(parsed).select(F.lit("eval").alias("kind"), "step", F.col("val_loss").alias("value"), F.col("train_val_gap").alias("other"))
    return steps.unionByName(evals)


@query(
    "structured_log",
    f"""WITH {sql.RUN_LOG}
        SELECT run_id, step, loss, round(ts, 6) AS ts FROM run_log""",
)
def structured_log(t: Tables):
    """A JSON step log in which a resumed run repeats every record once more."""
    steps = store(derive.run_log(t), "run-log")
    stale = steps.withColumns({"loss": F.col("loss") + 100, "ts": F.col("ts") - 3600})
    path = new_folder(t.spark, "step-log")
    stale.unionByName(steps).write.json(path)
    return latest_attempts(read_step_log(t.spark, path)).select(
        "run_id", "step", "loss", F.round("ts", 6).alias("ts")
    )


@query(
    "structured_eval_log",
    f"""WITH {sql.RUN_LOG}, {sql.EVAL_LOG}
        SELECT run_id, step, round(val_loss, 6) AS val_loss, round(train_val_gap, 6) AS train_val_gap FROM eval_log""",
)
def structured_eval_log(t: Tables):
    path = new_folder(t.spark, "eval-log")
    derive.eval_log(derive.run_log(t)).write.json(path)
    return read_eval_log(t.spark, path).select(
        "run_id", "step", F.round("val_loss", 6).alias("val_loss"), F.round("train_val_gap", 6).alias("train_val_gap")
    )


@query(
    "run_summary",
    f"""WITH {sql.RUN_LOG}, b AS (SELECT run_id, min(loss) AS best_loss FROM run_log GROUP BY run_id)
        SELECT run_id, count(*) AS n_steps, any_value(best_loss) AS best_loss, min(step) FILTER (WHERE loss = best_loss) AS best_step,
               arg_min(loss, step) AS first_loss, arg_max(loss, step) AS last_loss, max(step) AS last_step
        FROM run_log JOIN b USING (run_id) GROUP BY run_id""",
)
def summary(t: Tables):
    return run_summary(derive.run_log(t))


@query(
    "step_loss",
    """WITH micro AS (SELECT (user_id % 3)::VARCHAR AS run_id, value AS loss,
                             (row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) - 1) AS i FROM events)
       SELECT run_id, (i // 2 + 1)::BIGINT AS step, round(sum(loss / 2.0), 6) AS loss FROM micro GROUP BY 1, 2""",
)
def micro_losses(t: Tables):
    return step_losses(derive.micro_log(t)).withColumn("loss", F.round("loss", 6))


def _times_sql(records: str) -> str:
    """Time, throughput and pauses, with the steps of every pause counted one by one."""
    return f"""WITH {sql.RUN_LOG}, records AS (SELECT * FROM run_log WHERE {records}), timed AS (
          SELECT run_id, step, ts - lag(ts) OVER w AS dt, lag(step) OVER w AS prev_step FROM records
          WINDOW w AS (PARTITION BY run_id ORDER BY step))
        SELECT run_id, step, prev_step, step - prev_step AS steps_elapsed, round(dt / (step - prev_step), 6) AS step_time_s,
               round(2048.0 * (step - prev_step) / nullif(dt, 0), 3) AS nominal_tok_s,
               coalesce(len(list_filter(range(prev_step, step), lambda s: s > 0 AND (s % 100 = 0 OR s % 50 = 0))) > 0, false) AS after_pause FROM timed"""


def _rounded_times(log):
    return step_times(log).select(
        "run_id", "step", "prev_step", "steps_elapsed", F.round("step_time_s", 6).alias("step_time_s"),
        F.round("nominal_tok_s", 3).alias("nominal_tok_s"), "after_pause",
    )


@query("step_times", _times_sql("true"))
def timing(t: Tables):
    return _rounded_times(store(derive.run_log(t), "run-log"))


@query("step_times_decimated", _times_sql("step % 10 = 0"))
def timing_of_a_decimated_log(t: Tables):
    """The log as runs write it: every tenth step only."""
    return _rounded_times(store(every_nth_step(derive.run_log(t), LOG_EVERY), "run-log"))


@query(
    "log_records",
    f"WITH {sql.RUN_LOG} SELECT run_id, step, loss, round(lr, 12) AS lr FROM run_log WHERE step % 10 = 0",
)
def log_records(t: Tables):
    records = every_nth_step(derive.run_log(t), LOG_EVERY)
    return records.select("run_id", "step", "loss", F.round("lr", 12).alias("lr"))


@query(
    "train_val_gap",
    f"""WITH {sql.RUN_LOG}, {sql.EVAL_LOG}
        SELECT run_id, step, r.loss AS loss, round(val_loss, 6) AS val_loss, round(r.loss - val_loss, 6) AS train_val_gap
        FROM run_log r JOIN eval_log USING (run_id, step)""",
)
def gap(t: Tables):
    steps = store(derive.run_log(t), "run-log")
    return train_val_gap(steps, derive.eval_log(steps)).select(
        "run_id", "step", "loss", F.round("val_loss", 6).alias("val_loss"), F.round("train_val_gap", 6).alias("train_val_gap")
    )


@query(
    "train_val_gap_between_records",
    f"""WITH {sql.RUN_LOG}, records AS (SELECT run_id, step, loss FROM run_log WHERE step % 10 = 0),
          evals AS (SELECT run_id, step, loss * 0.5 + 1 AS val_loss FROM run_log WHERE step % 15 = 5 OR step < 4)
        SELECT e.run_id, e.step, r.step AS loss_step, r.loss, round(val_loss, 6) AS val_loss, round(r.loss - val_loss, 6) AS train_val_gap
        FROM evals e ASOF LEFT JOIN records r ON e.run_id = r.run_id AND e.step >= r.step""",
)
def gap_between_records(t: Tables):
    """A log of every tenth step, and evaluations that mostly fall between its records or before the first."""
    steps = store(derive.run_log(t), "run-log")
    evals = steps.filter((F.col("step") % 15 == 5) | (F.col("step") < 4)).select("run_id", "step", (F.col("loss") * 0.5 + 1).alias("val_loss"))
    return train_val_gap(every_nth_step(steps, LOG_EVERY), evals).select(
        "run_id", "step", "loss_step", "loss", F.round("val_loss", 6).alias("val_loss"), F.round("train_val_gap", 6).alias("train_val_gap")
    )


@query(
    "lr_audit",
    f"""WITH {sql.RUN_LOG}
        SELECT run_id, step, round(expected_lr, 12) AS expected_lr, round(expected_lr * 0.02, 14) AS expected_muon_lr,
               event_type <> 'error' AS lr_ok FROM run_log""",
)
def lr_audit(t: Tables):
    return audit_learning_rate(derive.run_log(t)).select(
        "run_id", "step", F.round("expected_lr", 12).alias("expected_lr"),
        F.round("expected_muon_lr", 14).alias("expected_muon_lr"), "lr_ok",
    )


@query(
    "loss_trajectory",
    f"""WITH {sql.RUN_LOG} SELECT run_id, step, loss FROM run_log WHERE step IN {TRAJECTORY} ORDER BY run_id, step""",
)
def trajectory(t: Tables):
    return loss_at_steps(derive.run_log(t), TRAJECTORY)


@query(
    "request_log",
    f"""SELECT conv_id AS request_id, true AS valid, md5('system={DEFAULT_SYSTEM_PROMPT}|' ||
               CASE WHEN conv_id % 3 = 0 THEN 'user=' || arg_min(text, turn) ELSE string_agg(role || '=' || text, '|' ORDER BY turn) END) AS digest,
               CASE conv_id % 3 WHEN 0 THEN 256 WHEN 1 THEN 128 ELSE 512 END::BIGINT AS max_tokens,
               CASE WHEN conv_id % 3 = 2 THEN 0.25 ELSE 0.7 END::DOUBLE AS temperature
        FROM conversations GROUP BY conv_id""",
)
def request_log(t: Tables):
    digest = F.md5(
        F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("="), m["content"])), "|")
    )
    return read_requests(derive.requests(t)).select(
        "request_id", "valid", digest.alias("digest"), "max_tokens", "temperature"
    )


def _state_sql(key: str, *types: str) -> str:
    kinds = ", ".join(f"'{t}'" for t in types)
    kind = f"json_type(body, '$.{key}')"
    return f"CASE WHEN NOT valid OR {kind} IS NULL THEN 'missing' WHEN {kind} = 'NULL' THEN 'null' WHEN {kind} IN ({kinds}) THEN 'given' ELSE 'mistyped' END"


_WHOLE = ("BIGINT", "UBIGINT")
_REQUEST_STATES = {"message": ("VARCHAR",), "messages": ("ARRAY",), "max_tokens": _WHOLE, "temperature": (*_WHOLE, "DOUBLE")}


@query(
    "requests_by_key",
    f"""WITH made AS (
          SELECT conv_id, arg_min(text, turn) AS first, to_json(list({{'role': role, 'content': text}} ORDER BY turn))::VARCHAR AS turns FROM conversations GROUP BY conv_id),
        bodies AS (
          SELECT conv_id, CASE conv_id % 6 WHEN 0 THEN '{{"message":' || to_json(first)::VARCHAR || '}}'
                   WHEN 1 THEN '{{"message":null,"max_tokens":null}}'
                   WHEN 2 THEN '{{"messages":' || turns || ',"max_tokens":128}}'
                   WHEN 3 THEN '{{"messages":"none","max_tokens":"12","temperature":1}}'
                   WHEN 4 THEN '{{"messages":[{{"role":"user"}},{{"content":null,"role":"tool"}}],"temperature":null}}'
                   ELSE CASE WHEN conv_id % 12 = 5 THEN '{{}}' ELSE '[1]' END END::JSON AS body FROM made),
        states AS (SELECT *, {", ".join(f"{_state_sql(k, *t)} AS s_{k}" for k, t in _REQUEST_STATES.items())}
                   FROM (SELECT *, json_type(body) = 'OBJECT' AS valid, conv_id % 6 < 2 AS single, conv_id % 6 > 1 AND conv_id % 2 = 1 AS streamed FROM bodies)),
        asked AS (
          SELECT *, CASE WHEN single THEN ['user=' || coalesce(CASE s_message WHEN 'missing' THEN '' WHEN 'given' THEN body->>'$.message' END, '?')]
                         WHEN s_messages = 'missing' THEN [] WHEN s_messages = 'given'
                         THEN list_transform((body->'$.messages')::JSON[], lambda m: coalesce(m->>'$.role', '?') || '=' || coalesce(m->>'$.content', '?')) END AS parts FROM states)
        SELECT conv_id AS request_id, valid, s_message || ' ' || s_messages || ' ' || s_max_tokens || ' ' || s_temperature AS states,
               CASE WHEN valid AND parts IS NOT NULL THEN md5(array_to_string(list_prepend('system={DEFAULT_SYSTEM_PROMPT}', parts), '|')) END AS digest,
               CASE WHEN valid THEN CASE s_max_tokens WHEN 'missing' THEN CASE WHEN streamed THEN 512 ELSE 256 END WHEN 'given' THEN (body->>'$.max_tokens')::BIGINT END END::BIGINT AS max_tokens,
               CASE WHEN valid THEN CASE s_temperature WHEN 'missing' THEN 0.7 WHEN 'given' THEN (body->>'$.temperature')::DOUBLE END END::DOUBLE AS temperature
        FROM asked""",
)
def requests_by_key(t: Tables):
    """Requests in which a key that is null is no key that is missing."""
    part = lambda m: F.concat(F.coalesce(m["role"], F.lit("?")), F.lit("="), F.coalesce(m["content"], F.lit("?")))
    digest = F.md5(F.array_join(F.transform("messages", part), "|"))
    states = F.concat_ws(" ", *[F.col(f"key_states.{k}") for k in _REQUEST_STATES])
    return read_requests_by_key(derive.keyed_requests(t)).select(
        "request_id", "valid", states.alias("states"), digest.alias("digest"), "max_tokens", "temperature"
    )


_RESPONSES_SQL = f"""SELECT conv_id || ':' || turn AS request_id, md5(regexp_replace(text, '^\\s+', '')) AS digest,
               len({sql.tokens('text')})::BIGINT AS n_chunks, CASE WHEN conv_id % 4 IN (1, 2) THEN 1 ELSE 0 END::BIGINT AS n_malformed,
               conv_id % 4 = 0 AS complete
        FROM conversations WHERE role = 'assistant'"""


@query("reassembled_responses", _RESPONSES_SQL)
def responses(t: Tables):
    return reassemble_responses(derive.chunks(t)).select(
        "request_id", F.md5("response").alias("digest"), "n_chunks", "n_malformed", "complete"
    )


_CHUNK_SCHEMA = "request_id string, seq bigint, raw string, ts timestamp"


@query("streamed_responses", _RESPONSES_SQL)
def responses_from_a_stream(t: Tables):
    """The same chunks as a stream of files, out of order, and a last file that lets event time pass."""
    sent = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq"))
    folder, path, state = (new_folder(t.spark, name) for name in ("chunks", "responses", "responses-state"))
    chunks = store(derive.chunks(t).select("request_id", "seq", "raw", sent.alias("ts")), "chunk-log")
    part = F.pmod(F.xxhash64("request_id", "seq"), F.lit(3))
    files = 0
    for k in (2, 0, 1):
        chunks.where(part == k).write.mode("append").json(folder)
        files = files or len(t.spark.read.schema(_CHUNK_SCHEMA).json(folder).inputFiles())
    closing = chunks.agg(F.lit("end of log").alias("request_id"), F.lit(0).cast("bigint").alias("seq"), F.lit("data: [DONE]").alias("raw"),
                         F.timestamp_seconds(F.lit(1_700_000_000) + F.max("seq") + 86_400).alias("ts"))
    closing.coalesce(1).write.mode("append").json(folder)
    # As many files at a time as one part has, so that the parts arrive one after the other.
    stream = t.spark.readStream.schema(_CHUNK_SCHEMA).option("maxFilesPerTrigger", max(1, files)).json(folder)
    made = reassemble_stream(stream, delay="12 hours", lifetime="1 hour")
    made.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    out = t.spark.read.schema(RESULT).parquet(path).where((F.col("kind") == RESPONSE) & (F.col("request_id") != "end of log"))
    return out.select("request_id", F.md5("response").alias("digest"), "n_chunks", "n_malformed", "complete")
