"""Building blocks of the comparison SQL."""

from __future__ import annotations

from turnloom.config import DEFAULT_SEED, DEFAULT_SYSTEM_PROMPT

NL = "chr(10)"


def rendered(role: str, content: str) -> str:
    return f"('<|' || {role} || '|>' || {NL} || {content} || {NL} || '<|end|>' || {NL})"


def tokens(text: str) -> str:
    return f"regexp_extract_all({text}, '\\S+')"


def token_ids(toks: str) -> str:
    return f"list_transform({toks}, lambda w: ('0x' || substr(md5(w), 1, 7))::BIGINT)"


def hash_key(*ids: str, seed: int = DEFAULT_SEED) -> str:
    text = " || ':' || ".join([f"'{seed}'", *ids])
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


HEAD = f"split_part(text, {NL}, 1)"
REST = f"substr(text, length({HEAD}) + 2)"
EXTRA = f"split_part({REST}, {NL}, 1)"
AFTER_EXTRA = f"substr({REST}, length({EXTRA}) + 2)"

FACTS = """facts AS (
  SELECT conv_id, count(*) AS n_messages, bool_or(role = 'user') AS has_user,
         bool_or(role = 'assistant') AS has_assistant, bool_or(role = 'system') AS has_system,
         coalesce(max(CASE WHEN role = 'assistant' THEN turn END), -1) AS last_assistant
  FROM conversations GROUP BY conv_id)"""

_SYSTEM = f"CASE WHEN has_system THEN '' ELSE {rendered(chr(39) + 'system' + chr(39), chr(39) + DEFAULT_SYSTEM_PROMPT + chr(39))} END"

TEXTS = f"""texts AS (
  SELECT conv_id, any_value(f.has_user AND f.has_assistant) AS eligible, any_value(f.has_assistant) AS has_assistant,
         any_value({_SYSTEM}) || string_agg({rendered('role', 'text')}, '' ORDER BY turn) AS full_text,
         any_value({_SYSTEM}) || coalesce(string_agg({rendered('role', 'text')}, '' ORDER BY turn)
             FILTER (WHERE turn < f.last_assistant), '') || '<|assistant|>' || {NL} AS prompt_text,
         any_value({_SYSTEM}) || coalesce(string_agg({rendered('role', 'text')}, '' ORDER BY turn)
             FILTER (WHERE turn <= f.last_assistant), '') AS answer_text
  FROM conversations JOIN facts f USING (conv_id) GROUP BY conv_id)"""


def examples(max_len: int, masked_tail: bool = False) -> str:
    """CTEs up to ``examples(conv_id, skip_reason, ids, n_tokens, prompt_len, answer_end)``."""
    end = f"least({max_len}, len({tokens('answer_text')}))" if masked_tail else str(max_len)
    return f"""WITH {FACTS}, {TEXTS}, enc AS (
  SELECT conv_id, eligible, {token_ids(f"{tokens('full_text')}[1:{max_len}]")} AS ids,
         least({max_len}, len({tokens('prompt_text')})) AS prompt_len, {end} AS answer_end
  FROM texts), examples AS (
  SELECT conv_id, ids, len(ids) AS n_tokens, prompt_len, answer_end,
         CASE WHEN NOT eligible THEN 'missing_role'
              WHEN prompt_len >= len(ids) OR answer_end <= prompt_len THEN 'too_short' END AS skip_reason
  FROM enc)"""


SCORES = f"""docs AS (
  SELECT doc_id AS sample_id, len({tokens('text')}) AS n_tokens,
         row_number() OVER (ORDER BY {hash_key('doc_id')}, doc_id) AS i FROM documents),
scores AS (
  SELECT model, sample_id, i, n_tokens,
         ('0x' || substr(md5(model || ':' || sample_id), 1, 4))::BIGINT / 65535.0 * 4 AS loss
  FROM docs, (VALUES ('base'), ('tuned')) m(model))"""

_LR = """CASE WHEN i < 50 THEN 2e-4 * (i + 1) / 50
              WHEN i >= 2000 THEN 1e-5
              ELSE 1e-5 + 0.5 * (1 + cos(pi() * (i - 50) / 1950.0)) * (2e-4 - 1e-5) END"""

RUN_LOG = f"""numbered AS (
  SELECT event_id, (user_id % 3)::VARCHAR AS run_id, value, ts, event_type,
         row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) - 1 AS i FROM events),
run_log AS (
  SELECT run_id, i + 1 AS step, value AS loss, {_LR} AS expected_lr,
         {_LR} * (CASE WHEN event_type = 'error' THEN 1.05 ELSE 1.0 END) AS lr,
         value / 10 AS grad_norm, epoch_us(ts) / 1e6 AS ts, event_type
  FROM numbered)"""

EVAL_LOG = """eval_log AS (
  SELECT run_id, step, loss * 0.5 + 1 AS val_loss, loss - (loss * 0.5 + 1) AS train_val_gap
  FROM run_log WHERE step % 100 = 0)"""
