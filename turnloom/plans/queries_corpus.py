"""Queries on reading, normalising, mixing, filtering and splitting corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.config import DEFAULT_SYSTEM_PROMPT, PrepConfig, SourceSpec, SplitConfig
from turnloom.functions.messages import (
    conversation_facts,
    from_instruction,
    from_prompt_completion,
    inject_system,
    prepend_system,
    select_prompt,
)
from turnloom.functions.template import render_plain
from turnloom.operators.corpus import cap_per_group, concatenate, load_mixture, normalise, prepare_source
from turnloom.operators.examples import keep_eligible, render_texts
from turnloom.operators.json_rows import ROW_KEYS, normalise_lines
from turnloom.operators.ordered import by_column, first_n, global_index, order_of, shuffle_key, shuffled
from turnloom.operators.split import exact_split, hash_split, heldout_overlap, overlap_rate, seeded_sample, without
from turnloom.plans import derive, sql
from turnloom.plans.prepare import prepare_corpus
from turnloom.plans.registry import Tables, query
from turnloom.sources.readers import read_corpus
from turnloom.sources.sinks import new_folder, store

THINKING = "Reason first, then answer."


def _flat(messages: str = "messages"):
    """Digest of a message list, readable from SQL as well."""
    joined = F.array_join(
        F.transform(messages, lambda m: F.concat(m["role"], F.lit("="), m["content"])), "|"
    )
    return F.md5(joined).alias("digest")


@query(
    "load_split",
    """SELECT lang, count(*) AS n_rows, sum(n_chars)::BIGINT AS n_chars, sum(length(text))::BIGINT AS n_text
       FROM documents GROUP BY lang""",
)
def load_split(t: Tables):
    docs = read_corpus(t.spark, SourceSpec("documents", t.path("documents")))
    return docs.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("n_chars").alias("n_chars"),
        F.sum(F.length("text")).alias("n_text"),
    )


@query(
    "assemble_turns",
    """SELECT conv_id, count(*) AS n_messages,
              md5(string_agg(role || '=' || text, '|' ORDER BY turn)) AS digest,
              bool_or(role = 'user') AS has_user, bool_or(role = 'assistant') AS has_assistant,
              bool_or(role = 'system') AS has_system,
              coalesce(max(CASE WHEN role = 'assistant' THEN turn END), -1)::BIGINT AS last_assistant
       FROM conversations GROUP BY conv_id""",
)
def assembled(t: Tables):
    facts = F.col("facts")
    return derive.conversations(t).select(
        "conv_id", facts["n_messages"].alias("n_messages"), _flat(),
        *[facts[c].alias(c) for c in ("has_user", "has_assistant", "has_system", "last_assistant")],
    )


@query(
    "format_dispatch",
    f"""SELECT doc_id,
         CASE doc_id % 5 WHEN 0 THEN 'messages' WHEN 1 THEN 'conversations' WHEN 2 THEN 'prompt'
                         WHEN 3 THEN 'instruction' END AS format,
         CASE WHEN doc_id % 5 < 4 THEN md5(CASE doc_id % 5
             WHEN 3 THEN 'user=' || {sql.HEAD} || CASE WHEN doc_id % 3 = 0 OR {sql.EXTRA} = '' THEN '' ELSE chr(10) || chr(10) || {sql.EXTRA} END
                         || '|assistant=' || {sql.AFTER_EXTRA}
             ELSE 'user=' || {sql.HEAD} || '|assistant=' || {sql.REST} END) END AS digest
        FROM documents""",
)
def format_dispatch(t: Tables):
    """One table with the columns of all layouts; each row fills in one of them.

    Rows of the two list layouts hold prompt and completion as well, which the
    order of precedence must ignore.
    """
    pairs = derive.both_layouts(t.documents)
    kind = F.col("doc_id") % 5
    prompt, completion = F.col("prompt"), F.col("completion")
    speakers = F.array(
        F.struct(F.lit("human").alias("from"), prompt.alias("value")),
        F.struct(F.lit("gpt").alias("from"), completion.alias("value")),
    )
    mixed = pairs.select(
        "doc_id",
        F.when(kind == 0, from_prompt_completion(prompt, completion)).alias("messages"),
        F.when(kind == 1, speakers).alias("conversations"),
        F.when(kind <= 2, prompt).alias("prompt"),
        F.when(kind <= 2, completion).alias("completion"),
        *[F.when(kind == 3, F.col(c)).alias(c) for c in ("instruction", "input", "output")],
    )
    return normalise(mixed, presence="value").select("doc_id", "format", _flat())


_SHARED_ROLE = """CASE WHEN json_type(m, '$.from') IS NOT NULL THEN m->>'$.from' ELSE coalesce(m->>'$.role', '') END"""
_MAPPED_ROLE = f"""CASE {_SHARED_ROLE} WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE {_SHARED_ROLE} END"""
_OWN_CONTENT = "CASE WHEN json_type(m, '$.content') IS NULL THEN '' WHEN json_type(m, '$.content') = 'VARCHAR' THEN m->>'$.content' END"
_ROW_STATES = " || ' ' || ".join(
    f"CASE WHEN NOT parsed OR json_type(j, '$.{k}') IS NULL THEN 'missing' WHEN json_type(j, '$.{k}') = 'NULL' THEN 'null' "
    f"WHEN json_type(j, '$.{k}') = '{'ARRAY' if kind == 'list' else 'VARCHAR'}' THEN 'given' ELSE 'mistyped' END" for k, kind in ROW_KEYS.items())


@query(
    "mixed_rows_by_key",
    f"""WITH made AS (
          SELECT doc_id, {sql.HEAD} AS head, {sql.REST} AS rest,
                 json_object('from', 'human', 'value', {sql.HEAD})::VARCHAR || ',' || json_object('role', 'gpt', 'content', {sql.REST})::VARCHAR
                 || CASE WHEN doc_id % 16 < 8 THEN ',{{"from":null,"role":"user","value":"x"}}' ELSE '' END AS shared,
                 json_object('role', 'user', 'content', {sql.HEAD})::VARCHAR || ',' || json_object('role', 'assistant', 'content', {sql.REST})::VARCHAR
                 || CASE WHEN doc_id % 3 = 0 THEN ',{{"role":"user","content":5}}' ELSE '' END AS own FROM documents),
        lines AS (
          SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN json_object('prompt', head, 'completion', rest)::VARCHAR
              WHEN 1 THEN json_object('prompt', head, 'completion', NULL)::VARCHAR WHEN 2 THEN json_object('prompt', head, 'instruction', head, 'output', rest)::VARCHAR
              WHEN 3 THEN json_object('instruction', head, 'input', NULL, 'output', NULL)::VARCHAR WHEN 4 THEN json_object('instruction', head, 'input', 'more')::VARCHAR
              WHEN 5 THEN '{{"messages":"none","conversations":[' || shared || ']}}' WHEN 6 THEN '{{"prompt":"p","completion":"c","messages":[' || own || ']}}'
              ELSE '{{"prompt": "cut' END AS line FROM made),
        parsed AS (SELECT doc_id, json_valid(line) AS parsed, CASE WHEN json_valid(line) THEN line::JSON END AS j FROM lines),
        laid AS (
          SELECT *, CASE WHEN json_type(j, '$.messages') = 'ARRAY' THEN 'messages' WHEN json_type(j, '$.conversations') = 'ARRAY' THEN 'conversations'
              WHEN json_type(j, '$.prompt') IS NOT NULL AND json_type(j, '$.completion') IS NOT NULL THEN 'prompt' WHEN json_type(j, '$.instruction') IS NOT NULL THEN 'instruction' END AS format
          FROM parsed),
        turned AS (
          SELECT *, CASE format
              WHEN 'messages' THEN list_transform((j->'$.messages')::JSON[], lambda m: {{'role': m->>'$.role', 'content': {_OWN_CONTENT}}})
              WHEN 'conversations' THEN list_transform((j->'$.conversations')::JSON[], lambda m: {{'role': {_MAPPED_ROLE},
                   'content': CASE WHEN json_type(m, '$.value') IS NOT NULL THEN m->>'$.value' ELSE coalesce(m->>'$.content', '') END}})
              WHEN 'prompt' THEN [{{'role': 'user', 'content': j->>'$.prompt'}}, {{'role': 'assistant', 'content': j->>'$.completion'}}]
              WHEN 'instruction' THEN [{{'role': 'user', 'content': (j->>'$.instruction') || CASE WHEN coalesce(j->>'$.input', '') <> '' THEN chr(10) || chr(10) || (j->>'$.input') ELSE '' END}},
                   {{'role': 'assistant', 'content': CASE WHEN json_type(j, '$.output') IS NULL THEN '' ELSE j->>'$.output' END}}] END AS turns FROM laid)
        SELECT doc_id, parsed, format, {_ROW_STATES} AS states, coalesce(len(turns), 0)::BIGINT AS n_messages,
               coalesce(list_bool_or(list_transform(turns, lambda m: m.role IS NULL OR m.content IS NULL)), false) AS malformed,
               md5(array_to_string(list_transform(turns, lambda m: coalesce(m.role, '?') || '=' || coalesce(m.content, '?')), '|')) AS digest
        FROM turned""",
)
def mixed_rows_by_key(t: Tables):
    """Lines of all layouts in one file, told apart by the keys that each one has."""
    rows = normalise_lines(derive.mixed_lines(t.spread("documents", "doc_id", "text")))
    part = lambda m: F.concat(F.coalesce(m["role"], F.lit("?")), F.lit("="), F.coalesce(m["content"], F.lit("?")))
    return rows.select(
        "doc_id", "parsed", "format", F.concat_ws(" ", *[F.col(f"key_states.{k}") for k in ROW_KEYS]).alias("states"),
        F.col("facts.n_messages").alias("n_messages"), F.col("facts.malformed").alias("malformed"),
        F.md5(F.array_join(F.transform("messages", part), "|")).alias("digest"),
    )


@query(
    "sharegpt_roles",
    """SELECT conv_id, md5(string_agg(CASE WHEN role = 'system' AND conv_id % 2 = 0 THEN 'narrator' ELSE role END
              || '=' || text, '|' ORDER BY turn)) AS digest
       FROM conversations GROUP BY conv_id""",
)
def sharegpt_roles(t: Tables):
    return normalise(derive.sharegpt_rows(t)).select("conv_id", _flat())


@query(
    "prompt_completion",
    f"SELECT doc_id, md5('user=' || {sql.HEAD} || '|assistant=' || {sql.REST}) AS digest FROM documents",
)
def prompt_completion(t: Tables):
    return normalise(derive.prompt_rows(t.documents)).select("doc_id", _flat())


@query(
    "instruction_pairs",
    f"""SELECT doc_id, md5('user=' || {sql.HEAD} ||
           CASE WHEN doc_id % 3 = 0 OR {sql.EXTRA} = '' THEN '' ELSE chr(10) || chr(10) || {sql.EXTRA} END
           || '|assistant=' || {sql.AFTER_EXTRA}) AS digest FROM documents""",
)
def instruction_pairs(t: Tables):
    return normalise(derive.instruction_rows(t.documents)).select("doc_id", _flat())


@query(
    "instruction_without_output",
    f"SELECT doc_id, md5('user=' || {sql.HEAD} || '|assistant=') AS digest, true AS eligible FROM documents",
)
def instruction_without_output(t: Tables):
    """A source without an output column gives an empty answer and stays eligible."""
    rows = keep_eligible(normalise(derive.instruction_rows(t.documents).select("doc_id", "instruction")))
    return rows.select("doc_id", _flat(), (F.col("facts.has_user") & F.col("facts.has_assistant")).alias("eligible"))


def _prompted(prompt: str) -> str:
    lead = f"CASE WHEN bool_or(role = 'system') THEN '' ELSE 'system=' || {prompt} || '|' END"
    return f"""SELECT conv_id, md5({lead} || string_agg(role || '=' || text, '|' ORDER BY turn)) AS digest
               FROM conversations GROUP BY conv_id"""


@query("system_prompt", _prompted(f"'{DEFAULT_SYSTEM_PROMPT}'"))
def system_prompt(t: Tables):
    made = inject_system(F.col("messages"), DEFAULT_SYSTEM_PROMPT, F.col("facts.has_system"))
    return derive.conversations(t).select("conv_id", made.alias("messages")).select("conv_id", _flat())


@query(
    "thinking_prompt",
    _prompted(f"CASE WHEN conv_id % 2 = 1 THEN '{THINKING}' ELSE '{DEFAULT_SYSTEM_PROMPT}' END"),
)
def thinking_prompt(t: Tables):
    prompt = select_prompt(F.col("conv_id") % 2 == 1, THINKING, DEFAULT_SYSTEM_PROMPT)
    made = inject_system(F.col("messages"), prompt)
    return derive.conversations(t).select("conv_id", made.alias("messages")).select("conv_id", _flat())


@query(
    "always_system",
    f"""SELECT conv_id, md5('system={DEFAULT_SYSTEM_PROMPT}|' || string_agg(role || '=' || text, '|' ORDER BY turn)) AS digest,
              (1 + count(*) FILTER (WHERE role = 'system'))::BIGINT AS n_system
       FROM conversations GROUP BY conv_id""",
)
def always_system(t: Tables):
    made = derive.conversations(t).select(
        "conv_id", prepend_system(F.col("messages"), DEFAULT_SYSTEM_PROMPT).alias("messages")
    )
    n = F.array_size(F.filter("messages", lambda m: m["role"] == "system")).cast("bigint")
    return made.select("conv_id", _flat(), n.alias("n_system"))


@query(
    "render_chat",
    f"""WITH {sql.FACTS}, {sql.TEXTS}
        SELECT conv_id, md5(full_text) AS digest, length(full_text)::BIGINT AS n_chars FROM texts WHERE eligible""",
)
def render_chat(t: Tables):
    return render_texts(keep_eligible(derive.conversations(t))).select(
        "conv_id", F.md5("full_text").alias("digest"), F.length("full_text").cast("bigint").alias("n_chars")
    )


@query(
    "render_prompt",
    f"""WITH {sql.FACTS}, {sql.TEXTS}
        SELECT conv_id, md5(prompt_text) AS digest, starts_with(full_text, prompt_text) AS is_prefix
        FROM texts WHERE eligible""",
)
def render_prompt(t: Tables):
    return render_texts(keep_eligible(derive.conversations(t))).select(
        "conv_id",
        F.md5("prompt_text").alias("digest"),
        F.startswith("full_text", "prompt_text").alias("is_prefix"),
    )


@query(
    "render_plain",
    """SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS digest
       FROM conversations GROUP BY conv_id""",
)
def plain_text(t: Tables):
    return derive.conversations(t).select("conv_id", F.md5(render_plain(F.col("messages"))).alias("digest"))


@query(
    "eligible_conversations",
    """SELECT conv_id, count(*) AS n_messages FROM conversations GROUP BY conv_id
       HAVING bool_or(role = 'user') AND bool_or(role = 'assistant')""",
)
def eligible_conversations(t: Tables):
    return keep_eligible(derive.conversations(t)).select("conv_id", F.col("facts.n_messages").alias("n_messages"))


MIXTURE = (
    SourceSpec("chats", cap=60, category="conversation", order_by="conv_id"),
    SourceSpec("pairs", cap=250, category="instruction", order_by="doc_id"),
    SourceSpec("instructions", category="instruction", order_by="doc_id"),
)


def mixture(t: Tables):
    tables = (
        derive.conversations(t),
        derive.prompt_rows(t.documents).drop("source"),
        derive.instruction_rows(t.documents).drop("source"),
    )
    return concatenate([prepare_source(df, spec, stored=bool(spec.cap) and i == 0) for i, (df, spec) in enumerate(zip(tables, MIXTURE))])


_MIXTURE_SQL = f"""chats AS (
  SELECT 'chats' AS source, 'conversation' AS category, 'messages' AS format, conv_id AS id, count(*) AS n_messages,
         row_number() OVER (ORDER BY conv_id) AS rn
  FROM conversations GROUP BY conv_id HAVING bool_or(role = 'user') AND bool_or(role = 'assistant')),
mixture AS (
  SELECT source, category, format, id, n_messages FROM chats WHERE rn <= 60
  UNION ALL SELECT 'pairs', 'instruction', 'prompt', doc_id, 2
  FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 250
  UNION ALL SELECT 'instructions', 'instruction', 'instruction', doc_id, 2 FROM documents)"""


@query(
    "mixture_union",
    f"""WITH {_MIXTURE_SQL}
        SELECT source, category, format, count(*) AS n_rows, sum(n_messages)::BIGINT AS n_messages,
               max(id)::BIGINT AS last_id, sum(id)::BIGINT AS ids
        FROM mixture GROUP BY source, category, format""",
)
def mixture_union(t: Tables):
    return mixture(t).groupBy("source", "category", "format").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("facts.n_messages").alias("n_messages"),
        F.max("id").alias("last_id"),
        F.sum("id").alias("ids"),
    )


@query(
    "concatenated_duplicates",
    """SELECT conv_id, 2 * count(*) AS n_messages, 2::BIGINT AS n_copies FROM conversations GROUP BY conv_id""",
)
def concatenated_duplicates(t: Tables):
    rows = derive.conversations(t)
    return concatenate([rows, rows]).groupBy("conv_id").agg(
        F.sum("facts.n_messages").alias("n_messages"), F.count(F.lit(1)).alias("n_copies")
    )


@query(
    "source_caps",
    """SELECT source, doc_id FROM (
         SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents)
       WHERE rn <= 10""",
)
def source_caps(t: Tables):
    return cap_per_group(t.documents.select("source", "doc_id"), "source", by_column("doc_id"), 10)


@query(
    "eligible_cap",
    """SELECT conv_id FROM conversations GROUP BY conv_id
       HAVING bool_or(role = 'user') AND bool_or(role = 'assistant') ORDER BY conv_id LIMIT 50""",
)
def eligible_cap(t: Tables):
    eligible = keep_eligible(derive.conversations(t)).select("conv_id")
    return first_n(store(eligible, "eligible"), by_column("conv_id"), 50)


@query("shuffle_order", f"SELECT doc_id, {sql.hash_key('doc_id')} AS shuffle_key FROM documents")
def shuffle_order(t: Tables):
    return t.documents.select("doc_id", shuffle_key("doc_id").alias("shuffle_key"))


@query(
    "global_positions",
    f"""SELECT doc_id, row_number() OVER (ORDER BY {sql.hash_key('doc_id')}, doc_id) - 1 AS position,
               row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS position_in_source,
               count(*) OVER (PARTITION BY source) AS source_rows
        FROM documents""",
)
def global_positions(t: Tables):
    docs = global_index(t.documents.select("doc_id", "source"), shuffled("doc_id"))
    return global_index(
        docs, by_column("doc_id"), by=["source"], name="position_in_source", total="source_rows"
    ).drop("source")


def split_sql(ratio: float = 0.05) -> str:
    return f"""split_rows AS (
  SELECT conv_id, CASE WHEN row_number() OVER (ORDER BY {sql.hash_key('conv_id')}, conv_id)
           > count(*) OVER () - greatest(1, trunc(count(*) OVER () * {ratio}::DOUBLE)) THEN 'eval' ELSE 'train' END AS split
  FROM facts WHERE has_user AND has_assistant)"""


def eligible_ids(t: Tables):
    """Ids of eligible conversations, written once: a split looks at them several times."""
    return store(keep_eligible(derive.conversations(t)).select("conv_id"), "eligible")


@query("exact_split", f"WITH {sql.FACTS}, {split_sql()} SELECT conv_id, split FROM split_rows")
def split_rows(t: Tables):
    return exact_split(eligible_ids(t), ["conv_id"])


@query(
    "exact_split_documents",
    f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {sql.hash_key('doc_id', seed=7)}, doc_id)
          > count(*) OVER () - greatest(1, trunc(count(*) OVER () * 0.2::DOUBLE)) THEN 'eval' ELSE 'train' END AS split
        FROM documents""",
)
def split_documents(t: Tables):
    return exact_split(t.documents.select("doc_id"), ["doc_id"], SplitConfig(0.2, 7))


@query(
    "train_anti_join",
    f"WITH {sql.FACTS}, {split_sql()} SELECT conv_id FROM split_rows WHERE split = 'train'",
)
def train_anti_join(t: Tables):
    everything = eligible_ids(t)
    rows = exact_split(everything, ["conv_id"])
    return without(everything, rows.filter(F.col("split") == "eval"), ["conv_id"])


@query(
    "hash_split",
    f"""SELECT doc_id, CASE WHEN ({sql.hash_key('doc_id')})::DOUBLE < 0.95 * 1152921504606846976.0 THEN 'train' ELSE 'eval' END AS split
        FROM documents""",
)
def threshold_split(t: Tables):
    return t.documents.select("doc_id", hash_split(["doc_id"]).alias("split"))


@query(
    "seeded_sample",
    f"SELECT doc_id, n_chars FROM documents ORDER BY {sql.hash_key('doc_id')}, doc_id LIMIT 100",
)
def sample(t: Tables):
    return seeded_sample(t.documents.select("doc_id", "n_chars"), ["doc_id"], 100)


@query(
    "conversation_facts",
    """SELECT conv_id, count(*) AS n_messages,
              coalesce(max(CASE WHEN role = 'assistant' THEN turn END), -1)::BIGINT AS last_assistant,
              NOT bool_or(role <> CASE WHEN (turn - lead) % 2 = 0 THEN 'user' ELSE 'assistant' END AND turn >= lead) AS alternates
       FROM (SELECT *, CASE WHEN first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'system' THEN 1 ELSE 0 END AS lead
             FROM conversations) GROUP BY conv_id""",
)
def facts_of_arrays(t: Tables):
    """Facts measured on assembled arrays, which must equal those of the turns."""
    facts = F.col("f")
    return derive.conversations(t).select("conv_id", conversation_facts(F.col("messages")).alias("f")).select(
        "conv_id", facts["n_messages"].alias("n_messages"), facts["last_assistant"].alias("last_assistant"),
        facts["alternates"].alias("alternates"),
    )


@query(
    "string_ids_cap",
    f"""SELECT source, doc_name, doc_id FROM (
          SELECT source, 'd-' || doc_id AS doc_name, doc_id, row_number() OVER (ORDER BY {sql.hash_key("'d-' || doc_id")}, 'd-' || doc_id) AS rn FROM documents)
        WHERE rn <= 77""",
)
def string_ids_cap(t: Tables):
    """A cap over ids that are no numbers: by hash of the id."""
    docs = t.documents.select("source", F.concat(F.lit("d-"), F.col("doc_id").cast("string")).alias("doc_name"), "doc_id")
    return first_n(docs, order_of(docs, "doc_name"), 77)


@query(
    "caps_of_any_keys",
    """WITH keyed AS (SELECT source, CASE WHEN doc_id % 7 > 0 THEN doc_id // 5 END AS k FROM documents),
       ranked AS (SELECT source, k, row_number() OVER (PARTITION BY source ORDER BY k NULLS LAST) AS rn FROM keyed)
       SELECT source, count(*) AS n_rows, count(k) AS n_keyed, coalesce(sum(k), 0)::BIGINT AS keys FROM ranked WHERE rn <= 40 GROUP BY source""",
)
def caps_of_any_keys(t: Tables):
    """Caps where keys repeat or are missing: the number of rows is exact."""
    key = F.when(F.col("doc_id") % 7 > 0, F.floor(F.col("doc_id") / 5).cast("bigint"))
    capped = cap_per_group(t.documents.select("source", key.alias("k")), "source", by_column("k"), 40)
    return capped.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("k").alias("n_keyed"), F.coalesce(F.sum("k"), F.lit(0)).alias("keys")
    )


_HELD = f"""sides AS (
  SELECT source, md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS digest, doc_id,
         row_number() OVER (ORDER BY {sql.hash_key('doc_id', seed=7)}, doc_id) > count(*) OVER () - greatest(1, trunc(count(*) OVER () * 0.2::DOUBLE)) AS held
  FROM documents)"""


def _sides(t: Tables):
    docs = t.documents.select("doc_id", "source", "text")
    parts = exact_split(docs, ["doc_id"], SplitConfig(0.2, 7))
    return (parts.filter(F.col("split") == side).drop("split") for side in ("eval", "train"))


@query(
    "heldout_overlap",
    f"WITH {_HELD} SELECT doc_id, source FROM sides WHERE held AND digest IN (SELECT digest FROM sides WHERE NOT held)",
)
def overlapping(t: Tables):
    return heldout_overlap(*_sides(t)).select("doc_id", "source")


@query(
    "heldout_overlap_rate",
    f"""WITH {_HELD} SELECT source, count(*) AS n_held_out, count(*) FILTER (WHERE digest IN (SELECT digest FROM sides WHERE NOT held)) AS n_overlap,
          count(*) FILTER (WHERE digest IN (SELECT digest FROM sides WHERE NOT held)) / count(*)::DOUBLE AS overlap_rate
        FROM sides WHERE held GROUP BY source""",
)
def overlap_rates(t: Tables):
    return overlap_rate(*_sides(t), by=["source"])


def _written_corpora(t: Tables) -> list[SourceSpec]:
    """Documents as two stored corpora: one split by folder with columns of other names, one by a split column with text ids."""
    root = new_folder(t.spark, "corpora")
    side = F.when(F.col("doc_id") % 4 == 0, "test").otherwise("train")
    pairs = derive.prompt_rows(t.documents).withColumns({"question": F.col("prompt"), "reply": F.col("completion"), "side": side})
    for name in ("train", "test"):
        pairs.filter(F.col("side") == name).select("doc_id", "question", "reply").write.parquet(f"{root}/pairs/{name}")
    told = derive.instruction_rows(t.documents).withColumn("key", F.concat(F.lit("k"), F.col("doc_id").cast("string")))
    told.select("key", "instruction", "input", "output", side.alias("split")).write.parquet(f"{root}/told")
    return [
        SourceSpec("pairs", root + "/pairs/{split}", split="test", order_by="doc_id", column_map=(("question", "prompt"), ("reply", "completion"))),
        SourceSpec("told", f"{root}/told", cap=120, order_by="key"),
    ]


_LOADED = f"""loaded AS (
  SELECT 'pairs' AS source, doc_id::VARCHAR AS id, 'user=' || {sql.HEAD} || '|assistant=' || {sql.REST} AS chat, {sql.HEAD} AS ask, {sql.REST} AS answer FROM documents WHERE doc_id % 4 = 0
  UNION ALL SELECT 'told', key, 'user=' || ask || '|assistant=' || answer, ask, answer FROM (
    SELECT 'k' || doc_id AS key, {sql.HEAD} || CASE WHEN doc_id % 3 = 0 OR {sql.EXTRA} = '' THEN '' ELSE chr(10) || chr(10) || {sql.EXTRA} END AS ask, {sql.AFTER_EXTRA} AS answer,
           row_number() OVER (ORDER BY {sql.hash_key("'k' || doc_id")}, 'k' || doc_id) AS rn
    FROM documents WHERE doc_id % 4 > 0) WHERE rn <= 120)"""


@query("loaded_mixture", f"WITH {_LOADED} SELECT source, id, md5(chat) AS digest FROM loaded")
def loaded_mixture(t: Tables):
    """Sources read as a user reads them: split by folder or column, renamed, capped, with ids of two types."""
    return load_mixture(t.spark, _written_corpora(t)).select("source", "id", _flat())


@query(
    "prepared_corpus",
    f"""WITH {_LOADED}, texts AS (
          SELECT source, id, answer, {sql.rendered("'system'", f"'{DEFAULT_SYSTEM_PROMPT}'")} || {sql.rendered("'user'", 'ask')} AS head,
                 row_number() OVER (ORDER BY {sql.hash_key('source', 'id')}, source, id) > count(*) OVER () - greatest(1, trunc(count(*) OVER () * 0.05::DOUBLE)) AS held
          FROM loaded),
        enc AS (
          SELECT *, {sql.token_ids(sql.tokens("(head || " + sql.rendered("'assistant'", 'answer') + ")") + '[1:256]')} AS ids,
                 least(256, len({sql.tokens("(head || '<|assistant|>' || chr(10))")})) AS prompt_len FROM texts)
        SELECT source, id, CASE WHEN held THEN 'eval' ELSE 'train' END AS split,
               CASE WHEN answer = '' THEN 'empty_target' WHEN prompt_len >= len(ids) THEN 'too_short' END AS skip_reason,
               CASE WHEN answer <> '' AND prompt_len < len(ids) THEN list_sum(ids)::BIGINT END AS ids_sum
        FROM enc""",
)
def prepared_corpus(t: Tables):
    """The whole main path over stored corpora; empty answers are skipped here."""
    made = prepare_corpus(t.spark, _written_corpora(t), PrepConfig(max_seq_len=256, reject_empty_target=True))
    total = F.aggregate("input_ids", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return made.select("source", "id", "split", "skip_reason", F.when(F.col("skip_reason").isNull(), total).alias("ids_sum"))
