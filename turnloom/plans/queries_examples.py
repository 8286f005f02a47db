"""Queries on tokens, label masks, batches, packing, manifests and their sinks."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.config import DEFAULT_SYSTEM_PROMPT, IGNORE_INDEX, PrepConfig
from turnloom.functions.template import ChatTemplate
from turnloom.functions.tokens import WhitespaceTokenizer
from turnloom.operators.examples import (
    SKIP_REASONS,
    build_examples,
    build_plain_examples,
    keep_eligible,
    kept,
)
from turnloom.operators.ordered import by_column, shuffled
from turnloom.operators.packing import pack_documents, pad_batches, training_manifest
from turnloom.operators.permutation import examples_of_steps, number_examples, steps_of_examples
from turnloom.operators.report import StageCounts, counts_table, sample_counts, skip_counts, watch_preparation
from turnloom.operators.split import exact_split
from turnloom.operators.subwords import RankedMerges
from turnloom.operators.turn_examples import build_turn_examples, build_turn_plain_examples
from turnloom.plans import derive, sql
from turnloom.plans.queries_corpus import split_sql
from turnloom.plans.registry import Tables, query
from turnloom.sources.sinks import new_folder, store, store_bucketed, write_examples
from turnloom.streaming.prepare import prepare_stream, write_stream


def _total(ids: str):
    return F.aggregate(ids, F.lit(0).cast("bigint"), lambda a, x: a + x)


def sft_examples(t: Tables, cfg: PrepConfig = PrepConfig()):
    return build_examples(derive.conversations(t), cfg)


def _columns(examples):
    return examples.select(
        "conv_id", "n_tokens", "prompt_len", "n_unmasked",
        _total("input_ids").alias("ids_sum"), _total("labels").alias("labels_sum"),
    )


def _columns_sql(max_len: int, masked_tail: bool = False) -> str:
    inside = "i > prompt_len AND i <= answer_end"
    return f"""{sql.examples(max_len, masked_tail)}
        SELECT conv_id, n_tokens::BIGINT AS n_tokens, prompt_len::BIGINT AS prompt_len,
               (least(n_tokens, answer_end) - prompt_len)::BIGINT AS n_unmasked, list_sum(ids)::BIGINT AS ids_sum,
               list_sum(list_transform(ids, lambda x, i: CASE WHEN {inside} THEN x ELSE {IGNORE_INDEX} END))::BIGINT AS labels_sum
        FROM examples WHERE skip_reason IS NULL"""


@query("sft_examples", _columns_sql(1024))
def flagship(t: Tables):
    return _columns(kept(sft_examples(t)))


@query("sft_examples_truncated", _columns_sql(256))
def truncated(t: Tables):
    return _columns(kept(sft_examples(t, PrepConfig(max_seq_len=256))))


@query("sft_examples_masked_tail", _columns_sql(512, masked_tail=True))
def masked_tail(t: Tables):
    return _columns(kept(sft_examples(t, PrepConfig(max_seq_len=512, trailing="mask"))))


@query(
    "tokenised_documents",
    f"""SELECT doc_id, len(ids)::BIGINT AS n_tokens, coalesce(list_sum(ids), 0)::BIGINT AS ids_sum, ids[1] AS first_id, ids[-1] AS last_id
        FROM (SELECT doc_id, {sql.token_ids(sql.tokens('text'))} AS ids FROM documents)""",
)
def tokenised_documents(t: Tables):
    docs = t.spread("documents", "doc_id", "text")
    ids = docs.select("doc_id", WhitespaceTokenizer().ids(F.col("text")).alias("ids"))
    return ids.select(
        "doc_id", F.array_size("ids").cast("bigint").alias("n_tokens"), _total("ids").alias("ids_sum"),
        F.try_element_at("ids", F.lit(1)).alias("first_id"), F.try_element_at("ids", F.lit(-1)).alias("last_id"),
    )


def _subwords() -> RankedMerges:
    import public_tokenizers

    return RankedMerges(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query("subword_documents")
def subword_documents(t: Tables):
    docs = _subwords().encode(t.spread("documents", "doc_id", "text"), "text", "ids", None, {"n_tokens": "text"})
    return docs.select(
        "doc_id", "n_tokens", _total("ids").alias("ids_sum"), F.get("ids", F.lit(0)).alias("first_id"),
        F.try_element_at("ids", F.lit(-1)).alias("last_id"), F.md5(F.array_join("ids", ",")).alias("ids_md5"),
    )


@query("sft_examples_subword")
def subword_examples(t: Tables):
    """The main path with subword ids; every label is its input or ignored."""
    talks = store(derive.conversations(t), "conversations")
    return _columns(kept(build_examples(talks, tokenizer=_subwords())))


@query(
    "attention_masks",
    f"""{sql.examples(512)}
        SELECT conv_id, n_tokens::BIGINT AS mask_sum, n_tokens::BIGINT AS mask_len, prompt_len::BIGINT AS n_masked,
               array_to_string(list_transform(ids, lambda x, i: CASE WHEN i > prompt_len THEN x ELSE -100 END), ' ') AS labels
        FROM examples WHERE skip_reason IS NULL""",
)
def attention_masks(t: Tables):
    labels = F.transform("labels", lambda x: x.cast("string"))
    return kept(sft_examples(t, PrepConfig(max_seq_len=512))).select(
        "conv_id", _total("attention_mask").alias("mask_sum"),
        F.array_size("attention_mask").cast("bigint").alias("mask_len"),
        F.array_size(F.filter("labels", lambda x: x == IGNORE_INDEX)).cast("bigint").alias("n_masked"),
        F.array_join(labels, " ").alias("labels"),
    )


def _glued(role: str, content: str) -> str:
    return f"('<|' || {role} || '|>' || {content} || {sql.NL} || '<|end|>' || {sql.NL})"


def _prefix_sql() -> str:
    """Ids of whole texts and prompts, compared from the start, in the default layout and in one without a blank behind the role."""
    system = "CASE WHEN has_system THEN '' ELSE {} END"
    sides = {"apart": (sql.rendered, sql.NL), "glued": (_glued, "''")}
    texts = ", ".join(
        f"any_value({system.format(render(chr(39) + 'system' + chr(39), chr(39) + DEFAULT_SYSTEM_PROMPT + chr(39)))}) || string_agg({render('role', 'text')}, '' ORDER BY turn) AS full_{name}, "
        f"any_value({system.format(render(chr(39) + 'system' + chr(39), chr(39) + DEFAULT_SYSTEM_PROMPT + chr(39)))}) || coalesce(string_agg({render('role', 'text')}, '' ORDER BY turn) "
        f"FILTER (WHERE turn < last_assistant), '') || '<|assistant|>' || {gap} AS prompt_{name}" for name, (render, gap) in sides.items())
    same = ", ".join(f"{sql.tokens(f'full_{name}')}[1:512][1:len(p_{name})] = p_{name} AS {name}_ok" for name in sides)
    prompts = ", ".join(f"{sql.tokens(f'prompt_{name}')}[1:512] AS p_{name}" for name in sides)
    return f"""WITH {sql.FACTS}, both_texts AS (
          SELECT conv_id, {texts} FROM conversations JOIN facts USING (conv_id) WHERE has_user AND has_assistant GROUP BY conv_id)
        SELECT conv_id, {same} FROM (SELECT *, {prompts} FROM both_texts)"""


@query("prompt_prefix", _prefix_sql())
def prompt_prefix(t: Tables):
    """Whether the prompt's ids begin the example, in a layout that parts tokens there and in one that does not."""
    rows = derive.conversations(t)
    cfg = PrepConfig(max_seq_len=512, check_prefix=True)
    glued = ChatTemplate(prefix="<|{role}|>", generation="<|assistant|>")
    apart, joined = build_examples(rows, cfg), build_examples(rows, cfg, glued)
    return apart.select("conv_id", F.col("prefix_ok").alias("apart_ok")).where("apart_ok IS NOT NULL").join(
        joined.select("conv_id", F.col("prefix_ok").alias("glued_ok")), "conv_id")


@query(
    "last_assistant",
    """SELECT conv_id, coalesce(max(CASE WHEN role = 'assistant' THEN turn END), -1)::BIGINT AS last_assistant,
              (max(turn) > coalesce(max(CASE WHEN role = 'assistant' THEN turn END), -1)) AS has_tail
       FROM conversations GROUP BY conv_id""",
)
def last_assistant(t: Tables):
    last = F.col("facts.last_assistant")
    return derive.conversations(t).select(
        "conv_id", last.alias("last_assistant"), (F.col("facts.n_messages") - 1 > last).alias("has_tail")
    )


_PLAIN_SQL = f"""WITH {sql.FACTS}, texts AS (
          SELECT conv_id, any_value(CASE WHEN has_system THEN '' ELSE 'system: You are a helpful assistant.' || chr(10) END)
                 || string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS full_text,
                 'assistant: ' || any_value(text) FILTER (WHERE turn = last_assistant) AS answer
          FROM conversations JOIN facts USING (conv_id) WHERE has_user AND has_assistant GROUP BY conv_id),
        enc AS (SELECT conv_id, {sql.token_ids(sql.tokens('full_text') + '[1:256]')} AS ids,
                       least(256, len({sql.tokens('answer')})) AS answer_len FROM texts)
        SELECT conv_id, len(ids)::BIGINT AS n_tokens, least(len(ids), answer_len)::BIGINT AS n_unmasked, list_sum(ids)::BIGINT AS ids_sum,
               list_sum(list_transform(ids, lambda x, i: CASE WHEN i > len(ids) - answer_len THEN x ELSE -100 END))::BIGINT AS labels_sum
        FROM enc"""


def _plain_columns(examples):
    return examples.select(
        "conv_id", "n_tokens", "n_unmasked", _total("input_ids").alias("ids_sum"), _total("labels").alias("labels_sum")
    )


@query("plain_examples", _PLAIN_SQL)
def plain_examples(t: Tables):
    return _plain_columns(kept(build_plain_examples(derive.conversations(t), PrepConfig(max_seq_len=256))))


@query("turn_examples", _columns_sql(1024))
def by_token_budget(t: Tables):
    """The flagship's examples, without putting a conversation together."""
    return _columns(kept(build_turn_examples(t.conversations, dense=True)))


@query("turn_examples_masked_tail", _columns_sql(300, masked_tail=True))
def by_token_budget_in_small_blocks(t: Tables):
    """Blocks of two turns, so that prompts, answers and the budget's end lie in different ones."""
    cfg = PrepConfig(max_seq_len=300, trailing="mask")
    return _columns(kept(build_turn_examples(t.conversations, cfg, dense=True, turns_per_block=1)))


@query("turn_plain_examples", _PLAIN_SQL)
def plain_by_token_budget(t: Tables):
    made = build_turn_plain_examples(t.conversations, PrepConfig(max_seq_len=256), dense=True, turns_per_block=1)
    return _plain_columns(kept(made))


@query(
    "skip_counts",
    f"""{sql.examples(256)}
        SELECT coalesce(skip_reason, 'kept') AS skip_reason, count(*) AS n_rows FROM examples GROUP BY 1""",
)
def skipped(t: Tables):
    return skip_counts(sft_examples(t, PrepConfig(max_seq_len=256)))


@query(
    "skip_counts_unfiltered",
    f"""WITH picked AS (
          SELECT conv_id, role, text FROM conversations
          WHERE conv_id % 3 = 0 OR (conv_id % 3 = 1 AND role = 'user') OR (conv_id % 3 = 2 AND role = 'system'))
        SELECT conv_id, CASE WHEN conv_id % 7 = 6 THEN 'unrecognised'
                             WHEN count(p.role) = 0 THEN 'empty'
                             WHEN NOT coalesce(bool_or(p.role = 'assistant'), false) THEN 'no_assistant' ELSE 'other' END AS reason
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN picked p USING (conv_id) GROUP BY conv_id""",
)
def skipped_unfiltered(t: Tables):
    """Rows that never went through the role test: whole, user-only, system-only
    and missing message lists."""
    kind, m = F.col("conv_id") % 3, F.col("messages")
    picked = (
        F.when(F.col("conv_id") % 7 == 6, F.lit(None))
        .when(kind == 0, m)
        .when(kind == 1, F.filter(m, lambda x: x["role"] == "user"))
        .otherwise(F.filter(m, lambda x: x["role"] == "system"))
    )
    rows = derive.conversations(t).select("conv_id", picked.alias("messages"))
    found = build_examples(rows, PrepConfig(require_roles=False))
    reason = F.col("skip_reason")
    early = reason.isin("unrecognised", "empty", "no_assistant")
    return found.select("conv_id", F.when(early, reason).otherwise("other").alias("reason"))


@query(
    "render_errors",
    """SELECT conv_id, CASE WHEN NOT (bool_or(role = 'user') AND bool_or(role = 'assistant')) THEN 'missing_role'
                            WHEN bool_or(turn = 1 AND conv_id % 5 = 0) OR
                                 bool_or(turn >= lead AND role <> CASE WHEN (turn - lead) % 2 = 0 THEN 'user' ELSE 'assistant' END)
                            THEN 'render_error' ELSE 'other' END AS reason
       FROM (SELECT *, CASE WHEN first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'system' THEN 1 ELSE 0 END AS lead
             FROM (SELECT conv_id, turn - (conv_id % 4 = 1)::INT AS turn, role FROM conversations WHERE conv_id % 4 <> 1 OR turn > 0))
       GROUP BY conv_id""",
)
def render_errors(t: Tables):
    """Strict alternation, on conversations of which some lost their first turn
    and some the text of their second."""
    m = F.col("messages")
    cut = F.when(F.col("conv_id") % 4 == 1, F.slice(m, F.lit(2), F.array_size(m))).otherwise(m)

    def blank(x, i):
        hit = (F.col("conv_id") % 5 == 0) & (i == 1)
        return F.struct(x["role"].alias("role"), F.when(~hit, x["content"]).alias("content"))

    rows = derive.conversations(t).select("conv_id", F.transform(cut, blank).alias("messages"))
    found = build_examples(rows, template=ChatTemplate(strict_alternation=True))
    reason = F.col("skip_reason")
    early = reason.isin("missing_role", "render_error")
    return found.filter(F.array_size("messages") > 0).select("conv_id", F.when(early, reason).otherwise("other").alias("reason"))


@query(
    "sample_counts",
    f"""{sql.examples(512)}, {split_sql()}
        SELECT split, count(*) AS n_rows, count(*) FILTER (WHERE skip_reason IS NULL) AS n_examples,
               coalesce(sum(n_tokens) FILTER (WHERE skip_reason IS NULL), 0)::BIGINT AS n_tokens,
               coalesce(sum(n_tokens - prompt_len) FILTER (WHERE skip_reason IS NULL), 0)::BIGINT AS n_unmasked
        FROM split_rows JOIN examples USING (conv_id) GROUP BY split""",
)
def counts(t: Tables):
    rows = exact_split(keep_eligible(derive.conversations(t)), ["conv_id"])
    return sample_counts(build_examples(rows, PrepConfig(max_seq_len=512)), by=["split"])


@query(
    "stored_examples",
    f"""{sql.examples(1024)}, {split_sql()}
        SELECT split, count(*) AS n_examples, sum(n_tokens)::BIGINT AS n_tokens, sum(list_sum(ids))::BIGINT AS ids_sum
        FROM split_rows JOIN examples USING (conv_id) WHERE skip_reason IS NULL GROUP BY split""",
)
def stored_examples(t: Tables):
    """Examples written per split, and summed up from the files."""
    rows = exact_split(keep_eligible(derive.conversations(t)), ["conv_id"])
    path = new_folder(t.spark, "examples")
    made = kept(build_examples(rows))
    write_examples(made.select("conv_id", "split", "input_ids", "labels", "attention_mask"), path)
    return t.spark.read.parquet(path).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_examples"),
        F.sum(F.array_size("input_ids")).alias("n_tokens"),
        F.sum(_total("input_ids")).alias("ids_sum"),
    )


_MEASURES = ("n_rows", "eligible", "kept", *SKIP_REASONS, "n_tokens", "n_unmasked")


@query(
    "observed_counts",
    f"""{sql.examples(256)}, measures AS (SELECT unnest({list(_MEASURES)}) AS measure),
        rows AS (
          SELECT 'n_rows' AS measure, 1 AS v FROM examples UNION ALL SELECT 'eligible', 1 FROM examples WHERE skip_reason IS DISTINCT FROM 'missing_role'
          UNION ALL SELECT coalesce(skip_reason, 'kept'), 1 FROM examples
          UNION ALL SELECT 'n_tokens', n_tokens FROM examples WHERE skip_reason IS NULL
          UNION ALL SELECT 'n_unmasked', n_tokens - prompt_len FROM examples WHERE skip_reason IS NULL)
        SELECT 'prepared' AS stage, measure, coalesce(sum(v), 0)::BIGINT AS n FROM measures LEFT JOIN rows USING (measure) GROUP BY measure
        UNION ALL SELECT 'loaded', 'n_rows', count(DISTINCT conv_id) FROM conversations
        UNION ALL SELECT 'written', 'n_rows', count(*) FROM examples WHERE skip_reason IS NULL""",
)
def observed_counts(t: Tables):
    """All counts of a preparation from the one pass that writes its examples."""
    stages = StageCounts()
    loaded = stages.watch(derive.conversations(t), "loaded")
    made = watch_preparation(build_examples(loaded, PrepConfig(max_seq_len=256)), stages)
    written = stages.watch(kept(made), "written")
    written.select("conv_id", "input_ids", "labels", "attention_mask").write.parquet(new_folder(t.spark, "examples"))
    return counts_table(t.spark, stages.counts())


_PADDED_SQL = f"""{sql.examples(512)}, placed AS (
          SELECT *, (row_number() OVER (ORDER BY {sql.hash_key('conv_id')}, conv_id) - 1) AS p FROM examples WHERE skip_reason IS NULL),
        batched AS (SELECT *, (p // 4)::BIGINT AS batch_id, (p % 4)::BIGINT AS row_in_batch,
                           max(n_tokens) OVER (PARTITION BY p // 4) AS batch_len FROM placed)
        SELECT conv_id, batch_id, row_in_batch, batch_len::BIGINT AS ids_len, list_sum(ids)::BIGINT AS ids_sum,
               (list_sum(list_transform(ids, lambda x, i: CASE WHEN i > prompt_len THEN x ELSE -100 END)) - 100 * (batch_len - n_tokens))::BIGINT AS labels_sum,
               n_tokens::BIGINT AS mask_sum
        FROM batched"""


@query("padded_batches", _PADDED_SQL)
def padded_batches(t: Tables):
    return _padded_columns(store(_batch_input(t), "examples"))


@query("padded_batches_bucketed", _PADDED_SQL)
def padded_batches_bucketed(t: Tables):
    """Stored by the id that the batches come with, so that the arrays do not move again."""
    return _padded_columns(store_bucketed(_batch_input(t), "examples", "conv_id", 8))


def _batch_input(t: Tables):
    cfg = PrepConfig(max_seq_len=512)
    return kept(sft_examples(t, cfg)).select("conv_id", "n_tokens", "input_ids", "labels", "attention_mask")


def _padded_columns(examples):
    padded = pad_batches(examples, ["conv_id"], shuffled("conv_id"), 4)
    return padded.select(
        "conv_id", "batch_id", "row_in_batch", F.array_size("input_ids").cast("bigint").alias("ids_len"),
        _total("input_ids").alias("ids_sum"), _total("labels").alias("labels_sum"),
        _total("attention_mask").alias("mask_sum"),
    )


def _packed_sql(length: int, stride: int, keep_tail: bool) -> str:
    full = "" if keep_tail else f"HAVING count(*) = {length + 1}"
    if keep_tail:
        full = "HAVING count(*) > 1"
    return f"""WITH toks AS (
          SELECT doc_id, unnest(list_append(ids, -1)) AS tok, generate_subscripts(list_append(ids, -1), 1) AS k
          FROM (SELECT doc_id, {sql.token_ids(sql.tokens('text'))} AS ids FROM documents)),
        flat AS (SELECT tok, row_number() OVER (ORDER BY doc_id, k) - 1 AS p FROM toks),
        placed AS (
          SELECT p // {stride} - d AS chunk_id, p - (p // {stride} - d) * {stride} AS i, tok
          FROM flat, (VALUES (0), (1)) v(d)
          WHERE p // {stride} - d >= 0 AND p - (p // {stride} - d) * {stride} <= {length})
        SELECT chunk_id::BIGINT AS chunk_id, (count(*) - 1)::BIGINT AS n_tokens,
               sum(tok) FILTER (WHERE NOT is_last)::BIGINT AS ids_sum, sum(tok) FILTER (WHERE i > 0)::BIGINT AS labels_sum,
               max(tok) FILTER (WHERE i = 0)::BIGINT AS first_id
        FROM (SELECT *, i = max(i) OVER (PARTITION BY chunk_id) AS is_last FROM placed) GROUP BY chunk_id {full}"""


def _packed_columns(chunks):
    return chunks.select(
        "chunk_id", F.array_size("input_ids").cast("bigint").alias("n_tokens"),
        _total("input_ids").alias("ids_sum"), _total("labels").alias("labels_sum"),
        F.element_at("input_ids", 1).alias("first_id"),
    )


@query("packed_documents", _packed_sql(128, 128, False))
def packed(t: Tables):
    return _packed_columns(pack_documents(t.spread("documents", "doc_id", "text"), by_column("doc_id", bits=10), chunk_len=128))


@query("packed_documents_apart", _packed_sql(512, 513, True))
def packed_apart(t: Tables):
    docs = t.spread("documents", "doc_id", "text")
    return _packed_columns(
        pack_documents(docs, by_column("doc_id", bits=10), chunk_len=512, stride=513, keep_tail=True)
    )


@query(
    "training_manifest",
    f"""WITH e AS (SELECT range AS epoch FROM range(100)), ids AS (SELECT conv_id FROM conversations GROUP BY conv_id),
        placed AS (
          SELECT epoch, conv_id, epoch * count(*) OVER (PARTITION BY epoch)
                 + row_number() OVER (PARTITION BY epoch ORDER BY {sql.hash_key('epoch', 'conv_id')}, conv_id) - 1 AS p
          FROM e, ids)
        SELECT (p // 2)::BIGINT AS step, (p % 2)::BIGINT AS slot, epoch::BIGINT AS epoch, conv_id FROM placed WHERE p < 1000""",
)
def manifest(t: Tables):
    return training_manifest(
        derive.conversations(t).select("conv_id"), "conv_id", max_steps=500, per_step=2
    )


def _network_sql(first: int, last: int, per_step: int) -> str:
    """The same network in SQL: one row of the recursion per position and round, walked until it falls below n."""
    mix = lambda half: f"('0x' || substr(md5('42:' || epoch || ':' || (i % 6) || ':' || {half}), 1, 15))::BIGINT"
    return f"""WITH RECURSIVE ids AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS row FROM (SELECT DISTINCT conv_id FROM conversations)),
        total AS (SELECT count(*) AS n, floor(sqrt(count(*)))::BIGINT AS root FROM ids),
        dims AS (SELECT n, a, (n + a - 1) // a AS b FROM total, range(1, 5000) c(a)
                 WHERE a BETWEEN root - 1024 AND root + 1024 AND a <= n ORDER BY a * ((n + a - 1) // a) - n, abs(a - root), a LIMIT 1),
        walk AS (
          SELECT place, place // n AS epoch, (place % n) // b AS l, (place % n) % b AS r, 0 AS i, n, a, b FROM dims, range({first * per_step}, {last * per_step}) p(place)
          UNION ALL
          SELECT place, epoch, CASE WHEN i % 2 = 0 THEN (l + {mix('r')}) % a ELSE l END, CASE WHEN i % 2 = 1 THEN (r + {mix('l')}) % b ELSE r END, i + 1, n, a, b
          FROM walk WHERE i = 0 OR i % 6 <> 0 OR l * b + r >= n)
        SELECT (place // {per_step})::BIGINT AS step, (place % {per_step})::BIGINT AS slot, epoch::BIGINT AS epoch, conv_id
        FROM walk JOIN ids ON row = l * b + r WHERE i > 0 AND i % 6 = 0 AND l * b + r < n"""


def _numbered(t: Tables):
    index = store(number_examples(t.conversations.select("conv_id").distinct(), "conv_id"), "numbered")
    return index, index.count()


@query("manifest_steps", _network_sql(120, 170, 4))
def manifest_of_some_steps(t: Tables):
    """Steps 120 to 169 of a run, without the epochs around them."""
    index, n = _numbered(t)
    return examples_of_steps(index, n, "conv_id", first_step=120, last_step=170, per_step=4)


@query("manifest_by_example", _network_sql(0, 1000, 2))
def manifest_from_the_examples(t: Tables):
    """Where every example goes in the first 1,000 steps."""
    index, n = _numbered(t)
    return steps_of_examples(index, n, "conv_id", first_step=0, last_step=1000, per_step=2)


_DOC_TYPE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)


_STREAMED_SQL = f"""WITH enc AS (
          SELECT doc_id, {sql.token_ids(sql.tokens("full_text") + '[1:512]')} AS ids, least(512, len({sql.tokens('prompt_text')})) AS prompt_len,
                 CASE WHEN ({sql.hash_key('doc_id')})::DOUBLE < 0.95 * 1152921504606846976.0 THEN 'train' ELSE 'eval' END AS split
          FROM (SELECT doc_id, p || '<|assistant|>' || chr(10) AS prompt_text, p || {sql.rendered("'assistant'", sql.REST)} AS full_text
                FROM (SELECT doc_id, text, {sql.rendered("'system'", "'You are a helpful assistant.'")} || {sql.rendered("'user'", sql.HEAD)} AS p FROM documents)))
        SELECT doc_id, split, len(ids)::BIGINT AS n_tokens, prompt_len::BIGINT AS prompt_len, list_sum(ids)::BIGINT AS ids_sum
        FROM enc WHERE prompt_len < len(ids)"""


_DELIVERED = "doc_id bigint, source string, text string, ts timestamp"


@query("streamed_examples_once", _STREAMED_SQL)
def streamed_once(t: Tables):
    """Files that are delivered again, some while the stream stands still: the restarted stream adds no row for them."""
    folder, path, state = (new_folder(t.spark, name) for name in ("delivered", "stream", "stream-state"))
    docs = t.spread("documents", "doc_id", "source", "text").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") % 3600))
    columns = ["doc_id", "split", "n_tokens", "prompt_len", "input_ids"]

    def deliver(rows):
        rows.write.mode("append").parquet(folder)

    def take_in(files):
        # As many files at a time as one delivery has, so that deliveries are taken in one after the other.
        stream = t.spark.readStream.schema(_DELIVERED).option("maxFilesPerTrigger", files).parquet(folder)
        prompt, completion = derive.head_and_rest(F.col("text"))
        rows = stream.select("doc_id", "source", "ts", prompt.alias("prompt"), completion.alias("completion"))
        made = kept(prepare_stream(rows, ["doc_id"], PrepConfig(max_seq_len=512), event_time="ts", repeats_within="2 hours")).select(columns)
        write_stream(made, path, state).awaitTermination()
        return made.schema

    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    deliver(docs.where(half == 0))
    files = max(1, len(t.spark.read.schema(_DELIVERED).parquet(folder).inputFiles()))
    deliver(docs.where(half == 0))
    take_in(files)
    deliver(docs)
    schema = take_in(files)
    return t.spark.read.schema(schema).parquet(path).select("doc_id", "split", "n_tokens", "prompt_len", _total("input_ids").alias("ids_sum"))


def _pattern_of(path: str) -> str:
    """A pattern that matches this path alone."""
    folder, name = path.rsplit("/", 1)
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", folder) + "/" + f"[{name[0]}]{name[1:]}"


@query("streamed_examples", _STREAMED_SQL)
def streamed(t: Tables):
    """Documents as a stream of files into Parquet, read back afterwards."""
    # As a pattern, because a plain path may only be a folder here; it takes a table of one file and a folder of files.
    docs = t.spark.readStream.schema(_DOC_TYPE).parquet(_pattern_of(t.path("documents")))
    made = kept(prepare_stream(derive.prompt_rows(docs), ["doc_id"], PrepConfig(max_seq_len=512)))
    path, state = new_folder(t.spark, "stream"), new_folder(t.spark, "stream-state")
    examples = made.select("doc_id", "split", "n_tokens", "prompt_len", "input_ids")
    write_stream(examples, path, state).awaitTermination()
    return t.spark.read.schema(examples.schema).parquet(path).select(
        "doc_id", "split", "n_tokens", "prompt_len", _total("input_ids").alias("ids_sum")
    )
