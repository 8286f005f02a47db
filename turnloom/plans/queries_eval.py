"""Queries on scoring, comparing and generating."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.functions.tokens import WhitespaceTokenizer
from turnloom.operators.evaluate import (
    compare_models,
    compare_samples,
    first_batches_mean_loss,
    generation_previews,
    generation_summary,
    mean_loss,
    new_tokens,
    perplexity_summary,
    running_perplexity,
    with_speed,
)
from turnloom.operators.ordered import by_column
from turnloom.operators.quantiles import RANK_ERROR, length_sketches, merge_sketches, quantile_ranks, read_quantiles
from turnloom.plans import derive, sql
from turnloom.plans.evaluate import scoring_inputs
from turnloom.plans.registry import Tables, query
from turnloom.sources.sinks import new_folder, store, write_evaluation


@query(
    "perplexity",
    f"""WITH {sql.SCORES}
        SELECT model, round(exp(sum(loss * n_tokens) / sum(n_tokens)), 6) AS perplexity,
               round(sum(loss * n_tokens) / sum(n_tokens), 6) AS avg_loss, sum(n_tokens)::BIGINT AS total_tokens
        FROM scores GROUP BY model""",
)
def perplexity_by_model(t: Tables):
    return perplexity_summary(derive.scores(t), by=["model"]).select(
        "model", F.round("perplexity", 6).alias("perplexity"), F.round("avg_loss", 6).alias("avg_loss"), "total_tokens"
    )


@query(
    "mean_eval_loss",
    f"""WITH {sql.SCORES}
        SELECT round(coalesce(avg(loss), 0.0), 6) AS val_loss, count(*) AS n_batches FROM scores WHERE model = 'tuned'""",
)
def mean_eval_loss(t: Tables):
    tuned = derive.scores(t).filter(F.col("model") == "tuned")
    return mean_loss(tuned).withColumn("val_loss", F.round("val_loss", 6))


@query(
    "eval_first_batches",
    f"""WITH {sql.SCORES}, losses AS (SELECT sample_id, loss, row_number() OVER (ORDER BY sample_id) AS rn, count(*) OVER () AS n
                                      FROM scores WHERE model = 'tuned'),
        k AS (SELECT sum(w * loss) / sum(w) AS m, sum(w)::BIGINT AS n_batches, 20 AS asked
              FROM (SELECT loss, 20 // n + (rn <= 20 % n)::INT AS w FROM losses)
              UNION ALL
              SELECT sum(w * loss) / sum(w), sum(w)::BIGINT, 250000
              FROM (SELECT loss, 250000 // n + (rn <= 250000 % n)::INT AS w FROM losses))
        SELECT asked::BIGINT AS asked, round(m, 6) AS val_loss, n_batches FROM k""",
)
def eval_first_batches(t: Tables):
    tuned = derive.scores(t).filter(F.col("model") == "tuned").select("sample_id", "loss")

    def run(k: int):
        return first_batches_mean_loss(tuned, by_column("sample_id"), k).select(
            F.lit(k).cast("bigint").alias("asked"), F.round("val_loss", 6).alias("val_loss"), "n_batches"
        )

    return run(20).unionByName(run(250_000))


@query(
    "running_perplexity",
    f"""WITH {sql.SCORES}, run AS (
          SELECT model, i, sum(n_tokens) OVER w AS total_tokens, exp(sum(loss * n_tokens) OVER w / sum(n_tokens) OVER w) AS ppl
          FROM scores WINDOW w AS (PARTITION BY model ORDER BY i ROWS UNBOUNDED PRECEDING))
        SELECT model, i::BIGINT AS i, total_tokens::BIGINT AS total_tokens, round(ppl, 6) AS perplexity FROM run WHERE i % 20 = 0""",
)
def running(t: Tables):
    scores = store(derive.scores(t, numbered=True), "scores")
    return running_perplexity(scores).withColumn("perplexity", F.round("perplexity", 6))


@query(
    "model_comparison",
    f"""WITH {sql.SCORES}, p AS (SELECT exp(sum(loss * n_tokens) FILTER (WHERE model = 'base') / sum(n_tokens) FILTER (WHERE model = 'base')) AS b,
                                        exp(sum(loss * n_tokens) FILTER (WHERE model = 'tuned') / sum(n_tokens) FILTER (WHERE model = 'tuned')) AS u FROM scores)
        SELECT round(b, 6) AS base_ppl, round(u, 6) AS tuned_ppl, round(b - u, 6) AS improvement,
               CASE WHEN b - u > 0 THEN 'better' ELSE 'worse' END AS verdict FROM p""",
)
def model_comparison(t: Tables):
    scores = derive.scores(t)
    base, tuned = (scores.filter(F.col("model") == m) for m in derive.MODELS)
    return compare_models(base, tuned).select(
        *[F.round(c, 6).alias(c) for c in ("base_ppl", "tuned_ppl", "improvement")], "verdict"
    )


@query(
    "sample_comparison",
    f"""WITH {sql.SCORES}
        SELECT sample_id, round(b.loss, 9) AS base_loss, round(u.loss, 9) AS tuned_loss, round(b.loss - u.loss, 9) AS improvement,
               CASE WHEN b.loss - u.loss > 0 THEN 'better' WHEN b.loss - u.loss <= 0 THEN 'worse' END AS verdict
        FROM (SELECT * FROM scores WHERE model = 'base') b FULL JOIN (SELECT * FROM scores WHERE model = 'tuned') u USING (sample_id)""",
)
def sample_comparison(t: Tables):
    scores = derive.scores(t)
    base, tuned = (scores.filter(F.col("model") == m) for m in derive.MODELS)
    return compare_samples(base, tuned).select(
        "sample_id", *[F.round(c, 9).alias(c) for c in ("base_loss", "tuned_loss", "improvement")], "verdict"
    )


@query(
    "scoring_pairs",
    f"""SELECT doc_id, CASE WHEN whole THEN NULL ELSE 'render_error' END AS skip_reason, CASE WHEN whole THEN len(ids) END::BIGINT AS n_tokens,
               CASE WHEN whole THEN list_sum(ids) END::BIGINT AS ids_sum FROM (
          SELECT doc_id, doc_id % 11 > 1 AS whole, {sql.token_ids(sql.tokens(sql.rendered("'user'", sql.HEAD) + ' || ' + sql.rendered("'assistant'", sql.AFTER_EXTRA)) + '[1:2048]')} AS ids
          FROM documents)""",
)
def scoring_pairs(t: Tables):
    docs = t.spread("documents", "doc_id", "source", "text")
    rows = derive.instruction_rows(docs)
    halves = {"output": F.when(F.col("doc_id") % 11 != 0, F.col("output")), "instruction": F.when(F.col("doc_id") % 11 != 1, F.col("instruction"))}
    ids = scoring_inputs(rows.withColumns(halves))
    total = F.aggregate("input_ids", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return ids.select("doc_id", "skip_reason", "n_tokens", total.alias("ids_sum"))


_GENERATIONS = f"""generations AS (
  SELECT doc_id, {sql.HEAD} AS prompt, {sql.REST} AS response, len({sql.tokens(sql.REST)}) AS tokens, (1 + doc_id % 7)::DOUBLE AS latency_s
  FROM documents)"""


@query(
    "generation_speed",
    f"""WITH {_GENERATIONS}
        SELECT count(*) AS n, round(avg(tokens / latency_s), 6) AS avg_tok_per_sec, round(sum(tokens) / sum(latency_s), 6) AS overall_tok_per_sec,
               round(avg(tokens), 6) AS avg_tokens, min(tokens)::BIGINT AS min_tokens, max(tokens)::BIGINT AS max_tokens,
               quantile_cont(tokens, 0.5)::DOUBLE AS median_tokens
        FROM generations""",
)
def generation_speed(t: Tables):
    table = generation_summary(with_speed(derive.generations(t)))
    rounded = {c: F.round(c, 6) for c in ("avg_tok_per_sec", "overall_tok_per_sec", "avg_tokens")}
    return table.withColumns(rounded)


@query(
    "length_quantiles",
    f"""WITH lengths AS (SELECT source, len({sql.tokens(sql.REST)}) AS tokens FROM documents),
        groups AS (SELECT source, tokens FROM lengths UNION ALL SELECT 'all sources', tokens FROM lengths)
        SELECT source, q AS quantile, count(*) AS n, min(tokens)::BIGINT AS lowest, max(tokens)::BIGINT AS highest, true AS within_error
        FROM groups, (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE)) v(q) GROUP BY source, q""",
)
def length_quantiles(t: Tables):
    """Sketches per source, stored and then merged to one of all; each quantile's rank is checked against the rows."""
    rows = derive.prompt_rows(t.spread("documents", "doc_id", "source", "text"))
    rows = store(rows.select("source", WhitespaceTokenizer().count(F.col("completion")).alias("tokens")), "lengths")
    kept = store(length_sketches(rows, "tokens", ["source"]), "length-sketches")
    together = merge_sketches(kept).select(F.lit("all sources").alias("source"), "n", "lowest", "highest", "sketch")
    found = read_quantiles(kept.unionByName(together), ["source"])
    everything = rows.unionByName(rows.withColumn("source", F.lit("all sources")))
    ranked = quantile_ranks(everything, "tokens", found, ["source"])
    within = (F.col("below") <= F.col("quantile") + RANK_ERROR) & (F.col("upto") >= F.col("quantile") - RANK_ERROR)
    return ranked.select("source", "quantile", "n", "lowest", "highest", within.alias("within_error"))


@query(
    "generation_previews",
    f"""WITH {_GENERATIONS}
        SELECT doc_id, substr(prompt, 1, 60) || '...' AS prompt_preview, substr(response, 1, 200) || '...' AS response_preview FROM generations""",
)
def previews(t: Tables):
    return generation_previews(derive.generations(t)).select("doc_id", "prompt_preview", "response_preview")


@query(
    "new_tokens",
    f"""SELECT doc_id, coalesce(list_sum(ids[p + 1:]), 0)::BIGINT AS new_sum, (len(ids) - p)::BIGINT AS n_new FROM (
          SELECT doc_id, {sql.token_ids(sql.tokens('text'))} AS ids, len({sql.tokens(sql.HEAD)}) AS p FROM documents)""",
)
def generated_part(t: Tables):
    tok = WhitespaceTokenizer()
    head, _ = derive.head_and_rest(F.col("text"))
    docs = t.spread("documents", "doc_id", "text")
    docs = docs.select("doc_id", tok.ids(F.col("text")).alias("ids"), tok.count(head).alias("p"))
    new = docs.withColumn("new", new_tokens(F.col("ids"), F.col("p")))
    total = F.aggregate("new", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return new.select("doc_id", total.alias("new_sum"), F.array_size("new").cast("bigint").alias("n_new"))


@query(
    "evaluation_json",
    f"""WITH {sql.SCORES}, {_GENERATIONS},
        p AS (SELECT exp(sum(loss * n_tokens) / sum(n_tokens)) AS ppl, sum(n_tokens) AS n FROM scores WHERE model = 'tuned')
        SELECT round(ppl, 6) AS perplexity, n::BIGINT AS total_tokens, (SELECT count(*) FROM generations) AS n_generations,
               (SELECT sum(tokens) FROM generations)::BIGINT AS tokens, (SELECT sum(length(response)) FROM generations)::BIGINT AS n_chars FROM p""",
)
def evaluation_json(t: Tables):
    """Results written as JSON lines, and summed up from the files."""
    path = new_folder(t.spark, "evaluation")
    tuned = derive.scores(t).filter(F.col("model") == "tuned")
    write_evaluation(perplexity_summary(tuned), with_speed(derive.generations(t)), path)
    summary = t.spark.read.schema(
        "perplexity struct<perplexity:double,avg_loss:double,total_tokens:bigint>"
    ).json(f"{path}/perplexity")
    made = t.spark.read.schema("prompt string, response string, tokens bigint, tok_per_sec double, latency_s double")
    totals = made.json(f"{path}/generations").agg(
        F.count(F.lit(1)).alias("n_generations"), F.sum("tokens").alias("tokens"),
        F.sum(F.length("response")).alias("n_chars"),
    )
    names = ("n_generations", "tokens", "n_chars")
    totals = totals.select(F.struct(*names)).scalar()
    return summary.select(
        F.round("perplexity.perplexity", 6).alias("perplexity"), F.col("perplexity.total_tokens").alias("total_tokens"),
        *[totals[n].alias(n) for n in names],
    )
