"""Batches, packed chunks and the order examples are consumed in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnloom.config import DEFAULT_SEED, PAD_LABEL, PAD_MASK, PAD_TOKEN_ID
from turnloom.functions.tokens import Tokenizer, WhitespaceTokenizer, pad_to
from turnloom.operators.ordered import RowOrder, global_index, ordered_scan, shuffle_key


def assign_batches(
    examples: DataFrame, ids: Sequence[str], order: RowOrder, batch_size: int = 1
) -> DataFrame:
    """``ids, batch_id, row_in_batch, batch_len`` of every example.

    Works on ids and lengths only. The last batch may be short.
    """
    slim = examples.select(*dict.fromkeys([*ids, *order.tie]), "n_tokens", order.key.alias("__key"))
    slim_order = RowOrder(F.col("__key"), order.tie, order.shifts)
    placed = global_index(slim, slim_order)
    placed = placed.withColumns(
        {
            "batch_id": F.floor(F.col("position") / batch_size).cast("bigint"),
            "row_in_batch": F.pmod("position", F.lit(batch_size)).cast("bigint"),
        }
    )
    longest = F.max("n_tokens").over(W.partitionBy("batch_id")) if batch_size > 1 else F.col("n_tokens")
    return placed.select(*ids, "batch_id", "row_in_batch", longest.alias("batch_len"))


def pad_batches(
    examples: DataFrame, ids: Sequence[str], order: RowOrder, batch_size: int = 1
) -> DataFrame:
    """Examples with their batch, padded to its longest one.

    The arrays move once, in the join on the id; give it stored examples, which
    are read twice.
    """
    placed = assign_batches(examples, ids, order, batch_size)
    length = F.col("batch_len")
    return examples.join(placed, list(ids)).withColumns(
        {
            "input_ids": pad_to(F.col("input_ids"), length, PAD_TOKEN_ID),
            "labels": pad_to(F.col("labels"), length, PAD_LABEL),
            "attention_mask": pad_to(F.col("attention_mask"), length, PAD_MASK),
        }
    )


def pack_documents(
    docs: DataFrame,
    order: RowOrder,
    *,
    text: str = "text",
    chunk_len: int = 1024,
    eos_id: int = -1,
    stride: int | None = None,
    keep_tail: bool = False,
    tokenizer: Tokenizer = WhitespaceTokenizer(),
) -> DataFrame:
    """``chunk_id, input_ids, labels``: documents laid end to end and cut.

    Each document is followed by ``eos_id``. A chunk takes ``chunk_len + 1``
    tokens, so that labels are the inputs one token on; the next one starts
    ``stride`` tokens later (default ``chunk_len``, sharing one token). No
    padding; an incomplete last chunk is dropped unless ``keep_tail``.

    A document is cut into its pieces before anything is exploded, so what is
    grouped is one row per document and chunk, and a chunk never gathers more
    pieces than it has tokens. Token ids move once, as 32-bit numbers (larger
    ones fail), to the block of the order key; a chunk inside a block is put
    together there, and only pieces of chunks that go over a border of blocks
    move again. Whole texts are heavy rows, so blocks of about a thousand
    documents suit (``by_column(..., bits=10)``).
    """
    stride = chunk_len if stride is None else stride
    if not 1 <= stride <= chunk_len + 1:
        raise ValueError("stride must be between 1 and chunk_len + 1")
    width = chunk_len + 1
    slim = docs.select(order.key.alias("__key"), *order.tie, F.col(text).alias("__text"))
    slim = slim.filter(F.col("__text").isNotNull())
    encoded = tokenizer.encode(slim, "__text", "__ids", None, {"__n": "__text"}).drop("__text")
    encoded = encoded.withColumns(
        {
            "__ids": F.concat("__ids", F.array(F.lit(eos_id).cast("bigint"))).cast("array<int>"),
            "__n": F.col("__n") + 1,
        }
    )
    placed = ordered_scan(
        encoded,
        RowOrder(F.col("__key"), order.tie, order.shifts),
        sums={"__start": F.col("__n")},
        block="__block",
    )
    along = W.partitionBy("__block")
    placed = placed.select(
        "__block",
        "__ids",
        F.col("__start"),
        (F.col("__start") + F.col("__n")).alias("__end"),
        F.min("__start").over(along).alias("__from"),
        F.max(F.col("__start") + F.col("__n")).over(along).alias("__to"),
    )
    start, end, ids = F.col("__start"), F.col("__end"), F.col("__ids")
    first = F.greatest(F.ceil((start - width + 1) / stride), F.lit(0)).cast("bigint")
    last = F.floor((end - 1) / stride).cast("bigint")

    def within(chunk):
        return (chunk * stride >= F.col("__from")) & (chunk * stride + width <= F.col("__to"))

    def piece(chunk):
        begin = F.greatest(start, chunk * stride)
        stop = F.least(end, chunk * stride + width)
        return F.struct(
            chunk.alias("chunk_id"),
            begin.alias("at"),
            F.slice(ids, (begin - start + 1).cast("int"), (stop - begin).cast("int")).alias("ids"),
        )

    def assembled(wanted, *keys: str) -> DataFrame:
        numbers = F.filter(F.sequence(first, last), wanted)
        return (
            placed.select("__block", F.inline(F.transform(numbers, piece)))
            .groupBy(*keys, "chunk_id")
            .agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("__p"))
            .select("chunk_id", F.flatten(F.transform("__p", lambda p: p["ids"])).alias("__c"))
        )

    chunks = assembled(within, "__block").unionByName(assembled(lambda c: ~within(c)))
    size = F.array_size("__c")
    chunks = chunks.filter(size > 1) if keep_tail else chunks.filter(size == width)
    tokens = F.col("__c").cast("array<bigint>")
    return chunks.select(
        "chunk_id",
        F.slice(tokens, F.lit(1), size - 1).alias("input_ids"),
        F.slice(tokens, F.lit(2), size - 1).alias("labels"),
    )


def training_manifest(
    examples: DataFrame,
    id_col: str,
    *,
    max_steps: int,
    per_step: int,
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """``step, slot, epoch, id`` for every example a run consumes.

    Each epoch is a new shuffle of all examples, each step takes ``per_step`` of
    them, and an epoch starts as soon as the previous one is used up.
    """
    if max_steps < 1 or per_step < 1:
        raise ValueError("max_steps and per_step must be positive")
    ids = examples.select(id_col)
    n = ids.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    needed = F.lit(max_steps * per_step).cast("bigint")
    epochs = F.ceil(needed / F.greatest(n, F.lit(1))).cast("bigint")
    repeated = ids.withColumn(
        "epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), epochs - 1))
    )
    order = RowOrder(shuffle_key("epoch", id_col, seed=seed), (id_col,), (44,))
    placed = global_index(repeated, order, by=["epoch"], name="__i", total="__n")
    at = F.col("epoch") * F.col("__n") + F.col("__i")
    return (
        placed.filter(at < needed)
        .withColumns(
            {"step": F.floor(at / per_step).cast("bigint"), "slot": F.pmod(at, F.lit(per_step)).cast("bigint")}
        )
        .select("step", "slot", "epoch", id_col)
    )
