"""Corpora in four layouts to one messages column, capped and concatenated."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.config import SourceSpec
from turnloom.functions.messages import (
    MESSAGES_TYPE,
    conversation_facts,
    from_instruction,
    from_prompt_completion,
    from_sharegpt,
    has_facts,
    message,
    pair_facts,
)
from turnloom.operators.examples import computed_once, keep_eligible, with_facts
from turnloom.operators.ordered import RowOrder, counted_blocks, first_n, order_of, total_order
from turnloom.sources.readers import read_corpus
from turnloom.sources.sinks import store


def normalise(df: DataFrame, presence: str = "schema") -> DataFrame:
    """Add ``messages``, ``format`` and ``facts``; null where no layout fits.

    Tried in order: messages, conversations, prompt + completion, instruction.
    A list layout fits a row whose list is not null. With ``presence="schema"``
    a flat layout fits every row of a table that has its columns. Files that
    mix layouts get the union of all columns, so for those ``"value"`` asks for
    non-null values in each row instead.

    The facts of a flat layout are known without reading its texts, so testing
    and capping such a source reads no text at all. Facts that came with the
    table describe whole conversations and are kept.
    """
    if presence not in ("schema", "value"):
        raise ValueError("presence must be 'schema' or 'value'")
    types = {f.name: f.dataType for f in df.schema.fields}
    by_value = presence == "value"
    lists, flat = [], []  # (name, does it fit this row, messages, null text)

    def is_turn_list(name: str) -> bool:
        kind = types.get(name)
        return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)

    if is_turn_list("messages"):
        turns = F.col("messages")
        plain = F.transform(turns, lambda m: message(m["role"], m["content"]))
        lists.append(("messages", turns.isNotNull(), plain))
    if is_turn_list("conversations"):
        turns = F.col("conversations")
        fields = types["conversations"].elementType.fieldNames()
        lists.append(("conversations", turns.isNotNull(), from_sharegpt(turns, fields)))
    if "prompt" in types and "completion" in types:
        prompt, completion = F.col("prompt"), F.col("completion")
        fits = prompt.isNotNull() & completion.isNotNull() if by_value else F.lit(True)
        blank = prompt.isNull() | completion.isNull()
        flat.append(("prompt", fits, from_prompt_completion(prompt, completion), blank))
    if "instruction" in types:
        instruction = F.col("instruction")
        output = F.col("output") if "output" in types else None
        if by_value and output is not None:
            output = F.coalesce(output, F.lit(""))
        extra = F.col("input") if "input" in types else None
        fits = instruction.isNotNull() if by_value else F.lit(True)
        blank = instruction.isNull() | (output.isNull() if output is not None else F.lit(False))
        flat.append(("instruction", fits, from_instruction(instruction, extra, output), blank))

    layouts = lists + [f[:3] for f in flat]
    if not layouts:
        missing = F.lit(None).cast(MESSAGES_TYPE)
        return with_facts(
            df.withColumns({"messages": missing, "format": F.lit(None).cast("string")})
        )
    made = df.withColumns(
        {
            "messages": F.coalesce(*[F.when(fits, m.cast(MESSAGES_TYPE)) for _, fits, m in layouts]),
            "format": F.coalesce(*[F.when(fits, F.lit(name)) for name, fits, _ in layouts]),
        }
    )
    if has_facts(df):
        return made
    if lists:
        return with_facts(computed_once(made, ["messages", "format"]))
    known = [F.when(fits, pair_facts(blank)) for _, fits, _, blank in flat]
    nothing = [conversation_facts(F.col("messages"))] if by_value else []
    return made.withColumn("facts", F.coalesce(*known, *nothing))


def cap_per_group(df: DataFrame, by: str, order: RowOrder, cap: int) -> DataFrame:
    """Exactly the first ``cap`` rows of every group, or all it has; 0 keeps all rows.

    Finds the block of each group in which the cap falls from counts. Rows of
    earlier blocks stay, and only those of that block are ranked, so a group may
    own any share of the table. Null keys come last, rows of one key and tie in
    an order of their own, and a null group is a group.
    """
    if cap <= 0:
        return df
    key, tie = total_order(order, df)
    block = F.shiftright("__k", order.shifts[0])
    work = df.withColumns({"__k": key, "__group": F.struct(by)})
    found = (
        counted_blocks(work.select("__group", "__k"), order, by=["__group"])
        .withColumn("__rank", F.lit(cap) - F.col("before"))
        .filter("__rank BETWEEN 1 AND n")
        .select("__group", F.col("block").alias("__cut"), "__rank")
    )
    # A group with fewer rows than the cap has no such block and stays whole.
    placed = work.withColumn("__block", block).join(found, "__group", "left")
    names = [F.col(f"`{c}`") for c in df.columns]
    before = placed.filter(F.col("__cut").isNull() | (F.col("__block") < F.col("__cut"))).select(*names)
    w = W.partitionBy("__group", "__block").orderBy("__k", *tie)
    ranked = placed.filter(F.col("__block") == F.col("__cut")).withColumn("__rn", F.row_number().over(w))
    return before.unionAll(ranked.filter(F.col("__rn") <= F.col("__rank")).select(*names))


def load_source(spark: SparkSession, spec: SourceSpec, presence: str = "schema") -> DataFrame:
    """Read, normalise, keep eligible rows, then cap: the cap counts those."""
    return prepare_source(read_corpus(spark, spec), spec, presence)


def prepare_source(df: DataFrame, spec: SourceSpec, presence: str = "schema", stored: bool = False) -> DataFrame:
    """Eligible rows of one source under ``id, source, category, format, messages, facts``.

    Columns are renamed by ``column_map`` first. An id of whole numbers is a
    bigint, any other stays as it is. A cap reads its input several times;
    ``stored`` writes the eligible rows down before, for inputs that cost more
    than a scan.
    """
    for theirs, ours in spec.column_map:
        df = df.withColumnRenamed(theirs, ours)
    rows = keep_eligible(normalise(df, presence))
    order = order_of(rows, spec.order_by)
    if spec.cap > 0:
        rows = first_n(store(rows, "source") if stored else rows, order, spec.cap)
    whole = isinstance(rows.schema[spec.order_by].dataType, T.IntegralType)
    return rows.select(
        (F.col(spec.order_by).cast("bigint") if whole else F.col(spec.order_by)).alias("id"),
        F.lit(spec.name).alias("source"),
        F.lit(spec.category).alias("category"),
        "format",
        "messages",
        "facts",
    )


def concatenate(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of all parts; duplicates stay. Ids of different types become text."""
    if len({p.schema["id"].dataType.simpleString() for p in parts if "id" in p.columns}) > 1:
        parts = [p.withColumn("id", F.col("id").cast("string")) for p in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=False), parts)


def load_mixture(
    spark: SparkSession, specs: Sequence[SourceSpec], presence: str = "schema"
) -> DataFrame:
    if not specs:
        raise ValueError("a mixture needs at least one source")
    return concatenate([load_source(spark, s, presence) for s in specs])
