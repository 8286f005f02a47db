"""Subword ids by ranked merges, over the distinct words of a table.

A text is cut into words in the JVM. Every distinct word is merged once. Texts lie
in blocks of about ``BLOCK_BYTES``; a block asks for the ids of its distinct words
and takes them for all its places, so that what moves is a text and a word of a
block, never a place. Words that make up more than one in ``HOT`` of all places are
at most ``HOT`` many, so they are joined by broadcast; only the others are shuffled
by word.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.sources.sinks import ship_package, store

# --- Fixed value: words, and the blanks between them, that merges do not cross ---
WORD_PATTERN = r"(?U) ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# ---------------------------------------------------------------------------------
HOT = 2000              # a word above one in so many places is hot
HOT_LENGTH = 256        # longer words are never broadcast
BLOCK_BYTES = 32 << 20  # text that one dictionary of words serves
MAX_FILE = 64 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of tokens from lines of base64 and rank; a rank is the token's id."""
    if os.path.getsize(path) > MAX_FILE:
        raise ValueError(f"{path} is larger than {MAX_FILE} bytes")
    with open(path, "rb") as f:
        pairs = (line.split() for line in f if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


def merge(word: bytes, ranks: Mapping[bytes, int]) -> list[int]:
    """Join the neighbours of least rank, the leftmost of equals, until none can be joined.

    A word that is a token itself stays whole. Neighbours wait in a heap, so a
    word of n bytes takes about n log n steps.
    """
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    stop = list(range(1, n + 1))    # where the part that begins here ends; 0 if none does
    before = list(range(-1, n - 1))
    waiting: list[tuple[int, int, int]] = []

    def offer(a: int) -> None:
        b = stop[a] if a >= 0 else n
        if b < n:
            rank = ranks.get(word[a : stop[b]])
            if rank is not None:
                heapq.heappush(waiting, (rank, a, stop[b]))

    for a in range(n):
        offer(a)
    while waiting:
        _, a, end = heapq.heappop(waiting)
        b = stop[a]
        if not 0 < b < n or stop[b] != end:
            continue    # one of the two has been joined meanwhile
        stop[a], stop[b] = end, 0
        if end < n:
            before[end] = a
        offer(before[a])
        offer(a)
    ids, a = [], 0
    while a < n:
        ids.append(ranks[word[a : stop[a]]])
        a = stop[a]
    return ids


class RankedMerges:
    """A ``Tokenizer`` of subwords; its token files stay where they are, the path is a parameter.

    Ids depend on the text alone, so equal texts are encoded once and rows need
    no id of their own. A null text has null ids and counts, an empty one none.
    Every byte must be a token, as in byte-level vocabularies. Distinct texts,
    words and ids go through stored tables in the shared folder. The input is
    read twice, so hand in a stored table or one that is cheap to derive.
    """

    def __init__(self, path: str):
        self.path = path

    def _merged(self, words: DataFrame) -> DataFrame:
        ranks = ship_package(words.sparkSession).sparkContext.broadcast(read_ranks(self.path))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = [merge(w.encode("utf-8", "surrogatepass"), ranks.value) for w in batch.column("word").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], ["word", "places", "ids"])

        return words.mapInArrow(run, "word string, places bigint, ids array<int>")

    def texts_to_ids(self, texts: DataFrame) -> DataFrame:
        """``key, ids`` of distinct non-empty texts given as ``key, text``."""
        partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        n_bytes = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).select("n").scalar()
        # Blocks refine the partitions that a shuffle by key gives, so a task that reads such a table sees few of them.
        blocks = (F.floor(n_bytes / (partitions * BLOCK_BYTES)) + 1) * partitions
        cut = texts.select("key", F.pmod(F.hash("key"), blocks).cast("bigint").alias("block"), F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0)).alias("words"))
        asked = store(cut.select("block", F.explode("words").alias("word")).groupBy("block", "word").agg(F.count(F.lit(1)).alias("places")), "block-words")
        # Merging, the costly part, must not run in the few tasks that a small list of words would get.
        counted = asked.groupBy("word").agg(F.sum("places").alias("places"))
        merged = store(self._merged(counted.repartition(partitions, "word")), "words")
        places = merged.agg(F.sum("places").alias("n")).select("n").scalar()
        is_hot = (F.col("places") * HOT > places) & (F.char_length("word") <= HOT_LENGTH)
        hot = F.broadcast(merged.where(is_hot).select("word", "ids"))
        cold = merged.where(~is_hot).select("word", "ids")
        # A hot word of a block has its ids at once; the others are the rest.
        placed = asked.select("block", "word").join(hot, "word", "left")
        rare = placed.where(F.col("ids").isNull()).drop("ids").join(cold, "word")
        common = placed.where(F.col("ids").isNotNull())
        known = common.select("block", "word", "ids").unionByName(rare.select("block", "word", "ids"))
        # Words cover a text, so their lengths cut it again.
        lengths = F.transform("words", lambda w: F.octet_length(w))
        whole = cut.select("block", "key", F.array_join("words", "").alias("text"), lengths.alias("lengths"))
        return whole.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_look_up, "key string, ids array<int>")

    def encode(self, df: DataFrame, text: str, ids: str, max_len: int | None, counts: dict[str, str]) -> DataFrame:
        columns = list(dict.fromkeys([text, *counts.values()]))
        all_texts = reduce(DataFrame.unionAll, [df.select(F.col(f"`{c}`").alias("text")) for c in columns])
        some = all_texts.where(F.length("text") > 0).select(_key(F.col("text")).alias("key"), "text")
        distinct = store(some.groupBy("key").agg(F.first("text").alias("text")), "texts")
        coded = store(self.texts_to_ids(distinct), "ids")
        if max_len is not None:
            coded = coded.withColumn("ids", F.slice("ids", 1, max_len))

        def filled(found: Column, empty: Column, i: int) -> Column:
            return F.when(F.col(f"__empty{i}"), empty).otherwise(found)

        # Texts are asked for their keys before the joins, so one that nobody reads afterwards is not moved.
        out = df.withColumns({f"__key{i}": _key(F.col(f"`{c}`")) for i, c in enumerate(columns)}
                             | {f"__empty{i}": F.length(f"`{c}`") == 0 for i, c in enumerate(columns)})
        for i, c in enumerate(columns):
            value = coded.select(F.col("key").alias(f"__key{i}"), F.size("ids").cast("bigint").alias(f"__n{i}"), *([F.col("ids").alias("__coded")] if c == text else []))
            out = out.join(value, f"__key{i}", "left")
        new = {ids: filled(F.col("__coded").cast("array<bigint>"), F.array().cast("array<bigint>"), 0)}
        new |= {name: filled(F.col(f"__n{columns.index(c)}"), F.lit(0).cast("bigint"), columns.index(c)) for name, c in counts.items()}
        return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in new], *[e.alias(n) for n, e in new.items()])


def _key(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def _look_up(texts: pa.Table, known: pa.Table) -> pa.Table:
    """Ids of a block's texts from those of its words."""
    known = known.combine_chunks()
    words, ids = known.column("word").cast(pa.large_string()), known.column("ids")
    out = []
    for batch in texts.to_batches(max_chunksize=1024):
        if not batch.num_rows:
            continue
        lists = batch.column("lengths")
        ends = np.cumsum(lists.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)
        joined = "".join(batch.column("text").to_pylist()).encode("utf-8", "surrogatepass")
        offsets = np.concatenate(([0], ends))
        places = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(joined))
        found = ids.take(pc.index_in(places, value_set=words)).combine_chunks()
        if found.null_count:
            raise ValueError("a word has no ids")
        # From places to texts: the ids before a text's first place.
        before = np.concatenate(([0], np.cumsum(pc.list_value_length(found).to_numpy(zero_copy_only=False))))
        firsts = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))
        value = pa.ListArray.from_arrays(pa.array(before[firsts].astype(np.int32)), found.flatten())
        out.append(pa.RecordBatch.from_arrays([batch.column("key"), value], ["key", "ids"]))
    return pa.Table.from_batches(out, pa.schema([("key", pa.string()), ("ids", pa.list_(pa.int32()))]))
