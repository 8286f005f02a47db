"""Benchmark decontamination with an FM-index per shard.

A shard is some hundred thousand consecutive words of the documents in one
task. Words that no benchmark item has, and the borders of documents, are one
separator symbol, so a shard is a string over the benchmark's own vocabulary.
Its suffixes are sorted, the Burrows-Wheeler transform goes into a wavelet
matrix with rank counts, and all windows are searched backwards at once.
Occurrences are located by walking back to sampled suffix positions. Hits are
merged into spans of words per document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.llm.common import as_named, as_numbered, byte_blocks, kept_columns, numbered_fields, query, stored, table

WINDOW = 10
SHARD_WORDS = 400_000
SAMPLE_EVERY = 8
BLOCK_WORDS = 2_000_000     # benchmark words sent to the tasks at a time

_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased words: digits, a-z and everything beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


# --- FM-index -----------------------------------------------------------------

def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes of a string whose zeros are separators: each differs from all others, by place.

    Prefix doubling; every round sorts only what is still undecided, and no
    comparison goes beyond a separator. The string must end with one.
    """
    n = len(symbols)
    bits = max(1, int(n).bit_length())
    order = np.argsort(symbols.astype(np.uint16) if symbols.max() < 1 << 16 else symbols, kind="stable")
    first = symbols[order]
    fresh = np.concatenate(([True], first[1:] != first[:-1])) | (first == 0)
    rank = np.empty(n, np.int64)     # first place of its group
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    undecided = order[~(fresh & np.concatenate((fresh[1:], [True])))]
    step = 1
    while len(undecided):
        # What an undecided suffix has in common with another holds no separator, so undecided + step is inside.
        mine, other = rank[undecided], rank[undecided + step]
        if 3 * bits <= 63:
            packed = np.sort((mine << (2 * bits)) | (other << bits) | undecided)
            moved, pair = packed & ((1 << bits) - 1), packed >> bits
        else:
            by = np.lexsort((other, mine))
            moved, pair = undecided[by], (mine[by] << bits) | other[by]
        group, place = pair >> bits, np.arange(len(moved))
        new_group = np.concatenate(([True], group[1:] != group[:-1]))
        fresh = np.concatenate(([True], pair[1:] != pair[:-1]))
        start = np.maximum.accumulate(np.where(new_group, place, 0))
        head = np.maximum.accumulate(np.where(fresh, place, 0))
        rank[moved] = group + (head - start)
        order[group + (place - start)] = moved
        undecided = moved[~(fresh & np.concatenate((fresh[1:], [True])))]
        step *= 2
    return order


class WaveletMatrix:
    """Ranks in a sequence of small numbers, one bit plane per level, highest bit first."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            plane = (values >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(plane, dtype=np.int32))).astype(np.int32))
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            bit = plane.astype(bool)
            values = np.concatenate((values[~bit], values[bit]))

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low, high = np.zeros(len(symbols), np.int64), places.astype(np.int64)
        for i, level in enumerate(range(self.bits - 1, -1, -1)):
            ones_low, ones_high = self.ones[i][low], self.ones[i][high]
            bit = ((symbols >> level) & 1).astype(bool)
            low = np.where(bit, self.zeros[i] + ones_low, low - ones_low)
            high = np.where(bit, self.zeros[i] + ones_high, high - ones_high)
        return high - low


class FMIndex:
    """Counts and places of phrases in a string of symbols 0 .. ``n_symbols`` - 1 that ends with 0; 0 is never searched."""

    def __init__(self, symbols: np.ndarray, n_symbols: int, every: int = SAMPLE_EVERY):
        order = suffix_array(symbols)
        self.transform = symbols[order - 1]          # the suffix at 0 is preceded by the string's end, a separator
        self.before = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=n_symbols))))
        self.matrix = WaveletMatrix(self.transform, max(1, int(n_symbols - 1).bit_length()))
        # Places after a separator are sampled too, so that no walk goes over one.
        self.marked = (order % every == 0) | (self.transform == 0)
        self.marks_before = np.concatenate(([0], np.cumsum(self.marked)))
        self.samples = order[self.marked]

    def ranges(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose suffix begins with each phrase; phrases are right-aligned rows of an array."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.transform), np.int64)
        active = np.arange(len(phrases))
        for back in range(1, phrases.shape[1] + 1):
            active = active[(lengths[active] >= back) & (high[active] > low[active])]
            if not len(active):
                break
            c = phrases[active, -back]
            low[active] = self.before[c] + self.matrix.rank(c, low[active])
            high[active] = self.before[c] + self.matrix.rank(c, high[active])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by steps back to a sampled one."""
        place, steps = np.full(len(rows), -1, np.int64), 0
        left, at = np.arange(len(rows)), rows.astype(np.int64)
        while len(left):
            there = self.marked[at]
            place[left[there]] = self.samples[self.marks_before[at[there]]] + steps
            left, at = left[~there], at[~there]
            c = self.transform[at]
            at = self.before[c] + self.matrix.rank(c, at)
            steps += 1
        return place


# --- benchmark and shards -------------------------------------------------------

@dataclass(frozen=True)
class Phrases:
    """Distinct windows of one block of benchmark items."""

    vocabulary: dict[bytes, int]
    phrases: np.ndarray     # right-aligned symbols
    lengths: np.ndarray
    items: list[list[str]]  # items of each window


def phrases_of(rows: list[tuple[str, str | None]], window: int) -> Phrases:
    vocabulary: dict[bytes, int] = {}
    found: dict[tuple[int, ...], set[str]] = {}
    for item, text in rows:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)]
        for i in range(max(1, len(ids) - window + 1) if ids else 0):
            found.setdefault(tuple(ids[i : i + window]), set()).add(item)
    out = np.zeros((len(found), window), np.int64)
    for r, p in enumerate(found):
        out[r, window - len(p) :] = p
    return Phrases(vocabulary, out, np.array([len(p) for p in found], np.int64), [sorted(v) for v in found.values()])


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> Iterator[Phrases]:
    """The items in blocks of at most about ``block_words`` words (a larger item is a block of its own)."""
    rows, size = [], 0
    for r in benchmark.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("string"), text_col).toLocalIterator():
        n = len(r[1]) // 2 + 1
        if rows and size + n > block_words:
            yield phrases_of(rows, window)
            rows, size = [], 0
        rows.append((r[0], r[1]))
        size += n
    if rows:
        yield phrases_of(rows, window)


def shard_hits(symbols: np.ndarray, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Places and windows of all occurrences in one shard, by place."""
    if not len(symbols) or not len(p.lengths):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    index = FMIndex(symbols, len(p.vocabulary) + 1)
    low, high = index.ranges(p.phrases, p.lengths)
    n = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(n)), n)
    rows = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    place = index.locate(rows)
    by = np.argsort(place, kind="stable")
    return place[by], which[by]


def search_texts(texts: list[str | None], p: Phrases, window: int, shard_words: int) -> list[tuple[int, list[dict], list[str]]]:
    """Per text: words, merged spans of hit words, items. Texts go into shards whole, or in overlapping pieces if longer."""
    get = p.vocabulary.get
    encoded = []
    for t in texts:
        found = words(t)
        encoded.append(np.fromiter(map(get, found, repeat(0)), np.int64, len(found)))
    hit = [None] * len(texts)
    items: list[set[str]] = [set() for _ in texts]
    shard: list[tuple[int, int, np.ndarray]] = []

    def flush() -> None:
        # One separator after each piece keeps phrases from crossing over.
        starts = np.cumsum([0, *(len(s[2]) + 1 for s in shard)])
        symbols = np.zeros(int(starts[-1]), np.int64)
        for (_, _, piece), a in zip(shard, starts):
            symbols[a : a + len(piece)] = piece
        place, which = shard_hits(symbols, p)
        owner = np.searchsorted(starts, place, "right") - 1
        for at, w, o in zip(place.tolist(), which.tolist(), owner.tolist()):
            row, first, _ = shard[o]
            if hit[row] is None:
                hit[row] = np.zeros(len(encoded[row]), np.int8)
            at += first - int(starts[o])
            hit[row][at : at + int(p.lengths[w])] = 1
            items[row].update(p.items[w])
        shard.clear()

    size = 0
    for row, symbols in enumerate(encoded):
        for a in range(0, max(1, len(symbols) - window + 1), shard_words):
            piece = symbols[a : a + shard_words + window - 1]
            if shard and size + len(piece) > shard_words:
                flush()
                size = 0
            shard.append((row, a, piece))
            size += len(piece)
    if shard:
        flush()
    out = []
    for symbols, h, i in zip(encoded, hit, items):
        edge = [] if h is None else np.flatnonzero(np.diff(np.concatenate(([0], h, [0])))).tolist()
        out.append((len(symbols), [{"first": a, "stop": b} for a, b in zip(edge[::2], edge[1::2])], sorted(i)))
    return out


def merged(spans: Column) -> Column:
    """Overlapping and touching spans of words joined."""
    return F.aggregate(F.array_sort(spans), F.slice(spans, 1, 0), lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["stop"] >= s["first"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            F.element_at(acc, -1)["first"].alias("first"), F.greatest(F.element_at(acc, -1)["stop"], s["stop"]).alias("stop")))),
    ).otherwise(F.concat(acc, F.array(s))))


def find_windows(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                 window: int = WINDOW, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS, keep: list[str] | None = None) -> DataFrame:
    """Benchmark windows in every whole text: the columns ``keep`` (all if not given) and ``n_words, spans, items``.

    A window is ``window`` consecutive words of an item, or the whole of a
    shorter one. ``spans`` are the merged runs of hit words (first, stop),
    ``items`` the sorted ids, as strings, of items with a window in the text.
    One row per row, nothing is shuffled. The benchmark is sent to the tasks in
    blocks of bounded size; between two blocks the rows are stored.

    A null text, or one without a word, has no words; null items and null item
    ids are left out; items of equal text are all reported. Repeated rows are
    judged each by itself. Other columns pass through; a kept column named like
    a result is replaced by it.
    """
    spark = docs.sparkSession
    kept = kept_columns(docs, keep, ["n_words", "spans", "items"])
    rows = docs.select(*as_numbered(kept), F.col(text_col).alias("text"))
    added = T.StructType.fromDDL("n_words bigint, spans array<struct<first:bigint,stop:bigint>>, items array<string>")
    types = [pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())])), pa.list_(pa.string())]

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in byte_blocks(batches, "text", 6 * shard_words):
                found = search_texts(batch.column("text").to_pylist(), shared.value, window, shard_words)
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(zip(*found), types))], [*batch.schema.names, *added.names])
        return run

    blocks = benchmark_blocks(benchmark, item_col, item_text_col, window, block_words)
    result = rows.mapInArrow(search(spark.sparkContext.broadcast(next(blocks, None) or phrases_of([], window))), T.StructType([*rows.schema, *added]))
    for block in blocks:
        before = stored(result.select(*rows.columns, F.col("spans").alias("old_spans"), F.col("items").alias("old_items")))
        both = before.mapInArrow(search(spark.sparkContext.broadcast(block)), T.StructType([*before.schema, *added]))
        result = both.withColumns({"spans": merged(F.concat("old_spans", "spans")), "items": F.array_sort(F.array_union("old_items", "items"))})
    return result.select(*as_named(kept), *added.names)


_WORD_RUN = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def cut(text: str | None, spans: list[dict]) -> str | None:
    """A text without the words of the spans and what stands between them; blanks at a cut become one."""
    if not spans:
        return text
    places = [m.span() for m in _WORD_RUN.finditer(text)]
    out, at = [], 0
    for s in spans:
        out.append(text[at : places[s["first"]][0]])
        at = places[s["stop"] - 1][1]
    out.append(text[at:])
    joined = out[0]
    for part in out[1:]:
        joined += part[1:] if joined.endswith(" ") and part.startswith(" ") else part
    return joined


def without_spans(found: DataFrame, text_col: str = "text", out_col: str = "clean_text") -> DataFrame:
    """``find_windows``' rows with a column of the text without its hit words; texts without a hit stay as they are, null too.

    A column that is named ``out_col`` already, the text's own included, is replaced.
    """
    kept = kept_columns(found, None, [out_col])
    rows = found.select(*as_numbered(kept), F.col(f"`{text_col}`").alias("text"), "spans")
    schema = T.StructType([*numbered_fields(found, kept), T.StructField("clean", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_blocks(batches, "text"):
            clean = map(cut, batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(clean, pa.string())], schema.names)

    return rows.mapInArrow(run, schema).select(*as_named(kept), F.col("clean").alias(out_col))


@query("op6_decontamination", """
WITH RECURSIVE norm AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bench AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + 9], ' ') AS g, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM bench WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
found AS (
  SELECT doc_id, i, d.n, g FROM (
    SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
    FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM norm, sizes WHERE len(w) >= n)) d
  WHERE g IN (SELECT g FROM windows)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found JOIN windows USING (g, n)) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM norm LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = find_windows(table(spark, folder, "documents"), table(spark, folder, "benchmark"), keep=["doc_id"])
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["stop"] - s["first"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
