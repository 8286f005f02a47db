"""Line dedup over a whole corpus.

Lines travel as 128-bit hashes with document and position, never as text. They
are range-partitioned and sorted by hash, then document, so that a task streams
over them and sees the first occurrence of a line before all others. A line of
any frequency may cover many ranges: what a task cannot decide alone, its first
and last line, is decided from a few rows that each task adds about them. The
result is a compressed bitmap of the lines to keep for each document that loses
some.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.llm.common import as_named, as_numbered, ascii_lower, byte_blocks, kept_columns, numbered_fields, query, shuffle_width, stored, table

MIN_LENGTH = 20
MIN_DOCS = 3
BLANKS = " \t\n\x0b\x0c\r"
_NO_ID = -(1 << 63)
_DROP, _OPEN, _SEEN = 0, 1, 2


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _id(column: str) -> Column:
    return F.coalesce(F.col(column).cast("bigint"), F.lit(_NO_ID))


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_length: int) -> DataFrame:
    """``h1, h2, id, version, pos`` of every line whose key is long enough; ``version`` tells texts of one id apart."""
    rows = docs.select(_id(id_col).alias("id"), F.xxhash64(text_col).alias("version"), F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "line"))
    keyed = rows.select("id", "version", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_length)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "id", "version", "pos")


def _stream(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """One range of sorted lines: which to drop, which lie in an undecided line, and documents seen of such lines."""
    run: tuple[int, int] | None = None  # the line the stream is in
    opening = True                      # it may have begun in the range before
    seen: list[int] = []                # its first documents, min_docs at most
    held: list[np.ndarray] = []         # its rows while it is undecided

    def batch(kind: int, rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), kind, np.int32)), *(pa.array(rows[:, i]) for i in range(5))],
                                          ["kind", "h1", "h2", "id", "version", "pos"])

    def close(last: bool) -> Iterator[pa.RecordBatch]:
        if run is None:
            return
        if opening or last:
            yield batch(_SEEN, np.array([(*run, d, 0, 0) for d in seen], np.int64).reshape(-1, 5))
            if held:
                yield batch(_OPEN, np.concatenate(held))

    for b in batches:
        rows = np.column_stack([b.column(c).to_numpy().astype(np.int64) for c in ("h1", "h2", "id", "version", "pos")])
        if not len(rows):
            continue
        cut = np.flatnonzero((rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])) + 1
        first = (int(rows[0, 0]), int(rows[0, 1]))
        if run is None:
            run = first
        elif run != first:
            yield from close(False)
            run, opening, seen, held = first, False, [], []
        # Lines that lie within this batch are decided by arrays; the ones at its ends go through the state.
        head = cut[0] if len(cut) else len(rows)
        yield from _extend(rows[:head], opening, seen, held, min_docs, batch)
        if len(cut):
            yield from close(False)
            inner = rows[cut[0] : cut[-1]]
            if len(inner):
                starts = cut[:-1] - cut[0]
                fresh = np.concatenate(([True], inner[1:, 2] != inner[:-1, 2]))
                fresh[starts] = True
                n_docs = np.repeat(np.add.reduceat(fresh.astype(np.int64), starts), np.diff(np.append(starts, len(inner))))
                rank = np.cumsum(fresh)
                rank -= np.repeat(rank[starts], np.diff(np.append(starts, len(inner))))
                drop = (n_docs >= min_docs) & (rank > 0)
                if drop.any():
                    yield batch(_DROP, inner[drop])
            run, opening, seen, held = (int(rows[cut[-1], 0]), int(rows[cut[-1], 1])), False, [], []
            yield from _extend(rows[cut[-1] :], opening, seen, held, min_docs, batch)
    yield from close(True)


def _extend(rows: np.ndarray, opening: bool, seen: list[int], held: list[np.ndarray], min_docs: int, batch) -> Iterator[pa.RecordBatch]:
    """More rows of the line the stream is in."""
    if len(seen) < min_docs:
        ids = rows[:, 2]
        for d in ids[np.concatenate(([True], ids[1:] != ids[:-1]))][: min_docs + 1].tolist():
            if len(seen) < min_docs and (not seen or seen[-1] != d):
                seen.append(d)
    if opening:     # its first document may lie in a range before
        yield batch(_OPEN, rows)
    elif len(seen) < min_docs:
        held.append(rows)
    else:
        rows = np.concatenate([*held, rows])
        held.clear()
        rows = rows[rows[:, 2] != seen[0]]
        if len(rows):
            yield batch(_DROP, rows)


def pack_bitmap(dropped: list[int]) -> bytes:
    """One bit per line, 1 to keep, compressed; lines beyond the last bit are kept."""
    keep = np.ones(max(dropped) // 8 * 8 + 8, bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep).tobytes(), 6)


def dropped_lines(bitmap: bytes | None) -> list[int]:
    return [] if bitmap is None else np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8)) == 0).tolist()


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS) -> DataFrame:
    """``id, version, keep_bitmap`` of each document that loses lines.

    A line's key is the line without blanks at its ends and with A-Z in lower
    case. Keys of at least ``min_length`` code points that at least ``min_docs``
    documents hold stay in the largest id that holds them, and go elsewhere.

    Null and empty texts are one empty line, which is never long enough. Rows of
    one id are one document, each with the lines of its own text (``version`` is
    the text's hash); a null id is the smallest one. Other columns are not
    looked at.
    """
    n = shuffle_width(docs.sparkSession)
    order = ["h1", "h2", F.col("id").desc()]
    lines = line_hashes(docs, id_col, text_col, min_length).repartitionByRange(n, *order).sortWithinPartitions(*order, "version", "pos")
    # Written once: the rows of undecided lines meet what is known of those lines.
    found = stored(lines.mapInArrow(lambda batches: _stream(batches, min_docs), "kind int, h1 bigint, h2 bigint, id bigint, version bigint, pos bigint"))
    # At most 2 * min_docs rows per range, so this is small whatever the corpus.
    known = (found.where(F.col("kind") == _SEEN).groupBy("h1", "h2").agg(F.count_distinct("id").alias("docs"), F.max("id").alias("last"))
             .where(F.col("docs") >= min_docs))
    late = found.where(F.col("kind") == _OPEN).join(F.broadcast(known), ["h1", "h2"]).where(F.col("id") != F.col("last"))
    drops = found.where(F.col("kind") == _DROP).select("id", "version", "pos").unionByName(late.select("id", "version", "pos"))
    per_doc = drops.groupBy("id", "version").agg(F.collect_set("pos").alias("dropped"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(pack_bitmap, b.column(2).to_pylist()), pa.binary())], ["id", "version", "keep_bitmap"])

    return per_doc.mapInArrow(pack, "id bigint, version bigint, keep_bitmap binary")


def _without(text: str, dropped: list[int]) -> tuple[str, int]:
    gone = set(dropped)
    return "\n".join([line for i, line in enumerate(text.split("\n")) if i not in gone]), len(gone)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                        min_docs: int = MIN_DOCS, keep: list[str] | None = None) -> DataFrame:
    """``n_lines, n_dropped, kept_text`` of every row after the columns ``keep`` (the id alone if not given).

    See ``keep_bitmaps`` for the rule. A row that loses nothing keeps its text
    as it is; null becomes "". The texts meet their bitmaps by id and version. A
    kept column named like a result is replaced by it.
    """
    kept = kept_columns(docs, [id_col] if keep is None else keep, ["n_lines", "n_dropped", "kept_text"])
    bitmaps = keep_bitmaps(docs, id_col, text_col, min_length, min_docs).select(F.col("id").alias("__id"), F.col("version").alias("__version"), F.col("keep_bitmap").alias("__bitmap"))
    rows = docs.select(*as_numbered(kept), F.col(text_col).alias("__text"), _id(id_col).alias("__id"), F.xxhash64(text_col).alias("__version"))
    both = rows.join(bitmaps, ["__id", "__version"], "left").drop("__id", "__version")
    schema = T.StructType([*numbered_fields(docs, kept), *T.StructType.fromDDL("n_lines bigint, n_dropped bigint, kept_text string")])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_blocks(batches, "__text"):
            texts = [t or "" for t in b.column("__text").to_pylist()]
            n_lines = [t.count("\n") + 1 for t in texts]
            done = [(t, 0) if m is None else _without(t, dropped_lines(m)) for t, m in zip(texts, b.column("__bitmap").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(n_lines, pa.int64()), pa.array([n for _, n in done], pa.int64()), pa.array([t for t, _ in done], pa.string())], schema.names)

    out = both.mapInArrow(apply, schema)
    return out.select(*as_named(kept), "n_lines", "n_dropped", "kept_text")


@query("op1_line_dedup", """
WITH lines AS (
  SELECT doc_id, i - 1 AS pos, l[i] AS line, translate(trim(l[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
shared AS (
  SELECT k, max(doc_id) AS last FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE last IS NOT NULL AND doc_id <> last) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE last IS NULL OR doc_id = last), '')) AS kept_sha256
FROM lines LEFT JOIN shared USING (k) GROUP BY doc_id""")
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = drop_repeated_lines(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
