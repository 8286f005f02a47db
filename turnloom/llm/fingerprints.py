"""Document fingerprints by winnowing.

Every k-gram of code points is hashed; of each window of ``w`` successive
hashes the smallest is kept, the rightmost one of equals, with its position.
Two texts that share ``w + k - 1`` code points in a row share a fingerprint.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.llm.common import byte_blocks, code_points, query, table
from turnloom.llm.ranges import key_ranges

K = 12
W = 32
BLOCK = 1 << 18     # code points hashed at a time
HASH_BITS = 32

_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _POWERS:
        pair = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        _POWERS[n] = tuple(pair)
    return _POWERS[n]


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Rolling hash of each k-gram: prefix sums of a polynomial, shifted back by the inverse power."""
    n = len(codes)
    up, down = _powers(BLOCK + (1 << 12))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    rolled = (sums[k:] - sums[:-k]) * down[: n - k + 1]
    rolled ^= rolled >> np.uint64(32)
    rolled *= _MIX
    return rolled >> np.uint64(64 - HASH_BITS)


def _window_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` successive values, by doubling."""
    size = 1
    while size * 2 <= w:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = w - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def winnow(text: str, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the fingerprints of a whole text, in order.

    A text of fewer than ``k`` code points, but at least one, has one
    fingerprint of all it has; one of fewer than ``w`` grams is one window.
    """
    codes = code_points(text)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    k = min(k, len(codes))
    grams = len(codes) - k + 1
    w = min(w, grams)
    tail = np.uint64((1 << (64 - HASH_BITS)) - 1)
    found: list[np.ndarray] = []
    places: list[np.ndarray] = []
    for a in range(0, grams - w + 1, BLOCK):
        h = gram_hashes(codes[a : min(len(codes), a + BLOCK + w + k - 2)], k)
        # The smaller the rest below the hash, the further right the gram is.
        packed = (h << np.uint64(64 - HASH_BITS)) | (tail - np.arange(len(h), dtype=np.uint64))
        low = _window_min(packed, w)[:BLOCK]
        low = low[np.concatenate(([True], low[1:] != low[:-1]))]
        place = (tail - (low & tail)).astype(np.int64) + a
        if places and place[0] == places[-1][-1]:
            low, place = low[1:], place[1:]
        found.append(low >> np.uint64(64 - HASH_BITS))
        places.append(place)
    return np.concatenate(places), np.concatenate(found)


def encode(places: np.ndarray, hashes: np.ndarray) -> str:
    """``position:hash`` in hexadecimal, comma-joined, in order of position."""
    return ",".join([f"{p:x}:{h:08x}" for p, h in zip(places.tolist(), hashes.tolist())])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared hashes over all hashes of two sorted sets; 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return both / either if either else 1.0


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by as many code points of the beginning of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """Fingerprints of every whole text: ``id_col, fingerprint``. Null counts as empty; an empty text has none ("").

    Row by row, without a shuffle; equal texts have equal fingerprints. Other
    columns are not looked at.
    """
    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_blocks(batches, "__text"):
            out = [encode(*winnow(t or "", k, w)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [id_col, "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).alias("__text")).mapInArrow(marks, f"`{id_col}` {kind}, fingerprint string")


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """How far fingerprints tell a text, its half-replaced version and its neighbour apart.

    The next document is the one that follows in order of id (nulls first, ties
    by text); the last one is followed by the first. Rows are cut into ranges of
    the id, and the texts move once; each range also gets the first row of the
    next one. Null counts as an empty text. Every row of a repeated id counts as
    a document of its own. Two empty texts are alike (1).
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    number, _ = key_ranges(rows.select("id"), "id")
    # At most one row per range: the first document of each.
    heads = rows.select("id", number.alias("r")).groupBy("r").agg(F.min(F.struct(F.col("id").isNotNull(), "id")).getField("id").alias("id"))
    heads = sorted((r["r"], r["id"]) for r in heads.collect())
    firsts = docs.sparkSession.createDataFrame(
        [(first, heads[i - 1][0]) for i, (_, first) in enumerate(heads)], T.StructType([T.StructField("first", rows.schema["id"].dataType), T.StructField("guest_of", T.IntegerType())]))
    placed = (rows.withColumn("own", number).join(F.broadcast(firsts), F.col("id").eqNullSafe(F.col("first")), "left")
              .select(F.posexplode(F.array_compact(F.array("own", "guest_of"))).alias("place", "part"), "id", "text")
              .select("part", (F.col("place") == 1).alias("guest"), "id", "text"))
    spread = placed.repartitionById(max(1, len(heads)), "part").sortWithinPartitions("part", "guest", F.col("id").asc_nulls_first(), "text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple | None = None   # the last own row of the range, whose neighbour is still to come
        part, guest_seen = None, False
        for batch in byte_blocks(batches, "text", 1 << 20):
            done: list[tuple] = []
            for p, g, i, t in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part:
                    part, guest_seen, waiting = p, False, None
                if g and guest_seen:
                    continue  # further rows of the same id
                places, hashes = winnow(t, k, w)
                own = (i, t, places, hashes, np.unique(hashes))
                if waiting is not None:
                    done.append(outcome(waiting, own))
                waiting = None if g else own
                guest_seen = g
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k2) for c, k2 in zip(zip(*done), kinds)], names)

    def outcome(own: tuple, following: tuple) -> tuple:
        changed = edited(own[1], following[1])
        places, hashes = winnow(changed, k, w)
        return (own[0], len(own[1]), hashlib.sha256(changed.encode()).hexdigest(), encode(own[2], own[3]), encode(places, hashes),
                likeness(own[4], np.unique(hashes)), likeness(own[4], following[4]))

    id_type = pa.int64() if docs.schema[id_col].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint") else pa.string()
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    id_kind = "bigint" if id_type == pa.int64() else "string"
    return spread.mapInArrow(judge, f"`{id_col}` {id_kind}, n_chars bigint, edited_sha256 string, fingerprint string, "
                                    "edited_fingerprint string, near_edited double, near_next double")


@query("op4_fingerprints")
def op4_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return compare_edits(table(spark, folder, "documents"))
