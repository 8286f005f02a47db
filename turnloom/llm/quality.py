"""Quality classifier: supervised subword embeddings.

Every word and every character n-gram is hashed to a learned vector, a document
is the mean of its vectors, and a softmax over the mean gives the classes. All
vectors are trained by plain stochastic gradient descent in numpy. N-grams are
runs of bytes, so one pass of array operations serves any script. A word equal
to the one before it is looked up as one common "repeat" word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm.common import byte_blocks, crc_class, query, table, utf8

BUCKET_BITS = 18
DIMENSIONS = 8
GRAMS = (3, 5)
SLICE = 1 << 20     # a longer text is hashed in slices of so many bytes from its start

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_REPEAT = 1
_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base modulo 2**64, and their inverses."""
    if not _POWERS:
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(SLICE + 1, b, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0], _POWERS[1]


def _bucket(key: np.ndarray) -> np.ndarray:
    key = (key ^ (key >> np.uint64(31))) * _MIX
    return (key >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def features(data: np.ndarray) -> np.ndarray:
    """Buckets of all words and n-grams of one text (one slice of a very long one)."""
    if not len(data):
        return np.zeros(0, np.int32)
    blank = _BLANK[data]
    edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    word = (sums[ends] - sums[starts]) * down[starts]
    word[1:][word[1:] == word[:-1]] = _REPEAT
    found = [_bucket(word)]
    wide = data.astype(np.uint64)
    for n in GRAMS:
        m = len(data) - n + 1
        if m > 0:
            key = np.full(m, n, np.uint64)
            for i in range(n):
                key <<= np.uint64(8)
                key |= wide[i : m + i]
            found.append(_bucket(key))
    return np.concatenate(found)


def slices(data: np.ndarray) -> Iterator[np.ndarray]:
    for a in range(0, len(data), SLICE):
        yield data[a : a + SLICE]


@dataclass(frozen=True)
class QualityModel:
    """``weight[b]`` is what one occurrence of bucket ``b`` adds to the log odds, before the mean."""

    weight: np.ndarray
    bias: float

    def log_odds(self, data: np.ndarray) -> float:
        total, n = 0.0, 0
        for part in slices(data):
            f = features(part)
            total += float(self.weight[f].sum(dtype=np.float64))
            n += len(f)
        return total / n + self.bias if n else self.bias


def fit(texts: list[str | None], labels: list[int], epochs: int = 8, rate: float = 2.0, seed: int = 7) -> QualityModel:
    """Stochastic gradient descent on the cross entropy of a softmax over two classes."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    out = rng.uniform(-1, 1, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    rows = []
    for t in texts:
        f = [features(p) for p in slices(np.frombuffer((t or "").encode("utf-8", "replace"), np.uint8))]
        x, c = np.unique(np.concatenate(f), return_counts=True) if f else (np.zeros(0, np.int32), np.zeros(0))
        rows.append((x, (c / max(1, c.sum())).astype(np.float32)))
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x, c = rows[i]
            own = vectors[x]
            mean = c @ own
            logits = mean @ out + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            now = rate * (1 - done / steps)
            back = out @ p
            out -= (now * 0.1) * np.outer(mean, p)
            bias -= (now * 0.02) * p
            # A row's share of the mean is tiny; dividing by the norm of the shares keeps the step's size alike for all lengths.
            vectors[x] = own - (now / max(float(np.sqrt(c @ c)), 1e-6) * 0.1) * c[:, None] * back
            done += 1
    return QualityModel((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int,
                    held_out: int, max_docs: int, max_bytes: int) -> tuple[list, list]:
    """About ``max_docs`` labelled rows, chosen by a hash of the id over the whole table."""
    rows = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("l")).where(
        F.col("l").isin(0, 1) & (crc_class(F.col("i"), folds) != held_out))
    n = rows.count()
    spread = F.pmod(F.xxhash64(F.lit("quality sample"), F.col("i")), F.lit(1 << 30)) / (1 << 30)
    chosen = rows.where(spread < min(1.0, max_docs / max(n, 1))).groupBy("i").agg(F.max("l").alias("l"))
    sample = (docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where(F.octet_length("t") <= max_bytes)
              .join(F.broadcast(chosen), "i")  # about max_docs ids
              .select("i", "t", "l").toArrow().sort_by([("i", "ascending"), ("t", "ascending")]))
    return sample["t"].to_pylist(), sample["l"].to_pylist()


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                  folds: int = 4, held_out: int = 2, max_docs: int = 6000, max_bytes: int = 1 << 18, threshold: float = 0.7) -> DataFrame:
    """Probability of label 1 for every whole text: ``id_col, held_out, score, predicted``.

    Learns from labelled rows whose ``crc32(id) % folds`` is not ``held_out``:
    about ``max_docs`` whole texts of at most ``max_bytes`` bytes. Both bounds
    limit the fit only; every text is scored whole.

    Null and empty texts get the score that the bias alone gives. Labels other
    than 0 and 1 and null ids teach nothing; of labels that contradict each
    other the larger counts. With nothing to learn from, every score is 0.5.
    Repeated rows are scored alike; other columns are not looked at.
    """
    texts, marks = training_sample(docs, labels, id_col, text_col, label_col, folds, held_out, max_docs, max_bytes)
    model = fit(texts, marks) if texts else QualityModel(np.zeros(1 << BUCKET_BITS, np.float32), 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BUCKET_BITS floats, whatever the corpus
    rows = docs.select(F.col(id_col), F.coalesce(crc_class(F.col(id_col), folds) == held_out, F.lit(False)).alias("held_out"),
                       F.col(text_col).alias("__text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in byte_blocks(batches, "__text"):
            data, off = utf8(batch.column(2))
            odds = np.array([model.log_odds(data[a:b]) for a, b in zip(off[:-1], off[1:])])
            score = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))],
                [id_col, "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(judge, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


@query("op10_quality")
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    return score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))
