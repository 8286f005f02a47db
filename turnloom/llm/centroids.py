"""Centroid clustering with bounds that look back to the last evaluation (ns-bounds).

Every vector keeps its cluster, an upper bound (distance to its own centroid,
measured in round ``tu``) and a lower bound (distance to the second nearest one,
measured in round ``tl``). The centroids of all rounds are kept. In a later round
the upper bound grows by the norm of the whole way its centroid has gone since
``tu``, and the lower bound shrinks by the longest such way of any other centroid
since ``tl``. A way there and back cancels out, while a sum over the rounds would
not. Vectors whose bounds no longer part them are measured again: first to their
own centroid, then, if that is not enough, to all.

Distances are those of whole numbers, so results are exact and ties are seen.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.llm.common import query, stored, table

DIMS, CLUSTERS, ROUNDS, SCALE = 64, 40, 5, 256
SEED = "2"
COMPONENT_LIMIT = 1 << 27       # of a scaled component; squared distances then fit a bigint
_SLACK = 1e-12                  # roundings of square roots and sums of bounds


@dataclass
class History:
    """Centroids of rounds 0 .. t, and how far each has gone since any of them."""

    rounds: list[np.ndarray]

    def __post_init__(self) -> None:
        now = self.rounds[-1].astype(np.float64)
        self.way = np.array([np.sqrt(((now - then) ** 2).sum(1)) for then in self.rounds]) * (1 + _SLACK)     # round, centroid
        k = len(now)
        # The longest way of any other centroid: the longest one, or for its owner the second longest.
        order = np.argsort(-self.way, axis=1, kind="stable")
        rows = np.arange(len(self.rounds))
        self.others = np.repeat(self.way[rows, order[:, 0]][:, None], k, 1)
        self.others[rows, order[:, 0]] = self.way[rows, order[:, 1]] if k > 1 else 0.0

    @property
    def now(self) -> np.ndarray:
        return self.rounds[-1]


def squared_distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of whole-number vectors to all centroids, exactly."""
    largest = max(int(np.abs(v).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * largest**2 * v.shape[1] < 1 << 53:     # every term is a whole number that a double holds
        x, y = v.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)).astype(np.int64)
    return np.stack([((v - row) ** 2).sum(1) for row in c], 1)


def own_distances(v: np.ndarray, c: np.ndarray, a: np.ndarray) -> np.ndarray:
    return ((v - c[a]) ** 2).sum(1)


@dataclass
class Bounds:
    """Cluster and bounds of some vectors; ``tu`` and ``tl`` are the rounds the bounds were measured in."""

    a: np.ndarray
    u: np.ndarray
    tu: np.ndarray
    l: np.ndarray   # noqa: E741
    tl: np.ndarray

    @classmethod
    def unknown(cls, n: int) -> Bounds:
        return cls(np.zeros(n, np.int32), np.full(n, np.inf), np.zeros(n, np.int32), np.zeros(n), np.zeros(n, np.int32))


def reassign(v: np.ndarray, b: Bounds, history: History) -> int:
    """Move ``b`` to the newest centroids of ``history``; the number of vectors measured against all of them is returned."""
    t = len(history.rounds) - 1

    def parted(rows: np.ndarray) -> np.ndarray:
        """Whether the bounds of these rows prove that no other centroid is as near as their own."""
        upper = b.u[rows] + history.way[b.tu[rows], b.a[rows]]
        lower = b.l[rows] - history.others[b.tl[rows], b.a[rows]]
        return upper * (1 + _SLACK) < lower * (1 - _SLACK)

    rows = np.flatnonzero(~parted(np.arange(len(b.a))))
    seen = rows[np.isfinite(b.u[rows])]
    if len(seen):
        b.u[seen] = np.sqrt(own_distances(v[seen], history.now, b.a[seen]).astype(np.float64))
        b.tu[seen] = t
        rows = rows[~parted(rows)]
    if len(rows):
        d = squared_distances(v[rows], history.now)
        b.a[rows] = d.argmin(1)     # the first of equals
        two = np.partition(d, 1, axis=1)[:, :2] if d.shape[1] > 1 else None
        b.u[rows] = np.sqrt(d.min(1).astype(np.float64))
        b.l[rows] = np.inf if two is None else np.sqrt(two[:, 1].astype(np.float64))
        b.tu[rows] = b.tl[rows] = t
    return len(rows)


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """``id, v`` of the vectors of exactly ``dims`` components, none null or non-finite; a component x is floor(scale * x)."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    scaled = F.transform(x, lambda e: F.when(F.abs(e * scale) < COMPONENT_LIMIT, F.floor(e * scale).cast("int")).otherwise(
        F.raise_error(F.lit(f"a component beyond {COMPONENT_LIMIT} / {scale} has no exact distance")).cast("int")))
    return vectors.where((F.size(x) == dims) & finite).select(F.col(f"`{id_col}`").alias("id"), scaled.alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``seed:id``; ties by vector, null ids last. ``k`` rows come to the driver."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    chosen = rows.select(digest.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in chosen], np.int64)


_STATE = "kind int, id {id}, v array<int>, a int, u double, tu int, l double, tl int, n bigint, s array<bigint>"


def _round(state: DataFrame, history: History, id_type: T.DataType) -> DataFrame:
    """One assignment: rows of kind 0 with new bounds, and of kind 1 with what each task's clusters won or lost."""
    shared = state.sparkSession.sparkContext.broadcast(history)     # rounds * clusters * dims numbers
    schema = T.StructType.fromDDL(_STATE.format(id=id_type.simpleString()))
    first = "a" not in state.columns
    k, dims = history.now.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        history = shared.value
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        arrow = None
        for batch in batches:
            column = batch.column("v")
            v = column.flatten().to_numpy().reshape(-1, dims).astype(np.int64)
            if first:
                b = Bounds.unknown(len(v))
                before = None
            else:
                b = Bounds(*(batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("a", "u", "tu", "l", "tl")))
                before = b.a.copy()
            reassign(v, b, history)
            moved = np.arange(len(v)) if before is None else np.flatnonzero(before != b.a)
            for sign, owner in ((1, b.a), (-1, before)):
                if owner is not None:
                    count += sign * np.bincount(owner[moved], minlength=k)
                    np.add.at(total, owner[moved], sign * v[moved])
            n = len(v)
            arrow = batch.column("id").type
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(n, np.int32)), batch.column("id"), column, pa.array(b.a), pa.array(b.u), pa.array(b.tu), pa.array(b.l), pa.array(b.tl),
                 pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))], schema.names)
        changed = np.flatnonzero((count != 0) | (total != 0).any(1))
        if len(changed):
            n = len(changed)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(n, np.int32)), pa.nulls(n, arrow), pa.nulls(n, pa.list_(pa.int32())), pa.array(changed.astype(np.int32)), pa.nulls(n, pa.float64()),
                 pa.nulls(n, pa.int32()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.int32()), pa.array(count[changed]), pa.array(total[changed].tolist(), pa.list_(pa.int64()))],
                schema.names)

    return state.mapInArrow(run, schema)


def _gains(done: DataFrame, k: int, dims: int) -> tuple[list[int], list[list[int]]]:
    """Per cluster, members and sums won in a round: at most clusters * dims rows come to the driver."""
    found = done.where("kind = 1").select("a", "n", F.posexplode("s").alias("d", "x")).groupBy("a", "d").agg(
        F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    counts, sums = [0] * k, [[0] * dims for _ in range(k)]
    for r in found:
        counts[r["a"]] = int(r["n"])
        sums[r["a"]][r["d"]] = int(r["x"])
    return counts, sums


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, dims: int = DIMS, clusters: int = CLUSTERS,
                    rounds: int = ROUNDS, scale: int = SCALE, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """``id_col, cluster, distance`` of every kept vector, and the final centroids (one row each).

    Kept are vectors of exactly ``dims`` finite components; others, null ones
    included, are left out. A component x counts as floor(``scale`` * x); beyond
    2**27 after scaling the job fails, because squared distances would not fit.
    Centroids start as the vectors with the smallest sha256 of ``seed:id``
    (fewer than ``clusters`` vectors are each one). ``rounds`` times every vector
    goes to its nearest centroid, of equals to the smaller number, and centroids
    move to the floor of their members' mean; then vectors are assigned once
    more. ``distance`` is squared.

    Repeated rows and equal vectors each count; of one id's vectors the smaller
    comes first among the starts; null ids start last and are kept. Other columns
    are not looked at. An empty table gives no row and no centroid.

    Each round is one pass without a shuffle of vectors, written as a table and
    read by the next; a task adds a row per cluster that its vectors joined or
    left. Only those changes are summed.
    """
    rows = stored(whole_vectors(vectors, id_col, vector_col, dims, scale))
    id_type = rows.schema["id"].dataType
    start = first_centroids(rows, clusters, seed)
    if not len(start):
        empty = rows.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"))
        return empty, np.zeros((0, dims), np.int64)
    history = [start]
    counts, sums = [0] * len(start), [[0] * dims for _ in start]
    state = rows
    for t in range(rounds + 1):
        done = stored(_round(state, History(history), id_type))
        state = done.where("kind = 0").select("id", "v", "a", "u", "tu", "l", "tl")
        if t == rounds:
            break
        won, more = _gains(done, len(start), dims)
        counts = [a + b for a, b in zip(counts, won)]
        sums = [[a + b for a, b in zip(x, y)] for x, y in zip(sums, more)]
        history.append(np.array([[x // n for x in s] if n else old.tolist() for s, n, old in zip(sums, counts, history[-1])], np.int64))
    final = history[-1]
    shared = vectors.sparkSession.sparkContext.broadcast(final)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v").flatten().to_numpy().reshape(-1, dims).astype(np.int64)
            d = own_distances(v, shared.value, batch.column("a").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("a"), pa.array(d)], ["id", "cluster", "distance"])

    placed = state.select("id", "v", "a").mapInArrow(measure, f"id {id_type.simpleString()}, cluster int, distance bigint")
    return placed.select(F.col("id").alias(id_col), "cluster", "distance"), final


def digests(centroids: Sequence[Sequence[int]]) -> list[str]:
    return [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centroids]


def _oracle(rounds: int = ROUNDS) -> str:
    def assigned(r: int) -> str:
        return f"""near{r} AS MATERIALIZED (
  SELECT vec_id, v, min({{'d': list_sum(list_transform(range(1, {DIMS + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT, 'j': j}}) AS m
  FROM kept, c{r} GROUP BY ALL)"""

    def moved(r: int) -> str:
        return f"""c{r + 1} AS MATERIALIZED (
  SELECT c{r}.j, coalesce(n.c, c{r}.c) AS c FROM c{r} LEFT JOIN (
    SELECT j, list(x ORDER BY d) AS c FROM (
      SELECT m.j AS j, d, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x
      FROM (SELECT m, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM near{r}) GROUP BY 1, 2) GROUP BY j) n ON n.j = c{r}.j)"""

    steps = ",\n".join(f"{assigned(r)},\n{moved(r)}" for r in range(rounds))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS j, v AS c FROM (SELECT sha256('{SEED}:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT {CLUSTERS})),
{steps},
{assigned(rounds)}
SELECT vec_id, m.j::INT AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.j))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM near{rounds} JOIN c{rounds} ON c{rounds}.j = m.j"""


@query("op11_centroids", _oracle())
def op11_centroids(spark: SparkSession, folder: str) -> DataFrame:
    placed, centroids = cluster_vectors(table(spark, folder, "embeddings"))
    placed = stored(placed)
    inertia = {r["cluster"]: int(r["d"]) for r in placed.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}     # a row per cluster
    facts = [(j, inertia.get(j, 0), sum(inertia.values()), sha) for j, sha in enumerate(digests(centroids))]
    per_cluster = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return placed.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
