import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.llm.centroids import Bounds, History, cluster_vectors, digests, op11_centroids, reassign, squared_distances


def loop(rows, dims, k, rounds, scale=256, seed="2"):
    """Lloyd's rounds, one distance at a time, in whole numbers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        owner = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            members = [v for (_, v), o in zip(kept, owner) if o == j]
            if members:
                centroids[j] = [sum(x) // len(members) for x in zip(*members)]
    return sorted(((i, *reversed(nearest(v))) for i, v in kept), key=lambda r: (r[0] is None, r)), centroids


def test_equals_loop(llm):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=3)]) for i in range(300)]
    rows += rows[:40] + [(7, [0.5, 0.5, 0.5]), (7, [-0.5, 0.5, 0.5]), (1001, [1.0, 2.0]), (1002, None), (1003, [1.0, None, 2.0]),
                         (1004, [float("nan"), 0.0, 0.0]), (1005, [float("inf"), 0.0, 0.0]), (1006, []), (None, [0.1, 0.2, 0.3]), (1007, [9000.0, -0.001, 0.0])]
    df = llm.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(c) for c in ("id", "v", "a", "kind", "cluster", "distance", "n", "s")})
    for k, rounds in ((9, 5), (1, 2), (400, 2)):
        placed, centroids = cluster_vectors(df.repartition(5), dims=3, clusters=k, rounds=rounds)
        expected, ends = loop(rows, 3, k, rounds)
        got = sorted(((r.vec_id, r.cluster, r.distance) for r in placed.collect()), key=lambda r: (r[0] is None, r))
        assert got == expected and centroids.tolist() == ends
        assert placed.columns == ["vec_id", "cluster", "distance"]


def test_text_ids_ties_and_nothing(llm):
    rows = [("a", [0.0]), ("b", [2.0]), ("c", [1.0]), ("c", [1.0])]     # c is as far from a as from b
    df = llm.createDataFrame(rows, "vec_id string, embedding array<float>")
    placed, centroids = cluster_vectors(df, dims=1, clusters=2, rounds=0)
    expected, ends = loop(rows, 1, 2, 0)
    assert sorted(map(tuple, placed.collect())) == expected and centroids.tolist() == ends
    empty, none = cluster_vectors(df.where("vec_id = 'z'"), dims=1)
    assert empty.count() == 0 and empty.columns == placed.columns and none.shape == (0, 1)
    with pytest.raises(Exception, match="no exact distance"):
        cluster_vectors(llm.createDataFrame([("a", [1e300])], "vec_id string, embedding array<double>"), dims=1)


def test_bounds_skip_and_stay_exact():
    rng = np.random.default_rng(5)
    middle = rng.integers(-3000, 3000, (12, 8))
    v = (middle[rng.integers(0, 12, 4000)] + rng.integers(-150, 150, (4000, 8))).astype(np.int64)
    history = [v[:12].copy()]
    b, measured = Bounds.unknown(len(v)), []
    for _ in range(8):
        measured.append(reassign(v, b, History(list(history))))
        assert b.a.tolist() == squared_distances(v, history[-1]).argmin(1).tolist()
        history.append(np.array([v[b.a == j].sum(0) // max(1, (b.a == j).sum()) if (b.a == j).any() else history[-1][j] for j in range(12)]))
    assert measured[0] == 4000 and measured[-1] < 400
    # There and back: the sum of the ways would have opened the bounds, the displacement does not.
    far = [history[-1], history[-1] + 2000, history[-1]]
    b = Bounds.unknown(len(v))
    reassign(v, b, History(far[:1]))
    assert reassign(v, b, History(far)) == 0


def test_large_numbers_are_exact():
    v = np.array([[(1 << 27) - 1, -(1 << 27) + 1]] * 2, np.int64)
    assert squared_distances(v, -v[:1]).tolist() == [[int(2 * (2 * ((1 << 27) - 1)) ** 2)]] * 2


def test_query_has_digest_columns(llm, tiny):
    out = op11_centroids(llm, tiny)
    rows = out.collect()
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert {r.inertia for r in rows} == {sum(r.distance for r in rows)}
    assert digests([[1, -2]]) == [hashlib.sha256(b"1,-2").hexdigest()]
