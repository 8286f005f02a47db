import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.llm import near_dedup as nd
from turnloom.llm.components import connected_components


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def expected(docs):
    sets = {}
    for i, t in docs:
        sets.setdefault(i, shingles(t))
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets, key=lambda i: (i is not None, i)), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            ra, rb = sorted((find(a), find(b)), key=lambda i: (i is not None, i or 0))
            root[rb] = ra
    return sorted([(i, len(sets[i]), find(i), find(i) == i) for i, _ in docs], key=str)


def test_equals_loop(llm):
    """Copies, chains of edits, groups around one text, and a passage that all share."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    common = [rng.choice(words) for _ in range(40)]
    docs, base = [], [[rng.choice(words) for _ in range(rng.randint(5, 120))] for _ in range(12)]
    for b in base:
        for _ in range(12):
            t = list(b)
            for _ in range(rng.randint(0, max(1, len(t) // 25))):
                t[rng.randrange(len(t))] = rng.choice(words)
            docs.append(" ".join(t + (common if rng.random() < 0.3 else [])))
    chain = [rng.choice(words) for _ in range(100)]
    for i in range(10):
        chain = list(chain)
        chain[i * 9] = f"new{i}"
        docs.append(" ".join(chain))
    docs += ["one two three", "One  two\nthree", "", None, " \t ", "one two three four five"]
    rng.shuffle(docs)
    rows = [(i * 3, t) for i, t in enumerate(docs)]
    got = nd.near_duplicates(llm.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


def test_edge_rows(edge, nothing):
    docs = [(r.doc_id, r.text) for r in edge.collect()]
    assert sorted(map(tuple, nd.near_duplicates(edge).collect()), key=str) == expected(docs)
    assert nd.near_duplicates(nothing).count() == 0


def test_large_keys_are_refined_without_loss(llm, monkeypatch):
    monkeypatch.setattr(nd, "LARGE", 2)
    monkeypatch.setattr(nd, "STAR_ROUNDS", 0)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(80)]
    rows = [(i, " ".join(base[:i] + [f"n{i}"] + base[i:])) for i in range(25)]
    got = nd.near_duplicates(llm.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


@pytest.mark.parametrize("wrong", [0, 1, 15, 29])
def test_pairs_below_the_distance_share_two_keys(llm, wrong):
    rng = np.random.default_rng(wrong)
    for _ in range(5):
        a = rng.integers(0, 1 << nd.SYMBOL_BITS, nd.SYMBOLS)
        b = a.copy()
        b[rng.permutation(nd.SYMBOLS)[:wrong]] ^= 1 << int(rng.integers(nd.SYMBOL_BITS))
        packed = [(x.reshape(-1, 4) << np.arange(0, 4 * nd.LANE, nd.LANE)).sum(1).tolist() for x in (a, b)]
        row = llm.createDataFrame([tuple(packed)], "a array<long>, b array<long>").select(
            nd.distance(F.col("a"), F.col("b")).alias("d"), F.size(F.array_intersect(nd.chunk_keys(F.col("a")), nd.chunk_keys(F.col("b")))).alias("n")).first()
        assert row.d == wrong and row.n >= 2


def test_components_of_a_path_and_a_star(llm):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (2001, 2000)]
    got = {r.node: r.component for r in connected_components(llm.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(50)}, 2000: 2000, 2001: 2000}


def test_group_of_unlinked_texts_is_not_paired(llm, monkeypatch):
    """Edited copies of one text, unlike enough for no link but for a few twins: neither their pairs are confirmed, nor is a twin lost."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(150)]

    def edited(text, times):
        text = list(text)
        for _ in range(times):
            text[rng.randrange(len(text))] = f"new{rng.randrange(10**9)}"
        return text

    texts = [edited(base, 4 + i % 2) for i in range(40)]
    texts += [edited(texts[i], 1) for i in (3, 17, 31)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    confirmed, asked = nd.confirmed, []

    def counted(pairs, sets, percent):
        asked.append(pairs.count())
        return confirmed(pairs, sets, percent)

    monkeypatch.setattr(nd, "confirmed", counted)
    got = nd.near_duplicates(llm.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)
    assert sum(asked) < len(rows) * (len(rows) - 1) // 4


@pytest.mark.parametrize("percent", [50, 80])
def test_linked_by_differences_equals_all_pairs(llm, percent):
    """Groups around a hub, near it and far from it; two sets under one id, and repeated rows."""
    rng = np.random.default_rng(percent)
    sets = [(0, np.arange(60))]
    for i in range(1, 50):
        near = np.setdiff1d(np.arange(60), rng.choice(60, int(rng.integers(0, 14)), False))
        sets.append((i, np.unique(np.concatenate((near, rng.integers(60, 90, int(rng.integers(0, 12))))))))
    sets += [(50, np.arange(500, 520)), (51, np.arange(500, 521)), (7, np.arange(499, 520)), sets[9], sets[0]]
    rows = llm.createDataFrame([(i, bytearray(np.sort(s.astype(np.uint64)).tobytes())) for i, s in sets], "id long, items binary")
    groups = llm.createDataFrame([(0, i, i) for i in range(52)], "hub long, node long, c long")
    links = [(a, b) for (a, x), (b, y) in itertools.combinations(sets, 2) if a != b and 100 * len(np.intersect1d(x, y)) >= percent * len(np.union1d(x, y))]
    want = {r.node: r.component for r in connected_components(llm.createDataFrame(links, "a long, b long")).collect()}
    found = nd.linked_by_differences(groups, rows, percent)
    assert {r.node: r.component for r in connected_components(found).collect()} == want
    assert {tuple(sorted(p)) for p in found.collect()} <= {tuple(sorted(p)) for p in links}


def test_components_of_later_links_join_those_of_earlier_ones(llm):
    rng = random.Random(3)
    table = lambda x: llm.createDataFrame(x, "a long, b long")
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    whole = {r.node: r.component for r in connected_components(table(links)).collect()}
    first = connected_components(table(links[:20]))
    both = connected_components(table(links[20:]), first)
    assert sorted(map(tuple, both.collect())) == sorted(whole.items())
    assert connected_components(table([(r.node, r.component) for r in first.collect()]), first) is first


def test_jobs_of_small_input(llm):
    """Each job takes memory of the driver, whatever its rows."""
    rows = [(i, " ".join(f"w{i // 3}x{j}" for j in range(40)) + f" {i}") for i in range(30)]
    context = llm.sparkContext
    context.setJobGroup("near duplicates", "")
    try:
        got = nd.near_duplicates(llm.createDataFrame(rows, "doc_id long, text string")).collect()
        jobs = context.statusTracker().getJobIdsForGroup("near duplicates")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(r.component_id for r in got) == [i // 3 * 3 for i in range(30)]
    assert len(jobs) <= 95
