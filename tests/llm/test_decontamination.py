import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.llm.decontamination import FMIndex, cut, find_windows, suffix_array, words


def test_index_equals_scan():
    rng = np.random.default_rng(1)
    for _ in range(60):
        v = int(rng.integers(1, 5))
        s = np.concatenate((rng.integers(0, v + 1, int(rng.integers(1, 60))), [0]))
        tail = [[(0, j) if s[j] == 0 else (int(s[j]), 0) for j in range(i, len(s))] for i in range(len(s))]
        assert suffix_array(s).tolist() == sorted(range(len(s)), key=tail.__getitem__)
        index = FMIndex(s, v + 1, 4)
        phrases = [tuple(rng.integers(1, v + 1, int(rng.integers(1, 4)))) for _ in range(5)]
        padded = np.zeros((5, 4), np.int64)
        for r, p in enumerate(phrases):
            padded[r, 4 - len(p) :] = p
        for p, a, b in zip(phrases, *index.ranges(padded, np.array([len(p) for p in phrases]))):
            assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == [i for i in range(len(s)) if tuple(s[i : i + len(p)]) == p]


def expected(text, items, window):
    w = words(text)
    hit, found = [False] * len(w), set()
    for item, t in items:
        b = words(t)
        for i in range(max(1, len(b) - window + 1) if b else 0):
            g = b[i : i + window]
            for j in range(len(w) - len(g) + 1):
                if w[j : j + len(g)] == g:
                    found.add(str(item))
                    hit[j : j + len(g)] = [True] * len(g)
    return len(w), sum(hit), sorted(found)


ITEMS = [(1, "quick brown fox jumps over"), (2, "Lazy dog"), (30, "lorem ipsum dolor sit amet lorem"), (4, ""), (5, None), (6, "lazy DOG!"), (7, "  x ")]


@pytest.mark.parametrize("shard_words, block_words", [(400_000, 2_000_000), (50, 5)])
def test_equals_loop(edge, llm, nothing, shard_words, block_words):
    items = llm.createDataFrame(ITEMS, "item_id long, text string")
    found = find_windows(edge, items, window=3, shard_words=shard_words, block_words=block_words, keep=["doc_id", "text"])
    for r in found.collect():
        if r.text and len(r.text) > 10_000:
            continue
        assert (r.n_words, sum(s.stop - s.first for s in r.spans), r["items"]) == expected(r.text, ITEMS, 3)
    long = found.where(F.length("text") > 250_000).first()
    assert long.n_words == 60_000 and [(s.first, s.stop) for s in long.spans] == [(0, 60_000)] and long["items"] == ["30"]
    assert found.count() == edge.count()
    assert find_windows(nothing, items).count() == 0
    assert {tuple(r["items"]) for r in find_windows(edge, items.where("item_id = 4")).collect()} == {()}


def test_cut_takes_words_only():
    text = "Keep this. The quick brown fox! And é that"
    assert cut(text, [{"first": 2, "stop": 6}]) == "Keep this. ! And é that"
    assert cut(text, []) is text and cut(None, []) is None
    assert cut("a b c", [{"first": 1, "stop": 2}]) == "a c"
