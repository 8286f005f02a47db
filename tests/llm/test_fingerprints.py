import hashlib
import random

import numpy as np

from turnloom.llm.fingerprints import K, W, compare_edits, fingerprint, gram_hashes, winnow
from turnloom.llm.common import QUERIES, code_points


def loop(text, k, w):
    if not text:
        return []
    k = min(k, len(text))
    h = gram_hashes(code_points(text), k).tolist()
    w = min(w, len(h))
    picked = {max(j for j in range(i, i + w) if h[j] == min(h[i : i + w])) for i in range(len(h) - w + 1)}
    return [(j, h[j]) for j in sorted(picked)]


def test_windows_equal_loop():
    rng = random.Random(4)
    for n in (0, 1, 5, 11, 12, 13, 40, 200):
        t = "".join(rng.choice("abé😀") for _ in range(n))
        assert list(zip(*(x.tolist() for x in winnow(t)))) == loop(t, K, W)
    assert [p for p, _ in loop("a" * 60, K, W)] == winnow("a" * 60)[0].tolist()


def test_blocks_do_not_show():
    t = "".join(random.Random(1).choice("abcdefgh ") for _ in range(600_000))
    places, _ = winnow(t)
    assert (np.diff(places) > 0).all() and np.diff(places).max() <= W
    middle = (1 << 18) - 500
    cut = t[middle : middle + 1000]
    inner = {int(p) for p in winnow(cut)[0] if W <= p <= 1000 - W - K}
    assert {int(p) - middle for p in places if middle + W <= p <= middle + 1000 - W - K} == inner


def test_shared_passage_shares_a_fingerprint():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage = text(W + K - 1)
    for _ in range(20):
        a, b = (set(winnow(text(300) + passage + text(300))[1].tolist()) for _ in range(2))
        assert a & b


def test_edits_equal_loop(llm, tiny, documents):
    got = {r.doc_id: r for r in QUERIES["op4_fingerprints"](llm, tiny).collect()}
    for i, (doc, t) in enumerate(documents):
        following = documents[(i + 1) % len(documents)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + following[:half]
        r = got[doc]
        a, b, c = (set(winnow(x)[1].tolist()) for x in (t, e, following))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (like(a, b), like(a, c))
    long = [r for r in got.values() if r.n_chars > 400]
    assert all(r.near_edited > r.near_next for r in long)


def test_edge_rows(edge, nothing):
    rows = compare_edits(edge).collect()
    assert len(rows) == edge.count() and sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in edge.collect())
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    same = [r for r in rows if r.doc_id in (3, 4)]
    assert same[0].fingerprint == same[1].fingerprint and {r.fingerprint for r in rows if r.doc_id in (6, 7)} == {""}
    assert compare_edits(nothing).count() == 0 and fingerprint(edge).count() == len(rows)
    assert compare_edits(edge.where("doc_id = 3")).first().near_next == 1.0
