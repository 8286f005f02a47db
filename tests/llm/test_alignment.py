import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from turnloom.llm.alignment import align_texts, aligned, judge_links, op12_alignment, pair_counts
from turnloom.llm.common import stored

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def common_ends(a, b):
    both = sorted(set(a) & set(b))
    return [[x.index(e) + 1 for e in both] for x in (a, b)]


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60)))
def test_groups_are_the_common_ends(x, y):
    a, b = sorted({*x, 61}), sorted({*y, 61})
    assert [g.tolist() for g in aligned(a, b)] == common_ends(a, b)


def test_long_stretches():
    a = list(range(1, 10_000))
    b = [e for e in a if e not in (1, 500, 501, 9000)]
    assert [g.tolist() for g in aligned(a, b)] == [[e for e in b], list(range(1, len(b) + 1))]
    assert [g.tolist() for g in aligned([], [])] == [[], []]


def library_rows(docs):
    """Both libraries on every text, ends met one by one, links counted in one dictionary."""
    byte_level, pieces = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    byte_level.encode_special_tokens = True
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    back = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
    links, out = Counter(), []
    for i, text in docs:
        a = byte_level.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        a_bytes = [bytes(back[c] for c in byte_level.id_to_token(t)) for t in a]
        b_bytes = [bytes([int(pieces.id_to_piece(t)[3:5], 16)]) if pieces.is_byte(t) else pieces.id_to_piece(t).replace("▁", " ").encode() for t in b]
        if not text or {b"".join(a_bytes), b"".join(b_bytes)} != {(" " + text).encode()}:
            a = b = a_bytes = b_bytes = []
        ends_a, ends_b = (np.cumsum([len(t) for t in x]).tolist() for x in (a_bytes, b_bytes))
        groups, at = [], (0, 0)
        for to in zip(*common_ends(ends_a, ends_b)):
            groups.append((a[at[0] : to[0]], b[at[1] : to[1]]))
            at = to
        mine = [(g[-1], h[-1]) for g, h in groups]
        links.update(mine)
        sha = hashlib.sha256(";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups).encode()).hexdigest() if groups else ""
        out.append((i, len(a), len(b), len(groups), mine, sha))
    most = Counter()
    for (_, b), n in links.items():
        most[b] = max(most[b], n)
    return sorted(((i, n_a, n_b, n, len(mine), sum(links[p] == most[p[1]] for p in mine), sum(links[p] for p in mine), sha) for i, n_a, n_b, n, mine, sha in out),
                  key=lambda r: (r[0] is None, r))


def got(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("block_bytes", [1 << 22, 300])
def test_equals_libraries(edge, block_bytes):
    odd = edge.sparkSession.createDataFrame(
        [(40, "<|endoftext|> and <s> are text </s> <unk> <0x41>"), (41, "▁ is no blank"), (42, "  two  blanks "), (43, "\n\n\ttab"), (44, "naïve 日本語 \U0001f600 " * 30),
         (45, "a\x00b"), (46, "ab" * 700)], "doc_id long, text string")
    docs = edge.unionByName(odd, allowMissingColumns=True).where(F.coalesce(F.length("text") < 20_000, F.lit(True)))
    blocks = stored(align_texts(docs.coalesce(2), A, B, block_bytes=block_bytes))
    out = judge_links(blocks, stored(pair_counts(blocks)))
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    expected = library_rows([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert got(out) == expected and any(r[1] == 0 for r in expected) and any(r[5] < r[4] for r in expected)
    assert (blocks.count() > 2) == (block_bytes == 300)


def test_nothing_and_text_ids(nothing, edge):
    blocks = stored(align_texts(nothing, A, B))
    assert judge_links(blocks, stored(pair_counts(blocks))).count() == 0
    blocks = stored(align_texts(edge.where("doc_id in (3, 6, 7, 9)").select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text"), A, B))
    rows = {r.doc_id: r for r in judge_links(blocks, stored(pair_counts(blocks))).collect()}
    assert set(rows) == {"d3", "d6", "d7", "d9"} and rows["d6"].n_links == 0 and rows["d9"].n_a > 60_000
    only_empty = stored(align_texts(edge.where("doc_id in (6, 7)"), A, B))
    assert [r.n_groups for r in judge_links(only_empty, stored(pair_counts(only_empty))).collect()] == [0, 0]


def test_query_equals_libraries(llm, tiny, documents):
    assert got(op12_alignment(llm, tiny)) == library_rows(documents)
