import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnloom.llm.byte_bpe_sql import RankCodec, encode_ranks, library_splitter, op13_byte_bpe, read_ranks

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        return tiktoken.Encoding("library", pat_str=PATTERN, mergeable_ranks=read_ranks(f.read()), special_tokens={})


@pytest.fixture(scope="module")
def coder():
    with open(PATH, "rb") as f:
        return RankCodec(f.read(), library_splitter(PATTERN))


def same(coder, library, texts):
    ids, counts = coder.encode(texts)
    ends = np.cumsum(counts)
    for text, a, b in zip(texts, ends - counts, ends):
        assert ids[a:b].tolist() == library.encode_ordinary(text), text[:80]
    assert [d.decode() for d in coder.decode(ids, counts)] == texts


def test_texts_of_all_kinds(coder, library):
    rng = random.Random(4)
    odd = [chr(c) for c in np.flatnonzero(coder.odd)[::211]]
    texts = ["", " ", "it's <|endoftext|> we'll", "a\n\n \tb  ", "日本語のテキスト 한국어", "😀👩‍👩‍👧", "x" * 30_000, "=" * 3000, " " * 5000 + "a", "\n" * 700, "é" * 300, "\x00\x1c\x85  x"]
    texts += [f"ab{c}c1 {c}{c}" for c in odd]
    texts += ["".join(rng.choice(letters) for _ in range(n)) for letters in ("ab", "abcdefgh", "=-_ ", "éüß日", "กขฃab", "0123456789") for n in (5, 60, 300, 900)]
    same(coder, library, texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(), max_size=4))
def test_any_text(coder, library, texts):
    same(coder, library, texts)


def test_merges_that_overtake():
    """A made token whose next merge has a lower rank than its own, in runs and side by side."""
    tokens = [bytes([b]) for b in range(256)] + [b"abab", b"aaa", b"bab", b"ab", b"aa", b"aaaa", b"ba", b"abb", b"abaab"]
    data = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens))
    own = RankCodec(data, library_splitter(PATTERN))
    library = tiktoken.Encoding("small", pat_str=PATTERN, mergeable_ranks=read_ranks(data), special_tokens={})
    rng = random.Random(6)
    words = ["".join(rng.choice("aab") for _ in range(rng.randint(2, 40))) for _ in range(200)] + ["".join(rng.choice("ab") for _ in range(300)) for _ in range(12)] + ["a" * 600, "ab" * 300]
    same(own, library, words)


def test_bad_files_and_ids(coder):
    with pytest.raises(ValueError):
        read_ranks(b"YQ== 0\n")
    with pytest.raises(ValueError, match="no token"):
        coder.decode(np.array([60_000]), np.array([1]))


def test_equals_library(edge, nothing, library):
    docs = edge.where(F.coalesce(F.length("text") < 150_000, F.lit(True)))
    rows = encode_ranks(docs, PATH, PATTERN, keep=["doc_id", "text", "ids", "c0"]).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded).decode() == (r.text or "") and r.c0 == "c0"
    assert encode_ranks(nothing, PATH, PATTERN).count() == 0


def test_query_equals_library(llm, tiny, documents, library):
    got = {r.doc_id: tuple(r)[1:] for r in op13_byte_bpe(llm, tiny).collect()}
    for i, text in documents:
        ids = library.encode_ordinary(text)
        assert got.pop(i) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert not got
