import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from turnloom.llm.common import QUERIES, file_bytes, shared_folder
from turnloom.llm.token_files import ChunkEncoder, TokenMatrix, byte_bpe, default_tokenizer, read_token_files, write_matrix, write_token_files


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(default_tokenizer())
    t.encode_special_tokens = True
    return t


def expected(library, docs):
    at, out = 0, []
    for i, t in docs:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_chunks_equal_whole_texts(library):
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "b", "'s", "'", "é", "你", "　", "\x1c", "1", "23", "!", "?.", "<|endoftext|>", "\r\n", "\xa0", " 're", "Z", "́", "😀",
             "the", "über", ".", ",", "--", "_", "$$"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(8_000)]
    own = ChunkEncoder(file_bytes(default_tokenizer()))
    ids, n = own.encode(texts)
    ends = np.cumsum(n)
    for t, a, b, e in zip(texts, ends - n, ends, library.encode_batch(texts, add_special_tokens=False)):
        assert ids[a:b].tolist() == e.ids, t


def test_matrix_access_rank_select():
    for n, top in ((0, 1), (1, 1), (700, 2), (5000, 300), (3000, 70_000)):
        x = np.random.default_rng(n).integers(0, top, n).astype(np.uint32)
        m = TokenMatrix(write_matrix(x, np.array([n])))
        assert (m.ids() == x).all() and m.lengths.tolist() == [n]
        assert [m.access(i) for i in range(0, n, 97)] == x[::97].tolist()
        for v in {int(v) for v in x[:3]} | {top + 5}:
            places = np.flatnonzero(x == v)
            assert [m.rank(v, p) for p in range(0, n + 1, 511)] == [int((places < p).sum()) for p in range(0, n + 1, 511)]
            assert [m.select(v, k) for k in range(min(5, len(places)))] == places[:5].tolist()
            assert m.select(v, len(places)) == -1


def test_query_equals_library(llm, tiny, documents, library):
    assert sorted(map(tuple, QUERIES["op5_token_files"](llm, tiny).collect())) == expected(library, documents)


def test_edge_rows(llm, edge, nothing, library):
    docs = sorted([(r.doc_id, r.text) for r in edge.collect()], key=lambda r: (r[0] is not None, r[0] or 0))
    out = shared_folder(llm)
    write_token_files(edge, default_tokenizer(), out, shard_tokens=1000)
    assert llm.read.parquet(out).count() > 2
    assert sorted(map(tuple, read_token_files(llm, out).collect()), key=lambda r: r[1]) == expected(library, docs)
    out = shared_folder(llm)
    write_token_files(nothing, default_tokenizer(), out)
    assert read_token_files(llm, out).count() == 0


def test_added_tokens_are_what_the_untouched_library_gives(llm):
    untouched = Tokenizer.from_file(default_tokenizer())
    end = "<|endoftext|>"
    assert untouched.encode(f"a {end} b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    rng = random.Random(2)
    parts = [end, end, end[:-1], end[1:], "<|", "|>", " ", "  ", "\n", "\xa0", "a", "the", "é", "'s", "!", "　", "1"]
    texts = [f"a {end} b", end, end * 3, *("".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(2_000))]
    ids, n = byte_bpe(file_bytes(default_tokenizer())).encode(texts)
    ends = np.cumsum(n)
    for t, a, b in zip(texts, ends - n, ends):
        assert ids[a:b].tolist() == untouched.encode(t, add_special_tokens=False).ids, t
    docs = list(enumerate(texts[:50]))
    out = shared_folder(llm)
    write_token_files(llm.createDataFrame(docs, "doc_id long, text string"), default_tokenizer(), out)
    assert sorted(map(tuple, read_token_files(llm, out).collect())) == expected(untouched, docs)


def test_added_tokens_that_take_blanks():
    from tokenizers import AddedToken

    library = Tokenizer.from_file(default_tokenizer())
    library.add_tokens([AddedToken("hello", normalized=False), AddedToken("[M]", lstrip=True, rstrip=True, normalized=False), AddedToken("cat", single_word=True, normalized=False)])
    own = ChunkEncoder(library.to_str().encode(), special=True)
    texts = ["hello", "say hello you", "helloworld hello<|endoftext|>hello", "a [M]  b", "[M]", "cat", "a cat", "concat <|endoftext|> cats cat."]
    ids, n = own.encode(texts)
    ends = np.cumsum(n)
    for t, a, b in zip(texts, ends - n, ends):
        assert ids[a:b].tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_chunks_end_before_signs(library):
    """Words are learned without the signs behind them; texts of any blanks and borders are as the library has them."""
    own = ChunkEncoder(file_bytes(default_tokenizer()))
    words = ["word", " word", "über", " Ünï", "ɏ", "×", "÷", "ɐ", "a'b", "ñ's", "你", "x1", "_", "\n", " \n ", "\t", "  ", " ", "", "\xa0z", "\x00"]
    texts = [a + s + b for a in words for s in (",", ".\"", "!!", "'", "(-)", "--", "$", "") for b in words]
    ids, n = own.encode(texts)
    ends = np.cumsum(n)
    for t, a, b, e in zip(texts, ends - n, ends, library.encode_batch(texts, add_special_tokens=False)):
        assert ids[a:b].tolist() == e.ids, t
    own = ChunkEncoder(file_bytes(default_tokenizer()))
    own.encode([" word" + s for s in (",", ".", "!", "...", ";", ":", "?", "!!", "--")])
    assert list(own.known).count(" word") == 1 and not any(k.startswith(" word") and k != " word" for k in own.known)
