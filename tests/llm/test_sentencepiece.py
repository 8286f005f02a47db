import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from turnloom.llm.common import file_bytes
from turnloom.llm.sentencepiece_codec import BLANK, PieceCodec, default_model, encode_pieces, read_model

PARTS = [" ", "  ", "\n", "\t", "a", "b", "the", "ing", "é", "你", "　", "x1", "23", "!", "?.", "<s>", "\r\n", " " * 9, " " * 40, "Z", "́", "😀", "th", "er", "ou", BLANK, "<0x0A>", "kk", "n.", ","]


@pytest.fixture(scope="module")
def texts(documents):
    rng = random.Random(1)
    return [t for _, t in documents[:60]] + ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(4_000)]


def test_bpe_equals_library(texts):
    own = PieceCodec(read_model(file_bytes(default_model())))
    library = sentencepiece.SentencePieceProcessor(model_file=default_model())
    for t, ids in zip(texts, library.encode(texts)):
        assert own.encode(t) == ids, t
        assert own.decode(ids) == library.decode(ids) == t.replace(BLANK, " ")


def test_neighbours_tell_what_merging_gives(texts):
    """The test for two pieces in a row against merging their text."""
    own = PieceCodec(read_model(file_bytes(default_model())))
    for t in texts[60:600]:
        own.encode(t)
    for (a, b), ok in list(own.follows.items())[:3000]:
        x, y = own.model.pieces[a], own.model.pieces[b]
        assert ok == (own.merge(x + y) == [x, y])


def test_unigram_paths_are_as_good_as_the_library_s(texts):
    """The same pieces with scores of a unigram model: both paths are best, though ties may differ."""
    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(file_bytes(default_model()))
    m.trainer_spec.model_type = 1
    for i, p in enumerate(m.pieces):
        if p.type == 1:
            p.score = -5 - ((i * 104729) % 30011) / 2500
    data = m.SerializeToString()
    own, library = PieceCodec(read_model(data)), sentencepiece.SentencePieceProcessor(model_proto=data)
    total = lambda ids: sum(own.model.scores[i] for i in ids)
    short = [t for t in texts if len(t) < 100]
    for t, ids in zip(short, library.encode(short)):
        assert total(own.encode(t)) >= total(ids) - 1e-3 and own.decode(own.encode(t)) == t.replace(BLANK, " ")


def test_edge_rows(edge, nothing):
    for r in encode_pieces(edge, default_model(), keep=["doc_id", "text"]).collect():
        assert r.decoded == (r.text or "").replace(BLANK, " ") and (len(r.ids) > 0) == bool(r.text)
    assert encode_pieces(nothing, default_model()).count() == 0


@pytest.mark.parametrize("sign", ["\t", "😀", "\ufffd", "\xa0"])
def test_long_runs_of_signs(sign):
    """Runs far beyond the interpreter's depth of calls, at the end, within and alone."""
    own = PieceCodec(read_model(file_bytes(default_model())))
    library = sentencepiece.SentencePieceProcessor(model_file=default_model())
    run = sign * 100_000
    for t in (run, f"the{run}", f"a{run}b {run}.", f"x {run}\ny"):
        ids = own.encode(t)
        assert ids == library.encode(t) and own.decode(ids) == t
