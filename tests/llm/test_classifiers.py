"""Held-out accuracy, and edge rows, of the two learned labels."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from turnloom.llm.common import QUERIES
from turnloom.llm.language import GRAM, LanguageFilter, decide, fit_filter, gram_keys, hits, identify
from turnloom.llm.quality import score_quality


def test_language_on_held_out_rows(llm, tiny):
    got = QUERIES["op9_language"](llm, tiny).join(llm.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    assert len(held) > 20 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95


def test_language_edge_rows(edge, nothing):
    got = {r.doc_id: r for r in identify(edge, docs_per_language=5).collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {6, 7, 11, -13}
    assert identify(edge).count() == edge.count() and identify(nothing).count() == 0
    assert {r.lang_pred for r in identify(edge.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_filters_hold_all_they_learned_and_correct_false_hits():
    texts = ["the cat sat on the mat " * 3, "der hund lief in den wald " * 3]
    model = fit_filter(texts, ["en", "de"])
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([0, *map(len, texts)])
    total, found = hits(model, data, ends)
    assert model.languages == ("de", "en") and found[0, 1] == total[0] == len(gram_keys(data[: ends[1]])) == ends[1] - GRAM + 1 and found[1, 0] == total[1]
    full = LanguageFilter(("a", "b"), np.full(16, 1, np.uint8))    # the filter of "a" says yes to everything
    best, score = decide(full, np.array([100]), np.array([[100, 30]]))
    assert best[0] == 1 or score[0] == 0
    half = LanguageFilter(("a", "b"), np.array([1, 0] * 8, np.uint8))    # wrong for a quarter of absent n-grams
    assert decide(half, np.array([100]), np.array([[25, 1]]))[0][0] == 1 and abs(decide(half, np.array([100]), np.array([[70, 1]]))[1][0] - 0.6) < 1e-9


def test_more_languages_than_a_word_has_bits(llm):
    word = lambda k: "".join(chr(97 + int(c)) for c in f"{k * 7919 + 10_000_000}")
    docs = [(i, f"{word(i % 130)} " * 5, f"l{i % 130:03}") for i in range(1300)]
    got = identify(llm.createDataFrame(docs, "doc_id long, text string, lang string"), keep=["doc_id", "lang"]).collect()
    assert len(got) == 1300 and all(r.lang_pred == r.lang and r.score > 0.9 for r in got)


def test_long_texts_are_hashed_in_windows():
    model = fit_filter(["abcde fghij klmno"], ["x"])
    data = np.frombuffer(("abcde fghij klmno " * 100_000).encode(), np.uint8)
    total, found = hits(model, data, np.array([0, len(data)]))
    assert total[0] == len(data) - GRAM + 1 and found[0, 0] >= total[0] * 13 // 18


def test_quality_on_held_out_rows(llm, tiny):
    got = QUERIES["op10_quality"](llm, tiny).join(llm.read.parquet(f"{tiny}/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for r in got)
    assert len(held) > 10 and sum(r.quality == r.predicted for r in held) / len(held) > 0.85


def test_quality_edge_rows(llm, edge, nothing):
    labels = llm.createDataFrame([(3, 1), (5, 0), (None, 1), (9, None), (9, 0), (77, 1)], "doc_id long, quality int")
    got = score_quality(edge, labels).collect()
    assert len(got) == edge.count() and all(0 <= r.score <= 1 for r in got)
    empty = {r.score for r in got if r.doc_id in (6, 7)}
    assert len(empty) == 1
    assert {r.score for r in score_quality(edge, labels.where("doc_id = 77")).collect()} == {0.5}
    assert score_quality(nothing, labels).count() == 0
