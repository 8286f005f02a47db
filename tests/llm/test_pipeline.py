"""The pipeline's stages, each against a plain version on its own input."""

import re

import pytest
from test_decontamination import expected as benchmark_words
from test_line_dedup import expected as line_dedup
from test_near_dedup import expected as near_dedup

import corpus_pipeline
from turnloom.llm.common import stored


@pytest.fixture(scope="module")
def steps(llm, tiny):
    docs = llm.read.parquet(f"{tiny}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(llm, out[-1], tiny)))
    return out


def rows(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_in_order_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "MinHash near-dedup", "benchmark decontamination", "SentencePiece encoding and decoding"]
    assert all(s.columns == steps[0].columns and s.dtypes == steps[0].dtypes for s in steps[1:5])


def test_language_keeps_all_with_letters(steps):
    before, after = rows(steps[0]), rows(steps[1])
    assert after == {i: t for i, t in before.items() if t and re.search(r"[^\W\d_]", t)}


def test_lines(steps):
    want = {i: t for i, _, _, t in line_dedup(list(rows(steps[1]).items()))}
    assert rows(steps[2]) == want and all(r.n_chars == len(r.text) for r in steps[2].collect())


def test_near_duplicates(steps):
    before = rows(steps[2])
    assert rows(steps[3]) == {i: before[i] for i, _, _, kept in near_dedup(list(before.items())) if kept}


def test_benchmark(llm, tiny, steps):
    items = [(r.item_id, r.text) for r in llm.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    before, after = rows(steps[3]), rows(steps[4])
    assert set(before) == set(after)
    for i, t in before.items():
        n, hit, _ = benchmark_words(t, items, 10)
        if hit:
            assert benchmark_words(after[i], items, 10)[0] == n - hit
        else:
            assert after[i] == t


def test_tokens_decode_to_the_text(steps):
    got = steps[5].collect()
    assert len(got) == steps[4].count() and all(r.same_text for r in got)


def test_edge_rows(llm, tiny, edge, nothing):
    for docs in (edge, nothing):
        kept = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stored(stage(llm, kept, tiny))
            assert kept.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](llm, kept, tiny).count() == kept.count()
    before = {str(r.doc_id) for r in edge.collect()}
    assert {"6", "7"} <= before
