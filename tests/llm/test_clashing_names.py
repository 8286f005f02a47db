"""Kept columns named like a result or like a working column."""
import pytest
from pyspark.sql import functions as F

from turnloom.llm.decontamination import find_windows, without_spans
from turnloom.llm.language import identify
from turnloom.llm.line_dedup import drop_repeated_lines
from turnloom.llm.sentencepiece_codec import default_model, encode_pieces

NAMES = ["c0", "c1", "text", "clean", "clean_text", "n_words", "spans", "items", "old_spans", "old_items", "held_out", "lang_pred", "score", "n_grams",
         "ids", "decoded", "n_lines", "n_dropped", "kept_text", "__text", "__id", "__version", "__bitmap", "with.dot"]


@pytest.fixture(scope="module")
def named(llm):
    rows = [(i, f"the quick brown fox {i % 3}\nline", "en") for i in range(4)]
    df = llm.createDataFrame(rows, "doc_id long, body string, lang string")
    return df.withColumns({c: F.lit(f"own {c}") for c in NAMES})


def checked(out, source, results):
    assert sorted(out.columns) == sorted({*source.columns, *results}) and len(set(out.columns)) == len(out.columns)
    rows = out.orderBy("doc_id").collect()
    assert [r["body"] for r in rows] == [f"the quick brown fox {i % 3}\nline" for i in range(4)]
    for r in rows:
        assert all(r[c] == f"own {c}" for c in NAMES if c not in results)
        assert not any(r[c] == f"own {c}" for c in results)
    return rows


def test_results_replace_kept_columns(named, llm):
    everything = named.columns
    judged = identify(named, "doc_id", "body", "lang", keep=everything)
    assert {r["lang_pred"] for r in checked(judged, named, ["held_out", "lang_pred", "score", "n_grams"])} == {"en"}
    coded = encode_pieces(named, default_model(), "doc_id", "body", keep=everything)
    assert all(r["decoded"] == r["body"] for r in checked(coded, named, ["ids", "decoded"]))
    lines = drop_repeated_lines(named, "doc_id", "body", 4, 3, keep=everything)
    assert [r["n_dropped"] for r in checked(lines, named, ["n_lines", "n_dropped", "kept_text"])] == [1, 1, 1, 0]
    items = llm.createDataFrame([(1, "quick brown fox 0"), (2, "brown fox 1")], "item_id long, text string")
    for words in (2_000_000, 3):
        found = find_windows(named, items, "body", window=3, block_words=words)
        assert [r["items"] for r in checked(found, named, ["n_words", "spans", "items"])] == [["1"], ["1", "2"], ["1"], ["1"]]
    clean = without_spans(found, "body")
    assert [r["clean_text"] for r in checked(clean, named, ["n_words", "spans", "items", "clean_text"])][:2] == ["the \nline", "the \nline"]
    assert without_spans(found, "body", "body").columns.count("body") == 1
