import pytest
from pyspark.sql import functions as F

from turnloom.llm.common import shipped

LONG = "lorem ipsum dolor sit amet " * 12_000

EDGE = [
    (3, "The quick brown fox jumps over the lazy dog, says a@b.org\nshared line of more than twenty characters\nend", "en"),
    (4, "The quick brown fox jumps over the lazy dog, says a@b.org\nshared line of more than twenty characters\nend", "en"),
    (5, "Shared Line of more than twenty characters \n\n\n\x0b", "en"),
    (5, "Shared Line of more than twenty characters \n\n\n\x0b", "en"),
    (6, None, None),
    (7, "", "en"),
    (None, "a null id\nshared line of more than twenty characters", "de"),
    (9, LONG, "de"),
    (10, "x" * 200_000, "fr"),
    (11, " \t\r\n ", "fr"),
    (12, "Ünïcödé 你好 😀 ▁ \x00 end", "fr"),
    (-13, "12.34 !!", "en"),
]


@pytest.fixture(scope="session")
def llm(spark):
    return shipped(spark)


@pytest.fixture(scope="session")
def edge(llm):
    """Nulls, empty and very long texts, ties, repeated rows, and columns named like those of operators and helpers."""
    df = llm.createDataFrame(EDGE, "doc_id long, text string, lang string").withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit(c) for c in ("id", "key", "line", "pos", "size", "sig", "m1", "part", "version", "ids", "score", "lang_pred", "held_out", "n_grams", "spans", "items", "n_words", "kept_text", "n_lines", "decoded", "kept", "n", "c0")})


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.where("doc_id = 999")


@pytest.fixture(scope="session")
def documents(llm, tiny):
    return [(r.doc_id, r.text or "") for r in llm.read.parquet(f"{tiny}/documents.parquet").orderBy("doc_id").collect()]
