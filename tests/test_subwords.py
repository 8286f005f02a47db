"""Subword ids against a plain loop and against a library that reads the same ranks."""

import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from turnloom.operators.examples import build_examples, kept
from turnloom.operators.subwords import WORD_PATTERN, RankedMerges, merge, read_ranks
from turnloom.plans import derive
from turnloom.plans.catalog import QUERIES
from turnloom.plans.registry import Tables, with_shared_folder

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def plain(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    if word in ranks:
        return [ranks[word]]
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("plain", pat_str=WORD_PATTERN.removeprefix("(?U)"), mergeable_ranks=read_ranks(PATH), special_tokens={})


def test_merging_equals_a_plain_loop():
    rng = random.Random(5)
    for _ in range(300):
        tokens = {bytes([c]) for c in b"abc"}
        while len(tokens) < 14:
            tokens.add(bytes(rng.choices(b"abc", k=rng.randint(2, 5))))
        ranks = dict(zip(rng.sample(sorted(tokens), len(tokens)), range(len(tokens))))
        for n in (0, 1, 2, 5, 9, 40):
            word = bytes(rng.choices(b"abc", k=n))
            assert merge(word, ranks) == plain(word, ranks)


def test_very_long_words(library):
    ranks, rng = read_ranks(PATH), random.Random(6)
    for letters in ("a", "ab", "abcdefghijklmnopqrstuvwxyz", "\u00e9\u4e2d"):
        word = "".join(rng.choices(letters, k=100_000))
        assert merge(word.encode(), ranks) == library.encode_ordinary(word)


def test_rows_of_any_kind(spark, library):
    """Nulls, empty texts, repeated rows, blanks, hot words, a very long word, two columns, clashing names."""
    texts = [None, "", " ", "a", "a", "  two  blanks ", "the " * 5000, "x" * 100_000, "tab\tline\n\nend\u00a0\u3000", "caf\u00e9 \u4e2d\u6587 12345 \U0001f600!", *[f"word{i} the end" for i in range(300)]]
    rows = [(i, t, texts[-i - 1], "kept", 1) for i, t in enumerate(texts)]
    df = with_shared_folder(spark).createDataFrame([*rows, rows[3]], "key int, text string, other string, places string, at int").repartition(5)
    for cut in (None, 7):
        got = RankedMerges(PATH).encode(df, "text", "ids", cut, {"n": "text", "other_n": "other"}).collect()
        assert len(got) == len(texts) + 1
        for r in got:
            want, other = ((None if x is None else library.encode_ordinary(x)[:cut]) for x in (r["text"], r["other"]))
            assert r["ids"] == want and r["n"] == (None if want is None else len(want)) and r["other_n"] == (None if other is None else len(other))
            assert (r["places"], r["at"]) == ("kept", 1)
    assert RankedMerges(PATH).encode(df.limit(0), "text", "text", None, {}).collect() == []


def test_documents_and_examples_equal_the_library(spark, tiny, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["subword_documents"](spark, tiny).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sum"], r["first_id"], r["last_id"]) == (len(ids), sum(ids), ids[0], ids[-1])
    words = {r["conv_id"]: r for r in kept(build_examples(derive.conversations(Tables(spark, tiny)))).collect()}
    subwords = {r["conv_id"]: r for r in QUERIES["sft_examples_subword"](spark, tiny).collect()}
    assert subwords and all(subwords[c]["n_tokens"] >= words[c]["n_tokens"] for c in subwords if c in words)
    assert all(0 < r["prompt_len"] < r["n_tokens"] <= 1024 and r["n_unmasked"] == r["n_tokens"] - r["prompt_len"] for r in subwords.values())


def test_only_rare_words_are_shuffled_to_the_word_table(spark):
    df = with_shared_folder(spark).createDataFrame([("a", "the cat " * 50)], "key string, text string")
    plan = RankedMerges(PATH).texts_to_ids(df)
    assert plan.select(F.size("ids")).first()[0] == 101 and "BroadcastHashJoin" in plan._jdf.queryExecution().executedPlan().toString()


def test_places_are_not_shuffled(spark, library, monkeypatch):
    """What moves is a text and a word of a block, not a row per place; here each text is nearly a block of its own."""
    monkeypatch.setattr("turnloom.operators.subwords.BLOCK_BYTES", 8)
    texts = {f"k{i}": f"the word{i % 50} and word{i % 7} again é中" * (1 + i % 3) for i in range(200)}
    df = with_shared_folder(spark).createDataFrame(list(texts.items()), "key string, text string")
    made = RankedMerges(PATH).texts_to_ids(df)
    assert {r["key"]: r["ids"] for r in made.collect()} == {k: library.encode_ordinary(t) for k, t in texts.items()}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "posexplode" not in plan
