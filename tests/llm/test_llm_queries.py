"""Queries with SQL equal it; those on documents hold one row for each."""

import pytest
from compare import difference, oracle_connection

from turnloom.llm.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(tiny):
    return oracle_connection(tiny)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(name, llm, con, tiny):
    assert difference(llm, con, tiny, QUERIES[name], ORACLES[name]) is None


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_one_row_per_document(name, llm, tiny):
    got = QUERIES[name](llm, tiny)
    assert got.select("doc_id").distinct().count() == got.count() == llm.read.parquet(f"{tiny}/documents.parquet").count()
