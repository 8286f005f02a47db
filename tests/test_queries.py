"""Every registered query equals its SQL on the smallest tables."""

import pytest
from compare import difference, oracle_connection

from turnloom.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(tiny):
    return oracle_connection(tiny)


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(name, spark, con, tiny):
    assert difference(spark, con, tiny, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", ["sft_examples", "packed_documents", "exact_split", "running_perplexity", "step_times"])
def test_result_does_not_depend_on_partitions(name, spark, con, tiny):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert difference(spark, con, tiny, QUERIES[name], ORACLES[name]) is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
