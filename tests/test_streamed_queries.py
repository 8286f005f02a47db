"""Streamed queries on tables of one file, of several files, and without rows."""

from turnloom.plans.catalog import QUERIES
from turnloom.plans.registry import with_shared_folder
from turnloom.sources.sinks import new_folder

DOCS = "doc_id long, text string, source string"


def documents(spark, rows, files):
    folder = new_folder(with_shared_folder(spark), "tables")
    spark.createDataFrame(rows, DOCS).repartition(files).write.parquet(f"{folder}/documents.parquet")
    return folder.removeprefix("file://")


def rows(n):
    return [(i, f"line {i}\nthe rest of text {i}", "web" if i % 2 else None) for i in range(n)] + [(n, None, "web")]


def test_a_table_that_is_a_folder_of_files(spark):
    got = QUERIES["streamed_examples"](spark, documents(spark, rows(40), 3))
    assert sorted(r.doc_id for r in got.collect()) == list(range(40))


def test_a_table_without_rows(spark):
    assert QUERIES["streamed_examples"](spark, documents(spark, [], 1)).collect() == []


def test_deliveries_are_not_gathered_in_one_task(spark):
    from pathlib import Path

    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "turnloom"
    before = set(shared.glob("delivered-*"))
    got = QUERIES["streamed_examples_once"](spark, documents(spark, rows(40), 9))
    assert sorted(r.doc_id for r in got.collect()) == list(range(40))
    (delivered,) = set(shared.glob("delivered-*")) - before
    assert len(list(delivered.glob("*.parquet"))) > 3
