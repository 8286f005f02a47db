"""The registered queries and the SQL that states the same result."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from turnloom.sources.readers import spread


@dataclass(frozen=True)
class Tables:
    """The given tables, one Parquet file each."""

    spark: SparkSession
    folder: str

    def path(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))


    def spread(self, name: str, *columns: str) -> DataFrame:
        """Columns of a table, the first one its id, over all cores."""
        return spread(getattr(self, name).select(*columns), columns[0])


def with_shared_folder(spark: SparkSession) -> SparkSession:
    """The session, which names a shared folder: its own, or on one machine a new one where it has none."""
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.master.startswith("local["):
        spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="turnloom-"))
    return spark


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables`` under ``name``, with its SQL if any."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(with_shared_folder(spark), folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
