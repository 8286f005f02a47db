"""Run registered queries beside their SQL: ``python tests/compare.py [folder] [names]``."""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


SECONDS: dict[str, float] = {}


def make_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="turnloom-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def oracle_connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def _sorted(rows: list[tuple]) -> list[tuple]:
    return sorted((tuple(_cell(v) for v in r) for r in rows), key=lambda r: [(v is not None, str(type(v)), v) for v in r])


def difference(spark: SparkSession, con, folder: str, query, sql: str) -> str | None:
    """What differs between a query and its SQL, if anything."""
    began = time.time()
    df = query(spark, folder)
    names = sorted(df.columns)
    got = _sorted([tuple(r) for r in df.select(*names).collect()])
    SECONDS["spark"] = time.time() - began
    rel = con.sql(sql)
    if sorted(rel.columns) != names:
        return f"columns {names} != {sorted(rel.columns)}"
    types = {n: _TYPES.get(k, k) for n, k in df.dtypes}
    for name, kind in zip(rel.columns, rel.types):
        if types[name] != str(kind):
            return f"type of {name}: {types[name]} != {kind}"
    want = _sorted(rel.select(*[f'"{n}"' for n in names]).fetchall())
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)} (first {got[:1]} / {want[:1]})"
    for g, w in zip(got, want):
        if g != w or [type(v) for v in g] != [type(v) for v in w]:
            return f"{dict(zip(names, g))} != {dict(zip(names, w))}"
    return None


def main() -> None:
    from turnloom.plans.catalog import ORACLES, QUERIES

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(QUERIES)
    spark, con = make_session(), oracle_connection(folder)
    bad = 0
    for name in wanted:
        began = time.time()
        try:
            diff = difference(spark, con, folder, QUERIES[name], ORACLES[name])
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            diff = f"{type(e).__name__}: {str(e)[:1200]}"
        bad += diff is not None
        print(f"{'ok ' if diff is None else 'BAD'} {time.time() - began:6.2f}s spark {SECONDS.get('spark', 0):6.2f}s {name} {diff or ''}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} equal")


if __name__ == "__main__":
    main()
