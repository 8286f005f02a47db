"""Writers, and the shared folder intermediate results go to."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's ``spark.checkpoint.dir``.

    It is the session's to name; without it nothing is written anywhere.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/turnloom/{name}-{uuid.uuid4().hex}"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """The session, whose Python workers can import this package wherever they run."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}_sources.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for source in sorted(package.rglob("*.py")):
                z.write(source, source.relative_to(package.parent))
        context.addPyFile(str(archive))
        _SHIPPED.add(context.applicationId)
    return spark


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    For results used more than once: later reads are cheap, survive lost
    executors and no longer carry the lineage.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def store_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Like ``store``, as a table hashed and sorted by a key.

    Joins and aggregations by that key take the table as it lies: only the other
    side is shuffled, into as many buckets. A bucket is one file.
    """
    spark = df.sparkSession
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    out = df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key)
    out.option("path", new_folder(spark, name)).saveAsTable(table)
    return spark.table(table)


def write_examples(
    examples: DataFrame, path: str, mode: str = "errorifexists", even_files: bool = False
) -> None:
    """Examples as Parquet, one folder per split.

    ``even_files`` lets adaptive execution merge small and split large
    partitions first; a split holding nearly all rows is still spread.
    """
    out = examples.hint("rebalance", "split") if even_files else examples
    out.write.mode(mode).partitionBy("split").parquet(path)


def write_evaluation(
    perplexity: DataFrame, generations: DataFrame, path: str, mode: str = "errorifexists"
) -> None:
    """Evaluation results as JSON lines: ``perplexity`` holds the one summary
    row, ``generations`` one line per prompt, however many there are."""
    summary = perplexity.select(F.struct(*perplexity.columns).alias("perplexity"))
    summary.write.mode(mode).json(f"{path}/perplexity")
    generations.select("prompt", "response", "tokens", "tok_per_sec", "latency_s").write.mode(
        mode
    ).json(f"{path}/generations")
