"""Batch readers: corpora, run logs, request logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.config import SourceSpec

# Field names of the log records.
STEP_LOG_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("step", T.LongType()),
        T.StructField("loss", T.DoubleType()),
        T.StructField("lr", T.DoubleType()),
        T.StructField("muon_lr", T.DoubleType()),
        T.StructField("grad_norm", T.DoubleType()),
        T.StructField("step_time_ms", T.DoubleType()),
        T.StructField("tokens_per_sec", T.DoubleType()),
        T.StructField("ts", T.DoubleType()),
    ]
)
EVAL_LOG_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("step", T.LongType()),
        T.StructField("val_loss", T.DoubleType()),
        T.StructField("train_val_gap", T.DoubleType()),
    ]
)


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Give a scan as many tasks as there are cores, if its files give fewer.

    For work that is heavy per row, such as tokenising, over a few unsplittable
    files. A table large enough to fill the cluster is left as it is, without a
    shuffle. Only for plain scans: other plans would be run to count partitions.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, *keys)


def read_corpus(spark: SparkSession, spec: SourceSpec, schema: T.StructType | None = None) -> DataFrame:
    """One split of a corpus. ``{split}`` in the path stands for the split;
    without it a ``split`` column, if there is one, is filtered and pruned."""
    reader = spark.read.format(spec.file_format)
    if schema is not None:
        reader = reader.schema(schema)
    if "{split}" in spec.path:
        return reader.load(spec.path.replace("{split}", spec.split))
    df = reader.load(spec.path)
    return df.filter(df["split"] == spec.split) if "split" in df.columns else df


def read_step_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STEP_LOG_SCHEMA).json(path)


def read_eval_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVAL_LOG_SCHEMA).json(path)


RUN_ID_OF_FILE = r"([^/]+?)(?:\.[A-Za-z]+)?$"


def read_console(spark: SparkSession, path: str, run_id: str = RUN_ID_OF_FILE) -> DataFrame:
    """Console output, one ``value`` per line, with its ``run_id``: the first
    group of a pattern in the file's path, by default the file's name."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__path"))
    return lines.select("value", F.regexp_extract("__path", run_id, 1).alias("run_id"))
