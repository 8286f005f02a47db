"""What several operators share: registration, Arrow text buffers, shared storage, held-out rows."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder)`` under ``name``, with its SQL if there is any."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(shipped(spark), folder)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


_SHIPPED: set[str] = set()


def shipped(spark: SparkSession) -> SparkSession:
    """The same session, whose executors can import this package wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp(prefix="turnloom-")) / "turnloom_package.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(path))
        _SHIPPED.add(sc.applicationId)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def kept_columns(docs: DataFrame, keep: list[str] | None, results: list[str]) -> list[str]:
    """The columns to keep (all if not given) but those that a result of the same name replaces."""
    return [c for c in (docs.columns if keep is None else keep) if c not in results]


def as_numbered(names: list[str]) -> list[Column]:
    """Columns under the neutral names c0, c1, ..., which clash with no working column."""
    return [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]


def as_named(names: list[str]) -> list[Column]:
    """The columns of ``as_numbered`` under their own names again."""
    return [F.col(f"c{i}").alias(c) for i, c in enumerate(names)]


def numbered_fields(docs: DataFrame, names: list[str]) -> list[T.StructField]:
    return [T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(names)]


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def crc_class(id_column: Column, modulus: int) -> Column:
    return F.crc32(id_column.cast("string").cast("binary")) % modulus


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Only a session on one machine may do without that setting; it then gets a
    temporary folder and keeps it as its setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="turnloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written once as a table in the shared folder and read from there."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_bytes(path: str, limit: int = 64 << 20) -> bytes:
    """A model file of the driver, to be sent to tasks; refused beyond ``limit`` bytes."""
    if os.path.getsize(path) > limit:
        raise ValueError(f"{path} is larger than {limit} bytes")
    with open(path, "rb") as f:
        return f.read()


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in one array, and the n + 1 offsets of the texts; null counts as empty."""
    array = pc.fill_null(array.cast(pa.large_string()), "")
    n = len(array)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, np.int64)[array.offset : array.offset + n + 1]
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


_HELD: dict[tuple[str, int], tuple[object, int | None]] = {}


def _task() -> int | None:
    context = TaskContext.get()
    return None if context is None else context.taskAttemptId()


def held(name: str, key: int, make: Callable[[], object]) -> object:
    """An object that this worker process keeps for later tasks, one for a name.

    ``byte_blocks`` drops it in a task that does not ask for it, and once no task
    has come for ``IDLE_SECONDS``.
    """
    found = _HELD.get((name, key))
    if found is None:
        for other in [k for k in _HELD if k[0] == name]:
            _HELD.pop(other, None)
    value = make() if found is None else found[0]
    _HELD[name, key] = value, _task()
    return value


IDLE_SECONDS = 2.0
_IDLE: list[threading.Timer] = []


def _give_back(keys: list[tuple[str, int]]) -> None:
    """Drop held objects, and return free memory to the system; workers live as long as the executor, beside its JVM."""
    for k in keys:
        _HELD.pop(k, None)
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _begin_task() -> None:
    while _IDLE:
        _IDLE.pop().cancel()
    unused = [k for k, (_, task) in _HELD.items() if task != _task()]
    if unused and _task() is not None:
        _give_back(unused)


def _end_task() -> None:
    if _task() is not None:
        timer = threading.Timer(IDLE_SECONDS, lambda: _give_back(list(_HELD)))
        timer.daemon = True
        _IDLE.append(timer)
        timer.start()


def byte_blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of ``column``; rows stay whole."""
    _begin_task()
    try:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
            block = np.cumsum(sizes) // limit
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    yield batch.slice(a, b - a)
    finally:
        _end_task()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
