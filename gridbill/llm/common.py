"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text or payload that one output batch of a Python task may hold.
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the data set with exactly ``columns``; other columns never reach an operator."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder name that the driver and all executors can reach.

    It lies in ``spark.checkpoint.dir``; only where that is unset (tests on a local
    master) a folder of this machine is taken, and set as the checkpoint folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/llm-{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut by a table that outlives executors."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_HELD: dict[object, object] = {}


def give_back() -> None:
    """Return what this process has freed to the machine: Arrow's pool and the C heap keep it otherwise.

    Several worker processes share an executor's memory with its JVM, and live on after their tasks.
    """
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def held(key: object, build: Callable[[], object]) -> object:
    """What ``build`` makes, kept by this process until another key is asked for.

    Worker processes serve the tasks of many operators one after another; so what an
    operator remembers serves its next task, and is gone when another operator comes.
    """
    if key not in _HELD:
        _HELD.clear()
        give_back()
        _HELD[key] = build()
    return _HELD[key]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` (or a lambda in it) refers to it."""
    return F.transform(F.array(value), use)[0]


def slices(batch: pa.RecordBatch, column: str, most: int = BATCH_BYTES, *others: str) -> Iterator[pa.RecordBatch]:
    """``batch`` cut so that no piece holds more than ``most`` bytes in ``column`` (and ``others``), or is one row."""
    if batch.num_rows == 0:
        return
    sizes = sum(np.asarray(pc.fill_null(pc.binary_length(batch.column(c)), 0)).astype(np.int64) for c in (column, *others))
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = BATCH_BYTES, *others: str) -> Iterator[pa.RecordBatch]:
    """All batches of a task cut by bytes; memory goes back to the machine after each large one and at the end."""
    since = 0
    for b in batches:
        yield from slices(b, column, most, *others)
        since += b.nbytes
        if since > most:
            del b
            give_back()
            since = 0
    give_back()


def map_batches(df: DataFrame, column: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str | StructType,
                most: int = BATCH_BYTES) -> DataFrame:
    """``mapInArrow`` over byte-bounded batches; ``make`` builds the per-task state once and returns the batch function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = None
        for s in pieces(batches, column, most):
            fn = fn or make()
            yield fn(s)

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, column: str, make: Callable[[], Callable[[list], list[bool]]], most: int = BATCH_BYTES) -> DataFrame:
    """The rows of ``df`` (all columns) whose value of ``column`` the function made by ``make`` keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = None
        for s in pieces(batches, column, most):
            fn = fn or make()
            yield s.filter(pa.array(fn(s.column(column).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)
