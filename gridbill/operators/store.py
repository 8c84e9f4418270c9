"""S2 inserts that write: a batch is checked against the store and stored once.

A stored entity is a folder of batches (``Batch=<id>``). A batch that is sent again, as after
a failure, is checked against all *other* batches and replaces its own folders, so the store
and the answers are the same after one run or many. Batches come one after another;
each takes an id of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from .maintain import OUTCOME
from .windows import freeze

BATCH = "Batch"


def _read(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The rows of all batches with their ids; a folder that is not there has none."""
    full = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType(), True)])
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(folder)


def stored(spark: SparkSession, base: str, entity: str, but: int | None = None) -> DataFrame:
    """The stored rows of an entity, without those of batch ``but`` (its folder is not read)."""
    schema = schemas.ENTITY_SCHEMAS[entity]
    rows = _read(spark, f"{base}/{entity}", schema)
    return (rows if but is None else rows.where(F.col(BATCH) != but)).select(*schema.fieldNames())


def refused(spark: SparkSession, base: str, entity: str) -> DataFrame:
    """The refused rows of all batches with their outcome and batch."""
    return _read(spark, f"{base}/refused/{entity}", T.StructType([*schemas.ENTITY_SCHEMAS[entity].fields, T.StructField(OUTCOME, T.StringType(), True)]))


def put(spark: SparkSession, base: str, entity: str, rows: DataFrame, batch_id: int) -> None:
    """Store rows as a batch, unchecked (the first load of a store)."""
    typed = rows.select(*[F.col(f.name).cast(f.dataType) for f in schemas.ENTITY_SCHEMAS[entity].fields])
    typed.write.mode("overwrite").parquet(f"{base}/{entity}/{BATCH}={batch_id}")


def append(spark: SparkSession, base: str, entity: str, batch: DataFrame, batch_id: int,
           check: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Check a batch and store its accepted and its refused rows; each row with its outcome.

    ``check(stored, batch)`` is one of ``maintain.append_*``: it gives the entity's columns and
    ``Outcome``. What it gives is frozen once, so both writes and the answer agree.
    """
    checked = freeze(check(stored(spark, base, entity, but=batch_id), batch))
    ok = F.col(OUTCOME) == "accepted"
    names = schemas.ENTITY_SCHEMAS[entity].fieldNames()
    checked.where(~ok).select(*names, OUTCOME).write.mode("overwrite").parquet(f"{base}/refused/{entity}/{BATCH}={batch_id}")
    put(spark, base, entity, checked.where(ok), batch_id)
    return checked
