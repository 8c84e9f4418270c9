"""Deletes and updates that rewrite only the files they touch (M1-M4).

A version of a stored entity is the list of its Parquet files. Maintenance reads the key
column of all files together with ``_metadata.file_path``, finds the files that hold a key asked
for, writes what becomes of *their* rows to a new folder and gives the next
version: the untouched files, which are not read, and the new ones. No file is
changed or removed, so the version before stays readable, and a job that dies half-way
leaves files that no version names.

The driver holds lists of files, as it does for any scan; never rows. Keys to delete are frozen and
counted: up to ``common.FEW_KEYS`` are broadcast, so the stored rows are not shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..sources.tables import Tables, load
from .bitmaps import id_bitmaps, with_bit
from .common import frozen_key_join, key_join
from .maintain import apply_updates
from .windows import freeze


@dataclass(frozen=True)
class Files:
    """One version of a stored entity: the files that hold its rows."""
    entity: str
    paths: frozenset[str]

    def rows(self, spark: SparkSession) -> DataFrame:
        if not self.paths:
            return spark.createDataFrame([], schemas.ENTITY_SCHEMAS[self.entity])
        return load(spark, self.entity, sorted(self.paths))


Version = Mapping[str, Files]
# Bitmaps of 4,096 bytes that are broadcast.
FEW_BITMAPS = 16_384


def _path(uri: str) -> str:
    """One form for a file: Spark names it ``file:/x`` or ``file:///x``, with its odd characters escaped."""
    u = urlsplit(uri)
    return f"{u.scheme}://{u.netloc}{unquote(u.path)}"


def files_of(spark: SparkSession, entity: str, folder: str) -> Files:
    """The version that a folder of Parquet files is."""
    return Files(entity, frozenset(map(_path, load(spark, entity, folder).inputFiles())))


def version_of(spark: SparkSession, base: str, entities: Sequence[str]) -> dict[str, Files]:
    """The version of a store with one folder per entity."""
    return {e: files_of(spark, e, f"{base.rstrip('/')}/{e}") for e in entities}


def save_version(spark: SparkSession, version: Version, path: str) -> None:
    """Write the list of files; once it is there, the version is."""
    named = [(e, p) for e, files in version.items() for p in sorted(files.paths) or [None]]
    spark.createDataFrame(named, "Entity string, File string").coalesce(1).write.parquet(path)


def open_version(spark: SparkSession, path: str) -> dict[str, Files]:
    """A version as ``save_version`` wrote it."""
    named = spark.read.schema("Entity string, File string").parquet(path).collect()  # one row for each file
    return {e: Files(e, frozenset(r.File for r in named if r.Entity == e and r.File)) for e in sorted({r.Entity for r in named})}


def tables_of(spark: SparkSession, version: Version) -> Tables:
    return Tables.from_frames(spark, **{e: f.rows(spark) for e, f in version.items()})


def touched(spark: SparkSession, files: Files, keys: DataFrame, key: str, join: Callable[..., DataFrame] = key_join) -> frozenset[str]:
    """The files that hold one of the distinct ``keys``; only the key column is read. ``join``: ``frozen_key_join`` for frozen keys."""
    if not files.paths:
        return frozenset()
    stored = spark.read.schema(schemas.ENTITY_SCHEMAS[files.entity]).parquet(*sorted(files.paths))
    placed = stored.select(key, F.col("_metadata.file_path").alias("_file"))
    return frozenset(_path(r[0]) for r in join(placed, keys.select(key), key).select("_file").distinct().collect())


def rewritten(spark: SparkSession, files: Files, keys: DataFrame, key: str, change: Callable[[DataFrame], DataFrame], folder: str,
              join: Callable[..., DataFrame] = key_join) -> Files:
    """The next version of an entity, where ``change`` applies to the rows of the files that hold one of ``keys``.

    ``folder`` is a new one; it is not written if no file holds a key.
    """
    hit = touched(spark, files, keys, key, join)
    if not hit:
        return files
    if not hit <= files.paths:
        raise ValueError(f"files by other names than the version's: {sorted(hit - files.paths)[:3]}")
    change(Files(files.entity, hit).rows(spark)).write.mode("errorifexists").parquet(folder)
    return Files(files.entity, (files.paths - hit) | files_of(spark, files.entity, folder).paths)


def without(spark: SparkSession, files: Files, keys: DataFrame, key: str, folder: str) -> Files:
    """The entity less the rows of the distinct, frozen ``keys``."""
    return rewritten(spark, files, keys, key, lambda df: frozen_key_join(df, keys.select(key), key, "left_anti"), folder, frozen_key_join)


def updated(spark: SparkSession, files: Files, updates: DataFrame, key: str, columns: Sequence[str], folder: str,
            rules: Mapping[str, Column] | None = None) -> Files:
    """M1: the entity with the latest valid update of each key (see ``apply_updates``)."""
    keys = updates.select(key).where(F.col(key).isNotNull()).distinct()
    columns_kept = [f.name for f in schemas.ENTITY_SCHEMAS[files.entity].fields]
    return rewritten(spark, files, keys, key, lambda df: apply_updates(df, updates, key, columns, rules=rules).select(*columns_kept), folder)


def _distinct(keys: DataFrame, key: str) -> DataFrame:
    return freeze(keys.select(key).where(F.col(key).isNotNull()).distinct())


def delete_customers(spark: SparkSession, version: Version, keys: DataFrame, folder: str) -> dict[str, Files]:
    """M2 over stored files: customers with their meters, readings, bills (by CustomerID) and payments.

    The keys of each step are frozen before any file is written, so all steps see the
    version they started from.
    """
    t = tables_of(spark, version)
    k = _distinct(keys, "CustomerID")
    bills = _distinct(frozen_key_join(t.bill.select("BillID", "CustomerID"), k, "CustomerID"), "BillID")
    meters = _distinct(frozen_key_join(t.meter.select("MeterID", "CustomerID"), k, "CustomerID"), "MeterID")
    steps = (("payment", bills, "BillID"), ("bill", k, "CustomerID"), ("meter_reading", meters, "MeterID"),
             ("meter", k, "CustomerID"), ("customer", k, "CustomerID"))
    return {**version, **{e: without(spark, version[e], gone, key, f"{folder}/{e}") for e, gone, key in steps}}


def delete_meters(spark: SparkSession, version: Version, keys: DataFrame, folder: str) -> dict[str, Files]:
    """M3 over stored files: meters with their readings, the bills of those readings and their payments."""
    t = tables_of(spark, version)
    k = _distinct(keys, "MeterID")
    readings = frozen_key_join(t.meter_reading.select("ReadingID", "MeterID"), k, "MeterID").select("ReadingID")
    marks = freeze(id_bitmaps(readings, "ReadingID", dense=False))
    billed = with_bit(t.bill.select("BillID", "ReadingID"), "ReadingID", F.broadcast(marks) if marks.count() <= FEW_BITMAPS else marks, "_gone")
    bills = _distinct(billed.where("_gone"), "BillID")
    steps = (("payment", bills, "BillID"), ("bill", bills, "BillID"), ("meter_reading", k, "MeterID"), ("meter", k, "MeterID"))
    return {**version, **{e: without(spark, version[e], gone, key, f"{folder}/{e}") for e, gone, key in steps}}
