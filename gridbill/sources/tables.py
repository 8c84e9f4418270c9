"""Entity loading (S1) and the ``Tables`` bundle every operator takes.

Stored entities are read with their explicit schema (no inference); Parquet,
ORC, CSV, JSON and JDBC all go through ``DataFrameReader`` so pruning and
filter pushdown happen in the scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import schemas
from . import testdata

ENTITIES = tuple(schemas.ENTITY_SCHEMAS)

def load(spark: SparkSession, entity: str, path: str | None = None, fmt: str = "parquet",
         **options) -> DataFrame:
    """Read one stored entity with its declared schema.

    ``fmt`` is any DataFrameReader format; for ``jdbc`` pass ``url``/``dbtable``
    in ``options`` and leave ``path`` empty.
    """
    schema = schemas.ENTITY_SCHEMAS[entity]
    reader = spark.read.format(fmt).options(**options)
    if fmt == "csv":
        reader = reader.option("header", options.get("header", "true"))
    if fmt != "jdbc":
        reader = reader.schema(schema)
    df = reader.load(path) if path else reader.load()
    # Select in declared order, so every source yields the same column layout.
    return df.select(*[f.name for f in schema.fields])


class Tables:
    """Lazily built entity frames; each attribute is built once per bundle."""

    def __init__(self, spark: SparkSession, builders: dict[str, Callable[[], DataFrame]],
                 source_dir: str | None = None):
        self.spark = spark
        self.source_dir = source_dir
        self._builders = builders
        self._built: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        builders = self.__dict__.get("_builders", {})
        if name not in builders:
            raise AttributeError(name)
        built = self.__dict__["_built"]
        if name not in built:
            built[name] = builders[name]()
        return built[name]

    def replace(self, **frames: DataFrame) -> "Tables":
        """A new bundle with some entities swapped (e.g. a post-maintenance snapshot)."""
        builders = dict(self._builders)
        for k, v in frames.items():
            builders[k] = (lambda d=v: d)
        return Tables(self.spark, builders, self.source_dir)

    @classmethod
    def from_testdata(cls, spark: SparkSession, sf_dir: str) -> "Tables":
        return cls(spark, {
            "utility_type": lambda: testdata.utility_type(spark),
            "tariff": lambda: testdata.tariff(spark),
            "customer": lambda: testdata.customer(spark, sf_dir),
            "meter": lambda: testdata.meter(spark, sf_dir),
            "meter_reading": lambda: testdata.meter_reading(spark, sf_dir),
            "bill": lambda: testdata.bill(spark, sf_dir),
            "payment": lambda: testdata.payment(spark, sf_dir),
        }, sf_dir)

    @classmethod
    def from_store(cls, spark: SparkSession, base: str, fmt: str = "parquet", **options) -> "Tables":
        """Entities stored one folder per entity under ``base`` (``base/customer`` ...)."""
        base = base.rstrip("/")
        return cls(spark, {
            e: (lambda e=e: load(spark, e, f"{base}/{e}", fmt, **options)) for e in ENTITIES
        })

    @classmethod
    def from_frames(cls, spark: SparkSession, **frames: DataFrame) -> "Tables":
        return cls(spark, {k: (lambda d=v: d) for k, v in frames.items()})
