"""Registry of named queries over the test data, with their DuckDB oracle SQL.

Every query reads the whole star-schema test tables through the entity mapping
(``Tables.from_testdata``); parameters are fixed clocks and ranges, never id
subsets. ``QUERIES[name](spark, sf_dir) -> DataFrame``; ``ORACLE[name]`` is the
same result in SQL, written independently from the DataFrame code.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import Tables
from .oracle_base import ENTITIES

# Fixed clocks (FIXTURES.md): bills/payments are read "now" = AS_OF, meter
# readings live in January 2024.
AS_OF = dt.datetime(2001, 7, 15, 9, 0, 0)
READ_AS_OF = dt.date(2024, 1, 15)
RANGE_START, RANGE_END = dt.date(1998, 1, 1), dt.date(1998, 12, 31)

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
# The Tables-level builders behind QUERIES, to run the same queries on other
# sources (e.g. entities stored as Parquet, see tools/plan_summary.py).
BUILDERS: dict[str, Callable[[Tables], DataFrame]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables.from_testdata(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        BUILDERS[name] = fn
        if sql is not None:
            ORACLE[name] = ENTITIES + sql
        return fn
    return deco


from . import registry, stored  # noqa: E402,F401  (register the queries)
