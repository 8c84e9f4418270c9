"""Payments stored by month, so a period reads its own folders only.

A range of days prunes months by literals when the query is planned; a set of months that
comes from another table prunes them when it runs (dynamic partition pruning).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timewin import DEFAULT_END, DEFAULT_START, DateLike, day_range, to_date
from ..schemas import PAYMENT

MONTH = "Month"


def month_of(date: str) -> Column:
    """The month of a date or timestamp column as ``yyyy-MM``."""
    return F.date_format(date, "yyyy-MM")


def write_by_month(payments: DataFrame, path: str) -> None:
    """Write payments to a folder for each month. Rows are dealt by month first and a month of many
    rows is split (rebalance), so folders hold few files and no month is one task. Payments without a date get a folder of their own."""
    payments.withColumn(MONTH, month_of("PaymentDate")).hint("rebalance", MONTH).write.partitionBy(MONTH).parquet(path)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T.StructType([*PAYMENT.fields, T.StructField(MONTH, T.StringType(), True)])).parquet(path)


def in_range(spark: SparkSession, path: str, start: DateLike | None, end: DateLike | None) -> DataFrame:
    """The payments of whole days ``start`` to ``end``; only the months between are listed. For use as ``Tables.payment``."""
    first, last = to_date(start, DEFAULT_START), to_date(end, DEFAULT_END)
    months = F.col(MONTH).between(first.strftime("%Y-%m"), last.strftime("%Y-%m"))
    return _stored(spark, path).where(months & day_range("PaymentDate", start, end)).drop(MONTH)


def in_months(spark: SparkSession, path: str, months: DataFrame) -> DataFrame:
    """The payments of the months in a frame (``Month``, repeated rows count once), with their month; a month that is not asked for is not read
    where the planner broadcasts the months (a row for each, after its own size check)."""
    return _stored(spark, path).join(months.select(MONTH), MONTH, "left_semi")
