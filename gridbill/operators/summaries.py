"""Revenue per month and utility kept as a log of signed deltas, one partition per epoch.

A posting, an append or a cascade adds only its own payments' sums (negative for what is
deleted), so a report reads a few rows per epoch and not the payment history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import Tables
from .aggregates import _revenue_by
from .common import key_join

#: Month (its last day), utility, signed number and sum of payments.
DELTA = "Month date, UtilityName string, Payments bigint, Revenue decimal(28,2)"


def revenue_delta(t: Tables, payments: DataFrame, sign: int = 1) -> DataFrame:
    """The summary rows of some ``payments``, whose bills and meters ``t`` still holds; ``sign`` -1 takes them back.

    Payments of unknown bills count nothing, as in the revenue reports; those without a date are in a NULL month.
    """
    rows = _revenue_by(t.replace(payment=payments), None, F.last_day("PaymentDate"), "Month")
    return rows.groupBy("Month", "UtilityName").agg(
        (F.sum("_n") * F.lit(sign)).cast("bigint").alias("Payments"),
        (F.sum("_amount") * F.lit(sign)).cast("decimal(28,2)").alias("Revenue"))


def customers_retracted(t: Tables, keys: DataFrame) -> DataFrame:
    """The delta of a cascade over customers: minus the payments of all their bills. Taken before the cascade."""
    k = keys.select("CustomerID").where(F.col("CustomerID").isNotNull()).distinct()
    bills_gone = key_join(t.bill.select("BillID", "CustomerID"), k, "CustomerID").select("BillID")
    return revenue_delta(t, key_join(t.payment, bills_gone, "BillID"), -1)


def log_delta(delta: DataFrame, path: str, epoch: int) -> None:
    """Write the delta of an epoch; an epoch written again replaces its former rows."""
    delta.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def revenue_summary(spark: SparkSession, path: str) -> DataFrame:
    """(Month, UtilityName, Payments, Revenue): the log summed up; groups without a payment left have no row."""
    log = spark.read.schema(DELTA).parquet(path)
    summed = log.groupBy("Month", "UtilityName").agg(
        F.sum("Payments").alias("Payments"), F.sum("Revenue").cast("decimal(28,2)").alias("Revenue"))
    return summed.where(F.col("Payments") != 0)
