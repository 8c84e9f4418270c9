"""Key lookups (P1) and the dated log reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timewin import DateLike, day_range
from ..sources.tables import Tables


def lookup(entity: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """P1 re-aimed from one id per request to a set of ids.

    Every distinct requested key comes back once, with the entity's columns and
    ``Found`` (False plays the role of the reference's 404). No broadcast hint:
    AQE broadcasts the key set only if its runtime size is small.
    """
    k = keys.select(key).where(F.col(key).isNotNull()).distinct()
    # Restrict the entity to the requested keys first (semi join: the key set can
    # be broadcast and the entity streamed), then keep every requested key.
    hit = entity.join(k, key, "left_semi").withColumn("_hit", F.lit(True))
    out = k.join(hit, key, "left")
    return out.select(*[F.col(c) for c in entity.columns],
                      F.coalesce(F.col("_hit"), F.lit(False)).alias("Found"))


def new_customers(t: Tables, start: DateLike | None = None, end: DateLike | None = None) -> DataFrame:
    """Customers registered in the range (default 1900-01-01..2099-12-31), newest first."""
    return (t.customer.where(day_range("RegistrationDate", start, end))
            .select("CustomerID", "CustomerName", "CustomerType", "RegistrationDate", "Email", "Phone")
            .orderBy(F.col("RegistrationDate").desc(), "CustomerID"))


def readings_log(t: Tables, start: DateLike | None = None, end: DateLike | None = None) -> DataFrame:
    """Readings in the range, newest first."""
    return (t.meter_reading.where(day_range("ReadingDate", start, end))
            .select("ReadingID", "MeterID", "ReadingValue", "ReadingDate", "UserID")
            .orderBy(F.col("ReadingDate").desc(), F.col("ReadingID").desc()))


def payment_log(t: Tables, start: DateLike | None = None, end: DateLike | None = None) -> DataFrame:
    """Payments in the range (end day included to its last second), newest first."""
    return (t.payment.where(day_range("PaymentDate", start, end))
            .select("PaymentID", "BillID", "PaymentAmount", "PaymentDate", "PaymentMethod", "UserID")
            .orderBy(F.col("PaymentDate").desc(), "PaymentID"))
