"""Billing runs and payment posting.

The reference creates one bill per request from values the browser posts back,
and records one payment per request through a stored procedure whose body is
not in the repository. Both are re-aimed as whole-table batch transforms:

* B4 ``billing_run``: every unbilled reading -> one Unpaid bill, amount from the
  rating rules, due 14 days after the bill date, deterministic BillID.
* B4b ``billing_run_month``: the same for readings dated in one billing month,
  optionally only for some customers.
* B5 ``post_payments`` (our definition of the absent procedure): validate,
  reject unknown bills, append, and mark a bill Paid once its payments cover
  AmountDue.
* B6 ``double_billed``: readings referenced by more than one bill.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timewin import DateLike, in_month, to_date, to_datetime
from ..schemas import BILL, MONEY, PAYMENT
from ..sources.tables import Tables
from .bitmaps import repeated_ids, without_ids
from .common import frozen_key_join, key_join
from .joins import billed_ids
from .rating import rate_readings, reading_consumption
from .validate import payment_rules, tag_errors
from .windows import freeze, numbered

DUE_DAYS = 14
BILL_PREFIX = "BILL-R"


def _bills_for(t: Tables, cons: DataFrame, bill_date: dt.date, due_date: dt.date | None) -> DataFrame:
    # Previous values come from whole histories, so LAG runs once over the readings; the
    # guard (no reading that stands on a bill) is then one bit test per reading.
    rated = rate_readings(t, without_ids(cons, "ReadingID", billed_ids(t)))
    bd = F.lit(bill_date)
    return rated.select(
        F.concat(F.lit(BILL_PREFIX), F.col("ReadingID").cast("string")).alias("BillID"),
        "CustomerID", "MeterID", "ReadingID",
        F.col("BaseTariffID").alias("TariffID"),
        bd.alias("BillDate"),
        (F.date_add(bd, DUE_DAYS) if due_date is None else F.lit(due_date)).alias("DueDate"),
        F.col("PreviousReadingValue").cast(MONEY).alias("PreviousReadingValue"),
        F.col("CurrentReadingValue").cast(MONEY).alias("CurrentReadingValue"),
        F.col("Consumption").cast(MONEY).alias("Consumption"),
        F.col("CalculatedAmountDue").cast(MONEY).alias("AmountDue"),
        F.lit("Unpaid").alias("Status"),
    )


def billing_run(t: Tables, bill_date: DateLike, due_date: DateLike | None = None) -> DataFrame:
    """One new bill per reading that no bill references yet (rerun adds nothing).

    ``due_date`` defaults to ``DUE_DAYS`` days after the bill date.
    """
    cons = reading_consumption(t, known_only=True)
    return _bills_for(t, cons, to_date(bill_date), None if due_date is None else to_date(due_date))


def billing_run_month(t: Tables, month_of: DateLike, bill_date: DateLike | None = None,
                      customers: DataFrame | None = None, due_date: DateLike | None = None) -> DataFrame:
    """Bills for unbilled readings dated in ``month_of``'s month (first-of-month
    billing like the reference's procedure call), optionally for some customers."""
    meters = None
    if customers is not None:
        c = customers.select("CustomerID").where(F.col("CustomerID").isNotNull()).distinct()
        meters = key_join(t.meter.select("MeterID", "CustomerID"), c, "CustomerID").select("MeterID")
    cons = reading_consumption(t, meters, known_only=True).where(in_month("ReadingDate", month_of))
    bd = to_date(bill_date) if bill_date else to_date(month_of).replace(day=1)
    return _bills_for(t, cons, bd, None if due_date is None else to_date(due_date))


def double_billed(bills: DataFrame) -> DataFrame:
    """Readings that appear on more than one bill."""
    return repeated_ids(bills.select("ReadingID"), "ReadingID").withColumnRenamed("count", "BillCount")


@dataclass
class PaymentPosting:
    accepted: DataFrame   # new Payment rows
    rejected: DataFrame   # batch rows + Reason
    bills: DataFrame      # new Bill snapshot
    payments: DataFrame   # new Payment snapshot (existing + accepted)
    paid: DataFrame       # BillID, PaidTotal for the bills the batch touched
    settled: DataFrame    # touched bills: BillID, AmountDue, PaidTotal, new Status


def post_payments(t: Tables, batch: DataFrame, as_of: DateLike, cashier: str | None = None,
                  batch_id: str | None = None) -> PaymentPosting:
    """Post a batch of payments (BillID, UserID?, PaymentAmount, PaymentMethod, PaymentID?).

    * a row that breaks a payment rule (P7: a missing field, an amount of 0, a method
      outside the domain) is refused with the rule's name
    * BillID not on any bill -> "unknown bill"
    * a PaymentID that is stored already -> "duplicate PaymentID"; given more than once
      in the batch -> "repeated PaymentID" (each of its rows)
    * rows without a PaymentID get PAY-<batch_id>-<n>, n from 1 in the order of the rows'
      content, equal rows one by one. ``batch_id`` defaults to ``as_of``: posting the
      same batch again gives the same ids, and so refuses all its rows as duplicates
    * accepted rows get PaymentDate = ``as_of``
    * a bill touched by the batch becomes Paid when all its payments >= AmountDue

    Stored payments are collapsed to one sum per bill where they are read; sums of bills of the batch are kept.
    """
    ts = to_datetime(as_of)
    cols = set(batch.columns)
    b = batch.select(
        (F.col("PaymentID") if "PaymentID" in cols else F.lit(None).cast("string")).alias("PaymentID"),
        F.col("BillID"),
        (F.col("UserID") if "UserID" in cols else F.lit(cashier).cast("string")).alias("UserID"),
        F.col("PaymentAmount").cast(MONEY).alias("PaymentAmount"),
        F.col("PaymentMethod"))
    given, bare = b.where(F.col("PaymentID").isNotNull()), b.where(F.col("PaymentID").isNull()).drop("PaymentID")
    prefix = f"PAY-{batch_id or ts.strftime('%Y%m%dT%H%M%S')}-"
    minted = numbered(bare, "_n").withColumn("PaymentID", F.concat(F.lit(prefix), F.col("_n").cast("string"))).drop("_n")
    b = freeze(given.unionByName(minted))

    # Faulty keys are found among narrow rows, one for each key; the batch itself meets only those.
    asked = b.select("BillID").where(F.col("BillID").isNotNull()).distinct()
    unknown = freeze(asked.join(t.bill.select("BillID").distinct(), "BillID", "left_anti"))
    ids = t.payment.select("PaymentID", F.lit(True).alias("_stored"), F.lit(0).alias("_n")).unionByName(
        b.select("PaymentID", F.lit(False).alias("_stored"), F.lit(1).alias("_n")))
    taken = freeze(ids.groupBy("PaymentID").agg(F.max("_stored").alias("_stored"), F.sum("_n").alias("_n"))
                   .where((F.col("_n") > 1) | F.col("_stored") & (F.col("_n") > 0)).select("PaymentID", "_stored"))
    checked = tag_errors(b, payment_rules())
    checked = frozen_key_join(checked, unknown.withColumn("_unknown", F.lit(True)), "BillID", "left", counted=b)
    checked = frozen_key_join(checked, taken, "PaymentID", "left", counted=b)
    reason = F.coalesce(F.try_element_at(F.col("Errors"), F.lit(1)),
                        F.when(F.col("_unknown"), F.lit("unknown bill")),
                        F.when(F.col("_stored"), F.lit("duplicate PaymentID")),
                        F.when(~F.col("_stored"), F.lit("repeated PaymentID")))
    # Frozen: each frame of the posting is a filter of the checked batch, and reads nothing stored again.
    checked = freeze(checked.select(*b.columns, reason.alias("Reason")))

    accepted = checked.where(F.col("Reason").isNull()).select(
        "PaymentID", "BillID", "UserID", "PaymentAmount",
        F.lit(ts.isoformat(sep=" ")).cast("timestamp_ntz").alias("PaymentDate"), "PaymentMethod")
    rejected = checked.where(F.col("Reason").isNotNull()).select(
        "PaymentID", "BillID", "UserID", "PaymentAmount", "PaymentMethod", "Reason")

    payments = t.payment.select(*[f.name for f in PAYMENT.fields]).unionByName(accepted)
    # New money per bill, plus what those bills had already received: both sides are
    # one row per bill before they meet, so a bill with many payments is one row.
    new_paid = accepted.groupBy("BillID").agg(F.sum("PaymentAmount").alias("_new"))
    old_paid = t.payment.groupBy("BillID").agg(F.sum("PaymentAmount").alias("_old"))
    paid = new_paid.join(old_paid, "BillID", "left").select(
        "BillID", (F.col("_new") + F.coalesce(F.col("_old"), F.lit(0))).alias("_paid"))
    covered = F.col("_paid").isNotNull() & (F.col("_paid") >= F.col("AmountDue"))
    joined = t.bill.join(paid, "BillID", "left").withColumn(
        "Status", F.when(covered, F.lit("Paid")).otherwise(F.col("Status")))
    bills = joined.select(*[f.name for f in BILL.fields])
    settled = joined.where(F.col("_paid").isNotNull()).select(
        "BillID", "AmountDue", F.col("_paid").cast("decimal(18,2)").alias("PaidTotal"), "Status")
    paid_out = paid.select("BillID", F.col("_paid").cast("decimal(18,2)").alias("PaidTotal"))
    return PaymentPosting(accepted, rejected, bills, payments, paid_out, settled)
