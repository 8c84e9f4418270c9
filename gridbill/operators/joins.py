"""Join operators J1-J9.

Join order is written smallest-first where it matters (bill -> meter -> utility
before payments), filters are applied before joins so they reach the Parquet
scans, and only dimension frames are broadcast, after a size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timewin import DateLike, in_month
from ..schemas import OPEN_BILL_STATUSES
from ..sources.tables import Tables
from .bitmaps import id_bitmaps, without_ids
from .common import facts_of, key_join


def _utilities(t: Tables) -> DataFrame:
    # No hint: the planner broadcasts a small dimension after its own size check
    # (autoBroadcastJoinThreshold, re-checked by AQE at runtime) and falls back to
    # a sort-merge join beyond it.
    return t.utility_type.select("UtilityID", "UtilityName", "Unit")


def meter_inventory(t: Tables) -> DataFrame:
    """Meter x Customer x Utility_Type (inner)."""
    m = t.meter.select("MeterID", "CustomerID", "UtilityID", "Status", "Location")
    c = t.customer.select("CustomerID", "ServiceAddress")
    return (m.join(c, "CustomerID").join(_utilities(t), "UtilityID")
            .select("MeterID", "CustomerID", "UtilityName", "Status", "ServiceAddress", "Location"))


def billing_ledger(t: Tables, ordered: bool = True) -> DataFrame:
    """Every bill with each of its payments (a bill with n payments gives n rows,
    a bill with none gives one row with a NULL PaymentDate), newest bill first."""
    b = t.bill.select("BillID", "CustomerID", "BillDate", "AmountDue", "Status")
    p = t.payment.select("BillID", "PaymentDate")
    cols = ["BillID", "CustomerID", "BillDate", "AmountDue", "Status", "PaymentDate"]
    out = facts_of(b, p, "BillID").select(*cols)
    if ordered:
        out = out.orderBy(F.col("BillDate").desc(), "BillID", F.col("PaymentDate").asc_nulls_first())
    return out


def open_bills(t: Tables, statuses=OPEN_BILL_STATUSES, collation: str | None = None) -> DataFrame:
    """P5: status-set predicate (pushed to the scan as an IN / OR filter).

    ``collation="UTF8_LCASE"`` matches statuses case-insensitively, for stores
    whose collation made 'unpaid' equal 'Unpaid' (T18); exact match by default.
    """
    status = F.col("Status") if collation is None else F.collate(F.col("Status"), collation)
    return t.bill.where(status.isin(*statuses))


def outstanding_bills(t: Tables) -> DataFrame:
    """Unpaid / Overdue bills with the customer name."""
    b = open_bills(t).select("BillID", "CustomerID", "BillDate", "DueDate", "AmountDue")
    c = t.customer.select("CustomerID", "CustomerName")
    return b.join(c, "CustomerID").select(
        "BillID", "CustomerID", "CustomerName", "BillDate", "DueDate", "AmountDue")


def meter_customer(t: Tables, meter_keys: DataFrame) -> DataFrame:
    """Meter details (MeterID, CustomerName, ServiceAddress) for a set of meters."""
    m = t.meter.select("MeterID", "CustomerID").join(
        meter_keys.select("MeterID").distinct(), "MeterID", "left_semi")
    c = t.customer.select("CustomerID", "CustomerName", "ServiceAddress")
    return m.join(c, "CustomerID").select("MeterID", "CustomerName", "ServiceAddress")


def meter_customer_outcome(t: Tables, meter_keys: DataFrame) -> DataFrame:
    """J4 with an answer for every key: ``Found`` is false for a meter that is not stored
    (or whose customer is not). NULL keys are left out."""
    keys = meter_keys.select("MeterID").where(F.col("MeterID").isNotNull()).distinct()
    found = meter_customer(t, keys).withColumn("Found", F.lit(True))
    return keys.join(found, "MeterID", "left").withColumn("Found", F.coalesce("Found", F.lit(False)))


def not_in(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
           strict: bool = False, unique: bool = False) -> DataFrame:
    """``left.key NOT IN (SELECT key FROM right)``; ``unique``: no key comes twice in ``left``.

    Default: anti join (a NULL on the right side matches nothing, rows survive).
    ``strict=True`` keeps SQL's three-valued logic: if the subquery yields any
    NULL, no row qualifies, and a NULL left key never qualifies.
    """
    r = right.select(F.col(right_key).alias(left_key))
    # distinct() collapses a hot key of the right side where it is read; a hot key of the
    # left side is spread over parts (see key_join).
    out = key_join(left, r.where(F.col(left_key).isNotNull()).distinct(), left_key, "left_anti", unique=unique)
    if not strict:
        return out
    # One boolean comes back to the driver: does the subquery contain a NULL?
    if r.where(F.col(left_key).isNull()).limit(1).count() > 0:
        return out.where(F.lit(False))
    return out.where(F.col(left_key).isNotNull())


def unread_meters(t: Tables, as_of: DateLike, strict_not_in: bool = False) -> DataFrame:
    """Active meters with no reading in ``as_of``'s calendar month (route list)."""
    m = t.meter.where(F.col("Status") == "Active").select("MeterID", "CustomerID", "UtilityID")
    read = t.meter_reading.where(in_month("ReadingDate", as_of)).select("MeterID")
    pending = not_in(m, read, "MeterID", "MeterID", strict_not_in, unique=True)
    c = t.customer.select("CustomerID", "CustomerName", "ServiceAddress")
    return (pending.join(c, "CustomerID").join(_utilities(t), "UtilityID")
            .select("MeterID", "CustomerName", "ServiceAddress", "UtilityName"))


def billed_ids(t: Tables) -> DataFrame:
    """The reading ids that stand on a bill, as bitmaps."""
    return id_bitmaps(t.bill.select("ReadingID"), "ReadingID")


def unbilled_readings(t: Tables, strict_not_in: bool = False) -> DataFrame:
    """Readings whose id appears on no bill, with the meter's owner.

    The billed ids are shuffled and held as bitmaps, one row per 32,768 ids.
    """
    r = t.meter_reading.select("ReadingID", "MeterID")
    todo = without_ids(r, "ReadingID", billed_ids(t))
    if strict_not_in:
        todo = not_in(r, t.bill.select("ReadingID"), "ReadingID", "ReadingID", True, unique=True)
    m = t.meter.select("MeterID", "CustomerID")
    return todo.join(m, "MeterID").select("ReadingID", "MeterID", "CustomerID")


def bill_utility(t: Tables) -> DataFrame:
    """Bill -> Meter -> Utility_Type: one row per bill with its utility (bill-sized)."""
    b = t.bill.select("BillID", "MeterID")
    m = t.meter.select("MeterID", "UtilityID")
    return b.join(m, "MeterID").join(_utilities(t), "UtilityID").select(
        "BillID", "UtilityName", "Unit")


def payment_utility_star(t: Tables, payment_filter: Column | None = None) -> DataFrame:
    """Payment -> Bill -> Meter -> Utility_Type.

    The payment filter is applied before the join so it reaches the scan; the
    bill side is joined to its (small) dimensions first.
    """
    p = t.payment.select("PaymentID", "BillID", "PaymentAmount", "PaymentDate")
    if payment_filter is not None:
        p = p.where(payment_filter)
    return p.join(bill_utility(t), "BillID").select(
        "PaymentID", "BillID", "PaymentAmount", "PaymentDate", "UtilityName")


def bill_utility_star(t: Tables, bill_filter: Column | None = None) -> DataFrame:
    """Bill -> Customer -> Meter -> Utility_Type."""
    b = t.bill.select("BillID", "CustomerID", "MeterID", "BillDate", "Consumption")
    if bill_filter is not None:
        b = b.where(bill_filter)
    c = t.customer.select("CustomerID", "CustomerName")
    m = t.meter.select("MeterID", "UtilityID")
    return (b.join(c, "CustomerID").join(m, "MeterID").join(_utilities(t), "UtilityID")
            .select("BillID", "CustomerID", "CustomerName", "BillDate", "Consumption",
                    "UtilityName", "Unit"))
