"""Aggregation operators A1-A9 and the top-k report O2.

Where a report groups by a key it also joins on, bills/payments are aggregated
*before* the join (partial aggregation collapses a hot customer map-side) and
the one-row-per-key result is joined to its dimension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formatting import day_label, month_label, quantity_text
from ..functions.timewin import DateLike, day_range, in_month, last_n_days, months_back_start
from ..schemas import OPEN_BILL_STATUSES, REPORT_MONEY
from ..sources.tables import Tables
from .common import count_col, money
from .joins import bill_utility, open_bills
from .windows import global_rank

TREND_UTILITIES = ("Electricity", "Water", "Gas")


def dashboard_stats(t: Tables, as_of: DateLike) -> DataFrame:
    """A1: customers, meters, Unpaid bills, payments in as_of's month (NULL -> 0).

    Four one-row aggregates are stacked with ``unionByName`` and folded into one
    row with ``max`` (no cross join).
    """
    parts = [
        t.customer.agg(count_col().alias("totalCustomers")),
        t.meter.agg(count_col().alias("totalMeters")),
        t.bill.where(F.col("Status") == "Unpaid").agg(count_col().alias("billsPending")),
        t.payment.where(in_month("PaymentDate", as_of)).agg(
            money(F.sum("PaymentAmount")).alias("monthlyRevenue")),
    ]
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p, allowMissingColumns=True)
    return stacked.agg(
        F.max("totalCustomers").alias("totalCustomers"),
        F.max("totalMeters").alias("totalMeters"),
        F.max("billsPending").alias("billsPending"),
        F.coalesce(F.max("monthlyRevenue"), F.lit(0).cast(REPORT_MONEY)).alias("monthlyRevenue"),
    )


def defaulters(t: Tables, start: DateLike | None = None, end: DateLike | None = None,
               ordered: bool = True, collation: str | None = None) -> DataFrame:
    """Per customer, count and sum of Unpaid/Overdue bills, by TotalDue desc.

    With ``start``/``end`` only bills dated in that range count (whole days).
    """
    b = open_bills(t, OPEN_BILL_STATUSES, collation)
    if start is not None or end is not None:
        b = b.where(day_range("BillDate", start, end))
    per_cust = b.groupBy("CustomerID").agg(
        count_col("BillID").alias("UnpaidBills"), money(F.sum("AmountDue")).alias("TotalDue"))
    c = t.customer.select("CustomerID", "CustomerName", "Phone", "CustomerType")
    out = (c.join(per_cust, "CustomerID")
           .where(F.col("UnpaidBills") > 0)
           .select("CustomerID", "CustomerName", "Phone", "CustomerType", "UnpaidBills", "TotalDue"))
    if ordered:
        out = out.orderBy(F.col("TotalDue").desc(), "CustomerID")
    return out


def defaulters_total(detail: DataFrame) -> DataFrame:
    """A2b total: sum of TotalDue over the defaulter rows (0 when there are none)."""
    return detail.agg(
        F.coalesce(F.sum("TotalDue"), F.lit(0)).cast(REPORT_MONEY).alias("GrandTotalDue"),
        count_col().alias("Defaulters"))


def consumption_totals(t: Tables, bill_filter) -> DataFrame:
    """SUM(Consumption) per customer x utility x unit over the filtered bills.

    Bills are summed per (CustomerID, MeterID) -- the join keys -- before the
    joins, so the customer / meter joins see one row per pair instead of one per
    bill (partial aggregation also collapses a hot customer map-side). Sums are
    decomposable and the joins are many-to-one, so the result is unchanged.
    """
    b = t.bill.select("CustomerID", "MeterID", "BillDate", "Consumption")
    if bill_filter is not None:
        b = b.where(bill_filter)
    per_pair = b.groupBy("CustomerID", "MeterID").agg(F.sum("Consumption").alias("_c"))
    c = t.customer.select("CustomerID", "CustomerName")
    m = t.meter.select("MeterID", "UtilityID")
    u = t.utility_type.select("UtilityID", "UtilityName", "Unit")
    star = per_pair.join(c, "CustomerID").join(m, "MeterID").join(u, "UtilityID")
    return star.groupBy("CustomerID", "CustomerName", "UtilityName", "Unit").agg(
        F.sum("_c").alias("TotalConsumption"))


def ranked_consumption(totals: DataFrame, ordered: bool = True, per_unit: bool = False) -> DataFrame:
    """A3 body: positive totals, RANK() by total desc (distributed, W1), N0 text.

    The reference ranks kWh, m3 and gas units in one list (T6); ``per_unit=True``
    ranks within each unit instead.
    """
    pos = totals.where(F.col("TotalConsumption") > 0)
    ranked = global_rank(pos, "TotalConsumption", "Rank", partition_by=["Unit"] if per_unit else ())
    out = ranked.select(
        "Rank", "CustomerID", "CustomerName",
        F.col("UtilityName").alias("Utility"),
        quantity_text("TotalConsumption", "Unit").alias("Consumption"),
        money("TotalConsumption").alias("TotalConsumption"))
    if ordered:
        out = out.orderBy("Rank", "CustomerID", "Utility")
    return out


def consumption_last_days(t: Tables, as_of: DateLike, days: int = 30) -> DataFrame:
    """A3: ranked consumption of bills issued in the ``days`` days up to ``as_of``."""
    return ranked_consumption(consumption_totals(t, last_n_days("BillDate", as_of, days)))


def usage_between(t: Tables, start: DateLike, end: DateLike, per_unit: bool = False) -> DataFrame:
    """The same ranking for a given BillDate range."""
    return ranked_consumption(consumption_totals(t, day_range("BillDate", start, end)), per_unit=per_unit)


def top_consumers(totals: DataFrame, k: int = 5) -> DataFrame:
    """O2: the first ``k`` rows of the consumption ranking and their chart label.

    No global rank is needed: ``orderBy().limit(k)`` plans as
    TakeOrderedAndProject (each task keeps k rows), and every row with a larger
    total than a kept row is itself kept, so RANK() computed over the k rows
    equals the global rank. The window below runs on at most k rows.
    """
    pos = totals.where(F.col("TotalConsumption") > 0)
    top = pos.orderBy(F.col("TotalConsumption").desc(), "CustomerID", "UtilityName").limit(k)
    rank = F.rank().over(Window.orderBy(F.col("TotalConsumption").desc())).cast("bigint")
    return top.select(
        rank.alias("Rank"), "CustomerID",
        F.concat(F.col("CustomerName"), F.lit(" ("), F.col("UtilityName"), F.lit(")")).alias("Label"),
        money("TotalConsumption").alias("TotalConsumption"))


def _revenue_by(t: Tables, flt: Column | None, period: Column, name: str) -> DataFrame:
    """Payments per utility and period: (``name``, UtilityName, _n, _amount), one row per bill and period.

    Payments are collapsed per bill before they meet the bills, so a bill with many
    payments is one row in the join, and only keys and sums are moved.
    """
    p = t.payment.select("BillID", "PaymentID", "PaymentAmount", "PaymentDate")
    if flt is not None:
        p = p.where(flt)
    per_bill = p.groupBy("BillID", period.alias(name)).agg(
        F.count("PaymentID").alias("_n"), F.sum("PaymentAmount").alias("_amount"))
    return per_bill.join(bill_utility(t).select("BillID", "UtilityName"), "BillID").select(
        name, "UtilityName", "_n", "_amount")


def revenue_trends(t: Tables, as_of: DateLike, months: int = 6, ordered: bool = True) -> DataFrame:
    """A4: monthly payments pivoted to Electricity / Water / Gas + total.

    Payments from the first day of the month ``months`` before as_of's month, with
    no upper bound (so the window spans months+1 calendar months and later
    payments count, as in the reference). Months whose payments all belong to
    other utilities still give a row of zeros.
    """
    start = months_back_start(as_of, months)
    keyed = _revenue_by(t, F.col("PaymentDate") >= F.lit(start), F.last_day("PaymentDate"), "MonthSortKey")
    piv = (keyed.groupBy("MonthSortKey")
           .pivot("UtilityName", list(TREND_UTILITIES)).agg(F.sum("_amount")))
    cols = [F.coalesce(money(u), F.lit(0).cast(REPORT_MONEY)).alias(u) for u in TREND_UTILITIES]
    out = piv.select("MonthSortKey", month_label("MonthSortKey").alias("Month"), *cols)
    out = out.withColumn("TotalRevenue", money(sum(F.col(u) for u in TREND_UTILITIES)))
    if ordered:
        out = out.orderBy("MonthSortKey")
    return out.drop("MonthSortKey")


def revenue_trend_totals(trends: DataFrame) -> DataFrame:
    """Column totals over the trend rows (one row)."""
    return trends.agg(*[money(F.coalesce(F.sum(c), F.lit(0))).alias(c)
                        for c in (*TREND_UTILITIES, "TotalRevenue")])


def revenue_by_day(t: Tables, start: DateLike, end: DateLike, ordered: bool = True) -> DataFrame:
    """A5: per day and utility, number and sum of payments in the range."""
    rows = _revenue_by(t, day_range("PaymentDate", start, end), F.to_date("PaymentDate"), "_day")
    out = rows.groupBy("_day", "UtilityName").agg(F.sum("_n").alias("_n"), F.sum("_amount").alias("_amount")).select(
        day_label("_day").alias("Date"), F.col("UtilityName").alias("Utility"),
        F.col("_n").cast("bigint").alias("PaymentsReceived"), money("_amount").alias("Total"))
    if ordered:
        out = out.orderBy("Date", "Utility")
    return out


def revenue_grand_total(t: Tables, start: DateLike, end: DateLike) -> DataFrame:
    """SUM(PaymentAmount) over Payment alone (no joins), NULL when empty."""
    return (t.payment.where(day_range("PaymentDate", start, end))
            .agg(money(F.sum("PaymentAmount")).alias("GrandTotal")))


def revenue_by_utility(t: Tables, start: DateLike | None = None, end: DateLike | None = None) -> DataFrame:
    """Payments and revenue per utility plus a 'Grand Total' row (ROLLUP)."""
    flt = day_range("PaymentDate", start, end) if (start or end) else None
    per = (_revenue_by(t, flt, F.lit(0), "_all").groupBy("UtilityName")
           .agg(F.sum("_n").alias("_n"), F.sum("_amount").alias("_amount")))
    # the roll-up sees one row per utility
    return (per.rollup("UtilityName")
            .agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("TotalPayments"),
                 money(F.sum("_amount")).alias("TotalRevenue"),
                 F.grouping("UtilityName").alias("_g"))
            .select(F.when(F.col("_g") == 1, F.lit("Grand Total")).otherwise(F.col("UtilityName"))
                    .alias("UtilityName"), "TotalPayments", "TotalRevenue")
            .orderBy(F.col("UtilityName") == "Grand Total", "UtilityName"))


def tariff_bill_counts(t: Tables) -> DataFrame:
    """Number of bills per tariff, zero for unused tariffs."""
    counts = t.bill.where(F.col("TariffID").isNotNull()).groupBy("TariffID").agg(
        count_col().alias("BillCount"))
    return (t.tariff.select("TariffID", "UtilityID", "TariffName")
            .join(counts, "TariffID", "left")
            .select("TariffID", "UtilityID", "TariffName",
                    F.coalesce("BillCount", F.lit(0).cast("bigint")).alias("BillCount")))


def defaulter_bills(t: Tables) -> DataFrame:
    """Bill-level defaulters list (BillID, CustomerName, Phone, DueDate, AmountDue, Status)."""
    b = open_bills(t).select("BillID", "CustomerID", "DueDate", "AmountDue", "Status")
    c = t.customer.select("CustomerID", "CustomerName", "Phone")
    return (b.join(c, "CustomerID")
            .select("BillID", "CustomerName", "Phone", "DueDate", money("AmountDue").alias("AmountDue"), "Status")
            .orderBy("DueDate", "BillID"))
