"""Report dispatch (R1 admin reports, R2 manager reports).

A report is a named DataFrame builder. Building the usage report runs jobs (its
ranking freezes a layout); the others run nothing until the caller acts on the
returned frames. The manager reports return the detail frame and, where the
reference shows one, a one-row total frame built from the same inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timewin import DateLike
from ..operators import aggregates as A
from ..operators import lookup as L
from ..operators.common import REPORT_MONEY
from ..sources import sinks
from ..sources.tables import Tables

ADMIN_REPORTS = {
    "new-customers": L.new_customers,
    "readings-log": L.readings_log,
    "payment-log": L.payment_log,
}

# The reports' names and column headings, in the order of their columns.
ADMIN_TITLES = {
    "new-customers": ("New Customer Registrations", ("Customer ID", "Name", "Type", "Registration Date", "Email", "Phone")),
    "readings-log": ("Meter Reading Log", ("Reading ID", "Meter ID", "Reading Value", "Reading Date", "Field Officer ID")),
    "payment-log": ("Payment Received Log", ("Payment ID", "Bill ID", "Payment Amount", "Payment Date", "Method", "Cashier ID")),
}


def titled(report: DataFrame, report_type: str) -> tuple[str, DataFrame]:
    """An admin report's name, and the report under its column headings (for exports)."""
    name, headings = ADMIN_TITLES[report_type]
    return name, report.toDF(*headings)


def admin_report(t: Tables, report_type: str, start: DateLike | None = None,
                 end: DateLike | None = None) -> DataFrame:
    """New-customers / readings-log / payment-log over an optional day range."""
    try:
        build = ADMIN_REPORTS[report_type]
    except KeyError:
        raise ValueError(f"unknown report type {report_type!r}") from None
    return build(t, start, end)


@dataclass
class ManagerReport:
    data: DataFrame
    total: DataFrame | None


def manager_report(t: Tables, report_type: str, start: DateLike, end: DateLike) -> ManagerReport:
    """R2: revenue / defaulters / usage for a required day range.

    * revenue: per day x utility payments, total = SUM over Payment alone (T10)
    * defaulters: per customer open bills in the range, total = sum of the rows
    * usage: ranked consumption, no total
    Unknown types raise (the reference answers an empty success).
    """
    if report_type == "revenue":
        return ManagerReport(A.revenue_by_day(t, start, end), A.revenue_grand_total(t, start, end))
    if report_type == "defaulters":
        detail = A.defaulters(t, start, end)
        return ManagerReport(detail, A.defaulters_total(A.defaulters(t, start, end, ordered=False)))
    if report_type == "usage":
        return ManagerReport(A.usage_between(t, start, end), None)
    raise ValueError(f"unknown report type {report_type!r}")


def export_defaulters(t: Tables, start: DateLike, end: DateLike, path: str, fmt: str = "csv") -> dict:
    """R2 defaulters as an export: the detail is written to ``path``, its total (0 without rows) and number of rows
    come back from the same pass. (The revenue report's total is over Payment alone, so it is no sum of its rows.)"""
    figures = {"GrandTotalDue": F.coalesce(F.sum("TotalDue"), F.lit(0)).cast(REPORT_MONEY), "Defaulters": F.count(F.lit(1))}
    return sinks.export_observed(A.defaulters(t, start, end), path, figures, fmt)
