"""The registered queries (one per SURVEY section 2 operator) and their oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import display as D
from ..functions import formatting as FM
from ..functions import timewin as TW
from ..operators import aggregates as A
from ..operators import billing as B
from ..operators import joins as J
from ..operators import lookup as L
from ..operators import maintain as M
from ..operators import validate as V
from ..operators import windows as W
from ..operators import rating as RT
from ..operators import summaries as SM
from ..session import output_dir
from ..streaming import consumption as SC
from ..streaming import ingest as ST
from ..sources.tables import Tables
from . import reports as RP
from .catalog import AS_OF, RANGE_END, RANGE_START, READ_AS_OF, register

# SQL literals for the fixed clocks/ranges used by the oracles.
_R0, _R1 = RANGE_START.isoformat(), RANGE_END.isoformat()
_R1_NEXT = "1999-01-01"


# --------------------------------------------------------------------------- S1
@register("customers", "SELECT * FROM cust")
def q_customers(t: Tables):
    """Full customer entity read."""
    return t.customer


@register("meters", "SELECT * FROM meter")
def q_meters(t: Tables):
    """Full meter entity read."""
    return t.meter


@register("tariffs", """
SELECT t.TariffID, t.UtilityID, t.TariffName, t.Rate, t.MinUnits, t.MaxUnits, t.FixedCharge,
       COUNT(b.BillID) AS BillCount
FROM tariff t LEFT JOIN bill b ON b.TariffID = t.TariffID
GROUP BY t.TariffID, t.UtilityID, t.TariffName, t.Rate, t.MinUnits, t.MaxUnits, t.FixedCharge
""")
def q_tariffs(t: Tables):
    """The full tariff entity; the rows are fixed, so each carries its bill count
    (the work grows with the bill table)."""
    return t.tariff.join(A.tariff_bill_counts(t).select("TariffID", "BillCount"), "TariffID")


@register("utility_types", """
SELECT u.UtilityID, u.UtilityName, u.Unit, COUNT(m.MeterID) AS MeterCount
FROM utility_type u LEFT JOIN meter m ON m.UtilityID = u.UtilityID
GROUP BY u.UtilityID, u.UtilityName, u.Unit
""")
def q_utility_types(t: Tables):
    """The full utility entity with the number of meters of each utility."""
    per = t.meter.groupBy("UtilityID").agg(F.count(F.lit(1)).alias("MeterCount"))
    return (t.utility_type.join(per, "UtilityID", "left")
            .select("UtilityID", "UtilityName", "Unit",
                    F.coalesce("MeterCount", F.lit(0)).cast("bigint").alias("MeterCount")))


# ------------------------------------------------------------------------- joins
@register("meter_inventory", """
SELECT m.MeterID, m.CustomerID, u.UtilityName, m.Status, c.ServiceAddress, m.Location
FROM meter m JOIN cust c ON m.CustomerID = c.CustomerID
JOIN utility_type u ON m.UtilityID = u.UtilityID
""")
def q_meter_inventory(t: Tables):
    """Every meter with its customer's service address and utility name."""
    return J.meter_inventory(t)


@register("billing_ledger", """
SELECT b.BillID, b.CustomerID, b.BillDate, b.AmountDue, b.Status, p.PaymentDate
FROM bill b LEFT JOIN payment p ON b.BillID = p.BillID
""")
def q_billing_ledger(t: Tables):
    """Every bill with each of its payments, newest bill first."""
    return J.billing_ledger(t)


@register("outstanding_bills", """
SELECT b.BillID, b.CustomerID, c.CustomerName, b.BillDate, b.DueDate, b.AmountDue
FROM bill b JOIN cust c ON b.CustomerID = c.CustomerID
WHERE b.Status IN ('Unpaid', 'Overdue')
""")
def q_outstanding_bills(t: Tables):
    """Unpaid and Overdue bills with the customer name."""
    return J.outstanding_bills(t)


@register("unread_meters", """
SELECT m.MeterID, c.CustomerName, c.ServiceAddress, u.UtilityName
FROM meter m JOIN cust c ON m.CustomerID = c.CustomerID
JOIN utility_type u ON m.UtilityID = u.UtilityID
WHERE m.Status = 'Active'
  AND m.MeterID NOT IN (SELECT MeterID FROM meter_reading
                        WHERE month(ReadingDate) = 1 AND year(ReadingDate) = 2024)
""")
def q_unread_meters(t: Tables):
    """Active meters with no reading in January 2024 (the readings' month)."""
    return J.unread_meters(t, READ_AS_OF)


@register("unbilled_readings", """
SELECT r.ReadingID, r.MeterID, m.CustomerID
FROM meter_reading r JOIN meter m ON r.MeterID = m.MeterID
WHERE r.ReadingID NOT IN (SELECT ReadingID FROM bill)
""")
def q_unbilled_readings(t: Tables):
    """Readings no bill refers to, with the meter's owner."""
    return J.unbilled_readings(t)


@register("meter_customer", """
SELECT m.MeterID, c.CustomerName, c.ServiceAddress
FROM meter m JOIN cust c ON m.CustomerID = c.CustomerID
WHERE m.MeterID IN (SELECT MeterID FROM meter_reading)
""")
def q_meter_customer(t: Tables):
    """Meter details for every meter that sent a reading."""
    return J.meter_customer(t, t.meter_reading)


@register("payment_utility_star", """
SELECT p.PaymentID, p.BillID, p.PaymentAmount, p.PaymentDate, u.UtilityName
FROM payment p JOIN bill b ON p.BillID = b.BillID
JOIN meter m ON b.MeterID = m.MeterID JOIN utility_type u ON m.UtilityID = u.UtilityID
""")
def q_payment_utility_star(t: Tables):
    """Every payment with the utility of its bill's meter."""
    return J.payment_utility_star(t)


@register("bill_utility_star", """
SELECT b.BillID, b.CustomerID, c.CustomerName, b.BillDate, b.Consumption, u.UtilityName, u.Unit
FROM bill b JOIN cust c ON b.CustomerID = c.CustomerID
JOIN meter m ON b.MeterID = m.MeterID JOIN utility_type u ON m.UtilityID = u.UtilityID
""")
def q_bill_utility_star(t: Tables):
    """Every bill with its customer and its meter's utility."""
    return J.bill_utility_star(t)


# ------------------------------------------------------------------ aggregations
@register("dashboard_stats", """
SELECT (SELECT COUNT(*) FROM cust) AS totalCustomers,
       (SELECT COUNT(*) FROM meter) AS totalMeters,
       (SELECT COUNT(*) FROM bill WHERE Status = 'Unpaid') AS billsPending,
       CAST(COALESCE((SELECT SUM(PaymentAmount) FROM payment
                      WHERE month(PaymentDate) = 7 AND year(PaymentDate) = 2001), 0)
            AS DECIMAL(18,2)) AS monthlyRevenue
""")
def q_dashboard_stats(t: Tables):
    """A1: dashboard figures as of 2001-07-15 09:00."""
    return A.dashboard_stats(t, AS_OF)


# Open bills are summed per customer id first, then named; a customer without any has no row to name.
_DEFAULTERS_SQL = """
SELECT CustomerID, CustomerName, Phone, CustomerType, open_bills.n AS UnpaidBills,
       CAST(open_bills.due AS DECIMAL(18,2)) AS TotalDue
FROM (SELECT CustomerID, COUNT(*) AS n, SUM(AmountDue) AS due FROM bill b
      WHERE Status IN ('Overdue', 'Unpaid') {extra} GROUP BY CustomerID) open_bills
JOIN cust USING (CustomerID)
"""


@register("defaulters", _DEFAULTERS_SQL.format(extra=""))
def q_defaulters(t: Tables):
    """A2: customers with Unpaid/Overdue bills, count and total due."""
    return A.defaulters(t)


@register("defaulters_between", _DEFAULTERS_SQL.format(
    extra=f"AND b.BillDate >= DATE '{_R0}' AND b.BillDate < DATE '{_R1_NEXT}'"))
def q_defaulters_between(t: Tables):
    """Defaulters over bills dated in 1998."""
    return A.defaulters(t, RANGE_START, RANGE_END)


@register("defaulters_total", f"""
SELECT CAST(COALESCE(SUM(TotalDue), 0) AS DECIMAL(18,2)) AS GrandTotalDue, COUNT(*) AS Defaulters
FROM ({_DEFAULTERS_SQL.format(extra=f"AND b.BillDate >= DATE '{_R0}' AND b.BillDate < DATE '{_R1_NEXT}'")}) d
""")
def q_defaulters_total(t: Tables):
    """Grand total and number of the 1998 defaulters."""
    return A.defaulters_total(A.defaulters(t, RANGE_START, RANGE_END, ordered=False))


# Bills are summed per (customer, meter), the sums named and summed again; a rank is one more than
# the rows that are larger.
_CONSUMPTION_SQL = """
, per_meter AS (
  SELECT CustomerID, MeterID, SUM(Consumption) AS used FROM bill b WHERE {where} GROUP BY CustomerID, MeterID
), used AS (
  SELECT p.CustomerID, m.UtilityID, SUM(p.used) AS total
  FROM per_meter p JOIN meter m USING (MeterID) GROUP BY p.CustomerID, m.UtilityID
), positive AS (
  SELECT used.CustomerID, CustomerName, UtilityName, Unit, total
  FROM used JOIN utility_type USING (UtilityID) JOIN cust ON cust.CustomerID = used.CustomerID WHERE total > 0
), places AS (
  SELECT {part} AS part, total, COUNT(*) AS n FROM positive GROUP BY ALL
), place AS (
  SELECT part, total, 1 + COALESCE(SUM(n) OVER (PARTITION BY part ORDER BY total DESC
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM places
), ranked AS (
  SELECT CAST(place.place AS BIGINT) AS Rank, CustomerID, CustomerName, UtilityName AS Utility,
         format('{{:,.0f}}', CAST(round(p.total, 0) AS DOUBLE)) || ' ' || Unit AS Consumption,
         CAST(p.total AS DECIMAL(18,2)) AS TotalConsumption
  FROM positive p JOIN place ON place.total = p.total AND place.part = {part}
)
"""
_LAST30 = "b.BillDate > DATE '2001-06-15' AND b.BillDate <= DATE '2001-07-15'"
_IN_RANGE = f"b.BillDate >= DATE '{_R0}' AND b.BillDate < DATE '{_R1_NEXT}'"


@register("consumption_by_customer", _CONSUMPTION_SQL.format(where=_LAST30, part="1") + "SELECT * FROM ranked")
def q_consumption_by_customer(t: Tables):
    """A3: consumption ranking of bills issued in the 30 days up to 2001-07-15."""
    return A.consumption_last_days(t, AS_OF, 30)


@register("usage_between", _CONSUMPTION_SQL.format(where=_IN_RANGE, part="1") + "SELECT * FROM ranked")
def q_usage_between(t: Tables):
    """Consumption ranking of bills dated in 1998."""
    return A.usage_between(t, RANGE_START, RANGE_END)


@register("usage_rank_per_unit", _CONSUMPTION_SQL.format(where=_IN_RANGE, part="Unit") + "SELECT * FROM ranked")
def q_usage_rank_per_unit(t: Tables):
    """A3b with T6's per-unit option: one ranking per unit (kWh, m3, unit)."""
    return A.usage_between(t, RANGE_START, RANGE_END, per_unit=True)


@register("top_consumers", _CONSUMPTION_SQL.format(where=_IN_RANGE, part="1") + """
SELECT Rank, CustomerID, CustomerName || ' (' || Utility || ')' AS Label, TotalConsumption
FROM ranked ORDER BY Rank, CustomerID, Utility LIMIT 5
""")
def q_top_consumers(t: Tables):
    """O2: the five top consumers of 1998 with their chart labels."""
    return A.top_consumers(A.consumption_totals(t, TW.day_range("BillDate", RANGE_START, RANGE_END)))


# Payments are summed per bill and month, priced by the bill's utility with CASE sums.
_TRENDS_SQL = """
, per_bill AS (
  SELECT BillID, date_trunc('month', PaymentDate) AS first_day, SUM(PaymentAmount) AS paid
  FROM payment WHERE PaymentDate >= TIMESTAMP '2001-01-01 00:00:00' GROUP BY ALL
), kinds AS (
  SELECT BillID, UtilityID FROM bill JOIN meter USING (MeterID)
), trends AS (
  SELECT strftime(first_day, '%B %Y') AS Month,
         CAST(SUM(CASE UtilityID WHEN 'UTIL-01' THEN paid ELSE 0 END) AS DECIMAL(18,2)) AS Electricity,
         CAST(SUM(CASE UtilityID WHEN 'UTIL-02' THEN paid ELSE 0 END) AS DECIMAL(18,2)) AS Water,
         CAST(SUM(CASE UtilityID WHEN 'UTIL-03' THEN paid ELSE 0 END) AS DECIMAL(18,2)) AS Gas
  FROM per_bill JOIN kinds USING (BillID) GROUP BY first_day
)
"""


@register("revenue_trends", _TRENDS_SQL + """
SELECT Month, Electricity, Water, Gas, CAST(Electricity + Water + Gas AS DECIMAL(18,2)) AS TotalRevenue
FROM trends
""")
def q_revenue_trends(t: Tables):
    """A4 (flagship): monthly revenue per utility from 2001-01-01 on."""
    return A.revenue_trends(t, AS_OF)


@register("revenue_trend_totals", _TRENDS_SQL + """
SELECT CAST(COALESCE(SUM(Electricity), 0) AS DECIMAL(18,2)) AS Electricity,
       CAST(COALESCE(SUM(Water), 0) AS DECIMAL(18,2)) AS Water,
       CAST(COALESCE(SUM(Gas), 0) AS DECIMAL(18,2)) AS Gas,
       CAST(COALESCE(SUM(Electricity + Water + Gas), 0) AS DECIMAL(18,2)) AS TotalRevenue
FROM trends
""")
def q_revenue_trend_totals(t: Tables):
    """Column totals of the revenue trend rows."""
    return A.revenue_trend_totals(A.revenue_trends(t, AS_OF, ordered=False))


_PAY_RANGE = f"p.PaymentDate >= TIMESTAMP '{_R0} 00:00:00' AND p.PaymentDate < TIMESTAMP '{_R1_NEXT} 00:00:00'"


# Payments are summed per bill and day before the bill's utility is looked up.
@register("revenue_by_day", f"""
, per_bill AS (
  SELECT BillID, CAST(PaymentDate AS DATE) AS day, COUNT(*) AS n, SUM(PaymentAmount) AS paid
  FROM payment p WHERE {_PAY_RANGE} GROUP BY ALL
), named AS (
  SELECT MeterID, UtilityName FROM meter JOIN utility_type USING (UtilityID)
)
SELECT CAST(day AS VARCHAR) AS Date, UtilityName AS Utility, CAST(SUM(n) AS BIGINT) AS PaymentsReceived,
       CAST(SUM(paid) AS DECIMAL(18,2)) AS Total
FROM per_bill JOIN bill USING (BillID) JOIN named ON named.MeterID = bill.MeterID GROUP BY day, UtilityName
""")
def q_revenue_by_day(t: Tables):
    """A5: payments per day and utility in 1998."""
    return A.revenue_by_day(t, RANGE_START, RANGE_END)


@register("revenue_grand_total", f"""
SELECT CAST(SUM(p.PaymentAmount) AS DECIMAL(18,2)) AS GrandTotal FROM payment p WHERE {_PAY_RANGE}
""")
def q_revenue_grand_total(t: Tables):
    """Total of all 1998 payments (Payment alone)."""
    return A.revenue_grand_total(t, RANGE_START, RANGE_END)


@register("revenue_by_utility", """
SELECT CASE WHEN GROUPING(u.UtilityName) = 1 THEN 'Grand Total' ELSE u.UtilityName END AS UtilityName,
       COUNT(p.PaymentID) AS TotalPayments, CAST(SUM(p.PaymentAmount) AS DECIMAL(18,2)) AS TotalRevenue
FROM payment p JOIN bill b ON p.BillID = b.BillID
JOIN meter m ON b.MeterID = m.MeterID JOIN utility_type u ON m.UtilityID = u.UtilityID
GROUP BY ROLLUP (u.UtilityName)
""")
def q_revenue_by_utility(t: Tables):
    """Payments and revenue per utility with a Grand Total row."""
    return A.revenue_by_utility(t)


@register("revenue_summary_maintained", """
SELECT LAST_DAY(CAST(p.PaymentDate AS DATE)) AS Month, u.UtilityName, COUNT(p.PaymentID) AS Payments, CAST(SUM(p.PaymentAmount) AS DECIMAL(28,2)) AS Revenue
FROM payment p JOIN bill b ON b.BillID = p.BillID JOIN meter m ON m.MeterID = b.MeterID JOIN utility_type u ON u.UtilityID = m.UtilityID
WHERE b.CustomerID IS NULL OR b.CustomerID NOT IN (SELECT CustomerID FROM meter WHERE Status = 'Inactive' AND CustomerID IS NOT NULL)
GROUP BY ALL
""")
def q_revenue_summary_maintained(t: Tables):
    """A4-A6 kept up to date: payments up to a day, an append of the later ones, then the cascade over customers
    with an Inactive meter, each as one epoch of deltas; equals the full recompute over what is left."""
    path = f"{output_dir(t.spark)}/revenue-{uuid.uuid4().hex}"
    before = F.col("PaymentDate") < F.lit(RANGE_START)
    SM.log_delta(SM.revenue_delta(t, t.payment.where(before)), path, 0)
    SM.log_delta(SM.revenue_delta(t, t.payment.where(~F.coalesce(before, F.lit(False)))), path, 1)
    SM.log_delta(SM.customers_retracted(t, t.meter.where(F.col("Status") == "Inactive").select("CustomerID")), path, 2)
    return SM.revenue_summary(t.spark, path)


@register("tariff_bill_counts", """
SELECT t.TariffID, t.UtilityID, t.TariffName, COUNT(b.BillID) AS BillCount
FROM tariff t LEFT JOIN bill b ON b.TariffID = t.TariffID
GROUP BY t.TariffID, t.UtilityID, t.TariffName
""")
def q_tariff_bill_counts(t: Tables):
    """Bills per tariff, zero for unused tariffs."""
    return A.tariff_bill_counts(t)


@register("defaulter_bills", """
SELECT b.BillID, c.CustomerName, c.Phone, b.DueDate, CAST(b.AmountDue AS DECIMAL(18,2)) AS AmountDue, b.Status
FROM bill b JOIN cust c ON b.CustomerID = c.CustomerID
WHERE b.Status IN ('Unpaid', 'Overdue')
""")
def q_defaulter_bills(t: Tables):
    """Bill-level list of Unpaid/Overdue bills with customer contact."""
    return A.defaulter_bills(t)


# ------------------------------------------------------------- lookups and logs
@register("lookup_meters", """
SELECT k.MeterID, m.CustomerID, m.UtilityID, m.Status, m.Location, m.InstallDate,
       m.MeterID IS NOT NULL AS Found
FROM (SELECT DISTINCT MeterID FROM meter_reading WHERE MeterID IS NOT NULL) k
LEFT JOIN meter m ON k.MeterID = m.MeterID
""")
def q_lookup_meters(t: Tables):
    """Meter details for every meter that sent a reading (unknown meters: Found=false)."""
    return L.lookup(t.meter, t.meter_reading, "MeterID")


@register("lookup_customers", """
SELECT k.CustomerID, c.CustomerName, c.CustomerType, c.Email, c.Phone, c.ServiceAddress,
       c.BillingAddress, c.RegistrationDate, c.CustomerID IS NOT NULL AS Found
FROM (SELECT DISTINCT CustomerID FROM bill WHERE Status IN ('Unpaid', 'Overdue')) k
LEFT JOIN cust c ON k.CustomerID = c.CustomerID
""")
def q_lookup_customers(t: Tables):
    """Customer details for every customer with an open bill."""
    return L.lookup(t.customer, J.open_bills(t), "CustomerID")


@register("lookup_tariffs", """
SELECT k.TariffID, t.UtilityID, t.TariffName, t.Rate, t.MinUnits, t.MaxUnits, t.FixedCharge,
       t.TariffID IS NOT NULL AS Found
FROM (SELECT DISTINCT TariffID FROM bill WHERE TariffID IS NOT NULL) k
LEFT JOIN tariff t ON k.TariffID = t.TariffID
""")
def q_lookup_tariffs(t: Tables):
    """Tariff details for every tariff referenced by a bill."""
    return L.lookup(t.tariff, t.bill, "TariffID")


@register("report_new_customers", f"""
SELECT CustomerID, CustomerName, CustomerType, RegistrationDate, Email, Phone FROM cust
WHERE RegistrationDate >= DATE '{_R0}' AND RegistrationDate < DATE '{_R1_NEXT}'
""")
def q_report_new_customers(t: Tables):
    """Customers registered in 1998, newest first."""
    return L.new_customers(t, RANGE_START, RANGE_END)


@register("report_readings_log", """
SELECT ReadingID, MeterID, ReadingValue, ReadingDate, UserID FROM meter_reading
WHERE ReadingDate >= DATE '2024-01-10' AND ReadingDate < DATE '2024-01-21'
""")
def q_report_readings_log(t: Tables):
    """Readings dated 2024-01-10..2024-01-20, newest first."""
    return L.readings_log(t, "2024-01-10", "2024-01-20")


@register("report_payment_log", f"""
SELECT p.PaymentID, p.BillID, p.PaymentAmount, p.PaymentDate, p.PaymentMethod, p.UserID
FROM payment p WHERE {_PAY_RANGE}
""")
def q_report_payment_log(t: Tables):
    """Payments made in 1998, newest first."""
    return L.payment_log(t, RANGE_START, RANGE_END)


# ---------------------------------------------------------------- display
@register("meter_display", """
SELECT m.MeterID, m.CustomerID, u.UtilityName, m.Status,
       regexp_replace(lower(m.Status), ' ', '-') AS StatusSlug,
       COALESCE(NULLIF(m.Location, ''), c.ServiceAddress) AS DisplayLocation
FROM meter m JOIN cust c ON m.CustomerID = c.CustomerID
JOIN utility_type u ON m.UtilityID = u.UtilityID
""")
def q_meter_display(t: Tables):
    """Meter list with status slug and location fallback."""
    inv = J.meter_inventory(t)
    return inv.select("MeterID", "CustomerID", "UtilityName", "Status",
                      D.status_slug("Status").alias("StatusSlug"),
                      D.fallback("Location", "ServiceAddress").alias("DisplayLocation"))


@register("customer_display", """
SELECT CustomerID, CustomerName, CustomerType, COALESCE(NULLIF(Email, ''), 'N/A') AS EmailText,
       Phone, ServiceAddress
FROM cust
""")
def q_customer_display(t: Tables):
    """Customer list with the e-mail fallback text."""
    return t.customer.select("CustomerID", "CustomerName", "CustomerType",
                             D.or_text("Email", "N/A").alias("EmailText"), "Phone", "ServiceAddress")


@register("ledger_display", """
SELECT b.BillID, b.CustomerID, b.BillDate, 'Rs. ' || CAST(CAST(b.AmountDue AS DECIMAL(20,2)) AS VARCHAR) AS AmountText,
       lower(b.Status) AS StatusSlug, COALESCE(strftime(p.PaymentDate, '%Y-%m-%d'), '---') AS PaidOn
FROM bill b LEFT JOIN payment p ON b.BillID = p.BillID
""")
def q_ledger_display(t: Tables):
    """Ledger with amount text, status slug and '---' for unpaid bills."""
    led = J.billing_ledger(t, ordered=False)
    return led.select("BillID", "CustomerID", "BillDate", FM.rupees("AmountDue").alias("AmountText"),
                      F.lower("Status").alias("StatusSlug"),
                      D.or_text(FM.day_label("PaymentDate"), "---").alias("PaidOn"))


@register("tariff_display", """
SELECT t.TariffID, t.UtilityID, t.TariffName, 'Rs. ' || CAST(t.Rate AS VARCHAR) AS RateText,
       CAST(t.MinUnits AS VARCHAR) || ' - ' ||
         CASE WHEN t.MaxUnits IS NULL OR t.MaxUnits = 0 THEN 'Above' ELSE CAST(t.MaxUnits AS VARCHAR) END AS SlabLabel,
       COUNT(b.BillID) AS BillCount
FROM tariff t LEFT JOIN bill b ON b.TariffID = t.TariffID
GROUP BY t.TariffID, t.UtilityID, t.TariffName, t.Rate, t.MinUnits, t.MaxUnits
""")
def q_tariff_display(t: Tables):
    """Tariff catalogue rows ("Rs. 30.00", "0 - 60" / "120 - Above") with their bill counts."""
    counts = A.tariff_bill_counts(t).select("TariffID", "BillCount")
    return t.tariff.join(counts, "TariffID").select(
        "TariffID", "UtilityID", "TariffName", FM.rupees("Rate").alias("RateText"),
        D.slab_label("MinUnits", "MaxUnits").alias("SlabLabel"), "BillCount")


# ------------------------------------------------------------- rating and billing
# A reading's previous value: the reading numbered one less on the same meter (0 where there is none,
# NULL where that reading has no value).
_STEPS = """
, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY MeterID ORDER BY ReadingDate, ReadingID) AS k FROM meter_reading
), steps AS (
  SELECT now.ReadingID, now.MeterID, now.ReadingDate, now.ReadingValue,
         CAST(CASE WHEN now.k = 1 THEN 0 ELSE before.ReadingValue END AS DECIMAL(10,2)) AS PreviousReadingValue
  FROM numbered now LEFT JOIN numbered before ON before.MeterID = now.MeterID AND before.k = now.k - 1
)
"""
_RC = _STEPS + """
, rc AS (
  SELECT ReadingID, s.MeterID, CustomerID, UtilityID, ReadingDate, ReadingValue AS CurrentReadingValue,
         PreviousReadingValue, CAST(ReadingValue - PreviousReadingValue AS DECIMAL(12,2)) AS Consumption,
         ReadingValue < PreviousReadingValue AS IsNegative
  FROM steps s LEFT JOIN meter ON meter.MeterID = s.MeterID
), base AS (
  SELECT UtilityID, TariffID AS BaseTariffID, Rate AS BaseRate FROM (
    SELECT *, row_number() OVER (PARTITION BY UtilityID ORDER BY MinUnits NULLS FIRST, TariffID) AS rn
    FROM tariff) x WHERE rn = 1
), flat AS (
  SELECT rc.*, b.BaseTariffID, CAST(rc.Consumption * b.BaseRate AS DECIMAL(12,2)) AS FlatAmount
  FROM rc LEFT JOIN base b ON rc.UtilityID = b.UtilityID
), slab AS (
  SELECT rc.ReadingID,
         CAST(SUM(COALESCE(t.Rate * CASE WHEN t.MaxUnits IS NULL THEN GREATEST(rc.Consumption - t.MinUnits, 0)
                  ELSE LEAST(GREATEST(rc.Consumption - t.MinUnits, 0), t.MaxUnits - t.MinUnits) END, 0))
              + SUM(COALESCE(t.FixedCharge, 0)) AS DECIMAL(12,2)) AS SlabAmount
  FROM rc JOIN tariff t ON t.UtilityID = rc.UtilityID
  WHERE rc.UtilityID = 'UTIL-01'
  GROUP BY rc.ReadingID
), rated AS (
  SELECT f.*, CASE WHEN f.UtilityID = 'UTIL-01' THEN s.SlabAmount ELSE f.FlatAmount END AS CalculatedAmountDue
  FROM flat f LEFT JOIN slab s ON f.ReadingID = s.ReadingID
)
"""


@register("reading_deltas", _STEPS + "SELECT * FROM steps")
def q_reading_deltas(t: Tables):
    """Previous reading value of every reading (LAG with default 0)."""
    return RT.reading_deltas(t.meter_reading)


@register("reading_consumption", _RC + """
SELECT ReadingID, MeterID, CustomerID, UtilityID, ReadingDate, CurrentReadingValue,
       PreviousReadingValue, Consumption, IsNegative FROM rc
""")
def q_reading_consumption(t: Tables):
    """B1: current/previous value, consumption and owner of every reading."""
    return RT.reading_consumption(t)


@register("flat_rating", _RC + """
SELECT ReadingID, MeterID, CustomerID, UtilityID, Consumption, BaseTariffID, FlatAmount FROM flat
""")
def q_flat_rating(t: Tables):
    """B2: base-rate amount of every reading."""
    return RT.flat_rating(t)


@register("slab_rating", _RC + """
SELECT rc.ReadingID, rc.MeterID, rc.CustomerID, rc.Consumption, s.SlabAmount
FROM rc JOIN slab s ON rc.ReadingID = s.ReadingID
""")
def q_slab_rating(t: Tables):
    """Block-tariff amount of every electricity reading."""
    return RT.slab_rating(t)


_BILLS_SQL = _RC + """
SELECT 'BILL-R' || CAST(r.ReadingID AS VARCHAR) AS BillID, r.CustomerID, r.MeterID, r.ReadingID,
       r.BaseTariffID AS TariffID, DATE '{bd}' AS BillDate, CAST(DATE '{bd}' + INTERVAL 14 DAY AS DATE) AS DueDate,
       CAST(r.PreviousReadingValue AS DECIMAL(10,2)) AS PreviousReadingValue,
       CAST(r.CurrentReadingValue AS DECIMAL(10,2)) AS CurrentReadingValue,
       CAST(r.Consumption AS DECIMAL(10,2)) AS Consumption,
       CAST(r.CalculatedAmountDue AS DECIMAL(10,2)) AS AmountDue, 'Unpaid' AS Status
FROM rated r JOIN meter m ON r.MeterID = m.MeterID
WHERE r.ReadingID NOT IN (SELECT ReadingID FROM bill) {extra}
"""


@register("billing_run", _BILLS_SQL.format(bd="2024-02-01", extra=""))
def q_billing_run(t: Tables):
    """Bills for all unbilled readings, dated 2024-02-01."""
    return B.billing_run(t, "2024-02-01")


@register("billing_run_month", _BILLS_SQL.format(
    bd="2024-01-01", extra="AND r.ReadingDate >= DATE '2024-01-01' AND r.ReadingDate < DATE '2024-02-01'"))
def q_billing_run_month(t: Tables):
    """First-of-month billing for January 2024 readings."""
    return B.billing_run_month(t, READ_AS_OF)


# Number of an entity's row, taken from its id, and the batches with faulty rows that the write paths get.
@register("billing_run_due", _BILLS_SQL.replace("CAST(DATE '{bd}' + INTERVAL 14 DAY AS DATE) AS DueDate", "DATE '2024-03-31' AS DueDate").format(
    bd="2024-02-01", extra=""))
def q_billing_run_due(t: Tables):
    """Bills for all unbilled readings with a due date that the cashier gives."""
    return B.billing_run(t, "2024-02-01", due_date="2024-03-31")


@register("billing_run_customers", _BILLS_SQL.format(
    bd="2024-01-01", extra="AND r.ReadingDate >= DATE '2024-01-01' AND r.ReadingDate < DATE '2024-02-01' "
                           "AND m.CustomerID IN (SELECT CustomerID FROM cust WHERE CustomerType = 'Business')"))
def q_billing_run_customers(t: Tables):
    """First-of-month billing for January 2024 of the business customers."""
    return B.billing_run_month(t, READ_AS_OF, customers=t.customer.where(F.col("CustomerType") == "Business"))


def _num(c: str):
    return F.substring_index(F.col(c), "-", -1).cast("bigint")


_STORED_UNTIL = "1997-01-01"
_POST_SQL = f"""
, old AS (SELECT * FROM payment WHERE PaymentDate < TIMESTAMP '{_STORED_UNTIL} 00:00:00'),
sent AS (SELECT *, CAST(split_part(BillID, '-', 2) AS BIGINT) % 50 AS k FROM payment
         WHERE PaymentDate >= TIMESTAMP '{_STORED_UNTIL} 00:00:00'),
rows0 AS (
  SELECT CASE WHEN k = 4 THEN NULL ELSE PaymentID END AS PaymentID, CASE WHEN k = 3 THEN 'BILL-none' ELSE BillID END AS BillID,
         UserID, CASE WHEN k = 2 THEN 0 ELSE PaymentAmount END AS PaymentAmount,
         CASE WHEN k = 1 THEN 'Barter' ELSE PaymentMethod END AS PaymentMethod FROM sent
  UNION ALL SELECT PaymentID, BillID, UserID, PaymentAmount, PaymentMethod FROM sent WHERE k = 7
  UNION ALL SELECT PaymentID, BillID, UserID, PaymentAmount, PaymentMethod FROM old
            WHERE CAST(split_part(BillID, '-', 2) AS BIGINT) % 50 = 6
), rows1 AS (
  SELECT PaymentID, BillID, UserID, PaymentAmount, PaymentMethod FROM rows0 WHERE PaymentID IS NOT NULL
  UNION ALL
  SELECT 'PAY-20010715T090000-' || CAST(row_number() OVER (ORDER BY BillID NULLS FIRST, UserID NULLS FIRST,
           PaymentAmount NULLS FIRST, PaymentMethod NULLS FIRST) AS VARCHAR), BillID, UserID, PaymentAmount, PaymentMethod
  FROM rows0 WHERE PaymentID IS NULL
), judged AS (
  SELECT *, CASE WHEN NULLIF(BillID, '') IS NULL THEN 'missing BillID'
      WHEN PaymentAmount IS NULL OR PaymentAmount = 0 THEN 'missing PaymentAmount'
      WHEN NULLIF(PaymentMethod, '') IS NULL THEN 'missing PaymentMethod'
      WHEN PaymentMethod NOT IN ('Cash', 'Card', 'Online') THEN 'bad PaymentMethod'
      WHEN BillID NOT IN (SELECT BillID FROM bill) THEN 'unknown bill'
      WHEN PaymentID IN (SELECT PaymentID FROM old) THEN 'duplicate PaymentID'
      WHEN COUNT(*) OVER (PARTITION BY PaymentID) > 1 THEN 'repeated PaymentID' END AS Reason FROM rows1
), news AS (SELECT BillID, SUM(PaymentAmount) AS paid FROM judged WHERE Reason IS NULL GROUP BY BillID
), olds AS (SELECT BillID, SUM(PaymentAmount) AS paid FROM old GROUP BY BillID
), due AS (
  SELECT b.BillID, b.AmountDue, CAST(n.paid + COALESCE(o.paid, 0) AS DECIMAL(18,2)) AS PaidTotal, b.Status
  FROM bill b JOIN news n ON n.BillID = b.BillID LEFT JOIN olds o ON o.BillID = b.BillID
)
"""


def _posting(t: Tables):
    """A posting onto the payments before 1997: all later ones as a batch, with faulty rows of every kind."""
    cut = F.col("PaymentDate") < F.lit(_STORED_UNTIL).cast("timestamp_ntz")
    old, k = t.payment.where(cut), _num("BillID") % 50
    cols = ["PaymentID", "BillID", "UserID", "PaymentAmount", "PaymentMethod"]
    sent = t.payment.where(~cut)
    rows = sent.select(
        F.when(k != 4, F.col("PaymentID")).alias("PaymentID"), F.when(k == 3, "BILL-none").otherwise(F.col("BillID")).alias("BillID"),
        "UserID", F.when(k == 2, 0).otherwise(F.col("PaymentAmount")).cast("decimal(10,2)").alias("PaymentAmount"),
        F.when(k == 1, "Barter").otherwise(F.col("PaymentMethod")).alias("PaymentMethod"))
    batch = rows.unionByName(sent.where(k == 7).select(*cols)).unionByName(old.where(k == 6).select(*cols))
    return B.post_payments(t.replace(payment=old), batch, AS_OF)


@register("post_payments", _POST_SQL + """
SELECT BillID, AmountDue, PaidTotal, CASE WHEN PaidTotal >= AmountDue THEN 'Paid' ELSE Status END AS Status FROM due
""")
def q_post_payments(t: Tables):
    """The bills that a batch (with refused rows) touches, on top of what they had received."""
    return _posting(t).settled


@register("post_payments_refused", _POST_SQL + """
SELECT PaymentID, BillID, UserID, CAST(PaymentAmount AS DECIMAL(10,2)) AS PaymentAmount, PaymentMethod, Reason FROM judged WHERE Reason IS NOT NULL
""")
def q_post_payments_refused(t: Tables):
    """The refused rows of the same batch; every reason occurs."""
    return _posting(t).rejected


@register("post_payments_log", _POST_SQL + """
SELECT PaymentID, BillID, UserID, PaymentAmount, PaymentDate, PaymentMethod FROM old
UNION ALL
SELECT PaymentID, BillID, UserID, CAST(PaymentAmount AS DECIMAL(10,2)), TIMESTAMP '2001-07-15 09:00:00', PaymentMethod
FROM judged WHERE Reason IS NULL
""")
def q_post_payments_log(t: Tables):
    """The payment snapshot after the posting: stored and accepted rows."""
    return _posting(t).payments


@register("post_payments_bills", _POST_SQL + """
SELECT b.BillID, b.AmountDue, CASE WHEN d.PaidTotal >= b.AmountDue THEN 'Paid' ELSE b.Status END AS Status
FROM bill b LEFT JOIN due d ON d.BillID = b.BillID
""")
def q_post_payments_bills(t: Tables):
    """The bill snapshot after the posting."""
    return _posting(t).bills.select("BillID", "AmountDue", "Status")


@register("reading_details", _RC + """
, asked AS (SELECT DISTINCT ReadingID FROM bill WHERE ReadingID IS NOT NULL
            UNION SELECT -ReadingID FROM meter_reading WHERE ReadingID % 100 = 1)
SELECT a.ReadingID, r.ReadingID IS NOT NULL AS Found, r.MeterID, r.CustomerID, c.CustomerName, r.UtilityID, r.ReadingDate,
       r.CurrentReadingValue, r.PreviousReadingValue, r.Consumption, r.BaseTariffID, r.CalculatedAmountDue
FROM asked a LEFT JOIN rated r ON r.ReadingID = a.ReadingID LEFT JOIN cust c ON c.CustomerID = r.CustomerID
""")
def q_reading_details(t: Tables):
    """Values, owner and rated amount of every reading that a bill names, and of unknown ids."""
    unknown = t.meter_reading.where(F.col("ReadingID") % 100 == 1).select((-F.col("ReadingID")).alias("ReadingID"))
    return RT.reading_details(t, t.bill.select("ReadingID").unionByName(unknown))


@register("double_billed", """
SELECT ReadingID, COUNT(*) AS BillCount FROM bill WHERE ReadingID IS NOT NULL
GROUP BY ReadingID HAVING COUNT(*) > 1
""")
def q_double_billed(t: Tables):
    """Readings that appear on more than one bill."""
    return B.double_billed(t.bill)


@register("double_billed_reissued", """
, every AS (SELECT ReadingID FROM bill UNION ALL SELECT ReadingID FROM bill WHERE Status IN ('Overdue', 'Unpaid')
            UNION ALL SELECT ReadingID FROM bill WHERE Status = 'Overdue')
SELECT ReadingID, COUNT(*) AS BillCount FROM every WHERE ReadingID IS NOT NULL GROUP BY ReadingID HAVING COUNT(*) > 1
""")
def q_double_billed_reissued(t: Tables):
    """B6 on a bill table in which every open bill was issued again, overdue ones twice: the readings found."""
    again = t.bill.where(F.col("Status").isin("Overdue", "Unpaid"))
    return B.double_billed(t.bill.unionByName(again).unionByName(again.where(F.col("Status") == "Overdue")))


# ------------------------------------------------------- validation and appends
_READING_OUTCOME = """CASE
    WHEN NULLIF(b.MeterID, '') IS NULL THEN 'missing MeterID'
    WHEN b.ReadingValue IS NULL THEN 'missing ReadingValue'
    WHEN b.ReadingDate IS NULL THEN 'missing ReadingDate'
    WHEN NULLIF(b.UserID, '') IS NULL THEN 'missing UserID'
    WHEN b.MeterID NOT IN (SELECT MeterID FROM meter) THEN 'unknown MeterID'
    ELSE 'accepted' END"""
_READING_IDS = """
SELECT CAST({after} + row_number() OVER (ORDER BY MeterID NULLS FIRST, ReadingDate NULLS FIRST, ReadingValue NULLS FIRST,
                                         UserID NULLS FIRST, Notes NULLS FIRST) AS BIGINT) AS ReadingID,
       MeterID, UserID, ReadingValue, ReadingDate, Notes, Outcome
FROM chk WHERE Outcome = 'accepted'
UNION ALL
SELECT CAST(NULL AS BIGINT), MeterID, UserID, ReadingValue, ReadingDate, Notes, Outcome
FROM chk WHERE Outcome <> 'accepted'
"""


_READINGS_SQL = f"""
, b AS (
  SELECT CASE ReadingID % 50 WHEN 1 THEN 'MTR-none' WHEN 2 THEN '' ELSE MeterID END AS MeterID,
         CASE ReadingID % 50 WHEN 3 THEN NULL ELSE UserID END AS UserID,
         CASE ReadingID % 50 WHEN 4 THEN NULL ELSE ReadingValue END AS ReadingValue,
         CASE ReadingID % 50 WHEN 5 THEN NULL ELSE ReadingDate END AS ReadingDate, Notes FROM meter_reading
  UNION ALL SELECT MeterID, UserID, ReadingValue, ReadingDate, Notes FROM meter_reading WHERE ReadingID % 10 = 6
), chk AS (SELECT b.*, {_READING_OUTCOME} AS Outcome FROM b)
"""


def _submissions(t: Tables):
    """The whole reading log as one batch with faulty rows of every kind and some readings sent twice."""
    r, k = t.meter_reading, F.col("ReadingID") % 50
    rows = r.select(
        F.when(k == 1, "MTR-none").when(k == 2, "").otherwise(F.col("MeterID")).alias("MeterID"),
        F.when(k != 3, F.col("UserID")).alias("UserID"), F.when(k != 4, F.col("ReadingValue")).alias("ReadingValue"),
        F.when(k != 5, F.col("ReadingDate")).alias("ReadingDate"), "Notes")
    return rows.unionByName(r.where(F.col("ReadingID") % 10 == 6).drop("ReadingID"))


@register("append_readings", _READINGS_SQL + _READING_IDS.format(after=1000000))
def q_append_readings(t: Tables):
    """That batch, of which readings sent twice are both kept; ids continue after 1,000,000."""
    return M.append_readings(_submissions(t), t.meter, 1000000)


_CUSTOMER_SQL = """
, sent AS (SELECT *, CAST(split_part(CustomerID, '-', 2) AS BIGINT) % 50 AS k FROM cust),
rows0 AS (
  SELECT CASE WHEN k IN (5, 6) THEN NULL ELSE CustomerID END AS CustomerID, CASE WHEN k = 1 THEN '' ELSE CustomerName END AS CustomerName,
         CASE WHEN k = 2 THEN 'Alien' WHEN k = 3 THEN NULL ELSE CustomerType END AS CustomerType, Email,
         CASE WHEN k = 4 THEN NULL ELSE Phone END AS Phone, CASE WHEN k = 8 THEN '' ELSE ServiceAddress END AS ServiceAddress,
         BillingAddress, RegistrationDate FROM sent
  UNION ALL SELECT CASE WHEN k = 6 THEN NULL ELSE CustomerID END, CustomerName, CustomerType, Email, Phone, ServiceAddress,
         BillingAddress, RegistrationDate FROM sent WHERE k IN (6, 7)
), c AS (
  SELECT COALESCE(CustomerID, 'CUST-X' || substr(sha256(concat_ws(chr(31), COALESCE(CustomerName, ''), COALESCE(CustomerType, ''),
           COALESCE(Email, ''), COALESCE(Phone, ''), COALESCE(ServiceAddress, ''), COALESCE(BillingAddress, ''))), 1, 20)) AS CustomerID,
         CustomerName, CustomerType, Email, Phone, ServiceAddress, BillingAddress, RegistrationDate FROM rows0
), chk AS (
  SELECT c.*, CASE
    WHEN NULLIF(CustomerName, '') IS NULL THEN 'missing CustomerName'
    WHEN NULLIF(CustomerType, '') IS NULL THEN 'missing CustomerType'
    WHEN NULLIF(Phone, '') IS NULL THEN 'missing Phone'
    WHEN NULLIF(ServiceAddress, '') IS NULL THEN 'missing ServiceAddress'
    WHEN CustomerType NOT IN ('Household', 'Business', 'Government') THEN 'bad CustomerType'
    WHEN CustomerID IN (SELECT CustomerID FROM cust WHERE RegistrationDate < DATE '1998-01-01') THEN 'duplicate CustomerID'
    WHEN COUNT(*) OVER (PARTITION BY CustomerID) > 1 THEN 'repeated CustomerID'
    ELSE 'accepted' END AS Outcome FROM c
)
"""


def _sign_ups(t: Tables):
    """All customers as a sign-up batch with faulty rows of every kind, some without an id, some sent
    twice; and those registered before 1998, who are stored already."""
    stored = t.customer.where(F.col("RegistrationDate") < F.lit(RANGE_START))
    c, k = t.customer, _num("CustomerID") % 50
    rows = c.select(
        F.when(~k.isin(5, 6), F.col("CustomerID")).alias("CustomerID"), F.when(k == 1, "").otherwise(F.col("CustomerName")).alias("CustomerName"),
        F.when(k == 2, "Alien").when(k != 3, F.col("CustomerType")).alias("CustomerType"), "Email",
        F.when(k != 4, F.col("Phone")).alias("Phone"), F.when(k == 8, "").otherwise(F.col("ServiceAddress")).alias("ServiceAddress"),
        "BillingAddress", "RegistrationDate")
    again = c.where(k.isin(6, 7)).withColumn("CustomerID", F.when(k != 6, F.col("CustomerID")))
    return stored, rows.unionByName(again)


@register("append_customers", _CUSTOMER_SQL + "SELECT * FROM chk")
def q_append_customers(t: Tables):
    """A sign-up batch onto the customers registered before 1998; every outcome occurs."""
    stored, batch = _sign_ups(t)
    return M.append_customers(stored, batch, AS_OF)


@register("append_customers_snapshot", _CUSTOMER_SQL + """
SELECT * FROM cust WHERE RegistrationDate < DATE '1998-01-01'
UNION ALL SELECT * EXCLUDE (Outcome) FROM chk WHERE Outcome = 'accepted'
""")
def q_append_customers_snapshot(t: Tables):
    """The customer table after that batch."""
    stored, batch = _sign_ups(t)
    return M.appended(stored, M.append_customers(stored, batch, AS_OF)).snapshot


_METER_SQL = """
, sent AS (SELECT *, CAST(split_part(MeterID, '-', 2) AS BIGINT) % 50 AS k FROM meter),
m AS (
  SELECT CASE WHEN k = 4 THEN NULL ELSE MeterID END AS MeterID, CASE k WHEN 2 THEN 'CUST-none' WHEN 6 THEN '' ELSE CustomerID END AS CustomerID,
         CASE k WHEN 11 THEN 'UTIL-09' WHEN 8 THEN NULL ELSE UtilityID END AS UtilityID,
         CASE k WHEN 3 THEN 'Broken' WHEN 9 THEN '' ELSE Status END AS Status, Location, InstallDate FROM sent
  UNION ALL SELECT MeterID, CustomerID, UtilityID, Status, Location, InstallDate FROM sent WHERE k IN (10, 21)
), chk AS (
SELECT m.*, CASE
    WHEN NULLIF(m.CustomerID, '') IS NULL THEN 'missing CustomerID'
    WHEN NULLIF(m.MeterID, '') IS NULL THEN 'missing MeterID'
    WHEN NULLIF(m.UtilityID, '') IS NULL THEN 'missing UtilityID'
    WHEN NULLIF(m.Status, '') IS NULL THEN 'missing Status'
    WHEN m.Status NOT IN ('Active', 'Pending Install', 'Inactive') THEN 'bad Status'
    WHEN m.MeterID IN (SELECT MeterID FROM meter WHERE Status = 'Inactive') THEN 'duplicate MeterID'
    WHEN COUNT(*) OVER (PARTITION BY MeterID) > 1 THEN 'repeated MeterID'
    WHEN m.CustomerID NOT IN (SELECT CustomerID FROM cust) THEN 'unknown CustomerID'
    WHEN m.UtilityID NOT IN (SELECT UtilityID FROM utility_type) THEN 'unknown UtilityID'
    ELSE 'accepted' END AS Outcome
FROM m)
"""


def _installations(t: Tables):
    """All meters as an installation batch with faulty rows of every kind, some sent twice; and the
    Inactive ones, which are stored already."""
    stored, m, k = t.meter.where(F.col("Status") == "Inactive"), t.meter, _num("MeterID") % 50
    rows = m.select(
        F.when(k != 4, F.col("MeterID")).alias("MeterID"),
        F.when(k == 2, "CUST-none").when(k == 6, "").otherwise(F.col("CustomerID")).alias("CustomerID"),
        F.when(k == 11, "UTIL-09").when(k != 8, F.col("UtilityID")).alias("UtilityID"),
        F.when(k == 3, "Broken").when(k == 9, "").otherwise(F.col("Status")).alias("Status"), "Location", "InstallDate")
    return stored, rows.unionByName(m.where(k.isin(10, 21)))


@register("append_meters", _METER_SQL + "SELECT * FROM chk")
def q_append_meters(t: Tables):
    """An installation batch onto the Inactive meters already stored; every outcome occurs."""
    stored, batch = _installations(t)
    return M.append_meters(stored, batch, t.customer, t.utility_type, AS_OF)


def _rule(entity: str, table: str, rule: str, pred: str) -> str:
    return (f"SELECT '{entity}' AS Entity, '{rule}' AS Rule, "
            f"CAST(COALESCE(SUM(CASE WHEN {pred} THEN 1 ELSE 0 END), 0) AS BIGINT) AS Violations FROM {table}")


_CHECKS_SQL = "\nUNION ALL\n".join([
    _rule("Customer", "cust", "missing CustomerName", "NULLIF(CustomerName, '') IS NULL"),
    _rule("Customer", "cust", "missing CustomerType", "NULLIF(CustomerType, '') IS NULL"),
    _rule("Customer", "cust", "missing Phone", "NULLIF(Phone, '') IS NULL"),
    _rule("Customer", "cust", "missing ServiceAddress", "NULLIF(ServiceAddress, '') IS NULL"),
    _rule("Customer", "cust", "bad CustomerType",
          "CustomerType IS NOT NULL AND CustomerType NOT IN ('Household', 'Business', 'Government')"),
    _rule("Meter", "meter", "missing CustomerID", "NULLIF(CustomerID, '') IS NULL"),
    _rule("Meter", "meter", "missing MeterID", "NULLIF(MeterID, '') IS NULL"),
    _rule("Meter", "meter", "missing UtilityID", "NULLIF(UtilityID, '') IS NULL"),
    _rule("Meter", "meter", "missing Status", "NULLIF(Status, '') IS NULL"),
    _rule("Meter", "meter", "bad Status",
          "Status IS NOT NULL AND Status NOT IN ('Active', 'Pending Install', 'Inactive')"),
    _rule("Meter_Reading", "meter_reading", "missing MeterID", "NULLIF(MeterID, '') IS NULL"),
    _rule("Meter_Reading", "meter_reading", "missing ReadingValue", "ReadingValue IS NULL"),
    _rule("Meter_Reading", "meter_reading", "missing ReadingDate", "ReadingDate IS NULL"),
    _rule("Meter_Reading", "meter_reading", "missing UserID", "NULLIF(UserID, '') IS NULL"),
    _rule("Bill", "bill", "bad Status", "Status IS NOT NULL AND Status NOT IN ('Unpaid', 'Overdue', 'Paid')"),
    _rule("Payment", "payment", "missing BillID", "NULLIF(BillID, '') IS NULL"),
    _rule("Payment", "payment", "missing PaymentAmount", "PaymentAmount IS NULL OR PaymentAmount = 0"),
    _rule("Payment", "payment", "missing PaymentMethod", "NULLIF(PaymentMethod, '') IS NULL"),
    _rule("Payment", "payment", "bad PaymentMethod",
          "PaymentMethod IS NOT NULL AND PaymentMethod NOT IN ('Cash', 'Card', 'Online')"),
])


@register("check_domains", _CHECKS_SQL)
def q_check_domains(t: Tables):
    """Rows breaking each required-field or value-domain rule, per entity."""
    parts = [V.rule_counts("Customer", t.customer, V.customer_rules()),
             V.rule_counts("Meter", t.meter, V.meter_rules()),
             V.rule_counts("Meter_Reading", t.meter_reading, V.reading_rules()),
             V.rule_counts("Bill", t.bill, V.bill_rules()),
             V.rule_counts("Payment", t.payment, V.payment_rules())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _validation_sql(table: str, key: str, rules: list[tuple[str, str]]) -> str:
    first = "CASE " + " ".join(f"WHEN {pred} THEN '{name}'" for name, pred in rules) + " END"
    count = " + ".join(f"(CASE WHEN {pred} THEN 1 ELSE 0 END)" for _, pred in rules)
    return (f"SELECT {key}, ({count}) = 0 AS Valid, {first} AS FirstError, "
            f"CAST({count} AS INTEGER) AS ErrorCount FROM {table}")


_READING_SQL_RULES = [("missing MeterID", "NULLIF(MeterID, '') IS NULL"),
                      ("missing ReadingValue", "ReadingValue IS NULL"),
                      ("missing ReadingDate", "ReadingDate IS NULL"),
                      ("missing UserID", "NULLIF(UserID, '') IS NULL")]
_PAYMENT_SQL_RULES = [("missing BillID", "NULLIF(BillID, '') IS NULL"),
                      ("missing PaymentAmount", "PaymentAmount IS NULL OR PaymentAmount = 0"),
                      ("missing PaymentMethod", "NULLIF(PaymentMethod, '') IS NULL"),
                      ("bad PaymentMethod",
                       "PaymentMethod IS NOT NULL AND PaymentMethod NOT IN ('Cash', 'Card', 'Online')")]
_METER_SQL_RULES = [("missing CustomerID", "NULLIF(CustomerID, '') IS NULL"),
                    ("missing MeterID", "NULLIF(MeterID, '') IS NULL"),
                    ("missing UtilityID", "NULLIF(UtilityID, '') IS NULL"),
                    ("missing Status", "NULLIF(Status, '') IS NULL"),
                    ("bad Status", "Status IS NOT NULL AND Status NOT IN ('Active', 'Pending Install', 'Inactive')")]


@register("validate_readings", _validation_sql("meter_reading", "ReadingID", _READING_SQL_RULES))
def q_validate_readings(t: Tables):
    """Required-field check of every reading."""
    return V.validation_report(t.meter_reading, "ReadingID", V.reading_rules())


@register("validate_payments", _validation_sql("payment", "PaymentID", _PAYMENT_SQL_RULES))
def q_validate_payments(t: Tables):
    """Required fields and method domain of every payment."""
    return V.validation_report(t.payment, "PaymentID", V.payment_rules())


@register("validate_meters", _validation_sql("meter", "MeterID", _METER_SQL_RULES))
def q_validate_meters(t: Tables):
    """Required fields and status domain of every meter."""
    return V.validation_report(t.meter, "MeterID", V.meter_rules())


# ----------------------------------------------------------------- maintenance
@register("update_meters", """
, upd AS (SELECT DISTINCT MeterID FROM meter_reading),
err AS (SELECT DISTINCT MeterID FROM meter_reading WHERE Notes = 'error')
SELECT m.MeterID, m.CustomerID, m.UtilityID,
       CASE WHEN e.MeterID IS NOT NULL THEN 'Inactive' WHEN u.MeterID IS NOT NULL THEN 'Active'
            ELSE m.Status END AS Status,
       m.Location, m.InstallDate, u.MeterID IS NOT NULL AS Updated
FROM meter m LEFT JOIN upd u ON m.MeterID = u.MeterID LEFT JOIN err e ON m.MeterID = e.MeterID
""")
def q_update_meters(t: Tables):
    """M1: meters that sent readings become Active (seq 1); a meter that reported an
    error is set Inactive by a later update (seq 2), which wins."""
    listed = ["CustomerID", "UtilityID", "Status", "Location"]
    m = t.meter.select("MeterID", "CustomerID", "UtilityID", "Location")
    read = t.meter_reading.select("MeterID").distinct()
    err = t.meter_reading.where(F.col("Notes") == "error").select("MeterID").distinct()
    u1 = m.join(read, "MeterID", "left_semi").withColumn("Status", F.lit("Active")).withColumn("seq", F.lit(1))
    u2 = m.join(err, "MeterID", "left_semi").withColumn("Status", F.lit("Inactive")).withColumn("seq", F.lit(2))
    return M.apply_updates(t.meter, u1.unionByName(u2), "MeterID", listed)


@register("update_customers", """
SELECT CustomerID, CustomerName, CustomerType, Email, Phone, ServiceAddress,
       COALESCE(BillingAddress, ServiceAddress) AS BillingAddress, RegistrationDate,
       BillingAddress IS NULL AS Updated
FROM cust
""")
def q_update_customers(t: Tables):
    """M1: customers without a billing address get their service address as one."""
    listed = ["CustomerName", "CustomerType", "Email", "Phone", "ServiceAddress", "BillingAddress"]
    upd = (t.customer.where(F.col("BillingAddress").isNull())
           .withColumn("BillingAddress", F.col("ServiceAddress")).withColumn("seq", F.lit(1)))
    return M.apply_updates(t.customer, upd, "CustomerID", listed)


def _audit_sql(entity: str, table: str, gone: str) -> str:
    return (f"SELECT '{entity}' AS Entity, COUNT(*) FILTER (WHERE {gone}) AS Deleted, "
            f"COUNT(*) - COUNT(*) FILTER (WHERE {gone}) AS Remaining FROM {table}")


@register("delete_customers", """
, k AS (SELECT DISTINCT CustomerID FROM meter WHERE Status = 'Inactive'),
bg AS (SELECT BillID FROM bill WHERE CustomerID IN (SELECT CustomerID FROM k)),
mg AS (SELECT MeterID FROM meter WHERE CustomerID IN (SELECT CustomerID FROM k))
""" + "\nUNION ALL\n".join([
    _audit_sql("Payment", "payment", "BillID IN (SELECT BillID FROM bg)"),
    _audit_sql("Bill", "bill", "CustomerID IN (SELECT CustomerID FROM k)"),
    _audit_sql("Meter_Reading", "meter_reading", "MeterID IN (SELECT MeterID FROM mg)"),
    _audit_sql("Meter", "meter", "CustomerID IN (SELECT CustomerID FROM k)"),
    _audit_sql("Customer", "cust", "CustomerID IN (SELECT CustomerID FROM k)"),
]))
def q_delete_customers(t: Tables):
    """M2: cascade-delete the customers whose meter is Inactive; audit counts."""
    keys = t.meter.where(F.col("Status") == "Inactive").select("CustomerID")
    return M.delete_customers(t, keys).audit


@register("delete_meters", """
, k AS (SELECT MeterID FROM meter WHERE Status = 'Inactive'),
rg AS (SELECT ReadingID FROM meter_reading WHERE MeterID IN (SELECT MeterID FROM k)),
bg AS (SELECT BillID FROM bill WHERE ReadingID IN (SELECT ReadingID FROM rg))
""" + "\nUNION ALL\n".join([
    _audit_sql("Payment", "payment", "BillID IN (SELECT BillID FROM bg)"),
    _audit_sql("Bill", "bill", "BillID IN (SELECT BillID FROM bg)"),
    _audit_sql("Meter_Reading", "meter_reading", "MeterID IN (SELECT MeterID FROM k)"),
    _audit_sql("Meter", "meter", "MeterID IN (SELECT MeterID FROM k)"),
]))
def q_delete_meters(t: Tables):
    """M3: cascade-delete Inactive meters (bills chosen through their readings)."""
    keys = t.meter.where(F.col("Status") == "Inactive").select("MeterID")
    return M.delete_meters(t, keys).audit


def _keys_sql(*parts: tuple[str, str, str, str]) -> str:
    return "\nUNION ALL\n".join(f"SELECT '{e}' AS Entity, CAST({key} AS VARCHAR) AS RowKey FROM {table} WHERE NOT COALESCE({gone}, FALSE)" for e, table, key, gone in parts)


def _kept(parts):
    """What is left of each table: (Entity, RowKey)."""
    out = None
    for entity, df, key in parts:
        rows = df.select(F.lit(entity).alias("Entity"), F.col(key).cast("string").alias("RowKey"))
        out = rows if out is None else out.unionByName(rows)
    return out


@register("delete_customers_snapshot", """
, k AS (SELECT DISTINCT CustomerID FROM meter WHERE Status = 'Inactive'),
bg AS (SELECT BillID FROM bill WHERE CustomerID IN (SELECT CustomerID FROM k)),
mg AS (SELECT MeterID FROM meter WHERE CustomerID IN (SELECT CustomerID FROM k))
""" + _keys_sql(("Payment", "payment", "PaymentID", "BillID IN (SELECT BillID FROM bg)"),
                ("Bill", "bill", "BillID", "CustomerID IN (SELECT CustomerID FROM k)"),
                ("Meter_Reading", "meter_reading", "ReadingID", "MeterID IN (SELECT MeterID FROM mg)"),
                ("Meter", "meter", "MeterID", "CustomerID IN (SELECT CustomerID FROM k)"),
                ("Customer", "cust", "CustomerID", "CustomerID IN (SELECT CustomerID FROM k)")))
def q_delete_customers_snapshot(t: Tables):
    """M2: every row that the five new snapshots keep."""
    d = M.delete_customers(t, t.meter.where(F.col("Status") == "Inactive").select("CustomerID"))
    return _kept([("Payment", d.payment, "PaymentID"), ("Bill", d.bill, "BillID"), ("Meter_Reading", d.meter_reading, "ReadingID"),
                  ("Meter", d.meter, "MeterID"), ("Customer", d.customer, "CustomerID")])


@register("delete_meters_snapshot", """
, k AS (SELECT MeterID FROM meter WHERE Status = 'Inactive'),
rg AS (SELECT ReadingID FROM meter_reading WHERE MeterID IN (SELECT MeterID FROM k)),
bg AS (SELECT BillID FROM bill WHERE ReadingID IN (SELECT ReadingID FROM rg))
""" + _keys_sql(("Payment", "payment", "PaymentID", "BillID IN (SELECT BillID FROM bg)"),
                ("Bill", "bill", "BillID", "BillID IN (SELECT BillID FROM bg)"),
                ("Meter_Reading", "meter_reading", "ReadingID", "MeterID IN (SELECT MeterID FROM k)"),
                ("Meter", "meter", "MeterID", "MeterID IN (SELECT MeterID FROM k)")))
def q_delete_meters_snapshot(t: Tables):
    """M3: every row that the four new snapshots keep."""
    d = M.delete_meters(t, t.meter.where(F.col("Status") == "Inactive").select("MeterID"))
    return _kept([("Payment", d.payment, "PaymentID"), ("Bill", d.bill, "BillID"),
                  ("Meter_Reading", d.meter_reading, "ReadingID"), ("Meter", d.meter, "MeterID")])


@register("delete_outcomes", """
, asked AS (SELECT DISTINCT CASE WHEN k % 50 = 1 THEN 'CUST-no' || CAST(k AS VARCHAR) ELSE CustomerID END AS CustomerID
            FROM (SELECT CustomerID, CAST(split_part(CustomerID, '-', 2) AS BIGINT) AS k FROM cust) c)
SELECT CustomerID, CASE WHEN CustomerID IN (SELECT CustomerID FROM cust) THEN 'deleted' ELSE 'not found' END AS Outcome FROM asked
""")
def q_delete_outcomes(t: Tables):
    """M2: the answer for each customer id asked for; some ids are not stored."""
    k = _num("CustomerID")
    asked = t.customer.select(F.when(k % 50 == 1, F.concat(F.lit("CUST-no"), k.cast("string"))).otherwise(F.col("CustomerID")).alias("CustomerID"))
    return M.delete_outcomes(t.customer, asked, "CustomerID")


@register("update_outcomes", """
, u AS (SELECT CASE k % 50 WHEN 2 THEN 'MTR-none' WHEN 3 THEN NULL ELSE MeterID END AS MeterID, CustomerID, UtilityID,
               CASE k % 50 WHEN 4 THEN 'Broken' WHEN 5 THEN '' ELSE Status END AS Status
        FROM (SELECT *, CAST(split_part(MeterID, '-', 2) AS BIGINT) AS k FROM meter) m)
SELECT MeterID, CustomerID, UtilityID, Status, CASE WHEN NULLIF(MeterID, '') IS NULL THEN 'missing MeterID'
    WHEN NULLIF(Status, '') IS NULL THEN 'missing Status' WHEN Status NOT IN ('Active', 'Pending Install', 'Inactive') THEN 'bad Status'
    WHEN MeterID NOT IN (SELECT MeterID FROM meter) THEN 'not found' ELSE 'updated' END AS Outcome FROM u
""")
def q_update_outcomes(t: Tables):
    """M1: the answer for each update of a batch with faulty rows of every kind."""
    k = _num("MeterID") % 50
    u = t.meter.select(F.when(k == 2, "MTR-none").when(k != 3, F.col("MeterID")).alias("MeterID"), "CustomerID", "UtilityID",
                       F.when(k == 4, "Broken").when(k == 5, "").otherwise(F.col("Status")).alias("Status"))
    return M.update_outcomes(t.meter, u, "MeterID", V.meter_rules())


@register("delete_tariffs_snapshot", """
SELECT * FROM tariff WHERE TariffID IN (SELECT TariffID FROM bill)
""")
def q_delete_tariffs_snapshot(t: Tables):
    """M4: the tariffs that are left when all are asked to go (those that bills use)."""
    return M.delete_tariffs(t, t.tariff.select("TariffID"))[0]


@register("meter_customer_outcome", """
, asked AS (SELECT DISTINCT CASE WHEN ReadingID % 100 = 0 THEN 'MTR-no' || CAST(ReadingID AS VARCHAR) ELSE MeterID END AS MeterID FROM meter_reading)
SELECT a.MeterID, c.CustomerName, c.ServiceAddress, c.CustomerID IS NOT NULL AS Found
FROM asked a LEFT JOIN meter m ON m.MeterID = a.MeterID LEFT JOIN cust c ON c.CustomerID = m.CustomerID
""")
def q_meter_customer_outcome(t: Tables):
    """J4 with an answer for every meter asked for; some are not stored."""
    r = F.col("ReadingID")
    asked = t.meter_reading.select(F.when(r % 100 == 0, F.concat(F.lit("MTR-no"), r.cast("string"))).otherwise(F.col("MeterID")).alias("MeterID"))
    return J.meter_customer_outcome(t, asked)


@register("delete_tariffs", """
SELECT t.TariffID,
       CASE WHEN COUNT(b.BillID) > 0 THEN 'blocked' ELSE 'deleted' END AS Outcome,
       COUNT(b.BillID) AS BillCount
FROM tariff t LEFT JOIN bill b ON b.TariffID = t.TariffID
GROUP BY t.TariffID
""")
def q_delete_tariffs(t: Tables):
    """M4: try to delete every tariff; those used by bills are blocked."""
    return M.delete_tariffs(t, t.tariff.select("TariffID"))[1]


# ------------------------------------------------------------- reports, scalars
@register("admin_report", """
SELECT 'new-customers' AS Report, CustomerID AS RowKey, CustomerName AS Label, RegistrationDate AS Day FROM cust
UNION ALL
SELECT 'readings-log', CAST(ReadingID AS VARCHAR), MeterID, ReadingDate FROM meter_reading
UNION ALL
SELECT 'payment-log', PaymentID, BillID, CAST(PaymentDate AS DATE) FROM payment
""")
def q_admin_report(t: Tables):
    """All three reports with no range given (defaults 1900-01-01..2099-12-31), in one long form."""
    out = None
    for name, key, label, day in (("new-customers", "CustomerID", "CustomerName", "RegistrationDate"),
                                  ("readings-log", "ReadingID", "MeterID", "ReadingDate"),
                                  ("payment-log", "PaymentID", "BillID", "PaymentDate")):
        rows = RP.admin_report(t, name).select(
            F.lit(name).alias("Report"), F.col(key).cast("string").alias("RowKey"), F.col(label).alias("Label"), F.col(day).cast("date").alias("Day"))
        out = rows if out is None else out.unionByName(rows)
    return out


_DEF_RANGE = _DEFAULTERS_SQL.format(extra=f"AND b.BillDate >= DATE '{_R0}' AND b.BillDate < DATE '{_R1_NEXT}'")


@register("manager_report", _CONSUMPTION_SQL.format(where=_IN_RANGE, part="1") + f"""
, kinds AS (SELECT BillID, UtilityName FROM bill JOIN meter USING (MeterID) JOIN utility_type USING (UtilityID)
), paid AS (SELECT BillID, PaymentAmount, CAST(PaymentDate AS DATE) AS day FROM payment p WHERE {_PAY_RANGE}
), days AS (
  SELECT strftime(day, '%Y-%m-%d') AS d, UtilityName, SUM(PaymentAmount) AS amount FROM paid JOIN kinds USING (BillID) GROUP BY day, UtilityName
), owed AS ({_DEF_RANGE}
)
SELECT 'revenue' AS Report, 'detail' AS Section, d || ' ' || UtilityName AS RowKey, CAST(amount AS DECIMAL(18,2)) AS Amount FROM days
UNION ALL SELECT 'revenue', 'total', 'total', CAST((SELECT SUM(PaymentAmount) FROM paid) AS DECIMAL(18,2))
UNION ALL SELECT 'defaulters', 'detail', CustomerID, TotalDue FROM owed
UNION ALL SELECT 'defaulters', 'total', 'total', CAST((SELECT SUM(TotalDue) FROM owed) AS DECIMAL(18,2))
UNION ALL SELECT 'usage', 'detail', CAST(Rank AS VARCHAR) || ' ' || CustomerID || ' ' || Utility, TotalConsumption FROM ranked
""")
def q_manager_report(t: Tables):
    """R2: the three reports for 1998 with their totals, in one long form."""
    reports = {n: RP.manager_report(t, n, RANGE_START, RANGE_END) for n in ("revenue", "defaulters", "usage")}
    row = lambda name, section, df, key, amount: df.select(
        F.lit(name).alias("Report"), F.lit(section).alias("Section"), key.alias("RowKey"), F.col(amount).cast("decimal(18,2)").alias("Amount"))
    parts = [
        row("revenue", "detail", reports["revenue"].data, F.concat_ws(" ", "Date", "Utility"), "Total"),
        row("revenue", "total", reports["revenue"].total, F.lit("total"), "GrandTotal"),
        row("defaulters", "detail", reports["defaulters"].data, F.col("CustomerID"), "TotalDue"),
        row("defaulters", "total", reports["defaulters"].total, F.lit("total"), "GrandTotalDue"),
        row("usage", "detail", reports["usage"].data, F.concat_ws(" ", F.col("Rank").cast("string"), "CustomerID", "Utility"), "TotalConsumption"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("scalar_suite", """
SELECT BillID,
       CAST(month(BillDate) AS INTEGER) AS BillMonth, CAST(year(BillDate) AS INTEGER) AS BillYear,
       last_day(BillDate) AS MonthEnd, last_day(CAST(BillDate - INTERVAL 1 MONTH AS DATE)) AS PrevMonthEnd,
       CAST(BillDate + INTERVAL 30 DAY AS DATE) AS Plus30, CAST(BillDate - INTERVAL 6 MONTH AS DATE) AS Minus6Months,
       strftime(BillDate, '%B %Y') AS MonthLabel, strftime(BillDate, '%Y-%m-%d') AS DayLabel,
       format('{:,.0f}', CAST(round(AmountDue, 0) AS DOUBLE)) AS AmountN0,
       BillID || ' ' || Status AS Label,
       CAST(COALESCE(Consumption, 0) AS DECIMAL(12,2)) AS ConsumptionOr0,
       CASE WHEN AmountDue >= 100000 THEN 'high' WHEN AmountDue >= 10000 THEN 'mid' ELSE 'low' END AS Band,
       BillDate >= DATE '1998-01-01' AND BillDate < DATE '1999-01-01' AS In1998,
       CAST(AmountDue - COALESCE(Consumption, 0) AS DECIMAL(12,2)) AS Net,
       upper(Status) = upper('paid') AS IsPaid,
       'Rs. ' || CAST(AmountDue AS VARCHAR) AS AmountText,
       CAST(replace(format('{:,.0f}', CAST(round(AmountDue, 0) AS DOUBLE)), ',', '') AS DECIMAL(20,2)) AS Parsed,
       CAST(BillDate + INTERVAL 14 DAY AS DATE) = DueDate AS DueIn14,
       format('{:,}', CAST(floor(AmountDue) AS BIGINT)) || '.' || lpad(CAST(CAST((AmountDue - floor(AmountDue)) * 100 AS INTEGER) AS VARCHAR), 2, '0') AS AmountN2,
       CASE WHEN Status = 'Paid' THEN 'm3' ELSE 'kWh' END AS Unit,
       CASE WHEN Status = 'Paid' THEN NULL ELSE CAST(round(AmountDue, 0) AS DECIMAL(20,2)) END AS ParsedOrNull
FROM bill
""")
def q_scalar_suite(t: Tables):
    """F1-F15 on every bill."""
    b = t.bill
    n0 = FM.format_n("AmountDue", 0)
    unit = F.when(F.col("Status") == "Paid", "m3").otherwise("kWh")
    return b.select(
        "BillID",
        F.month("BillDate").alias("BillMonth"), F.year("BillDate").alias("BillYear"),
        F.last_day("BillDate").alias("MonthEnd"),
        F.last_day(F.add_months("BillDate", -1)).alias("PrevMonthEnd"),
        F.date_add("BillDate", 30).alias("Plus30"), F.add_months("BillDate", -6).alias("Minus6Months"),
        FM.month_label("BillDate").alias("MonthLabel"), FM.day_label("BillDate").alias("DayLabel"),
        n0.alias("AmountN0"),
        F.concat("BillID", F.lit(" "), "Status").alias("Label"),
        F.coalesce("Consumption", F.lit(0)).cast("decimal(12,2)").alias("ConsumptionOr0"),
        F.when(F.col("AmountDue") >= 100000, "high").when(F.col("AmountDue") >= 10000, "mid")
         .otherwise("low").alias("Band"),
        TW.day_range("BillDate", "1998-01-01", "1998-12-31").alias("In1998"),
        (F.col("AmountDue") - F.coalesce("Consumption", F.lit(0))).cast("decimal(12,2)").alias("Net"),
        (F.upper("Status") == F.upper(F.lit("paid"))).alias("IsPaid"),
        FM.rupees("AmountDue").alias("AmountText"),
        FM.parse_quantity(F.concat(n0, F.lit(" kWh"))).alias("Parsed"),
        (F.date_add("BillDate", 14) == F.col("DueDate")).alias("DueIn14"),
        FM.format_n("AmountDue", 2).alias("AmountN2"),
        FM.quantity_unit(FM.quantity_text("AmountDue", unit)).alias("Unit"),
        FM.parse_quantity(F.when(F.col("Status") == "Paid", "n/a kWh").otherwise(FM.quantity_text("AmountDue", unit))).alias("ParsedOrNull"),
    )


# ------------------------------------------------------------------- streaming
@register("ingest_readings_stream", """
, b AS (SELECT 'MTR-' || CAST(user_id AS VARCHAR) AS MeterID,
             'U-00' || CAST(event_id % 5 + 1 AS VARCHAR) AS UserID,
             CAST(value AS DECIMAL(10,2)) AS ReadingValue, CAST(ts AS DATE) AS ReadingDate,
             CASE WHEN event_type = 'error' THEN 'error' END AS Notes
      FROM events),
chk AS (SELECT b.*, """ + _READING_OUTCOME + """ AS Outcome FROM b)
""" + _READING_IDS.format(after=ST.EPOCH_IDS))
def q_ingest_readings_stream(t: Tables):
    """ST1: the event log streamed in as reading submissions (availableNow trigger), validated and
    written by foreachBatch; returns what the two sinks hold: one row per submission."""
    spark = t.spark
    paths = ST.IngestPaths.fresh(spark)
    subs = ST.submissions_from_events(spark, t.source_dir)
    ST.ingest_readings_stream(subs, t.meter, paths).awaitTermination()
    accepted = ST.accepted_readings(spark, paths).withColumn(M.OUTCOME, F.lit("accepted"))
    return accepted.unionByName(ST.refused_submissions(spark, paths).drop(ST.EPOCH))


@register("reading_consumption_stream", """
, lagged AS (SELECT ReadingID, MeterID, ReadingDate, ReadingValue,
                    LAG(ReadingValue, 1, 0) OVER (PARTITION BY MeterID ORDER BY ReadingDate, ReadingID) AS before FROM meter_reading)
SELECT ReadingID, MeterID, ReadingDate, ReadingValue AS CurrentReadingValue, CAST(before AS DECIMAL(10,2)) AS PreviousReadingValue,
       CAST(ReadingValue - before AS DECIMAL(12,2)) AS Consumption
FROM lagged
""")
def q_reading_consumption_stream(t: Tables):
    """ST1 with W2 and B1: all readings arrive out of order in three micro-batches; the last answer of each."""
    base = f"{output_dir(t.spark)}/consumption-{uuid.uuid4().hex}"
    t.meter_reading.repartition(3, F.xxhash64("ReadingID")).write.parquet(f"{base}/arrived")
    paths = SC.Paths.under(base)
    SC.consumption_stream(SC.readings_from_files(t.spark, f"{base}/arrived", max_files=1), paths).awaitTermination()
    return SC.latest_answers(t.spark, paths)


# ------------------------------------------------- remaining SURVEY query keys
@register("consumption_rank", _CONSUMPTION_SQL.format(where="TRUE", part="1") + """
SELECT Rank, CustomerID, Utility, TotalConsumption FROM ranked
""")
def q_consumption_rank(t: Tables):
    """RANK() of every customer x utility by all-time consumption, distributed."""
    totals = A.consumption_totals(t, None).where(F.col("TotalConsumption") > 0)
    ranked = W.global_rank(totals, "TotalConsumption", "Rank")
    return ranked.select("Rank", "CustomerID", F.col("UtilityName").alias("Utility"),
                         F.col("TotalConsumption").cast("decimal(18,2)").alias("TotalConsumption"))


@register("base_tariff", """
, base AS (
  SELECT UtilityID, TariffID AS BaseTariffID, Rate AS BaseRate FROM (
    SELECT *, row_number() OVER (PARTITION BY UtilityID ORDER BY MinUnits NULLS FIRST, TariffID) AS rn
    FROM tariff) x WHERE rn = 1
)
SELECT b.UtilityID, b.BaseTariffID, b.BaseRate, COUNT(m.MeterID) AS MeterCount
FROM base b LEFT JOIN meter m ON m.UtilityID = b.UtilityID
GROUP BY b.UtilityID, b.BaseTariffID, b.BaseRate
""")
def q_base_tariff(t: Tables):
    """The first tariff of each utility (TOP 1 by MinUnits) and how many meters it rates."""
    per = t.meter.groupBy("UtilityID").agg(F.count(F.lit(1)).alias("MeterCount"))
    return (RT.base_tariff(t.tariff).join(per, "UtilityID", "left")
            .select("UtilityID", "BaseTariffID", "BaseRate",
                    F.coalesce("MeterCount", F.lit(0)).cast("bigint").alias("MeterCount")))


def _proposed_tariffs(t: Tables):
    """One proposed tariff per utility x customer type in use, priced at the base rate."""
    combos = (t.meter.join(t.customer.select("CustomerID", "CustomerType"), "CustomerID")
              .select("UtilityID", "CustomerType").distinct())
    base = RT.base_tariff(t.tariff).select("UtilityID", "BaseRate")
    return combos.join(base, "UtilityID", "left").select(
        F.concat("UtilityID", F.lit("-"), F.upper("CustomerType")).alias("TariffID"), "UtilityID",
        F.concat("CustomerType", F.lit(" standard")).alias("TariffName"), F.col("BaseRate").alias("Rate"))


_PROPOSED_SQL = """
, base AS (
  SELECT UtilityID, Rate AS BaseRate FROM (
    SELECT *, row_number() OVER (PARTITION BY UtilityID ORDER BY MinUnits NULLS FIRST, TariffID) AS rn
    FROM tariff) x WHERE rn = 1
), combos AS (
  SELECT DISTINCT m.UtilityID, c.CustomerType FROM meter m JOIN cust c ON m.CustomerID = c.CustomerID
), proposed AS (
  SELECT co.UtilityID || '-' || upper(co.CustomerType) AS TariffID, co.UtilityID,
         co.CustomerType || ' standard' AS TariffName, b.BaseRate AS Rate
  FROM combos co LEFT JOIN base b ON co.UtilityID = b.UtilityID
)
"""


@register("append_tariffs", _PROPOSED_SQL + """
SELECT TariffID, UtilityID, TariffName, CAST(Rate AS DECIMAL(10,2)) AS Rate, 0 AS MinUnits,
       CAST(NULL AS INTEGER) AS MaxUnits, CAST(0 AS DECIMAL(10,2)) AS FixedCharge,
       CASE WHEN NULLIF(TariffID, '') IS NULL THEN 'missing TariffID'
            WHEN NULLIF(UtilityID, '') IS NULL THEN 'missing UtilityID'
            WHEN NULLIF(TariffName, '') IS NULL THEN 'missing TariffName'
            WHEN Rate IS NULL THEN 'missing Rate'
            WHEN TariffID IN (SELECT TariffID FROM tariff) THEN 'duplicate TariffID'
            WHEN TariffID IN (SELECT TariffID FROM proposed GROUP BY TariffID HAVING COUNT(*) > 1)
              THEN 'repeated TariffID'
            WHEN UtilityID NOT IN (SELECT UtilityID FROM utility_type) THEN 'unknown UtilityID'
            ELSE 'accepted' END AS Outcome
FROM proposed
""")
def q_append_tariffs(t: Tables):
    """S2 addTariff: the proposed per-segment tariffs appended to the catalogue."""
    return M.append_tariffs(t.tariff, _proposed_tariffs(t), t.utility_type)


@register("validate_tariffs", _PROPOSED_SQL + """
SELECT TariffID,
       (CASE WHEN NULLIF(TariffID, '') IS NULL THEN 1 ELSE 0 END + CASE WHEN NULLIF(UtilityID, '') IS NULL THEN 1 ELSE 0 END
        + CASE WHEN NULLIF(TariffName, '') IS NULL THEN 1 ELSE 0 END + CASE WHEN Rate IS NULL THEN 1 ELSE 0 END) = 0 AS Valid,
       CASE WHEN NULLIF(TariffID, '') IS NULL THEN 'missing TariffID'
            WHEN NULLIF(UtilityID, '') IS NULL THEN 'missing UtilityID'
            WHEN NULLIF(TariffName, '') IS NULL THEN 'missing TariffName'
            WHEN Rate IS NULL THEN 'missing Rate' END AS FirstError,
       CAST(CASE WHEN NULLIF(TariffID, '') IS NULL THEN 1 ELSE 0 END + CASE WHEN NULLIF(UtilityID, '') IS NULL THEN 1 ELSE 0 END
        + CASE WHEN NULLIF(TariffName, '') IS NULL THEN 1 ELSE 0 END + CASE WHEN Rate IS NULL THEN 1 ELSE 0 END AS INTEGER) AS ErrorCount
FROM (SELECT TariffID, UtilityID, TariffName, Rate FROM tariff
      UNION ALL SELECT TariffID, UtilityID, TariffName, Rate FROM proposed) x
""")
def q_validate_tariffs(t: Tables):
    """Required fields of the tariff catalogue and of the proposed tariffs."""
    rows = t.tariff.select("TariffID", "UtilityID", "TariffName", "Rate").unionByName(_proposed_tariffs(t))
    return V.validation_report(rows, "TariffID", V.tariff_rules())


@register("update_tariffs", """
, used AS (SELECT DISTINCT TariffID FROM bill WHERE TariffID IS NOT NULL)
SELECT t.TariffID, t.UtilityID, t.TariffName,
       CASE WHEN u.TariffID IS NOT NULL THEN CAST(t.Rate * 1.10 AS DECIMAL(10,2)) ELSE t.Rate END AS Rate,
       t.MinUnits, t.MaxUnits, t.FixedCharge, u.TariffID IS NOT NULL AS Updated
FROM tariff t LEFT JOIN used u ON t.TariffID = u.TariffID
""")
def q_update_tariffs(t: Tables):
    """M1 updateTariff: every tariff that bills use gets a 10% higher rate; MinUnits,
    MaxUnits and FixedCharge are not among the listed columns and stay."""
    used = t.bill.where(F.col("TariffID").isNotNull()).select("TariffID").distinct()
    upd = (t.tariff.join(used, "TariffID", "left_semi")
           .select("TariffID", "TariffName", "UtilityID",
                   (F.col("Rate") * F.lit(1.10).cast("decimal(3,2)")).cast("decimal(10,2)").alias("Rate"),
                   F.lit(1).alias("seq")))
    return M.apply_updates(t.tariff, upd, "TariffID", ["TariffName", "UtilityID", "Rate"])


@register("export_report", _DEFAULTERS_SQL.format(extra=""))
def q_export_report(t: Tables):
    """S3: the defaulters report exported as CSV part files (one per task) into a new
    output folder, read back with its schema."""
    import uuid

    from ..session import output_dir
    from ..sources import sinks
    report = A.defaulters(t, ordered=False)
    path = f"{output_dir(t.spark)}/export-{uuid.uuid4().hex}"
    sinks.export(report, path, fmt="csv")
    return t.spark.read.schema(report.schema).option("header", "true").csv(path)


@register("load_customers_csv", "SELECT * FROM cust")
def q_load_customers_csv(t: Tables):
    """The customer entity exported as CSV part files and read back by ``load`` with its schema."""
    return _stored_as(t, "customer", "csv")


@register("load_bills_parquet", "SELECT * FROM bill")
def q_load_bills_parquet(t: Tables):
    """The bill entity written as Parquet and read back by ``load`` with its schema."""
    return _stored_as(t, "bill", "parquet")


def _stored_as(t: Tables, entity: str, fmt: str):
    import uuid

    from ..session import output_dir
    from ..sources import sinks
    from ..sources.tables import load
    path = f"{output_dir(t.spark)}/{entity}-{uuid.uuid4().hex}"
    sinks.export(getattr(t, entity), path, fmt=fmt)
    return load(t.spark, entity, path, fmt)


@register("first_reading", """
, firsts AS (SELECT *, row_number() OVER (PARTITION BY MeterID ORDER BY ReadingDate NULLS FIRST, ReadingID) AS k FROM meter_reading)
SELECT MeterID, ReadingID, ReadingDate, ReadingValue FROM firsts WHERE k = 1
""")
def q_first_reading(t: Tables):
    """W3 on a growing table: the first reading of each meter (TOP 1 by date, then id)."""
    return W.first_by_order(t.meter_reading, ["MeterID"], ["ReadingDate", "ReadingID"], ["ReadingID", "ReadingDate", "ReadingValue"])
