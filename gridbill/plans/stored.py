"""Queries over stored entities: line files with broken rows, appends that write, copy-on-write maintenance."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import maintain as M
from ..operators import rewrite as RW
from ..operators import store as S
from ..operators import validate as V
from ..session import output_dir
from ..sources import lines as LN
from ..sources import periods as PD
from ..sources import sinks
from ..sources.tables import Tables
from . import reports as RP
from .catalog import AS_OF, RANGE_END, RANGE_START, register
from .registry import _CUSTOMER_SQL, _DEF_RANGE, _METER_SQL, _READINGS_SQL, _installations, _keys_sql, _kept, _num, _sign_ups, _submissions


def _folder(t: Tables, what: str) -> str:
    return f"{output_dir(t.spark)}/{what}-{uuid.uuid4().hex}"


# ------------------------------------------------------------- S1, P7: line files
_JSON_SQL = """
, p AS (SELECT *, CAST(split_part(BillID, '-', 2) AS BIGINT) % 50 AS k FROM payment),
said AS (
  SELECT p.*, '{"PaymentID":"' || PaymentID || '","BillID":"' || CASE k WHEN 4 THEN '' ELSE BillID END || '","UserID":"' || UserID
    || '","PaymentAmount":' || CASE k WHEN 2 THEN '"n/a"' WHEN 7 THEN CAST(PaymentAmount AS VARCHAR) || '1' WHEN 8 THEN '99' || CAST(PaymentAmount AS VARCHAR) || '0e7' ELSE CAST(PaymentAmount AS VARCHAR) END
    || ',"PaymentDate":"' || CASE k WHEN 3 THEN '1998-02-30T10:00:00' ELSE strftime(PaymentDate, '%Y-%m-%dT%H:%M:%S') END
    || '","PaymentMethod":"' || CASE k WHEN 5 THEN 'Barter' ELSE PaymentMethod END || '"}' AS whole FROM p
), line AS (
  SELECT said.*, CASE k WHEN 1 THEN substr(whole, 1, length(whole) - 12) WHEN 6 THEN 'paid in cash: ' || PaymentID ELSE whole END AS Line,
    CASE k WHEN 1 THEN 'broken line' WHEN 6 THEN 'broken line' WHEN 2 THEN 'bad PaymentAmount' WHEN 7 THEN 'bad PaymentAmount' WHEN 8 THEN 'bad PaymentAmount'
      WHEN 3 THEN 'bad PaymentDate' WHEN 4 THEN 'missing BillID' WHEN 5 THEN 'bad PaymentMethod' ELSE 'accepted' END AS Outcome FROM said
)
"""


def _payment_lines(t: Tables):
    """Every payment as a JSON line, some of them broken in each way there is."""
    k = _num("BillID") % 50
    text = lambda *cs: F.concat(*[F.lit(c) if c[:1] in '{",' else F.col(c).cast("string") for c in cs])
    amount = F.col("PaymentAmount").cast("string")
    p = t.payment.select(
        "PaymentID", F.when(k == 4, "").otherwise(F.col("BillID")).alias("BillID"), "UserID",
        F.when(k == 2, '"n/a"').when(k == 7, F.concat(amount, F.lit("1"))).when(k == 8, F.concat(F.lit("99"), amount, F.lit("0e7"))).otherwise(amount).alias("PaymentAmount"),
        F.when(k == 3, "1998-02-30T10:00:00").otherwise(F.date_format("PaymentDate", "yyyy-MM-dd'T'HH:mm:ss")).alias("PaymentDate"),
        F.when(k == 5, "Barter").otherwise(F.col("PaymentMethod")).alias("PaymentMethod"), k.alias("k"))
    whole = text('{"PaymentID":"', "PaymentID", '","BillID":"', "BillID", '","UserID":"', "UserID", '","PaymentAmount":', "PaymentAmount",
                 ',"PaymentDate":"', "PaymentDate", '","PaymentMethod":"', "PaymentMethod", '"}')
    line = F.when(F.col("k") == 1, F.substring(whole, F.lit(1), F.length(whole) - 12)).when(
        F.col("k") == 6, F.concat(F.lit("paid in cash: "), F.col("PaymentID"))).otherwise(whole)
    path = _folder(t, "payment-lines")
    p.select(line.alias("value")).write.text(path)
    return LN.read_lines(t.spark, "payment", path, "json", V.payment_rules())


@register("load_payments_json", _JSON_SQL + "SELECT PaymentID, BillID, UserID, PaymentAmount, PaymentDate, PaymentMethod FROM line WHERE Outcome = 'accepted'")
def q_load_payments_json(t: Tables):
    """JSON lines of every payment, of which the sound ones are read."""
    return _payment_lines(t).where(F.col(LN.OUTCOME) == "accepted").drop(LN.LINE, LN.OUTCOME)


@register("load_payments_json_refused", _JSON_SQL + "SELECT Line, Outcome FROM line WHERE Outcome <> 'accepted'")
def q_load_payments_json_refused(t: Tables):
    """The lines of those files that are refused, with their text and the reason."""
    return _payment_lines(t).where(F.col(LN.OUTCOME) != "accepted").select(LN.LINE, LN.OUTCOME)


@register("load_meters_csv_checked", """
, m AS (SELECT *, CAST(split_part(MeterID, '-', 2) AS BIGINT) % 50 AS k FROM meter)
SELECT MeterID || ',' || CustomerID || ',' || UtilityID || ',' || CASE k WHEN 3 THEN 'Broken' WHEN 9 THEN '' ELSE Status END || ',"' || Location || '"'
    || CASE k WHEN 1 THEN '' WHEN 2 THEN ',soon' WHEN 4 THEN ',1995-01-01,?' ELSE ',1995-01-01' END AS Line,
  CASE k WHEN 1 THEN 'broken line' WHEN 2 THEN 'bad InstallDate' WHEN 4 THEN 'broken line' WHEN 3 THEN 'bad Status' WHEN 9 THEN 'missing Status' ELSE 'accepted' END AS Outcome
FROM m
""")
def q_load_meters_csv_checked(t: Tables):
    """The meters as CSV lines with a header, short and long lines and bad values; the outcome of each line."""
    k = _num("MeterID") % 50
    line = F.concat_ws(
        ",", "MeterID", "CustomerID", "UtilityID", F.when(k == 3, "Broken").when(k == 9, "").otherwise(F.col("Status")), F.concat(F.lit('"'), "Location", F.lit('"')),
        F.when(k == 2, "soon").when(k == 4, "1995-01-01,?").when(k != 1, F.col("InstallDate").cast("string")))
    path = _folder(t, "meter-lines")
    names = ",".join(t.meter.columns)
    t.meter.select(line.alias("value")).write.text(path)
    t.spark.createDataFrame([(names,), (" ",)], "value string").write.mode("append").text(path)
    return LN.read_lines(t.spark, "meter", path, "csv", V.meter_rules()).select(LN.LINE, LN.OUTCOME)


# ----------------------------------------------------------- S2: appends that write
def _sent_twice(t: Tables, entity: str, first, batch, check):
    """A store with a first load and a batch that was sent twice."""
    base = _folder(t, f"store-{entity}")
    if first is not None:
        S.put(t.spark, base, entity, first, 0)
    for _ in range(2):
        S.append(t.spark, base, entity, batch, 1, check)
    return base


@register("stored_customers", _CUSTOMER_SQL + """
SELECT * FROM cust WHERE RegistrationDate < DATE '1998-01-01'
UNION ALL SELECT * EXCLUDE (Outcome) FROM chk WHERE Outcome = 'accepted'
""")
def q_stored_customers(t: Tables):
    """S2 addCustomer, written: the customer store after a sign-up batch that was sent twice."""
    first, batch = _sign_ups(t)
    base = _sent_twice(t, "customer", first, batch, lambda stored, b: M.append_customers(stored, b, AS_OF))
    return S.stored(t.spark, base, "customer")


@register("stored_meters", _METER_SQL + """
SELECT MeterID, CustomerID, UtilityID, Status, Location, InstallDate, 'stored' AS Outcome FROM meter WHERE Status = 'Inactive'
UNION ALL SELECT MeterID, CustomerID, UtilityID, Status, Location, InstallDate, CASE Outcome WHEN 'accepted' THEN 'stored' ELSE Outcome END FROM chk
""")
def q_stored_meters(t: Tables):
    """S2 addMeter, written: stored and refused rows after an installation batch that was sent twice."""
    first, batch = _installations(t)
    base = _sent_twice(t, "meter", first, batch, lambda stored, b: M.append_meters(stored, b, t.customer, t.utility_type, AS_OF))
    return S.stored(t.spark, base, "meter").withColumn(M.OUTCOME, F.lit("stored")).unionByName(S.refused(t.spark, base, "meter").drop(S.BATCH))


@register("stored_readings", _READINGS_SQL + """
SELECT MeterID, UserID, ReadingValue, ReadingDate, Notes, COUNT(*) AS Copies, MIN(CASE WHEN Outcome = 'accepted' THEN 'stored' ELSE Outcome END) AS Outcome
FROM chk GROUP BY MeterID, UserID, ReadingValue, ReadingDate, Notes
""")
def q_stored_readings(t: Tables):
    """S2 submitReading, written: equal submissions and how often each is stored or refused, after a batch that was sent twice."""
    base = _sent_twice(t, "meter_reading", None, _submissions(t), lambda _, b: M.append_readings(b, t.meter, 1 << 40))
    rows = S.stored(t.spark, base, "meter_reading").withColumn(M.OUTCOME, F.lit("stored")).unionByName(S.refused(t.spark, base, "meter_reading").drop(S.BATCH))
    return rows.groupBy("MeterID", "UserID", "ReadingValue", "ReadingDate", "Notes").agg(F.count(F.lit(1)).alias("Copies"), F.min(M.OUTCOME).alias(M.OUTCOME))


# ------------------------------------------------------- M1-M3: rewriting touched files
def _laid_out(t: Tables) -> tuple[str, dict[str, RW.Files]]:
    """The entities as Parquet files of key ranges, and that version."""
    base = _folder(t, "entities")
    for entity, key in (("customer", "CustomerID"), ("meter", "MeterID"), ("meter_reading", "MeterID"), ("bill", "CustomerID"), ("payment", "BillID")):
        getattr(t, entity).repartitionByRange(key).write.parquet(f"{base}/{entity}")
    return base, RW.version_of(t.spark, base, ("customer", "meter", "meter_reading", "bill", "payment"))


def _kept_rows(t: Tables, version):
    now = RW.tables_of(t.spark, version)
    return _kept([("Payment", now.payment, "PaymentID"), ("Bill", now.bill, "BillID"), ("Meter_Reading", now.meter_reading, "ReadingID"),
                  ("Meter", now.meter, "MeterID"), ("Customer", now.customer, "CustomerID")])


@register("delete_customers_rewritten", """
, k AS (SELECT CustomerID FROM cust WHERE RegistrationDate < DATE '1995-03-01'),
mg AS (SELECT MeterID FROM meter WHERE CustomerID IN (SELECT CustomerID FROM k)),
bg AS (SELECT BillID FROM bill WHERE CustomerID IN (SELECT CustomerID FROM k))
""" + _keys_sql(("Payment", "payment", "PaymentID", "BillID IN (SELECT BillID FROM bg)"),
                ("Bill", "bill", "BillID", "CustomerID IN (SELECT CustomerID FROM k)"),
                ("Meter_Reading", "meter_reading", "ReadingID", "MeterID IN (SELECT MeterID FROM mg)"),
                ("Meter", "meter", "MeterID", "CustomerID IN (SELECT CustomerID FROM k)"),
                ("Customer", "cust", "CustomerID", "CustomerID IN (SELECT CustomerID FROM k)")))
def q_delete_customers_rewritten(t: Tables):
    """M2 on stored files: the rows left after the earliest customers were deleted, the version saved and opened again."""
    base, version = _laid_out(t)
    keys = t.customer.where(F.col("RegistrationDate") < F.lit("1995-03-01").cast("date"))
    RW.save_version(t.spark, RW.delete_customers(t.spark, version, keys, f"{base}/next"), f"{base}/versions/1")
    return _kept_rows(t, RW.open_version(t.spark, f"{base}/versions/1"))


@register("delete_meters_rewritten", """
, k AS (SELECT MeterID FROM meter WHERE Status = 'Inactive'),
rg AS (SELECT ReadingID FROM meter_reading WHERE MeterID IN (SELECT MeterID FROM k)),
bg AS (SELECT BillID FROM bill WHERE ReadingID IN (SELECT ReadingID FROM rg))
""" + _keys_sql(("Payment", "payment", "PaymentID", "BillID IN (SELECT BillID FROM bg)"),
                ("Bill", "bill", "BillID", "BillID IN (SELECT BillID FROM bg)"),
                ("Meter_Reading", "meter_reading", "ReadingID", "MeterID IN (SELECT MeterID FROM k)"),
                ("Meter", "meter", "MeterID", "MeterID IN (SELECT MeterID FROM k)"),
                ("Customer", "cust", "CustomerID", "FALSE")))
def q_delete_meters_rewritten(t: Tables):
    """M3 on stored files: the rows left after the Inactive meters were deleted."""
    base, version = _laid_out(t)
    keys = t.meter.where(F.col("Status") == "Inactive")
    return _kept_rows(t, RW.delete_meters(t.spark, version, keys, f"{base}/next"))


@register("update_meters_rewritten", """
, err AS (SELECT DISTINCT MeterID FROM meter_reading WHERE Notes = 'error')
SELECT m.* REPLACE (CASE WHEN e.MeterID IS NOT NULL THEN 'Inactive' ELSE m.Status END AS Status) FROM meter m LEFT JOIN err e ON m.MeterID = e.MeterID
""")
def q_update_meters_rewritten(t: Tables):
    """M1 on stored files: meters that reported an error are set Inactive, in the files that hold one."""
    base = _folder(t, "entities")
    t.meter.repartitionByRange("MeterID").write.parquet(f"{base}/meter")
    errors = t.meter_reading.where(F.col("Notes") == "error").select("MeterID").distinct()
    changes = errors.withColumn("Status", F.lit("Inactive")).withColumn("seq", F.lit(1))
    files = RW.updated(t.spark, RW.files_of(t.spark, "meter", f"{base}/meter"), changes, "MeterID", ["Status"], f"{base}/next")
    return files.rows(t.spark)


# ------------------------------------------- R2, P7, P8: detail and figures in one pass
@register("defaulters_exported", f"""
, owed AS ({_DEF_RANGE})
SELECT CustomerID, UnpaidBills, TotalDue FROM owed
UNION ALL SELECT 'total', COUNT(*), CAST(COALESCE(SUM(TotalDue), 0) AS DECIMAL(18,2)) FROM owed
""")
def q_defaulters_exported(t: Tables):
    """R2/S3: the 1998 defaulters written as CSV and read back, and the total that was taken on the way."""
    path = _folder(t, "defaulters")
    total = RP.export_defaulters(t, RANGE_START, RANGE_END, path)
    detail = t.spark.read.option("header", "true").csv(path).select(
        "CustomerID", F.col("UnpaidBills").cast("bigint"), F.col("TotalDue").cast("decimal(18,2)"))
    last = t.spark.createDataFrame([("total", total["Defaulters"], total["GrandTotalDue"])], detail.schema)
    return detail.unionByName(last)


_SENT_SQL = """
, sent AS (
  SELECT PaymentID, CASE k WHEN 1 THEN '' WHEN 2 THEN NULL ELSE BillID END AS BillID, CASE WHEN k IN (1, 3) THEN 0 ELSE PaymentAmount END AS PaymentAmount,
         CASE k WHEN 4 THEN 'Barter' WHEN 5 THEN NULL ELSE PaymentMethod END AS PaymentMethod
  FROM (SELECT *, CAST(split_part(BillID, '-', 2) AS BIGINT) % 50 AS k FROM payment) p
)
"""


@register("payments_checked_once", _SENT_SQL + "\nUNION ALL\n".join(
    f"SELECT '{name}' AS Item, COUNT(*) FILTER (WHERE {pred}) AS Payments FROM sent" for name, pred in (
        ("rows", "TRUE"), ("missing BillID", "NULLIF(BillID, '') IS NULL"), ("missing PaymentAmount", "PaymentAmount IS NULL OR PaymentAmount = 0"),
        ("missing PaymentMethod", "NULLIF(PaymentMethod, '') IS NULL"), ("bad PaymentMethod", "PaymentMethod NOT IN ('Cash', 'Card', 'Online')"),
        ("written as valid", "NULLIF(BillID, '') IS NOT NULL AND PaymentAmount <> 0 AND PaymentMethod IN ('Cash', 'Card', 'Online')"))))
def q_payments_checked_once(t: Tables):
    """Payments with faulty rows of every kind, written as valid and refused; the rules' counts are taken on the way."""
    k = _num("BillID") % 50
    sent = t.payment.select(
        "PaymentID", F.when(k == 1, "").when(k != 2, F.col("BillID")).alias("BillID"), F.when(~k.isin(1, 3), F.col("PaymentAmount")).otherwise(0).alias("PaymentAmount"),
        F.when(k == 4, "Barter").when(k != 5, F.col("PaymentMethod")).alias("PaymentMethod"))
    path = _folder(t, "checked")
    counts = sinks.write_checked(sent, V.payment_rules(), path)
    valid = t.spark.read.schema(sent.schema).parquet(f"{path}/{sinks.VALID}=true").agg(F.lit("written as valid").alias("Item"), F.count(F.lit(1)).alias("Payments"))
    return t.spark.createDataFrame(list(counts.items()), "Item string, Payments long").unionByName(valid)


# ------------------------------------------------------- A5: months that are not read
@register("revenue_settled_months", """
, settled AS (
  SELECT strftime(BillDate, '%Y-%m') AS Month FROM bill GROUP BY ALL HAVING 3 * COUNT(*) FILTER (WHERE Status = 'Unpaid') <= COUNT(*)
)
SELECT strftime(PaymentDate, '%Y-%m') AS Month, COUNT(*) AS Payments, CAST(SUM(PaymentAmount) AS DECIMAL(18,2)) AS Total
FROM payment WHERE strftime(PaymentDate, '%Y-%m') IN (SELECT Month FROM settled) GROUP BY ALL
""")
def q_revenue_settled_months(t: Tables):
    """A5 by month over payments stored by month: months of which at most a third of the bills is unpaid; the others are not read."""
    path = _folder(t, "payments")
    PD.write_by_month(t.payment, path)
    unpaid = F.count(F.when(F.col("Status") == "Unpaid", 1))
    settled = t.bill.groupBy(PD.month_of("BillDate").alias(PD.MONTH)).agg(unpaid.alias("_unpaid"), F.count(F.lit(1)).alias("_n")).where("3 * _unpaid <= _n")
    paid = PD.in_months(t.spark, path, settled)
    return paid.groupBy(PD.MONTH).agg(F.count(F.lit(1)).alias("Payments"), F.sum("PaymentAmount").cast("decimal(18,2)").alias("Total"))
