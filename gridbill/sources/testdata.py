"""Derive the billing entities from the star-schema test tables.

The mapping rules are the ones in FIXTURES.md section 3. Everything is a
column expression over the source tables, so work grows with the data; the only
fixed rows are the two dimension tables (three utilities, six tariffs).
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.windows import running_sum

EPOCH = dt.date(1995, 1, 1)

# Utility types (id, name, unit) as offered by the meter form.
UTILITY_ROWS = [
    ("UTIL-01", "Electricity", "kWh"),
    ("UTIL-02", "Water", "m3"),
    ("UTIL-03", "Gas", "unit"),
]

# Tariff plans (id, utility, name, rate, min units, max units, fixed charge).
TARIFF_ROWS = [
    ("ELEC-01", "UTIL-01", "Domestic (0-60 kWh)", Decimal("30.00"), 0, 60, Decimal("100.00")),
    ("ELEC-02", "UTIL-01", "Domestic (60-120 kWh)", Decimal("45.00"), 60, 120, Decimal("0.00")),
    ("ELEC-03", "UTIL-01", "Domestic (120+ kWh)", Decimal("60.00"), 120, None, Decimal("0.00")),
    ("WATR-01", "UTIL-02", "Water base", Decimal("20.00"), 0, None, Decimal("0.00")),
    ("WATR-02", "UTIL-02", "Water high", Decimal("35.00"), 50, None, Decimal("0.00")),
    ("GAS-01", "UTIL-03", "Gas flat", Decimal("15.50"), 0, None, Decimal("0.00")),
]


def _s(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return f"'{v}'" if isinstance(v, Decimal) else str(v)


def local_frame(spark: SparkSession, rows, schema) -> DataFrame:
    """A fixed table as an inline VALUES relation: the optimizer knows its exact
    size, so joins against it are broadcast by the planner's own size check."""
    values = ", ".join("(" + ", ".join(_sql_literal(v) for v in r) + ")" for r in rows)
    cols = [f"col{i + 1}" for i in range(len(schema.fields))]
    select = ", ".join(f"CAST({c} AS {f.dataType.simpleString()}) AS {f.name}"
                       for c, f in zip(cols, schema.fields))
    return spark.sql(f"SELECT {select} FROM VALUES {values}")


def utility_type(spark: SparkSession) -> DataFrame:
    return local_frame(spark, UTILITY_ROWS, schemas.UTILITY_TYPE)


def tariff(spark: SparkSession) -> DataFrame:
    return local_frame(spark, TARIFF_ROWS, schemas.TARIFF)


def customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    n = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # nation is tiny; the planner broadcasts it after its own size check.
    j = c.join(n, c.c_nationkey == n.n_nationkey, "inner")
    key = F.col("c_custkey")
    return j.select(
        F.concat(F.lit("CUST-"), _s(key)).alias("CustomerID"),
        F.col("c_name").alias("CustomerName"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", "Household")
         .when(F.col("c_mktsegment") == "BUILDING", "Government")
         .otherwise("Business").alias("CustomerType"),
        F.when(key % 4 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("c"), _s(key), F.lit("@example.test"))).alias("Email"),
        F.concat(F.lit("07"), F.lpad(_s(key), 8, "0")).alias("Phone"),
        F.col("n_name").alias("ServiceAddress"),
        F.when(key % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("n_name")).alias("BillingAddress"),
        F.date_add(F.lit(EPOCH), ((key * 7) % 2400).cast("int")).alias("RegistrationDate"),
    )


def meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    key = F.col("c_custkey")
    return c.select(
        F.concat(F.lit("MTR-"), _s(key)).alias("MeterID"),
        F.concat(F.lit("CUST-"), _s(key)).alias("CustomerID"),
        F.concat(F.lit("UTIL-0"), _s(key % 3 + 1)).alias("UtilityID"),
        F.when(key % 10 == 0, "Inactive").when(key % 10 == 1, "Pending Install")
         .otherwise("Active").alias("Status"),
        F.when(key % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("Block "), _s("c_nationkey"))).alias("Location"),
        F.lit(EPOCH).alias("InstallDate"),
    )


def meter_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", "event_type",
        F.col("value").cast(schemas.MONEY).alias("_v"))
    # The register value is the running total of a meter's events: a
    # distributed segmented scan, safe when one user owns a large share of events.
    reg = running_sum(e, ["user_id"], ["event_id"], "_v", "_reg")
    return reg.select(
        F.col("event_id").cast("bigint").alias("ReadingID"),
        F.concat(F.lit("MTR-"), _s("user_id")).alias("MeterID"),
        F.concat(F.lit("U-00"), _s(F.col("event_id") % 5 + 1)).alias("UserID"),
        F.col("_reg").cast(schemas.MONEY).alias("ReadingValue"),
        F.col("ts").cast("date").alias("ReadingDate"),
        F.when(F.col("event_type") == "error", F.lit("error")).alias("Notes"),
    )


def bill(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    li = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    per_order = li.groupBy("l_orderkey").agg(
        F.sum(F.col("l_quantity").cast(schemas.MONEY)).alias("_q"))
    j = o.join(per_order, o.o_orderkey == per_order.l_orderkey, "left")
    ck = F.col("o_custkey")
    bill_date = F.col("o_orderdate").cast("date")
    return j.select(
        F.concat(F.lit("BILL-"), _s("o_orderkey")).alias("BillID"),
        F.concat(F.lit("CUST-"), _s(ck)).alias("CustomerID"),
        F.concat(F.lit("MTR-"), _s(ck)).alias("MeterID"),
        (F.col("o_orderkey") * 2).cast("bigint").alias("ReadingID"),
        F.when(ck % 3 == 0, "ELEC-01").when(ck % 3 == 1, "WATR-01").otherwise("GAS-01").alias("TariffID"),
        bill_date.alias("BillDate"),
        F.date_add(bill_date, 14).alias("DueDate"),
        F.lit(None).cast(schemas.MONEY).alias("PreviousReadingValue"),
        F.lit(None).cast(schemas.MONEY).alias("CurrentReadingValue"),
        F.col("_q").cast(schemas.MONEY).alias("Consumption"),
        F.col("o_totalprice").cast(schemas.MONEY).alias("AmountDue"),
        F.when(F.col("o_orderstatus") == "F", "Paid").when(F.col("o_orderstatus") == "O", "Unpaid")
         .when(F.col("o_orderstatus") == "P", "Overdue").alias("Status"),
    )


def payment(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        "l_quantity", "l_shipdate", "l_returnflag")
    hours = (F.col("l_quantity") % 24).cast("int")
    return li.select(
        F.concat(F.lit("PAY-"), _s("l_orderkey"), F.lit("-"), _s("l_linenumber"), F.lit("-"),
                 _s("l_partkey")).alias("PaymentID"),
        F.concat(F.lit("BILL-"), _s("l_orderkey")).alias("BillID"),
        F.concat(F.lit("U-"), _s("l_suppkey")).alias("UserID"),
        F.col("l_extendedprice").cast(schemas.MONEY).alias("PaymentAmount"),
        F.timestamp_add("HOUR", hours, F.col("l_shipdate").cast("timestamp_ntz")).alias("PaymentDate"),
        F.when(F.col("l_returnflag") == "A", "Cash").when(F.col("l_returnflag") == "N", "Card")
         .when(F.col("l_returnflag") == "R", "Online").alias("PaymentMethod"),
    )
