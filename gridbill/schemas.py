"""Explicit schemas of the billing entities (no inference anywhere)."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)
# Report money columns are widened to one type so Spark and other engines agree.
REPORT_MONEY = T.DecimalType(18, 2)

UTILITY_TYPE = T.StructType([
    T.StructField("UtilityID", T.StringType(), False),
    T.StructField("UtilityName", T.StringType(), False),
    T.StructField("Unit", T.StringType(), False),
])

TARIFF = T.StructType([
    T.StructField("TariffID", T.StringType(), False),
    T.StructField("UtilityID", T.StringType(), False),
    T.StructField("TariffName", T.StringType(), False),
    T.StructField("Rate", MONEY, False),
    T.StructField("MinUnits", T.IntegerType(), True),
    T.StructField("MaxUnits", T.IntegerType(), True),
    T.StructField("FixedCharge", MONEY, True),
])

CUSTOMER = T.StructType([
    T.StructField("CustomerID", T.StringType(), False),
    T.StructField("CustomerName", T.StringType(), True),
    T.StructField("CustomerType", T.StringType(), True),
    T.StructField("Email", T.StringType(), True),
    T.StructField("Phone", T.StringType(), True),
    T.StructField("ServiceAddress", T.StringType(), True),
    T.StructField("BillingAddress", T.StringType(), True),
    T.StructField("RegistrationDate", T.DateType(), True),
])

METER = T.StructType([
    T.StructField("MeterID", T.StringType(), False),
    T.StructField("CustomerID", T.StringType(), True),
    T.StructField("UtilityID", T.StringType(), True),
    T.StructField("Status", T.StringType(), True),
    T.StructField("Location", T.StringType(), True),
    T.StructField("InstallDate", T.DateType(), True),
])

METER_READING = T.StructType([
    T.StructField("ReadingID", T.LongType(), False),
    T.StructField("MeterID", T.StringType(), True),
    T.StructField("UserID", T.StringType(), True),
    T.StructField("ReadingValue", MONEY, True),
    T.StructField("ReadingDate", T.DateType(), True),
    T.StructField("Notes", T.StringType(), True),
])

BILL = T.StructType([
    T.StructField("BillID", T.StringType(), False),
    T.StructField("CustomerID", T.StringType(), True),
    T.StructField("MeterID", T.StringType(), True),
    T.StructField("ReadingID", T.LongType(), True),
    T.StructField("TariffID", T.StringType(), True),
    T.StructField("BillDate", T.DateType(), True),
    T.StructField("DueDate", T.DateType(), True),
    T.StructField("PreviousReadingValue", MONEY, True),
    T.StructField("CurrentReadingValue", MONEY, True),
    T.StructField("Consumption", MONEY, True),
    T.StructField("AmountDue", MONEY, True),
    T.StructField("Status", T.StringType(), True),
])

PAYMENT = T.StructType([
    T.StructField("PaymentID", T.StringType(), False),
    T.StructField("BillID", T.StringType(), True),
    T.StructField("UserID", T.StringType(), True),
    T.StructField("PaymentAmount", MONEY, True),
    T.StructField("PaymentDate", T.TimestampNTZType(), True),
    T.StructField("PaymentMethod", T.StringType(), True),
])

ENTITY_SCHEMAS: dict[str, T.StructType] = {
    "utility_type": UTILITY_TYPE,
    "tariff": TARIFF,
    "customer": CUSTOMER,
    "meter": METER,
    "meter_reading": METER_READING,
    "bill": BILL,
    "payment": PAYMENT,
}

# Fixed value domains of the reference's forms and status columns.
CUSTOMER_TYPES = ("Household", "Business", "Government")
METER_STATUSES = ("Active", "Pending Install", "Inactive")
BILL_STATUSES = ("Unpaid", "Overdue", "Paid")
OPEN_BILL_STATUSES = ("Unpaid", "Overdue")
PAYMENT_METHODS = ("Cash", "Card", "Online")
UNITS = ("kWh", "m3", "unit")
