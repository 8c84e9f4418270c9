"""Required-field and value-domain checks.

The reference refuses a request when a required form field is missing. Over a
batch, each rule becomes one boolean column expression; one pass tags every
row with the array of rules it breaks, and valid / invalid rows are two filters
of the same tagged frame.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.display import blank_to_null
from ..schemas import (BILL_STATUSES, CUSTOMER_TYPES, METER_STATUSES, PAYMENT_METHODS)

ERRORS = "Errors"


def missing(c: str) -> Column:
    """JS ``!value`` for a posted form string: absent or blank."""
    return blank_to_null(F.col(c).cast("string")).isNull()


def outside(c: str, allowed) -> Column:
    """Value present but not in the allowed domain."""
    return F.col(c).isNotNull() & ~F.col(c).isin(*allowed)


def required(*cols: str) -> dict[str, Column]:
    return {f"missing {c}": missing(c) for c in cols}


# Rule sets per entity (the fields each reference handler insists on). They are
# functions because Column objects need an active session.
def reading_rules() -> dict[str, Column]:
    return required("MeterID", "ReadingValue", "ReadingDate", "UserID")


def meter_rules() -> dict[str, Column]:
    return {**required("CustomerID", "MeterID", "UtilityID", "Status"),
            "bad Status": outside("Status", METER_STATUSES)}


def tariff_rules() -> dict[str, Column]:
    return required("TariffID", "UtilityID", "TariffName", "Rate")


def customer_rules() -> dict[str, Column]:
    return {**required("CustomerName", "CustomerType", "Phone", "ServiceAddress"),
            "bad CustomerType": outside("CustomerType", CUSTOMER_TYPES)}


def payment_rules() -> dict[str, Column]:
    # an amount of 0 counts as missing, as in the reference's form check
    return {**required("BillID"), "missing PaymentAmount": missing("PaymentAmount") | (F.col("PaymentAmount") == 0),
            **required("PaymentMethod"),
            "bad PaymentMethod": outside("PaymentMethod", PAYMENT_METHODS)}


def bill_rules() -> dict[str, Column]:
    return {"bad Status": outside("Status", BILL_STATUSES)}


def tag_errors(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Add ``Errors``: the names of the broken rules (empty array = valid)."""
    checks = [F.when(pred, F.lit(name)) for name, pred in rules.items()]
    return df.withColumn(ERRORS, F.array_compact(F.array(*checks)))


def split_valid(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    tagged = tag_errors(df, rules)
    ok = F.size(ERRORS) == 0
    return tagged.where(ok).drop(ERRORS), tagged.where(~ok)


def validation_report(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """P7 per row: key, Valid, the first broken rule (rule order) and how many broke."""
    tagged = tag_errors(df, rules)
    return tagged.select(key, (F.size(ERRORS) == 0).alias("Valid"),
                         F.try_element_at(F.col(ERRORS), F.lit(1)).alias("FirstError"),
                         F.size(ERRORS).cast("int").alias("ErrorCount"))


def rule_counts(entity: str, df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Number of rows breaking each rule, one aggregate pass over ``df``."""
    aggs = [F.sum(F.when(pred, 1).otherwise(0)).cast("bigint").alias(f"r{i}")
            for i, pred in enumerate(rules.values())]
    wide = df.agg(*aggs)
    pairs = ", ".join(f"'{name}', r{i}" for i, name in enumerate(rules))
    long = wide.selectExpr(f"stack({len(rules)}, {pairs}) AS (Rule, Violations)")
    return long.select(F.lit(entity).alias("Entity"), "Rule", "Violations")
