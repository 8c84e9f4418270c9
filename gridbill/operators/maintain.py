"""Table maintenance as batch snapshot transforms.

Plain Parquet has no MERGE or DELETE, so each operator returns new snapshot
frames (to be written to a *new* path, never over the one being read) and an
audit frame. All key matching is done with semi / anti / left joins, so key
sets of any size work and nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.display import blank_to_null
from ..functions.timewin import DateLike, to_date
from ..schemas import CUSTOMER, METER, METER_READING, MONEY, TARIFF
from ..sources.tables import Tables
from .aggregates import tariff_bill_counts
from .bitmaps import id_bitmaps, with_bit
from .common import flagged, key_join, present_keys
from .validate import ERRORS, customer_rules, meter_rules, missing, reading_rules, tag_errors, tariff_rules
from .windows import freeze, numbered

OUTCOME = "Outcome"


def _first_error() -> Column:
    return F.try_element_at(F.col("Errors"), F.lit(1))


def _check_batch(batch: DataFrame, rules: Mapping[str, Column], key: str | None,
                 existing: DataFrame, fks: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """Tag each batch row with the first reason it is refused, or ``accepted``.

    Order: required fields / domains, then duplicate key (already stored or
    repeated in the batch), then each foreign key. A NULL key is refused by the
    entity's rules. Every lookup is a join against distinct keys in parts, so a
    key repeated in a third of the batch, or a parent of a third of it, stays spread.
    """
    tagged = tag_errors(batch, rules)
    reason = _first_error()
    if key is not None:
        tagged = flagged(tagged, present_keys(existing, key, batch), key, "_stored", counted=batch)
        repeats = (batch.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
                   .where(F.col("_n") > 1).select(key))
        tagged = flagged(tagged, repeats, key, "_dup_batch", counted=batch)
        reason = F.coalesce(reason,
                            F.when(F.col("_stored"), F.lit(f"duplicate {key}")),
                            F.when(F.col("_dup_batch"), F.lit(f"repeated {key}")))
    for i, (col, parent, parent_key) in enumerate(fks):
        flag = f"_fk{i}"
        p = present_keys(parent, parent_key, batch, probe_key=col, alias=col)
        tagged = flagged(tagged, p, col, flag, counted=batch)
        reason = F.coalesce(reason, F.when(F.col(col).isNotNull() & ~F.col(flag), F.lit(f"unknown {col}")))
    return tagged.withColumn(OUTCOME, F.coalesce(reason, F.lit("accepted")))


@dataclass
class Append:
    checked: DataFrame   # every row of the batch and its Outcome
    accepted: DataFrame  # the rows to store
    refused: DataFrame   # the others, with Outcome
    snapshot: DataFrame  # stored rows and accepted rows


def appended(existing: DataFrame, checked: DataFrame) -> Append:
    """What a checked batch makes of a stored table. ``checked`` is stored first by the
    caller when several of the frames are used, as each is a filter of it."""
    accepted = checked.where(F.col(OUTCOME) == "accepted").select(*existing.columns)
    return Append(checked, accepted, checked.where(F.col(OUTCOME) != "accepted"), existing.unionByName(accepted))


def append_customers(existing: DataFrame, batch: DataFrame, as_of: DateLike) -> DataFrame:
    """S2 addCustomer: default RegistrationDate = as_of; reject missing fields,
    bad CustomerType and ids already stored or repeated in the batch.

    A row without a CustomerID gets one from a hash of its content, so the same
    sign-up sent again (in this batch or a later one) is refused, not stored twice.
    """
    b = batch
    for c, kind in (("CustomerID", "string"), ("RegistrationDate", "date"), ("Email", "string"), ("BillingAddress", "string")):
        if c not in b.columns:
            b = b.withColumn(c, F.lit(None).cast(kind))
    b = b.withColumn("RegistrationDate", F.coalesce("RegistrationDate", F.lit(to_date(as_of))))
    said = ("CustomerName", "CustomerType", "Email", "Phone", "ServiceAddress", "BillingAddress")
    content = F.concat_ws("\x1f", *[F.coalesce(F.col(c), F.lit("")) for c in said])
    minted = F.concat(F.lit("CUST-X"), F.sha2(content, 256).substr(1, 20))
    b = b.withColumn("CustomerID", F.coalesce(blank_to_null("CustomerID"), minted))
    b = b.select(*[f.name for f in CUSTOMER.fields])
    checked = _check_batch(b, customer_rules(), "CustomerID", existing, [])
    return checked.select(*[f.name for f in CUSTOMER.fields], OUTCOME)


def append_meters(existing: DataFrame, batch: DataFrame, customers: DataFrame,
                  utilities: DataFrame, as_of: DateLike) -> DataFrame:
    """S2 addMeter: default InstallDate = as_of; customer and utility must exist."""
    b = batch
    if "InstallDate" not in b.columns:
        b = b.withColumn("InstallDate", F.lit(None).cast("date"))
    b = b.withColumn("InstallDate", F.coalesce("InstallDate", F.lit(to_date(as_of))))
    b = b.select(*[f.name for f in METER.fields])
    checked = _check_batch(b, meter_rules(), "MeterID", existing,
                           [("CustomerID", customers, "CustomerID"), ("UtilityID", utilities, "UtilityID")])
    return checked.select(*[f.name for f in METER.fields], OUTCOME)


def append_tariffs(existing: DataFrame, batch: DataFrame, utilities: DataFrame) -> DataFrame:
    """S2 addTariff: MinUnits = FixedCharge = 0 and MaxUnits NULL unless given."""
    b = batch
    defaults = {"MinUnits": F.lit(0), "MaxUnits": F.lit(None).cast("int"),
                "FixedCharge": F.lit(0).cast(MONEY)}
    for c, v in defaults.items():
        b = b.withColumn(c, F.coalesce(F.col(c), v) if c in b.columns else v)
    b = b.select(*[F.col(f.name).cast(f.dataType) for f in TARIFF.fields])
    checked = _check_batch(b, tariff_rules(), "TariffID", existing,
                           [("UtilityID", utilities, "UtilityID")])
    return checked.select(*[f.name for f in TARIFF.fields], OUTCOME)


def append_readings(batch: DataFrame, meters: DataFrame, after_id: int = 0) -> DataFrame:
    """S2 submitReading for a batch: every submission is kept, equal ones too.

    Accepted rows get ReadingID ``after_id`` + 1, + 2, ... in the order of their
    content (bigint, unique, the same for the same batch); refused rows have none. The
    caller gives ``after_id`` (the highest id handed out so far, or a range of
    its own per batch), so no history is scanned. The checked batch is frozen once:
    accepted and refused rows are two filters of it.
    """
    b = batch.select(
        "MeterID", "UserID", F.col("ReadingValue").cast(MONEY).alias("ReadingValue"),
        F.col("ReadingDate").cast("date").alias("ReadingDate"),
        F.nullif(F.col("Notes"), F.lit("")).alias("Notes") if "Notes" in batch.columns
        else F.lit(None).cast("string").alias("Notes"))
    tagged = flagged(tag_errors(b, reading_rules()), present_keys(meters, "MeterID", b), "MeterID", "_known", counted=b)
    reason = F.coalesce(_first_error(), F.when(~F.col("_known"), F.lit("unknown MeterID")), F.lit("accepted"))
    order = ["MeterID", "ReadingDate", "ReadingValue", "UserID", "Notes"]
    checked = freeze(tagged.select(*order, reason.alias(OUTCOME)))
    ids = numbered(checked.where(F.col(OUTCOME) == "accepted").select(*order), "_n")
    accepted = ids.select((F.lit(after_id).cast("bigint") + F.col("_n")).alias("ReadingID"), *order,
                          F.lit("accepted").alias(OUTCOME))
    refused = checked.where(F.col(OUTCOME) != "accepted").withColumn("ReadingID", F.lit(None).cast("bigint"))
    cols = [f.name for f in METER_READING.fields] + [OUTCOME]
    return accepted.select(*cols).unionByName(refused.select(*cols))


# ------------------------------------------------------------------------- M1
def _latest(updates: DataFrame, key: str, columns: Sequence[str], seq: str) -> DataFrame:
    """One update per key: the highest ``seq`` (NULL lowest), ties to the largest values."""
    u = F.struct(*columns)
    return (updates.where(F.col(key).isNotNull()).groupBy(key)
            .agg(F.max(F.struct(F.coalesce(F.col(seq).cast("bigint"), F.lit(-(2**63))).alias("_s"), u.alias("_u"))).alias("_m"))
            .select(key, F.col("_m._u").alias("_u")))


def apply_updates(existing: DataFrame, updates: DataFrame, key: str, columns: Sequence[str],
                  seq: str = "seq", rules: Mapping[str, Column] | None = None) -> DataFrame:
    """M1: overwrite ``columns`` for matching keys with the latest update (highest
    ``seq``); other columns and unmatched rows are unchanged. Adds ``Updated``.

    Updates that break one of ``rules`` are not applied (see ``update_outcomes``).
    """
    cols = list(columns)
    if rules:
        updates = tag_errors(updates, rules).where(F.size(ERRORS) == 0)
    latest = _latest(updates, key, cols, seq)
    j = existing.join(latest, key, "left")
    hit = F.col("_u").isNotNull()
    out = [F.col(key)] + [
        (F.when(hit, F.col("_u")[c]).otherwise(F.col(c)) if c in cols else F.col(c)).alias(c)
        for c in existing.columns if c != key]
    return j.select(*out, hit.alias("Updated"))


def update_outcomes(existing: DataFrame, updates: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """M1: one row per update with its Outcome: the first rule it breaks (a missing key
    included), 'not found', or 'updated' (a later update of the key may still win)."""
    checked = flagged(tag_errors(updates, {f"missing {key}": missing(key), **rules}), present_keys(existing, key, updates), key, "_stored", counted=updates)
    outcome = F.coalesce(_first_error(), F.when(~F.col("_stored"), F.lit("not found")), F.lit("updated"))
    return checked.withColumn(OUTCOME, outcome).select(*updates.columns, OUTCOME)


# ---------------------------------------------------------------------- M2-M4
@dataclass
class Cascade:
    customer: DataFrame | None
    meter: DataFrame
    meter_reading: DataFrame
    bill: DataFrame
    payment: DataFrame
    audit: DataFrame


def _audit(parts: Sequence[tuple[str, DataFrame, DataFrame, str]]) -> DataFrame:
    """Deleted / Remaining per entity. Each table is read once and counted per key before
    it meets the doomed keys, so a key with many rows is one row in the join."""
    rows = []
    for name, table, gone, key in parts:
        per_key = table.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        j = per_key.join(gone.select(key).distinct().withColumn("_gone", F.lit(True)), key, "left")
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
        rows.append(j.agg(total("_n").alias("_all"), total(F.when(F.col("_gone"), F.col("_n"))).alias("_del")).select(
            F.lit(name).alias("Entity"), F.col("_del").alias("Deleted"), (F.col("_all") - F.col("_del")).alias("Remaining")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def delete_outcomes(existing: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """M2/M3: for each distinct key asked for, 'deleted' or 'not found'."""
    k = keys.select(key).where(F.col(key).isNotNull()).distinct()
    stored = present_keys(existing, key, k).withColumn("_stored", F.lit(True))
    return k.join(stored, key, "left").select(
        key, F.when(F.col("_stored").isNotNull(), F.lit("deleted")).otherwise(F.lit("not found")).alias(OUTCOME))


def delete_customers(t: Tables, keys: DataFrame) -> Cascade:
    """M2: delete customers and, first, their payments, bills, readings and meters.
    Bills are chosen by CustomerID."""
    k = keys.select("CustomerID").where(F.col("CustomerID").isNotNull()).distinct()
    bills_gone = key_join(t.bill.select("BillID", "CustomerID"), k, "CustomerID").select("BillID")
    meters_gone = key_join(t.meter.select("MeterID", "CustomerID"), k, "CustomerID").select("MeterID")
    payment = key_join(t.payment, bills_gone, "BillID", "left_anti")
    bill = key_join(t.bill, k, "CustomerID", "left_anti")
    reading = key_join(t.meter_reading, meters_gone, "MeterID", "left_anti")
    meter = key_join(t.meter, k, "CustomerID", "left_anti")
    customer = t.customer.join(k, "CustomerID", "left_anti")
    audit = _audit([("Payment", t.payment, bills_gone, "BillID"), ("Bill", t.bill, k, "CustomerID"),
                    ("Meter_Reading", t.meter_reading, meters_gone, "MeterID"),
                    ("Meter", t.meter, k, "CustomerID"), ("Customer", t.customer, k, "CustomerID")])
    return Cascade(customer, meter, reading, bill, payment, audit)


def delete_meters(t: Tables, keys: DataFrame) -> Cascade:
    """M3: delete meters with their readings, the bills of those readings (chosen
    through ReadingID, so a bill without a reading survives) and their payments."""
    k = keys.select("MeterID").where(F.col("MeterID").isNotNull()).distinct()
    readings_gone = key_join(t.meter_reading.select("ReadingID", "MeterID"), k, "MeterID").select("ReadingID")
    on_bills = with_bit(t.bill.select("BillID", "ReadingID"), "ReadingID", id_bitmaps(readings_gone, "ReadingID", dense=False), "_gone")
    bills_gone = on_bills.where("_gone").select("BillID")
    payment = key_join(t.payment, bills_gone, "BillID", "left_anti")
    bill = t.bill.join(bills_gone, "BillID", "left_anti")
    reading = key_join(t.meter_reading, k, "MeterID", "left_anti")
    meter = t.meter.join(k, "MeterID", "left_anti")
    audit = _audit([("Payment", t.payment, bills_gone, "BillID"), ("Bill", t.bill, bills_gone, "BillID"),
                    ("Meter_Reading", t.meter_reading, k, "MeterID"), ("Meter", t.meter, k, "MeterID")])
    return Cascade(None, meter, reading, bill, payment, audit)


def delete_tariffs(t: Tables, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M4: delete tariffs no bill uses. Returns (new tariff snapshot, outcome per key:
    'deleted' / 'blocked' with the number of bills / 'not found')."""
    k = keys.select("TariffID").distinct()
    counts = tariff_bill_counts(t).select("TariffID", "BillCount", F.lit(True).alias("_exists"))
    res = k.join(counts, "TariffID", "left").select(
        "TariffID",
        F.when(F.col("_exists").isNull(), F.lit("not found"))
         .when(F.col("BillCount") > 0, F.lit("blocked")).otherwise(F.lit("deleted")).alias(OUTCOME),
        F.coalesce("BillCount", F.lit(0).cast("bigint")).alias("BillCount"))
    gone = res.where(F.col(OUTCOME) == "deleted").select("TariffID")
    return t.tariff.join(gone, "TariffID", "left_anti"), res
