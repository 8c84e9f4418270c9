"""One small literal-frame test per semantic trap (FIXTURES.md section 4)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

import pytest

from pyspark.sql import functions as F

from gridbill.functions import display, formatting
from gridbill.operators import aggregates as A
from gridbill.operators import billing as B
from gridbill.operators import joins as J
from gridbill.operators import lookup as L
from gridbill.operators import maintain as M
from gridbill.operators import rating as R
from gridbill.operators import windows as W

AS_OF = dt.datetime(2025, 11, 20, 9, 0)


def _cust(i):
    return {"CustomerID": f"C{i}", "CustomerName": f"N{i}", "CustomerType": "Household",
            "Phone": "07", "ServiceAddress": f"Addr{i}"}


def _meter(i, util="UTIL-01", status="Active", location="Block 1"):
    return {"MeterID": f"M{i}", "CustomerID": f"C{i}", "UtilityID": util, "Status": status,
            "Location": location}


def test_t2_payment_on_last_day_is_included(tables):
    t = tables(payment=[{"PaymentID": "P1", "BillID": "B1", "PaymentAmount": D("5.00"),
                         "PaymentDate": dt.datetime(2025, 11, 5, 10, 0), "PaymentMethod": "Cash"}])
    assert L.payment_log(t, "2025-11-01", "2025-11-05").count() == 1
    assert A.revenue_grand_total(t, "2025-11-05", "2025-11-05").first()[0] == D("5.00")


def test_t3_not_in_with_null(spark, tables):
    t = tables(bill=[{"BillID": "B1", "ReadingID": 1, "AmountDue": D(1)}, {"BillID": "B2", "ReadingID": None}],
               meter_reading=[{"ReadingID": 1, "MeterID": "M1"}, {"ReadingID": 2, "MeterID": "M1"}],
               meter=[_meter(1)])
    assert [r.ReadingID for r in J.unbilled_readings(t).collect()] == [2]
    assert J.unbilled_readings(t, strict_not_in=True).count() == 0


def test_t4_trend_window_spans_seven_months_and_has_no_upper_bound(tables):
    pays, bills = [], [{"BillID": "B1", "MeterID": "M1", "CustomerID": "C1"}]
    for k, month in enumerate([5, 6, 7, 8, 9, 10, 11, 12]):
        pays.append({"PaymentID": f"P{k}", "BillID": "B1", "PaymentAmount": D("1.00"),
                     "PaymentDate": dt.datetime(2025, month, 3), "PaymentMethod": "Cash"})
    pays.append({"PaymentID": "old", "BillID": "B1", "PaymentAmount": D("1.00"),
                 "PaymentDate": dt.datetime(2025, 4, 30), "PaymentMethod": "Cash"})
    t = tables(payment=pays, bill=bills, meter=[_meter(1)], customer=[_cust(1)])
    rows = A.revenue_trends(t, AS_OF).collect()
    assert [r.Month for r in rows][0] == "May 2025"
    assert len(rows) == 8
    assert all(r.Electricity == D("1.00") and r.TotalRevenue == D("1.00") for r in rows)


def test_t5_last_30_days(tables):
    d0 = AS_OF.date()
    bills = [{"BillID": f"B{n}", "CustomerID": "C1", "MeterID": "M1", "Consumption": D(n),
              "BillDate": d0 - dt.timedelta(days=n)} for n in (29, 30, 31)]
    t = tables(bill=bills, customer=[_cust(1)], meter=[_meter(1)])
    rows = A.consumption_last_days(t, AS_OF, 30).collect()
    assert [r.TotalConsumption for r in rows] == [D("29.00")]


def test_t6_rank_has_gaps(spark):
    df = spark.createDataFrame([("a", 50), ("b", 50), ("c", 40)], "k string, v int")
    got = {r.k: r.Rank for r in W.global_rank(df, "v").collect()}
    assert got == {"a": 1, "b": 1, "c": 3}


def test_t8_n0_rounds_half_away_from_zero(spark):
    df = spark.createDataFrame([(D("2.50"), "kWh"), (D("1234567.5"), "m3")], "x decimal(12,2), u string")
    got = [r[0] for r in df.select(formatting.quantity_text("x", "u")).collect()]
    assert got == ["3 kWh", "1,234,568 m3"]
    parsed = [r[0] for r in df.select(formatting.parse_quantity(formatting.quantity_text("x", "u"))).collect()]
    assert parsed == [D("3.00"), D("1234568.00")]


def test_t9_pending_counts_unpaid_only(tables):
    t = tables(customer=[_cust(1)], meter=[_meter(1)],
               bill=[{"BillID": "B1", "CustomerID": "C1", "AmountDue": D(10), "Status": "Unpaid"},
                     {"BillID": "B2", "CustomerID": "C1", "AmountDue": D(5), "Status": "Overdue"}])
    assert A.dashboard_stats(t, AS_OF).first().billsPending == 1
    d = A.defaulters(t).first()
    assert (d.UnpaidBills, d.TotalDue) == (2, D("15.00"))


def test_t10_grand_total_reads_payment_alone(tables):
    t = tables(payment=[{"PaymentID": "P1", "BillID": "NOPE", "PaymentAmount": D("7.00"),
                         "PaymentDate": dt.datetime(2025, 11, 5), "PaymentMethod": "Cash"}])
    assert A.revenue_by_day(t, "2025-11-01", "2025-11-30").count() == 0
    assert A.revenue_grand_total(t, "2025-11-01", "2025-11-30").first()[0] == D("7.00")
    assert A.revenue_grand_total(t, "2020-01-01", "2020-01-02").first()[0] is None


def test_t11_billing_run_fills_consumption(tables):
    t = tables(customer=[_cust(1)], meter=[_meter(1, util="UTIL-02")],
               meter_reading=[{"ReadingID": 1, "MeterID": "M1", "ReadingValue": D(100), "ReadingDate": dt.date(2025, 10, 1)},
                              {"ReadingID": 2, "MeterID": "M1", "ReadingValue": D(130), "ReadingDate": dt.date(2025, 11, 1)}],
               bill=[{"BillID": "B1", "ReadingID": 1, "CustomerID": "C1", "MeterID": "M1", "AmountDue": D(0)}])
    rows = B.billing_run(t, "2025-11-02").collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.ReadingID, r.PreviousReadingValue, r.Consumption, r.AmountDue) == (2, D("100.00"), D("30.00"), D("600.00"))
    assert (r.Status, r.DueDate, r.TariffID) == ("Unpaid", dt.date(2025, 11, 16), "WATR-01")


def test_t12_ledger_fan_out(tables):
    t = tables(bill=[{"BillID": "B1", "BillDate": dt.date(2025, 1, 1)}, {"BillID": "B2", "BillDate": dt.date(2025, 2, 1)}],
               payment=[{"PaymentID": f"P{i}", "BillID": "B1", "PaymentDate": dt.datetime(2025, 1, i + 2)} for i in range(2)])
    rows = J.billing_ledger(t).collect()
    assert len(rows) == 3 and rows[0].BillID == "B2" and rows[0].PaymentDate is None


def test_t13_first_tariff_tie_breaks_on_id(spark, tables):
    t = tables(tariff=spark.createDataFrame(
        [("Z", "U", "z", D(2), 0, None, D(0)), ("A", "U", "a", D(1), 0, None, D(0)),
         ("N", "V", "n", D(3), None, None, D(0)), ("M", "V", "m", D(4), 0, None, D(0))],
        "TariffID string, UtilityID string, TariffName string, Rate decimal(10,2), MinUnits int, "
        "MaxUnits int, FixedCharge decimal(10,2)"))
    got = {r.UtilityID: r.BaseTariffID for r in R.base_tariff(t.tariff).collect()}
    assert got == {"U": "A", "V": "N"}  # a NULL MinUnits sorts first


def test_t14_lag_default_only_without_previous_row(spark):
    df = spark.createDataFrame(
        [(1, "M", dt.date(2025, 1, 1), None), (2, "M", dt.date(2025, 1, 2), D(5)), (3, "M", dt.date(2025, 1, 3), D(7))],
        "ReadingID int, MeterID string, ReadingDate date, ReadingValue decimal(10,2)")
    got = [r.PreviousReadingValue for r in R.reading_deltas(df).orderBy("ReadingID").collect()]
    assert got == [D("0.00"), None, D("5.00")]


def test_t15_negative_consumption_is_flagged(tables):
    t = tables(meter=[_meter(1)], meter_reading=[
        {"ReadingID": 1, "MeterID": "M1", "ReadingValue": D(100), "ReadingDate": dt.date(2025, 1, 1)},
        {"ReadingID": 2, "MeterID": "M1", "ReadingValue": D(90), "ReadingDate": dt.date(2025, 1, 2)}])
    r = R.reading_consumption(t).where("ReadingID = 2").first()
    assert (r.Consumption, r.IsNegative) == (D("-10.00"), True)


def test_t17_blank_location_falls_back(spark):
    df = spark.createDataFrame([("", "Main St", "Pending Install"), (None, "B", "Active"), ("Lot", "C", "Inactive")],
                               "Location string, ServiceAddress string, Status string")
    got = df.select(display.fallback("Location", "ServiceAddress"), display.status_slug("Status")).collect()
    assert [tuple(r) for r in got] == [("Main St", "pending-install"), ("B", "active"), ("Lot", "inactive")]
    labels = spark.createDataFrame([(0, 60), (120, None), (5, 0)], "a int, b int").select(
        display.slab_label("a", "b")).collect()
    assert [r[0] for r in labels] == ["0 - 60", "120 - Above", "5 - Above"]


def test_b3_slab_amounts(spark, tables):
    cons = spark.createDataFrame(
        [(i, f"M{i}", f"C{i}", "UTIL-01", D(c)) for i, c in enumerate([0, 60, 61, 150])],
        "ReadingID int, MeterID string, CustomerID string, UtilityID string, Consumption decimal(12,2)")
    got = [r.SlabAmount for r in R.slab_rating(tables(), cons).orderBy("ReadingID").collect()]
    assert got == [D("100.00"), D("1900.00"), D("1945.00"), D("6400.00")]


@pytest.mark.parametrize("most", [0, 100])
def test_b5_faulty_keys_few_or_many(spark, tables, monkeypatch, most):
    """The batch meets only its faulty keys; sent to every task or shuffled, the reasons are the same."""
    from gridbill.operators import common as C

    monkeypatch.setattr(C, "FEW_KEYS", most)
    asked = []
    monkeypatch.setattr(B, "frozen_key_join", lambda left, keys, on, *a, **k: asked.append((on, keys.count())) or C.frozen_key_join(left, keys, on, *a, **k))
    pay = lambda p, b: (p, b, "U", D("5.00"), "Cash")
    t = tables(bill=[{"BillID": f"B{i}", "AmountDue": D("9.00"), "Status": "Unpaid"} for i in range(9)],
               payment=[{"PaymentID": p, "BillID": "B1", "PaymentAmount": D("5.00")} for p in ("P1", "P1", "P9")])
    rows = [pay("P1", "B1"), pay("P2", "B2"), pay("P2", "B3"), pay("P3", "none"), pay("P4", None), pay("P5", "B1"), pay("P6", "B6"), pay(None, "B7")]
    r = B.post_payments(t, spark.createDataFrame(rows, "PaymentID string, BillID string, UserID string, PaymentAmount decimal(10,2), PaymentMethod string"), AS_OF, batch_id="b")
    assert sorted((x.PaymentID, x.BillID, x.Reason) for x in r.rejected.where("BillID IS NOT NULL").collect()) == [
        ("P1", "B1", "duplicate PaymentID"), ("P2", "B2", "repeated PaymentID"), ("P2", "B3", "repeated PaymentID"), ("P3", "none", "unknown bill")]
    assert [x.Reason for x in r.rejected.where("BillID IS NULL").collect()] == ["missing BillID"]
    assert sorted(x.PaymentID for x in r.accepted.collect()) == ["P5", "P6", "PAY-b-1"]
    assert sorted(tuple(x) for x in r.settled.collect()) == [("B1", D("9.00"), D("20.00"), "Paid"), ("B6", D("9.00"), D("5.00"), "Unpaid"), ("B7", D("9.00"), D("5.00"), "Unpaid")]
    assert asked == [("BillID", 1), ("PaymentID", 2)]


def test_b5_post_payments(spark, tables):
    t = tables(bill=[{"BillID": "B1", "AmountDue": D(100), "Status": "Unpaid"}])
    batch1 = spark.createDataFrame([("B1", D(40), "Cash"), ("NOPE", D(1), "Card"), ("B1", None, "Cash")],
                                   "BillID string, PaymentAmount decimal(10,2), PaymentMethod string")
    r1 = B.post_payments(t, batch1, AS_OF, cashier="U-003")
    assert r1.bills.first().Status == "Unpaid"
    assert sorted(r.Reason for r in r1.rejected.collect()) == ["missing PaymentAmount", "unknown bill"]
    t2 = t.replace(bill=r1.bills, payment=r1.payments)
    batch2 = spark.createDataFrame([("B1", D(60), "Online")], "BillID string, PaymentAmount decimal(10,2), PaymentMethod string")
    r2 = B.post_payments(t2, batch2, AS_OF, cashier="U-003")
    assert r2.bills.first().Status == "Paid"
    assert r2.paid.first().PaidTotal == D("100.00")


def test_m3_bill_without_reading_survives(tables):
    t = tables(meter=[_meter(1)], meter_reading=[{"ReadingID": 1, "MeterID": "M1"}],
               bill=[{"BillID": "B1", "MeterID": "M1", "ReadingID": 1}, {"BillID": "B2", "MeterID": "M1", "ReadingID": None}],
               payment=[{"PaymentID": "P1", "BillID": "B1"}, {"PaymentID": "P2", "BillID": "B2"}])
    c = M.delete_meters(t, t.meter.select("MeterID"))
    assert [r.BillID for r in c.bill.collect()] == ["B2"]
    assert [r.PaymentID for r in c.payment.collect()] == ["P2"]
    audit = {r.Entity: (r.Deleted, r.Remaining) for r in c.audit.collect()}
    assert audit == {"Payment": (1, 1), "Bill": (1, 1), "Meter_Reading": (1, 0), "Meter": (1, 0)}


def test_m4_tariff_in_use_is_blocked(spark, tables):
    t = tables(bill=[{"BillID": f"B{i}", "TariffID": "GAS-01"} for i in range(2)])
    keys = spark.createDataFrame([("GAS-01",), ("WATR-02",), ("NOPE",)], "TariffID string")
    snap, res = M.delete_tariffs(t, keys)
    got = {r.TariffID: (r.Outcome, r.BillCount) for r in res.collect()}
    assert got == {"GAS-01": ("blocked", 2), "WATR-02": ("deleted", 0), "NOPE": ("not found", 0)}
    assert "WATR-02" not in {r.TariffID for r in snap.collect()}


def test_m2_cascade_leaves_no_orphans(tables):
    t = tables(customer=[_cust(1), _cust(2)], meter=[_meter(1), _meter(2)],
               meter_reading=[{"ReadingID": 1, "MeterID": "M1"}, {"ReadingID": 2, "MeterID": "M2"}],
               bill=[{"BillID": "B1", "CustomerID": "C1", "ReadingID": 1}, {"BillID": "B2", "CustomerID": "C2", "ReadingID": 2}],
               payment=[{"PaymentID": "P1", "BillID": "B1"}, {"PaymentID": "P2", "BillID": "B2"}])
    c = M.delete_customers(t, t.customer.where("CustomerID = 'C1'"))
    assert c.payment.join(c.bill, "BillID", "left_anti").count() == 0
    assert c.meter_reading.join(c.meter, "MeterID", "left_anti").count() == 0
    assert c.meter.join(c.customer, "CustomerID", "left_anti").count() == 0
    assert {r.CustomerID for r in c.customer.collect()} == {"C2"}


def test_m1_latest_update_wins(spark, tables):
    t = tables(meter=[_meter(1), _meter(2)])
    upd = spark.createDataFrame([("M1", "Inactive", 1), ("M1", "Pending Install", 2), ("M9", "Active", 1)],
                                "MeterID string, Status string, seq int")
    got = {r.MeterID: (r.Status, r.Updated, r.Location)
           for r in M.apply_updates(t.meter, upd, "MeterID", ["Status"]).collect()}
    assert got == {"M1": ("Pending Install", True, "Block 1"), "M2": ("Active", False, "Block 1")}


def test_s2_append_readings(spark, tables):
    t = tables(meter=[_meter(1)])
    batch = spark.createDataFrame(
        [("M1", "U", D(1), dt.date(2025, 1, 1), None), ("M1", "U", D(2), dt.date(2025, 1, 2), ""),
         ("M1", "U", D(2), dt.date(2025, 1, 2), None), ("M9", "U", D(3), dt.date(2025, 1, 3), None),
         ("M1", None, D(4), dt.date(2025, 1, 4), None)],
        "MeterID string, UserID string, ReadingValue decimal(10,2), ReadingDate date, Notes string")
    top = 2**31 + 5  # ids are bigint
    got = sorted((r.Outcome, r.ReadingID) for r in M.append_readings(batch, t.meter, top).collect())
    # both equal submissions are kept, each with an id of its own
    assert got == [("accepted", top + 1), ("accepted", top + 2), ("accepted", top + 3), ("missing UserID", None), ("unknown MeterID", None)]


def test_s2_no_null_or_repeated_ids(spark, tables):
    t = tables(customer=[_cust(1)])
    rows = [(None, "A", "Household", "1", "x"), (None, "A", "Household", "1", "x"), (None, "B", "Household", "2", "x"), ("", "C", "Household", "3", "x"), ("C1", "D", "Household", "4", "x")]
    batch = spark.createDataFrame(rows, "CustomerID string, CustomerName string, CustomerType string, Phone string, ServiceAddress string")
    checked = M.append_customers(t.customer, batch, AS_OF)
    got = sorted((r.CustomerName, r.Outcome) for r in checked.collect())
    assert got == [("A", "repeated CustomerID"), ("A", "repeated CustomerID"), ("B", "accepted"), ("C", "accepted"), ("D", "duplicate CustomerID")]
    new = M.appended(t.customer, checked)
    assert new.snapshot.where("CustomerID IS NULL").count() == 0 and new.snapshot.count() == 3 and new.refused.count() == 3
    again = M.append_customers(new.snapshot, batch.where("CustomerName = 'B'"), AS_OF)
    assert again.first().Outcome == "duplicate CustomerID"


def test_b5_rules_ids_and_reposting(spark, tables):
    t = tables(bill=[{"BillID": "B1", "AmountDue": D(5), "Status": "Unpaid"}], payment=[{"PaymentID": "P0", "BillID": "B1", "PaymentAmount": D(1)}])
    rows = [(None, "B1", D(2), "Cash"), (None, "B1", D(2), "Cash"), (None, "B1", D(0), "Cash"), (None, "B1", D(9), "Barter"),
            ("P0", "B1", D(1), "Card"), ("P7", "B1", D(1), "Card"), ("P7", "B1", D(1), "Card")]
    batch = spark.createDataFrame(rows, "PaymentID string, BillID string, PaymentAmount decimal(10,2), PaymentMethod string")
    r = B.post_payments(t, batch, AS_OF, batch_id="b1")
    assert sorted(x.PaymentID for x in r.accepted.collect()) == ["PAY-b1-2", "PAY-b1-3"]
    assert sorted(x.Reason for x in r.rejected.collect()) == ["bad PaymentMethod", "duplicate PaymentID", "missing PaymentAmount", "repeated PaymentID", "repeated PaymentID"]
    assert r.settled.first().PaidTotal == D("5.00") and r.settled.first().Status == "Paid"
    again = B.post_payments(t.replace(payment=r.payments, bill=r.bills), batch, AS_OF, batch_id="b1")
    assert again.accepted.count() == 0 and again.payments.count() == 3


def test_m1_ties_nulls_and_rules(spark, tables):
    from gridbill.operators import validate as V
    t = tables(meter=[_meter(1), _meter(2)])
    upd = spark.createDataFrame([("M1", "Active", None), ("M1", "Inactive", 3), ("M1", "Pending Install", 3), ("M2", "Broken", 9), (None, "Active", 1), ("M9", "Active", 1)],
                                "MeterID string, Status string, seq int")
    full = upd.withColumn("CustomerID", F.lit("C1")).withColumn("UtilityID", F.lit("UTIL-01"))
    got = {r.MeterID: (r.Status, r.Updated) for r in M.apply_updates(t.meter, full, "MeterID", ["Status"], rules=V.meter_rules()).collect()}
    assert got == {"M1": ("Pending Install", True), "M2": ("Active", False)}
    only_null = M.apply_updates(t.meter, full.where("seq IS NULL"), "MeterID", ["Status"]).where("MeterID = 'M1'").first()
    assert only_null.Updated
    outcomes = sorted(r.Outcome for r in M.update_outcomes(t.meter, full, "MeterID", V.meter_rules()).collect())
    assert outcomes == ["bad Status", "missing MeterID", "not found", "updated", "updated", "updated"]


def test_due_date_and_reading_details(spark, tables):
    t = tables(customer=[_cust(1)], meter=[_meter(1)], meter_reading=[
        {"ReadingID": i, "MeterID": "M1", "ReadingValue": D(10 * i), "ReadingDate": dt.date(2025, 1, i)} for i in (1, 2, 3)])
    assert {r.DueDate for r in B.billing_run(t, "2025-02-01", due_date="2025-03-09").collect()} == {dt.date(2025, 3, 9)}
    keys = spark.createDataFrame([(2,), (9,), (None,), (2,)], "ReadingID long")
    got = {r.ReadingID: (r.Found, r.PreviousReadingValue, r.CurrentReadingValue) for r in R.reading_details(t, keys).collect()}
    assert got == {2: (True, D("10.00"), D("20.00")), 9: (False, None, None)}


def test_billing_run_twice_adds_nothing(tables):
    t = tables(customer=[_cust(1)], meter=[_meter(1)], meter_reading=[
        {"ReadingID": i, "MeterID": "M1", "ReadingValue": D(10 * i), "ReadingDate": dt.date(2025, 1, i)} for i in (1, 2, 3)])
    first = B.billing_run(t, "2025-02-01")
    assert first.count() == 3
    t2 = t.replace(bill=t.bill.unionByName(first))
    assert B.billing_run(t2, "2025-02-01").count() == 0
    assert B.double_billed(t2.bill).count() == 0


def test_admin_reports_have_names_and_headings(tables):
    from gridbill.plans import reports
    t = tables(customer=[_cust(1)])
    for kind in reports.ADMIN_REPORTS:
        name, df = reports.titled(reports.admin_report(t, kind), kind)
        assert name and len(df.columns) == len(reports.ADMIN_TITLES[kind][1])
    assert reports.titled(reports.admin_report(t, "new-customers"), "new-customers")[1].columns[0] == "Customer ID"


def test_unknown_report_type_raises(tables):
    import pytest

    from gridbill.plans import reports
    with pytest.raises(ValueError):
        reports.admin_report(tables(), "nope")
    with pytest.raises(ValueError):
        reports.manager_report(tables(), "nope", "2025-01-01", "2025-01-02")
    assert reports.manager_report(tables(), "usage", "2025-01-01", "2025-01-02").total is None


def test_top_consumers_rank_within_top_k(spark):
    totals = spark.createDataFrame(
        [("C1", "Ann", "Water", "m3", D(9)), ("C2", "Bo", "Gas", "unit", D(9)), ("C3", "Cy", "Gas", "unit", D(5)),
         ("C4", "Di", "Water", "m3", D(1)), ("C5", "Ed", "Water", "m3", D(0))],
        "CustomerID string, CustomerName string, UtilityName string, Unit string, TotalConsumption decimal(20,2)")
    got = [(r.Rank, r.Label) for r in A.top_consumers(totals, 3).collect()]
    assert got == [(1, "Ann (Water)"), (1, "Bo (Gas)"), (3, "Cy (Gas)")]
    full = {r.CustomerID: r.Rank for r in A.ranked_consumption(totals).collect()}
    assert full == {"C1": 1, "C2": 1, "C3": 3, "C4": 4}


def test_in_month_is_a_range(spark, tables):
    t = tables(payment=[{"PaymentID": "P", "BillID": "B", "PaymentAmount": D(3),
                         "PaymentDate": dt.datetime(2025, 11, 30, 23, 59, 59)}])
    assert A.dashboard_stats(t, AS_OF).first().monthlyRevenue == D("3.00")
    assert A.dashboard_stats(t, dt.date(2025, 12, 1)).first().monthlyRevenue == D("0.00")


def test_m1_update_tariffs_keeps_unlisted_columns(spark, tables):
    t = tables()
    upd = spark.createDataFrame([("ELEC-01", "Domestic low", D("31.00"), "UTIL-01", 5)],
                                "TariffID string, TariffName string, Rate decimal(10,2), UtilityID string, seq int")
    got = {r.TariffID: r for r in M.apply_updates(t.tariff, upd, "TariffID",
                                                   ["TariffName", "UtilityID", "Rate"]).collect()}
    e = got["ELEC-01"]
    assert (e.TariffName, e.Rate, e.MinUnits, e.MaxUnits, e.FixedCharge, e.Updated) == (
        "Domestic low", D("31.00"), 0, 60, D("100.00"), True)
    assert got["GAS-01"].Updated is False and got["GAS-01"].Rate == D("15.50")


def test_split_valid_and_unit_parse(spark):
    from gridbill.operators import validate as V
    df = spark.createDataFrame([("M1", "U1", D(1), dt.date(2025, 1, 1)), ("", "U1", None, dt.date(2025, 1, 1))],
                               "MeterID string, UserID string, ReadingValue decimal(10,2), ReadingDate date")
    ok, bad = V.split_valid(df, V.reading_rules())
    assert ok.count() == 1
    assert bad.first().Errors == ["missing MeterID", "missing ReadingValue"]
    text = spark.createDataFrame([("1,299,000 kWh",)], "t string")
    r = text.select(formatting.parse_quantity("t"), formatting.quantity_unit("t")).first()
    assert (r[0], r[1]) == (D("1299000.00"), "kWh")


def test_slab_amount_is_monotone(spark, tables):
    cons = spark.range(0, 400, 3).select(
        F.col("id").cast("int").alias("ReadingID"), F.lit("M").alias("MeterID"), F.lit("C").alias("CustomerID"),
        F.lit("UTIL-01").alias("UtilityID"), (F.col("id") * F.lit(D("1.37"))).cast("decimal(12,2)").alias("Consumption"))
    amounts = [r.SlabAmount for r in R.slab_rating(tables(), cons).orderBy("Consumption").collect()]
    assert len(amounts) == cons.count()
    assert all(a <= b for a, b in zip(amounts, amounts[1:]))


def test_revenue_detail_sums_to_grand_total(spark):
    from gridbill.sources.tables import Tables
    t = Tables.from_testdata(spark, "/root/testdata/sf0.001")
    # every mapped payment reaches a bill, a meter and a utility, so nothing is lost to the joins
    assert t.payment.join(J.payment_utility_star(t), "PaymentID", "left_anti").count() == 0
    detail = A.revenue_by_day(t, "1990-01-01", "2030-12-31").agg(F.sum("Total")).first()[0]
    total = A.revenue_grand_total(t, "1990-01-01", "2030-12-31").first()[0]
    assert detail == total


def test_billing_run_month_and_customer_subset(spark, tables):
    t = tables(customer=[_cust(1), _cust(2)], meter=[_meter(1), _meter(2, util="UTIL-03")], meter_reading=[
        {"ReadingID": 1, "MeterID": "M1", "ReadingValue": D(10), "ReadingDate": dt.date(2025, 1, 31)},
        {"ReadingID": 2, "MeterID": "M1", "ReadingValue": D(70), "ReadingDate": dt.date(2025, 2, 3)},
        {"ReadingID": 3, "MeterID": "M2", "ReadingValue": D(4), "ReadingDate": dt.date(2025, 2, 4)}])
    rows = B.billing_run_month(t, "2025-02-15").collect()
    got = {r.ReadingID: (r.Consumption, r.AmountDue, r.BillDate) for r in rows}
    # reading 2: 60 kWh after reading 1 (dated in January, so not billed here) -> 1900.00
    assert got == {2: (D("60.00"), D("1900.00"), dt.date(2025, 2, 1)), 3: (D("4.00"), D("62.00"), dt.date(2025, 2, 1))}
    only = spark.createDataFrame([("C2",)], "CustomerID string")
    assert [r.ReadingID for r in B.billing_run_month(t, "2025-02-15", customers=only).collect()] == [3]


def test_manager_report_defaulters_total(tables):
    from gridbill.plans import reports
    t = tables(customer=[_cust(1), _cust(2)], bill=[
        {"BillID": "B1", "CustomerID": "C1", "AmountDue": D(10), "Status": "Unpaid", "BillDate": dt.date(2025, 1, 5)},
        {"BillID": "B2", "CustomerID": "C2", "AmountDue": D(5), "Status": "Overdue", "BillDate": dt.date(2025, 1, 6)},
        {"BillID": "B3", "CustomerID": "C2", "AmountDue": D(7), "Status": "Paid", "BillDate": dt.date(2025, 1, 6)},
        {"BillID": "B4", "CustomerID": "C2", "AmountDue": D(9), "Status": "Unpaid", "BillDate": dt.date(2025, 3, 1)}])
    rep = reports.manager_report(t, "defaulters", "2025-01-01", "2025-01-31")
    assert [r.CustomerID for r in rep.data.collect()] == ["C1", "C2"]
    tot = rep.total.first()
    assert (tot.GrandTotalDue, tot.Defaulters) == (D("15.00"), 2)


def test_t18_case_insensitive_status_option(tables):
    t = tables(customer=[_cust(1)], bill=[
        {"BillID": "B1", "CustomerID": "C1", "AmountDue": D(4), "Status": "unpaid"},
        {"BillID": "B2", "CustomerID": "C1", "AmountDue": D(6), "Status": "OVERDUE"},
        {"BillID": "B3", "CustomerID": "C1", "AmountDue": D(1), "Status": "Unpaid"}])
    assert A.defaulters(t).first().UnpaidBills == 1
    d = A.defaulters(t, collation="UTF8_LCASE").first()
    assert (d.UnpaidBills, d.TotalDue) == (3, D("11.00"))


def test_ledger_rewrite_equals_left_join_with_hot_bill(spark, tables):
    bills = [{"BillID": f"B{i}", "CustomerID": "C1", "BillDate": dt.date(2025, 1, 1 + i % 20),
              "AmountDue": D(i), "Status": "Unpaid"} for i in range(30)]
    pays = [{"PaymentID": f"P{i}", "BillID": "B0", "PaymentDate": dt.datetime(2025, 2, 1, i % 24)} for i in range(600)]
    pays += [{"PaymentID": f"Q{i}", "BillID": f"B{i}", "PaymentDate": dt.datetime(2025, 3, 1)} for i in range(1, 10)]
    pays += [{"PaymentID": "X", "BillID": None, "PaymentDate": dt.datetime(2025, 3, 2)},
             {"PaymentID": "Y", "BillID": "NOPE", "PaymentDate": dt.datetime(2025, 3, 3)}]
    t = tables(bill=bills, payment=pays)
    got = J.billing_ledger(t, ordered=False)
    want = (t.bill.select("BillID", "CustomerID", "BillDate", "AmountDue", "Status")
            .join(t.payment.select("BillID", "PaymentDate"), "BillID", "left"))
    assert got.count() == 600 + 9 + 20
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
