"""Revenue deltas against a full recompute: append, cascade, replay, hot bill, empty log rows."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from gridbill.operators import maintain as M
from gridbill.operators import summaries as S


def _tables(tables):
    pay = [{"PaymentID": f"P{i}", "BillID": "B1" if i % 3 else f"B{i % 4}", "PaymentAmount": Decimal(i) / 4,
            "PaymentDate": dt.datetime(2024, 1 + i % 5, 28, 10) if i % 11 else None} for i in range(1, 90)]
    return tables(
        customer=[{"CustomerID": f"C{i}"} for i in range(3)],
        meter=[{"MeterID": f"M{i}", "CustomerID": f"C{i % 3}", "UtilityID": f"UTIL-0{1 + i % 3}"} for i in range(6)],
        bill=[{"BillID": f"B{i}", "CustomerID": f"C{i % 3}", "MeterID": f"M{i}"} for i in range(3)], payment=pay)


def _rows(df):
    return sorted(map(str, df.select("Month", "UtilityName", "Payments", "Revenue").collect()))


def test_deltas_equal_the_recompute(spark, tables, tmp_path):
    t, path = _tables(tables), str(tmp_path / "log")
    late = F.col("PaymentDate") >= F.lit(dt.datetime(2024, 4, 1))
    S.log_delta(S.revenue_delta(t, t.payment.where(~F.coalesce(late, F.lit(False)))), path, 0)
    for _ in range(2):  # an epoch that is written again counts once
        S.log_delta(S.revenue_delta(t, t.payment.where(late)), path, 1)
    assert _rows(S.revenue_summary(spark, path)) == _rows(S.revenue_delta(t, t.payment))
    keys = t.customer.where("CustomerID in ('C1', 'C2')").unionByName(t.customer.where("CustomerID = 'C1'"))
    S.log_delta(S.customers_retracted(t, keys), path, 2)
    after = M.delete_customers(t, keys)
    left = t.replace(payment=after.payment, bill=after.bill, meter=after.meter, customer=after.customer)
    assert _rows(S.revenue_summary(spark, path)) == _rows(S.revenue_delta(left, left.payment)) != []


def test_everything_taken_back_leaves_no_row(spark, tables, tmp_path):
    t, path = _tables(tables), str(tmp_path / "log")
    S.log_delta(S.revenue_delta(t, t.payment), path, 0)
    S.log_delta(S.customers_retracted(t, t.customer), path, 1)
    S.log_delta(S.revenue_delta(t, t.payment.limit(0)), path, 2)
    assert S.revenue_summary(spark, path).count() == 0
