"""Line files with broken rows, appends that write, and maintenance that rewrites touched files only."""

from __future__ import annotations

import datetime as dt
import os
import tempfile
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from gridbill.operators import maintain as M
from gridbill.operators import rewrite as RW
from gridbill.operators import store as S
from gridbill.operators import validate as V
from gridbill.plans import reports as RP
from gridbill.sources import periods as PD
from gridbill.sources import sinks
from gridbill.sources.lines import LINE, OUTCOME, read_lines
from tests.conftest import frame

DAY = dt.date(2024, 1, 5)


def _written(lines):
    folder = tempfile.mkdtemp(prefix="gb-lines-")
    with open(f"{folder}/a.txt", "w") as f:
        f.write("\n".join(lines))
    return folder


def test_json_lines_lose_nothing_unseen(spark):
    good = '{"ReadingID":1,"MeterID":"M","UserID":"U","ReadingValue":"7.5","ReadingDate":"2024-01-05","Notes":null,"other":[1]}'
    cases = {
        good: "accepted",
        good.replace('"7.5"', "12"): "accepted",
        good.replace('"7.5"', "12.345"): "bad ReadingValue",  # would be rounded
        good.replace('"7.5"', "12345678901"): "bad ReadingValue",
        good.replace('"7.5"', '{"a":1}'): "bad ReadingValue",
        good.replace('"ReadingID":1', '"ReadingID":1.5'): "bad ReadingID",
        good.replace("2024-01-05", "soon"): "bad ReadingDate",
        good.replace('"M"', '""'): "missing MeterID",
        good[:-30]: "broken line", "nothing": "broken line", "[]": "broken line", "7": "broken line",
        "{}": "missing MeterID", "null": None,
    }
    got = {r[LINE]: r[OUTCOME] for r in read_lines(spark, "meter_reading", _written([*cases, "", "   "]), "json", V.reading_rules()).collect()}
    assert got.pop("null") in ("broken line", "missing MeterID")
    del cases["null"]
    assert got == cases


def test_csv_lines_and_a_query_of_one_column(spark):
    lines = ["ReadingID,MeterID,UserID,ReadingValue,ReadingDate,Notes", '1,M,U,7.50,2024-01-05,"a, b"', "2,M,U,7.5,2024-01-05", "3,M,U,7.5,2024-01-05,,more", "4,M,U,x,2024-01-05,", "5,M,U,,2024-01-05,"]
    rows = read_lines(spark, "meter_reading", _written(lines), "csv")
    assert {r[LINE][0]: r[OUTCOME] for r in rows.collect()} == {"1": "accepted", "2": "broken line", "3": "broken line", "4": "bad ReadingValue", "5": "accepted"}
    # what is noticed does not depend on the columns a query reads
    assert rows.where(F.col(OUTCOME) == "accepted").select("MeterID").count() == 2
    assert rows.where(F.col(OUTCOME) == "accepted").select("Notes").orderBy("ReadingID").first()[0] == "a, b"
    assert read_lines(spark, "meter_reading", _written([]), "csv").count() == 0


@pytest.mark.parametrize("fmt", ["json", "csv"])
def test_a_filter_on_the_outcome_parses_no_line_again(spark, fmt):
    rows = read_lines(spark, "payment", _written(["x"]), fmt, V.payment_rules())
    plan = rows.where(F.col(OUTCOME) == "accepted").drop(LINE, OUTCOME)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(f"from_{fmt}(") == 2  # as values and as texts


def test_rows_stay_where_they_are_when_few_frozen_keys_are_joined(spark, monkeypatch):
    from gridbill.operators import common as C
    from gridbill.operators.windows import freeze

    rows = spark.range(1000).selectExpr("concat('K', id % 50) AS k", "id")
    keys = freeze(spark.range(20, 60).selectExpr("concat('K', id) AS k"))
    for how, n in (("left_semi", 600), ("left_anti", 400), ("left", 1000)):
        joined = C.frozen_key_join(rows, keys, "k", how)
        assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == n
    monkeypatch.setattr(C, "FEW_KEYS", 39)  # one key more: shuffled
    assert [C.frozen_key_join(rows, keys, "k", how).count() for how in ("left_semi", "left_anti", "left")] == [600, 400, 1000]


def _customer(i, name="N"):
    return {"CustomerID": f"CUST-{i}", "CustomerName": name, "CustomerType": "Household", "Phone": "07", "ServiceAddress": "A", "RegistrationDate": DAY}


def test_append_is_stored_once(spark):
    base = tempfile.mkdtemp(prefix="gb-store-")
    check = lambda stored, b: M.append_customers(stored, b, DAY)
    first = frame(spark, "customer", [_customer(1), _customer(2, "")])
    second = frame(spark, "customer", [_customer(1), _customer(3)])
    answers = []
    for rows, batch in ((first, 0), (first, 0), (second, 1), (second, 1), (first, 0)):
        answers.append(sorted((r.CustomerID, r[OUTCOME]) for r in S.append(spark, base, "customer", rows, batch, check).collect()))
    assert answers[0] == answers[1] == [("CUST-1", "accepted"), ("CUST-2", "missing CustomerName")]
    assert answers[2] == answers[3] == [("CUST-1", "duplicate CustomerID"), ("CUST-3", "accepted")]
    assert answers[4] == answers[0]
    assert sorted(r.CustomerID for r in S.stored(spark, base, "customer").collect()) == ["CUST-1", "CUST-3"]
    assert sorted((r.CustomerID, r.Batch) for r in S.refused(spark, base, "customer").collect()) == [("CUST-1", 1), ("CUST-2", 0)]
    assert S.stored(spark, base, "meter").count() == 0


@pytest.fixture
def store(spark):
    """Ten customers with a meter, two readings, bills and payments each, in files of two customers."""
    base = tempfile.mkdtemp(prefix="gb files %41-")
    n = range(10)
    rows = {
        "customer": [_customer(i) for i in n],
        "meter": [{"MeterID": f"MTR-{i}", "CustomerID": f"CUST-{i}", "UtilityID": "UTIL-01", "Status": "Active"} for i in n],
        "meter_reading": [{"ReadingID": 2 * i + j, "MeterID": f"MTR-{i}", "ReadingValue": D(j), "ReadingDate": DAY} for i in n for j in range(2)],
        "bill": [{"BillID": f"BILL-{2 * i + j}", "CustomerID": f"CUST-{i}", "ReadingID": 2 * i + j if j else None} for i in n for j in range(2)],
        "payment": [{"PaymentID": f"PAY-{i}", "BillID": f"BILL-{i}", "PaymentAmount": D(1)} for i in range(20)],
    }
    for e, r in rows.items():
        per = len(r) // 5
        for k in range(5):
            frame(spark, e, r[k * per : (k + 1) * per]).coalesce(1).write.mode("append").parquet(f"{base}/{e}")
    return base, RW.version_of(spark, base, rows)


def _ids(spark, version, entity, column):
    return sorted(r[0] for r in version[entity].rows(spark).select(column).collect())


def test_only_touched_files_are_rewritten(spark, store):
    base, before = store
    assert all(len(f.paths) == 5 for f in before.values())
    stamps = {p: os.stat(p.removeprefix("file://")).st_mtime_ns for f in before.values() for p in f.paths}
    keys = spark.createDataFrame([("CUST-4",), ("CUST-4",), ("CUST-none",), (None,)], "CustomerID string")
    after = RW.delete_customers(spark, before, keys, f"{base}/next")
    for e in before:
        assert len(before[e].paths - after[e].paths) == 1  # each entity has one file with rows of CUST-4
        assert before[e].paths & after[e].paths == before[e].paths - (before[e].paths - after[e].paths)
    assert {p: os.stat(p.removeprefix("file://")).st_mtime_ns for p in stamps} == stamps
    assert _ids(spark, after, "customer", "CustomerID") == [f"CUST-{i}" for i in range(10) if i != 4]
    assert _ids(spark, after, "payment", "PaymentID") == sorted(f"PAY-{i}" for i in range(20) if i not in (8, 9))
    assert _ids(spark, after, "meter_reading", "ReadingID") == [i for i in range(20) if i not in (8, 9)]
    # the version before is still whole, and versions survive being written
    assert len(_ids(spark, before, "customer", "CustomerID")) == 10
    RW.save_version(spark, after, f"{base}/versions/1")
    assert RW.open_version(spark, f"{base}/versions/1") == after


def test_delete_meters_and_the_same_again(spark, store):
    base, before = store
    keys = spark.createDataFrame([("MTR-0",), ("MTR-1",)], "MeterID string")
    after = RW.delete_meters(spark, before, keys, f"{base}/next")
    assert _ids(spark, after, "bill", "BillID") == sorted(f"BILL-{i}" for i in range(20) if i not in (1, 3))  # bills without a reading stay
    assert _ids(spark, after, "payment", "PaymentID") == sorted(f"PAY-{i}" for i in range(20) if i not in (1, 3))
    assert len(_ids(spark, after, "meter", "MeterID")) == 8 and after["customer"] == before["customer"]
    assert RW.delete_meters(spark, after, keys, f"{base}/again") == after  # nothing touched, nothing written
    assert not os.path.exists(f"{base}/again")


def test_updates_and_an_entity_without_files(spark, store):
    base, before = store
    changes = spark.createDataFrame([("MTR-2", "Inactive", 1), ("MTR-2", "Active", 0), ("MTR-9", "Broken", 1), (None, "Inactive", 1)], "MeterID string, Status string, seq int")
    files = RW.updated(spark, before["meter"], changes, "MeterID", ["Status"], f"{base}/next", {"bad Status": V.outside("Status", ("Active", "Inactive"))})
    assert {r.MeterID for r in files.rows(spark).where("Status = 'Inactive'").collect()} == {"MTR-2"}
    assert files.rows(spark).count() == 10 and len(files.paths & before["meter"].paths) in (3, 4)
    none = RW.Files("meter", frozenset())
    assert none.rows(spark).count() == 0
    assert RW.without(spark, none, changes, "MeterID", f"{base}/none") == none


def _partitions_read(df):
    """Rows of ``df`` and the folders that its scan of a partitioned store listed when it ran."""
    query = df._jdf.queryExecution()
    rows = [tuple(r) for r in df.collect()]
    leaves, plans = [], [query.executedPlan()]
    while plans:
        p = plans.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            plans.append(p.executedPlan())
        elif p.nodeName().endswith("QueryStage"):
            plans.append(p.plan())
        else:
            leaves += [p] if p.metrics().contains("numPartitions") and "Scan" in p.nodeName() else []
            plans += [p.children().apply(i) for i in range(p.children().size())]
    return rows, [p.metrics().apply("numPartitions").value() for p in leaves]


def test_months_that_are_not_asked_for_are_not_read(spark):
    path = f"{tempfile.mkdtemp(prefix='gb-months-')}/payments"
    at = lambda m, d, h=0: dt.datetime(2024, m, d, h)
    rows = [{"PaymentID": f"P{m}-{d}", "BillID": "B", "PaymentAmount": D(m), "PaymentDate": at(m, d, 23)} for m in range(1, 13) for d in (1, 28)]
    PD.write_by_month(frame(spark, "payment", [*rows, {"PaymentID": "none", "PaymentAmount": D(1)}]), path)
    assert len([x for x in os.listdir(path) if x.startswith("Month=")]) == 13
    got, read = _partitions_read(PD.in_range(spark, path, "2024-03-28", "2024-05-01").select("PaymentID"))
    assert sorted(r[0] for r in got) == ["P3-28", "P4-1", "P4-28", "P5-1"] and read == [3]
    calendar = spark.range(1, 13).select(F.format_string("2024-%02d", "id").alias("Month"), ((F.col("id") - 1) / 3).cast("int").alias("Quarter"))
    months = calendar.unionByName(calendar)  # repeated months count once
    base = tempfile.mkdtemp(prefix="gb-calendar-")
    months.write.mode("overwrite").parquet(base)
    got, read = _partitions_read(PD.in_months(spark, path, spark.read.parquet(base).where("Quarter = 1")).select("PaymentID"))
    assert sorted(r[0] for r in got) == sorted(f"P{m}-{d}" for m in (4, 5, 6) for d in (1, 28)) and read == [3]
    assert PD.in_range(spark, path, None, None).count() == 24


def test_figures_of_an_export_come_from_its_one_pass(spark, tables):
    path = tempfile.mkdtemp(prefix="gb-seen-")
    bills = [{"BillID": f"B{i}", "CustomerID": f"CUST-{i % 3}", "BillDate": DAY, "AmountDue": D(i), "Status": "Unpaid" if i % 4 else "Paid"} for i in range(12)]
    t = tables(customer=[_customer(i) for i in range(4)], bill=bills)
    total = RP.export_defaulters(t, DAY, DAY, f"{path}/a")
    assert total == {"GrandTotalDue": D(sum(i for i in range(12) if i % 4)), "Defaulters": 3}
    assert spark.read.option("header", True).csv(f"{path}/a").count() == 3
    assert RP.export_defaulters(tables(), DAY, DAY, f"{path}/none") == {"GrandTotalDue": D(0), "Defaulters": 0}
    sent = frame(spark, "payment", [{"PaymentID": "1", "BillID": "B", "PaymentAmount": D(1), "PaymentMethod": "Cash"}, {"PaymentID": "2", "PaymentMethod": "Barter"}])
    counts = sinks.write_checked(sent, V.payment_rules(), f"{path}/b")
    assert counts == {"rows": 2, "missing BillID": 1, "missing PaymentAmount": 1, "missing PaymentMethod": 0, "bad PaymentMethod": 1}
    assert [r.PaymentID for r in spark.read.parquet(f"{path}/b/Valid=false").collect()] == ["2"]
