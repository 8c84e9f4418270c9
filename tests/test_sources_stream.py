"""Sources/sinks (S1, S3), tariff appends and the streaming ingest (ST1)."""

from __future__ import annotations

import datetime as dt
import json
import os
import tempfile
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from gridbill.operators import maintain as M
from gridbill.sources import sinks
from gridbill.sources.tables import Tables, load
from gridbill.streaming import ingest as ST

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json", "orc"])
def test_load_roundtrip(spark, fmt):
    t = Tables.from_testdata(spark, SF)
    base = tempfile.mkdtemp(prefix="gb-src-")
    path = f"{base}/customer"
    sinks.export(t.customer, path, fmt=fmt)
    back = load(spark, "customer", path, fmt)
    assert back.schema == t.customer.schema or [f.name for f in back.schema] == t.customer.columns
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, t.customer.collect()))


def test_from_store_and_snapshot_guard(spark):
    t = Tables.from_testdata(spark, SF)
    base = tempfile.mkdtemp(prefix="gb-store-")
    for e in ("customer", "meter"):
        sinks.write_snapshot(getattr(t, e), f"{base}/{e}")
    s = Tables.from_store(spark, base)
    assert s.meter.count() == t.meter.count()
    with pytest.raises(ValueError):
        sinks.write_snapshot(s.meter, f"{base}/meter", source_path=f"{base}/meter")


def test_export_csv_has_header(spark):
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    out = tempfile.mkdtemp(prefix="gb-exp-") + "/r"
    sinks.export(df, out)
    parts = [p for p in os.listdir(out) if p.endswith(".csv")]
    with open(os.path.join(out, parts[0])) as fh:
        assert fh.readline().strip() == "k,v"


def test_append_tariffs_defaults_and_checks(spark, tables):
    t = tables()
    batch = spark.createDataFrame(
        [("NEW-1", "UTIL-02", "New", D("5.00")), ("GAS-01", "UTIL-03", "Dup", D("1.00")),
         ("NEW-2", "UTIL-09", "Bad utility", D("2.00")), ("NEW-3", "UTIL-01", "No rate", None)],
        "TariffID string, UtilityID string, TariffName string, Rate decimal(10,2)")
    got = {r.TariffID: (r.Outcome, r.MinUnits, r.FixedCharge, r.MaxUnits)
           for r in M.append_tariffs(t.tariff, batch, t.utility_type).collect()}
    assert got == {"NEW-1": ("accepted", 0, D("0.00"), None), "GAS-01": ("duplicate TariffID", 0, D("0.00"), None),
                   "NEW-2": ("unknown UtilityID", 0, D("0.00"), None), "NEW-3": ("missing Rate", 0, D("0.00"), None)}


def _write_json(folder, name, rows):
    with open(os.path.join(folder, name), "w") as fh:
        for r in rows:
            fh.write(json.dumps(r) + "\n")


def test_stream_ingest_keeps_all_and_replays(spark, tables):
    t = tables(meter=[{"MeterID": "M1", "CustomerID": "C1", "UtilityID": "UTIL-01", "Status": "Active"}])
    src = tempfile.mkdtemp(prefix="gb-stream-src-")
    rows = [{"MeterID": "M1", "UserID": "U1", "ReadingValue": "10.5", "ReadingDate": "2025-01-01"},
            {"MeterID": "M1", "UserID": "U1", "ReadingValue": "12", "ReadingDate": "2025-01-02", "Notes": ""},
            {"MeterID": "M9", "UserID": "U1", "ReadingValue": "1", "ReadingDate": "2025-01-02"},
            {"MeterID": "M1", "UserID": "", "ReadingValue": "3", "ReadingDate": "2025-01-03"}]
    _write_json(src, "a.json", rows)
    paths = ST.IngestPaths.under(tempfile.mkdtemp(prefix="gb-stream-out-"))
    assert ST.accepted_readings(spark, paths).count() == 0

    def run(**bound):
        ST.ingest_readings_stream(ST.submissions_from_files(spark, src, **bound), t.meter, paths).awaitTermination()
        accepted = sorted((r.ReadingID, str(r.ReadingValue)) for r in ST.accepted_readings(spark, paths).collect())
        refused = sorted((r.Epoch, r.Outcome) for r in ST.refused_submissions(spark, paths).collect())
        return accepted, refused

    base = ST.EPOCH_IDS
    assert run() == ([(base + 1, "10.50"), (base + 2, "12.00")], [(0, "missing UserID"), (0, "unknown MeterID")])
    # Later files, one per micro-batch, land on the non-empty sinks; an equal submission is kept.
    _write_json(src, "b.json", [rows[0], rows[0], {"MeterID": "M1", "UserID": "U1", "ReadingValue": "15", "ReadingDate": "2025-01-05"}])
    _write_json(src, "c.json", [rows[2]])
    both = run(max_files=1)
    assert [v for _, v in both[0]] == ["10.50", "12.00", "10.50", "10.50", "15.00"] and len({i for i, _ in both[0]}) == 5
    assert [o for _, o in both[1]] == ["missing UserID", "unknown MeterID", "unknown MeterID"]
    # A replayed epoch leaves both sinks as they are.
    batch = spark.read.schema(ST.SUBMISSION).json(f"{src}/a.json")
    ST.batch_writer(t.meter, paths)(batch, 0)
    assert run() == both


def test_reports_from_a_stored_copy_match_the_mapping(spark):
    from gridbill.operators import aggregates as A
    from gridbill.operators import billing as B
    t = Tables.from_testdata(spark, SF)
    base = tempfile.mkdtemp(prefix="gb-ents-")
    for e in ("utility_type", "tariff", "customer", "meter", "meter_reading", "bill", "payment"):
        sinks.write_snapshot(getattr(t, e), f"{base}/{e}")
    s = Tables.from_store(spark, base)
    for build in (lambda x: A.defaulters(x, ordered=False),
                  lambda x: A.revenue_trends(x, "2001-07-15", ordered=False),
                  lambda x: B.billing_run(x, "2024-02-01")):
        a, b = build(t), build(s)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_checkpoint_dir_is_read_not_replaced(spark):
    from gridbill.session import ensure_checkpoint_dir
    before = spark.sparkContext.getCheckpointDir()
    assert before and ensure_checkpoint_dir(spark) == before == ensure_checkpoint_dir(spark)


def test_local_frame_escapes_quotes(spark):
    from gridbill import schemas
    from gridbill.sources.testdata import local_frame
    rows = [("UTIL-09", "O'Brien's Gas", "unit")]
    df = local_frame(spark, rows, schemas.UTILITY_TYPE)
    assert [tuple(r) for r in df.collect()] == rows
    assert df.schema.simpleString() == "struct<UtilityID:string,UtilityName:string,Unit:string>"
