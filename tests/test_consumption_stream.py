"""Streaming consumption: equal to the batch operator over any arrival order, restarts, late readings."""

import datetime as dt
import random
from decimal import Decimal as D

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridbill import schemas
from gridbill.streaming import consumption as SC


def test_placing_readings():
    every, said = SC.placed([], False, [(5, 1, 100), (7, 2, 300)])
    assert every == [(5, 1, 100), (7, 2, 300)] and said == [(1, 5, 100, 0, "answered"), (2, 7, 300, 100, "answered")]
    every, said = SC.placed(every, False, [(6, 3, None)])  # between the two
    assert said == [(3, 6, None, 100, "answered"), (2, 7, 300, None, "corrected")]
    assert SC.placed(every, False, [(7, 2, 300)])[1] == [(2, 7, 300, None, "repeated")]
    assert SC.kept(every, 7) == every[1:] and SC.kept(every, 5) == every and SC.kept(every, 99) == every[2:] and SC.kept([], 3) == []
    assert SC.placed(every[2:], True, [(6, 9, 1)])[1] == [(9, 6, 1, None, "too late")]


def test_any_order_of_arrival_ends_alike():
    rng = random.Random(2)
    for _ in range(200):
        rows = [(rng.randint(1, 6), i, rng.choice([None, i * 10])) for i in range(rng.randint(1, 9))]
        held, last, batches = [], {}, rng.sample(rows, len(rows))
        while batches:
            k = rng.randint(1, 3)
            held, said = SC.placed(held, False, batches[:k])
            last.update({a[0]: a[3] for a in said})
            batches = batches[k:]
        ordered = sorted(rows, key=lambda r: r[:2])
        assert last == {r[1]: ordered[i - 1][2] if i else 0 for i, r in enumerate(ordered)}


@pytest.fixture()
def arrive(spark, tmp_path):
    """Write readings (id, meter, day of 2025, value) as one more file of the source folder."""

    def write(rows):
        data = [(i, m, "U1", v if v is None else D(v), None if d is None else dt.date(2025, 1, 1) + dt.timedelta(d), None) for i, m, d, v in rows]
        spark.createDataFrame(data, schemas.METER_READING).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    return write


def test_restarts_equal_the_batch(spark, tmp_path, arrive):
    paths = SC.Paths.under(str(tmp_path))
    rng = random.Random(4)
    rows = [(i, f"M{0 if rng.random() < 0.4 else rng.randint(1, 5)}", rng.randint(0, 40), None if rng.random() < 0.1 else f"{i}.50") for i in range(60)]
    for k in range(0, 60, 20):  # each run ends, and the next one goes on from the checkpoint
        arrive(rows[k : k + 20])
        SC.consumption_stream(SC.readings_from_files(spark, str(tmp_path / "in"), max_files=1), paths).awaitTermination()
        stored = spark.read.parquet(str(tmp_path / "in"))
        before = F.lag("ReadingValue", 1, D(0)).over(Window.partitionBy("MeterID").orderBy("ReadingDate", "ReadingID"))
        want = {r.ReadingID: (r.p, None if r.p is None or r.ReadingValue is None else r.ReadingValue - r.p) for r in stored.withColumn("p", before).collect()}
        got = {r.ReadingID: (r.PreviousReadingValue, r.Consumption) for r in SC.latest_answers(spark, paths).collect()}
        assert got == want
    assert SC.all_answers(spark, paths).where("Outcome = 'corrected'").count() > 0


def test_late_readings(spark, tmp_path, arrive):
    paths = SC.Paths.under(str(tmp_path))

    def run():
        SC.consumption_stream(SC.readings_from_files(spark, str(tmp_path / "in")), paths, "10 days").awaitTermination()

    for rows in ([(1, "M", 1, "1.00"), (2, "M", 5, "4.00")], [(3, "M", 40, "9.00")], [(4, "M", 45, "11.00")]):
        arrive(rows)
        run()
    arrive([(5, "M", 41, "10.00"), (6, "M", 2, "2.00"), (7, "N", 1, "7.00"), (8, None, 3, "1.00"), (9, "M", None, "1.00")])
    run()
    got = {(r.ReadingID, r.Outcome): r.Consumption for r in SC.all_answers(spark, paths).collect()}
    assert got[5, "answered"] == 1 and got[4, "corrected"] == 1 and got[4, "answered"] == 2
    assert (6, "too late") in got and (6, "answered") not in got  # older than what the meter's state holds
    assert got[7, "answered"] == 7  # a meter without state is late for nobody
    assert not {8, 9} & {i for i, _ in got}
    assert {r.ReadingID for r in SC.latest_answers(spark, paths).collect()} == {1, 2, 3, 4, 5, 7}
