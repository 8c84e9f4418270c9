"""Id sets as bitmaps: bit tests, anti joins and repeats against plain joins and counts."""

import pytest
from pyspark.sql import functions as F

from gridbill.operators import bitmaps as BM

IDS = [0, 1, 7, 8, 9, 32767, 32768, 32769, 65536, -1, -32768, -40000, 1 << 40, (1 << 62) + 5, 5_000_000_000]


@pytest.mark.parametrize("dense", [True, False, None])
def test_every_bit_is_found(spark, dense):
    present = spark.createDataFrame([(i,) for i in IDS] + [(None,)], "r long")
    asked = spark.createDataFrame([(i + d,) for i in IDS for d in (-1, 0, 1, 8)] + [(None,)], "r long").distinct()
    got = {r.r: r.f for r in BM.with_bit(asked, "r", BM.id_bitmaps(present, "r", dense), "f").collect()}
    assert got == {r.r: r.r in IDS for r in asked.collect()}
    left = BM.without_ids(asked, "r", BM.id_bitmaps(present, "r", dense))
    assert {r.r for r in left.collect()} == {k for k in got if k not in IDS}


def test_random_ids_match_an_anti_join(spark):
    rows = spark.range(0, 200_000).select((F.xxhash64("id") % 300_000).alias("r"), "id")
    some = spark.range(0, 60_000).select((F.xxhash64("id", F.lit(1)) % 300_000).alias("r"))
    want = rows.join(some, "r", "left_anti").agg(F.count("id"), F.sum("id")).first()
    for dense in (True, False):
        got = BM.without_ids(rows, "r", BM.id_bitmaps(some, "r", dense)).agg(F.count("id"), F.sum("id")).first()
        assert got == want
    counted = {r.r: r.n for r in some.groupBy("r").agg(F.count(F.lit(1)).alias("n")).where("n > 1").collect()}
    assert {r.r: r["count"] for r in BM.repeated_ids(some, "r").collect()} == counted and counted


def test_density_is_measured(spark):
    assert BM.gathered(spark.range(0, 1_000_000, 1, 4), "id")
    assert not BM.gathered(spark.range(0, 4000, 1, 4).select((F.col("id") * 70_001).alias("id")), "id")


def test_empty_sets(spark):
    none, some = spark.createDataFrame([], "r long"), spark.range(3).withColumnRenamed("id", "r")
    assert BM.id_bitmaps(none, "r").count() == 0 and BM.repeated_ids(none, "r").count() == 0
    assert BM.without_ids(some, "r", BM.id_bitmaps(none, "r")).count() == 3
    assert BM.without_ids(none, "r", BM.id_bitmaps(some, "r")).count() == 0


def test_nothing_repeated_counts_no_ids(spark):
    unique = spark.range(0, 100_000).withColumnRenamed("id", "r")
    assert BM.repeated_ids(unique, "r").count() == 0
    assert BM.id_bitmaps(unique, "r").where(F.col(BM.IDS) > F.bitmap_count(BM.BITS)).count() == 0
