"""The distributed window helpers equal Spark's plain windows, also with a hot key."""

from __future__ import annotations

import random
from decimal import Decimal as D

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridbill.operators import windows as W


def _skewed(spark, n=4000, seed=7):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        # a third of the rows belong to key 0; values have many ties and some NULLs
        k = 0 if i % 3 == 0 else rng.randrange(1, 60)
        v = None if rng.random() < 0.03 else D(rng.randrange(0, 40))
        rows.append((k, i, v))
    return spark.createDataFrame(rows, "k int, o int, v decimal(10,2)")


def test_running_sum_matches_window(spark):
    df = _skewed(spark)
    got = {r.o: r.s for r in W.running_sum(df, ["k"], ["o"], "v", "s").collect()}
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = {r.o: r.s for r in df.select("o", F.sum("v").over(w).alias("s")).collect()}
    assert got == want


def test_lag_default_matches_window(spark):
    df = _skewed(spark)
    got = {r.o: r.p for r in W.lag_default(df, ["k"], ["o"], "v", 0, "p").collect()}
    w = Window.partitionBy("k").orderBy("o")
    want = {r.o: r.p for r in df.select("o", F.lag("v", 1, 0).over(w).cast("decimal(10,2)").alias("p")).collect()}
    assert got == want


def test_global_rank_matches_rank(spark):
    df = _skewed(spark)
    for desc in (True, False):
        got = {r.o: r.r for r in W.global_rank(df, "v", "r", descending=desc, segments=5).collect()}
        order = F.col("v").desc_nulls_last() if desc else F.col("v").asc_nulls_last()
        want = {r.o: r.r for r in df.select("o", F.rank().over(Window.orderBy(order)).alias("r")).collect()}
        assert got == want


def test_first_by_order(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", None, "z"), ("b", 0, "w")],
                               "g string, o int, t string")
    got = {r.g: r.t for r in W.first_by_order(df, ["g"], ["o"], ["t"]).collect()}
    assert got == {"a": "y", "b": "z"}


def test_helpers_on_empty_input(spark):
    empty = spark.createDataFrame([], "k int, o int, v decimal(10,2)")
    assert W.running_sum(empty, ["k"], ["o"], "v", "s").count() == 0
    assert W.lag_default(empty, ["k"], ["o"], "v", 0, "p").count() == 0
    assert W.global_rank(empty, "v").count() == 0


def test_empty_append_batch(spark, tables):
    from gridbill.operators import maintain as M
    t = tables()
    batch = spark.createDataFrame([], "MeterID string, UserID string, ReadingValue decimal(10,2), "
                                      "ReadingDate date, Notes string")
    assert M.append_readings(batch, t.meter).count() == 0


def test_hot_key_is_split_across_segments(spark):
    df = _skewed(spark, n=6000)
    seg = W._range_segmented(df, [F.col("k"), F.col("o")], 8)
    spread = seg.where("k = 0").select(W.SEG).distinct().count()
    assert spread >= 2  # the key holding a third of the rows is not pinned to one task
    biggest = max(r["count"] for r in seg.groupBy(W.SEG).count().collect())
    assert biggest < 6000 // 3  # no segment holds the whole hot key


def test_aqe_coalesced_segments_stay_exact(spark):
    """Default path: no explicit segment count, AQE merges adjacent range partitions."""
    confs = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
             "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    old = {k: spark.conf.get(k) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        # 200k rows, a third on key 0, many ties in v
        df = spark.range(0, 200000).select(
            F.when(F.col("id") % 3 == 0, 0).otherwise(F.abs(F.xxhash64("id")) % 500).alias("k"),
            F.col("id").alias("o"),
            (F.abs(F.xxhash64("id", F.lit(7))) % 1000).cast("decimal(10,2)").alias("v"))
        seg = W._range_segmented(df, [F.col("k"), F.col("o")], None)
        n_seg = seg.select(W.SEG).distinct().count()
        assert 1 < n_seg <= int(spark.conf.get("spark.sql.shuffle.partitions"))

        def diff(a, b):
            return a.exceptAll(b).count() + b.exceptAll(a).count()

        w = Window.partitionBy("k").orderBy("o")
        want = df.select("o", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("s"))
        assert diff(W.running_sum(df, ["k"], ["o"], "v", "s").select("o", "s"), want) == 0
        want = df.select("o", F.lag("v", 1, 0).over(w).cast("decimal(10,2)").alias("p"))
        assert diff(W.lag_default(df, ["k"], ["o"], "v", 0, "p").select("o", "p"), want) == 0
        want = df.select("o", F.rank().over(Window.orderBy(F.col("v").desc_nulls_last())).cast("bigint").alias("r"))
        assert diff(W.global_rank(df, "v", "r").select("o", "r"), want) == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_buckets_that_start_with_nulls(spark, monkeypatch):
    # key 1 spans several buckets; later ones start with NULL values
    rows = [(1, i, D(1)) for i in range(5)] + [(1, 5 + i, None) for i in range(5)] + [(2, 0, D(3)), (None, 1, D(2)), (None, 9, D(4)), (2, None, D(1))]
    df = spark.createDataFrame(rows, "k int, o int, v decimal(10,2)")
    for width in (2, 3, 4):
        monkeypatch.setattr(W, "BUCKET", width)
        got = {(r.k, r.o): r.s for r in W.running_sum(df, ["k"], ["o"], "v", "s").collect()}
        assert got[(1, 9)] == got[(1, 5)] == D("5.00") and got[(2, 0)] == D("4.00") and got[(None, 9)] == D("6.00")
        lag = {(r.k, r.o): r.p for r in W.lag_default(df, ["k"], ["o"], "v", 0, "p").collect()}
        assert lag[(1, 5)] == D("1.00") and lag[(1, 6)] is None and lag[(1, 0)] == 0 and lag[(2, 0)] == 1 and lag[(None, 9)] == 2


def test_buckets_match_windows(spark, monkeypatch):
    monkeypatch.setattr(W, "BUCKET", 50)
    test_running_sum_matches_window(spark)
    test_lag_default_matches_window(spark)


def test_dates_are_cut_by_month(spark):
    df = spark.sql("SELECT 1 AS k, date_add(DATE '2024-01-20', CAST(id * 10 AS INT)) AS o, CAST(id AS DECIMAL(10,2)) AS v FROM range(20)")
    w = Window.partitionBy("k").orderBy("o")
    want = {r.o: r.p for r in df.select("o", F.lag("v", 1, 0).over(w).cast("decimal(10,2)").alias("p")).collect()}
    assert {r.o: r.p for r in W.lag_default(df, ["k"], ["o"], "v", 0, "p").collect()} == want


def test_numbered_is_gapless_and_keeps_repeats(spark, monkeypatch):
    monkeypatch.setattr(W, "CHUNK", 7)
    df = spark.createDataFrame([("b", 1)] * 20 + [("a", None), ("a", 2), (None, 3)] + [("c", i) for i in range(9)], "s string, n int")
    got = sorted((r.i, r.s, r.n) for r in W.numbered(df, "i", segments=4).collect())
    assert [g[0] for g in got] == list(range(1, 33))
    assert [g[1:] for g in got] == [(None, 3), ("a", None), ("a", 2)] + [("b", 1)] * 20 + [("c", i) for i in range(9)]
    assert W.numbered(df.limit(0), "i").count() == 0


def _hot(spark, df, key):
    from gridbill.operators.common import hot_keys
    return spark.range(1).select(hot_keys(df, key).alias("m")).first().m


def test_only_hot_keys_are_found(spark, monkeypatch):
    from gridbill.operators import common as C
    rows = spark.range(0, 40_000)
    skewed = rows.select(F.when(F.col("id") % 5 < 4, 0).when(F.col("id") % 50 == 4, F.lit(None)).otherwise(F.col("id")).alias("k"))
    hot = _hot(spark, skewed, "k")
    assert set(hot) == {0} and 0.8 * C.HOT_PARTS <= hot[0] <= 0.85 * C.HOT_PARTS
    assert _hot(spark, rows.select("id"), "id") == {}
    assert _hot(spark, rows.limit(0).select("id"), "id") == {}
    assert _hot(spark, rows.select(F.concat(F.lit("x"), F.col("id") % 2).alias("k")), "k").keys() == {"x0", "x1"}
    # more keys than the sketch tracks, and one of them just above the share
    many = spark.range(0, 200_000).select(F.when(F.col("id") % 200 == 0, -1).otherwise(F.col("id")).alias("k"))
    assert _hot(spark, many, "k") == {}  # 1,000 rows: below HOT_ROWS
    monkeypatch.setattr(C, "HOT_ROWS", 500)
    assert set(_hot(spark, many, "k")) == {-1}


@pytest.mark.parametrize("least", [100, 1 << 40])
def test_key_join_of_a_hot_key(spark, monkeypatch, least):
    from gridbill.operators import common as C
    monkeypatch.setattr(C, "HOT_ROWS", least)
    df = spark.range(0, 4000).select(F.when(F.col("id") % 5 < 4, 0).when(F.col("id") % 10 == 4, F.lit(None)).otherwise(F.col("id")).alias("k"), "id")
    keys = spark.createDataFrame([(0,), (9,), (None,)], "k long").distinct()
    assert C.key_join(df, keys, "k").count() == 3201
    assert C.key_join(df, keys, "k", "left_anti").count() == 799
    assert C.flagged(df, keys, "k", "f").where("f").count() == 3201
    part = df.where("k = 0").groupBy(C.row_part(C.hot_keys(df, "k"), "k", df.columns)).count()
    assert max(r["count"] for r in part.collect()) == (3200 if least > 4000 else pytest.approx(1, abs=8))  # 80 % of the rows, spread


def test_cold_keys_are_not_copied(spark):
    from gridbill.operators.common import PART, hot_keys, key_parts
    keys = spark.range(0, 1000).withColumnRenamed("id", "k")
    skewed = spark.range(0, 100_000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("k"))
    copies = key_parts(keys, hot_keys(skewed, "k"), "k").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min(PART).alias("p")).collect()
    assert {r.n for r in copies if r.k != 7} == {1} and all(r.p == 0 for r in copies)
    assert next(r.n for r in copies if r.k == 7) >= 2048


@pytest.mark.parametrize("least", [50, 1 << 40])
def test_facts_of_is_the_left_join(spark, monkeypatch, least):
    from gridbill.operators import common as C
    monkeypatch.setattr(C, "HOT_ROWS", least)
    bills = spark.createDataFrame([(0, "hot"), (1, "none"), (2, "two"), (None, "null key")], "b long, name string")
    pays = spark.range(0, 3000).select(F.when(F.col("id") < 2900, 0).when(F.col("id") < 2902, 2).when(F.col("id") < 2950, F.lit(None)).otherwise(F.lit(99)).alias("b"), F.col("id").alias("pay"))
    want = sorted(map(str, bills.join(pays, "b", "left").select("b", "name", "pay").collect()))
    assert sorted(map(str, C.facts_of(bills, pays, "b").select("b", "name", "pay").collect())) == want
    assert C.facts_of(bills, pays.limit(0), "b").count() == 4


def _largest_task_share(spark, build, rows):
    """Share of ``rows`` in the largest partition that the key-set join of ``build()`` reads, without broadcasts."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in build().groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old[0])
        spark.conf.set("spark.sql.adaptive.enabled", old[1])
    return max(sizes) / rows


def test_hot_keys_of_the_write_paths_are_spread(spark, tables, monkeypatch):
    """80 % of the rows on one meter, customer or bill: no join task holds half of them (8 partitions)."""
    from gridbill.operators import common as C
    from gridbill.operators import maintain as M
    monkeypatch.setattr(C, "HOT_ROWS", 100)
    from gridbill.operators.common import flagged, key_join
    n = 4000
    ids = spark.range(0, n)
    hot = lambda p: F.concat(F.lit(p), F.when(F.col("id") % 5 < 4, 0).otherwise(F.col("id")).cast("string"))
    readings = ids.select(F.col("id").alias("ReadingID"), hot("M").alias("MeterID"))
    payments = ids.select(F.concat(F.lit("P"), F.col("id").cast("string")).alias("PaymentID"), hot("B").alias("BillID"))
    gone = spark.createDataFrame([("M0",), ("M4",)], "MeterID string")
    bills = spark.createDataFrame([("B0",), ("B4",)], "BillID string")
    for build in (lambda: key_join(readings, gone.distinct(), "MeterID"),  # history of the meters to bill
                  lambda: key_join(payments, bills.distinct(), "BillID", "left_anti"),  # cascading deletes
                  lambda: flagged(payments, bills.distinct(), "BillID", "f")):  # audit, posting, append checks
        assert _largest_task_share(spark, build, n) < 0.5
    t = tables(meter=[{"MeterID": "M0", "CustomerID": "C"}])
    checked = M._check_batch(readings.select("MeterID"), {}, None, t.meter, [("MeterID", t.meter, "MeterID")])
    assert checked.where("Outcome = 'accepted'").count() == n * 4 // 5


def test_partitioned_rank_matches_rank(spark):
    df = _skewed(spark, n=3000, seed=3).withColumn("g", (F.col("o") % 4).cast("int"))
    for segs in (3, 6, None):
        got = {r.o: r.r for r in W.global_rank(df, "v", "r", partition_by=["g"], segments=segs).collect()}
        w = Window.partitionBy("g").orderBy(F.col("v").desc_nulls_last())
        want = {r.o: r.r for r in df.select("o", F.rank().over(w).alias("r")).collect()}
        assert got == want
