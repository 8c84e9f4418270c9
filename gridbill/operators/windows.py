"""Window operators that stay distributed when one key holds a large share of rows.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task and an
unpartitioned ``Window.orderBy`` sends the whole table to one task. ``running_sum``
and ``lag_default`` cut a key into buckets of its order column and carry one row per
(key, bucket) across the borders. ``global_rank`` and ``numbered`` collapse equal rows,
range-partition the distinct ones, freeze that layout with a reliable checkpoint
and stitch the segments with a table of at most one row per segment (so its
broadcast size is bounded by the number of segments, at most
``spark.sql.shuffle.partitions``).

* ``running_sum``   -- SUM(v) OVER (PARTITION BY k ORDER BY o ROWS UNBOUNDED PRECEDING)
* ``lag_default``   -- LAG(v, 1, default) OVER (PARTITION BY k ORDER BY o)  (W2)
* ``global_rank``   -- RANK() OVER ([PARTITION BY p] ORDER BY v DESC)         (W1)
* ``numbered``      -- ROW_NUMBER() OVER (ORDER BY all columns)
* ``first_by_order``-- TOP 1 ... ORDER BY per group, as ``min_by``            (W3)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

SEG = "_seg"
# Width of a bucket of a numeric order column, and rows that one task spreads out at a time.
BUCKET, CHUNK = 1 << 16, 1 << 16


def freeze(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the session's shared checkpoint folder (never local)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _range_segmented(df: DataFrame, order: Sequence[Column], segments: int | None) -> DataFrame:
    # Without an explicit count the range exchange starts at
    # spark.sql.shuffle.partitions and AQE merges adjacent small partitions by
    # size, so segments stay contiguous key ranges, grow in number with the data,
    # and never exceed spark.sql.shuffle.partitions (the carry-table bound).
    ranged = df.repartitionByRange(int(segments), *order) if segments else df.repartitionByRange(*order)
    seg = ranged.withColumn(SEG, F.spark_partition_id())
    # spark_partition_id is only stable while the layout is; checkpointing fixes it
    # so both the local pass and the border pass see the same segments.
    return freeze(seg)


def _key_match(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = left[SEG] == right[SEG]
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def _bucket(df: DataFrame, column: str) -> Column:
    """A coarse, order-preserving piece of the first order column: a month, an hour or a run of whole numbers."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.DateType):
        return F.trunc(column, "month")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_trunc("hour", column)
    if isinstance(kind, T.NumericType):
        return F.floor(F.col(column) / F.lit(BUCKET))
    raise TypeError(f"no buckets for order column {column} of type {kind.simpleString()}")


def _carried(local: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``local`` left-joined with one carry row per (key, bucket); null-safe, so NULL keys and buckets meet too."""
    l, c = local.alias("l"), carry.alias("c")
    cond = F.col(f"l.{SEG}").eqNullSafe(F.col(f"c.{SEG}"))
    for k in keys:
        cond = cond & F.col(f"l.{k}").eqNullSafe(F.col(f"c.{k}"))
    return l.join(c, cond, "left")


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Cumulative sum of ``value`` per key in ``order`` (rows frame, current row included).

    The window runs per (key, bucket of the first order column), so a hot key spreads
    over its buckets; the totals of a key's earlier buckets (one row per key and bucket
    after partial aggregation) are added. Nothing is sampled or checkpointed.
    """
    keys, order = list(keys), list(order)
    cut = df.withColumn(SEG, _bucket(df, order[0]))
    w = (Window.partitionBy(*keys, SEG).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = cut.withColumn("_local", F.sum(value).over(w))
    earlier = Window.partitionBy(*keys).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    carry = (cut.groupBy(*keys, SEG).agg(F.sum(value).alias("_tot"))
             .select(*keys, SEG, F.sum("_tot").over(earlier).alias("_carry")))
    joined = _carried(local, carry, keys)
    # SUM ignores NULLs: a bucket that starts with NULL values has a NULL local sum
    # but the running total is the carry.
    local_sum, carry_sum = F.col("l._local"), F.col("c._carry")
    total = F.when(local_sum.isNull(), carry_sum).otherwise(local_sum + F.coalesce(carry_sum, F.lit(0)))
    return joined.select(*[F.col(f"l.{name}") for name in df.columns], total.alias(out))


def lag_default(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, default, out: str) -> DataFrame:
    """LAG(value, 1, default): ``default`` only when there is no previous row; a NULL
    previous value stays NULL. Cut into buckets like ``running_sum``: the first row of a
    bucket takes the last value of the key's previous bucket."""
    keys, order = list(keys), list(order)
    cut = df.withColumn(SEG, _bucket(df, order[0]))
    w = Window.partitionBy(*keys, SEG).orderBy(*order)
    local = (cut.withColumn("_prev", F.lag(value, 1).over(w))
             .withColumn("_first", F.row_number().over(w) == 1))
    last = cut.groupBy(*keys, SEG).agg(F.max_by(F.col(value), F.struct(*order)).alias("_last"))
    before = Window.partitionBy(*keys).orderBy(SEG)
    carry = last.select(*keys, SEG, F.lag("_last", 1).over(before).alias("_carry"),
                        F.lag(F.lit(True), 1).over(before).alias("_has"))
    joined = _carried(local, carry, keys)
    prev = (F.when(~F.col("l._first"), F.col("l._prev"))
            .when(F.col("c._has").isNotNull(), F.col("c._carry"))
            .otherwise(F.lit(default)))
    cols = [F.col(f"l.{name}") for name in df.columns]
    return joined.select(*cols, prev.cast(df.schema[value].dataType).alias(out))


def numbered(df: DataFrame, out: str, segments: int | None = None) -> DataFrame:
    """Rows numbered 1..n without gaps or repeats, in the order of all their columns.

    Equal rows are collapsed to one with their count, the distinct rows are
    range-partitioned and numbered by running counts (like ``global_rank``), and each is
    spread out again in chunks, so that neither the table nor a row repeated many
    times passes through one task. Equal input gives equal numbers.
    """
    cols = df.columns
    counts = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    seg = _range_segmented(counts, [F.col(c).asc_nulls_first() for c in cols], segments)
    earlier = Window.orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)  # one row per segment
    offsets = seg.groupBy(SEG).agg(F.sum("_n").alias("_tot")).select(
        SEG, F.coalesce(F.sum("_tot").over(earlier), F.lit(0)).alias("_off"))
    within = Window.partitionBy(SEG).orderBy(*[F.col(c).asc_nulls_first() for c in cols]).rowsBetween(Window.unboundedPreceding, -1)
    first = (seg.withColumn("_before", F.coalesce(F.sum("_n").over(within), F.lit(0)))
             .join(F.broadcast(offsets), SEG).withColumn("_start", F.col("_off") + F.col("_before")))
    chunk = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(CHUNK).cast("bigint")))
    chunks = first.withColumn("_at", chunk).hint("rebalance")
    one = F.explode(F.sequence(F.col("_at"), F.least(F.col("_at") + CHUNK, F.col("_n")) - 1))
    return chunks.withColumn("_i", one).select(*cols, (F.col("_start") + F.col("_i") + 1).cast("bigint").alias(out))


def global_rank(df: DataFrame, value: str, out: str = "Rank", descending: bool = True,
                segments: int | None = None, freeze_input: bool = True,
                partition_by: Sequence[str] = ()) -> DataFrame:
    """RANK() OVER ([PARTITION BY p] ORDER BY value [DESC]) without funnelling a
    table or a large group into one task.

    rank(v) = 1 + number of rows of the same group ordered strictly before v.
    Rows are first collapsed to distinct (group, value) pairs with their
    multiplicity (a value shared by a third of the rows is one row), the pairs
    are range-partitioned on (group, value), a per-segment running count gives
    the rows before v inside the segment, and an offset table adds the rows of
    the same group in earlier segments. Only the first group of a segment can
    have rows in earlier segments, so the offset table has at most one row per
    segment. ``freeze_input`` checkpoints the input first, since it is read twice
    (counts, then the join back).
    """
    parts = list(partition_by)
    v = F.col(value)
    order = v.desc_nulls_last() if descending else v.asc_nulls_last()
    if freeze_input:
        df = freeze(df)
    counts = df.groupBy(*parts, value).agg(F.count(F.lit(1)).alias("_n"))
    seg = _range_segmented(counts, [F.col(p) for p in parts] + [order], segments)

    seg_tot = seg.groupBy(SEG, *parts).agg(F.sum("_n").alias("_tot"))
    earlier = Window.partitionBy(*parts).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (seg_tot.select(SEG, *parts, F.sum("_tot").over(earlier).alias("_off"))
               .where(F.col("_off").isNotNull()))
    within = Window.partitionBy(SEG, *parts).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = seg.withColumn("_before", F.coalesce(F.sum("_n").over(within), F.lit(0))).alias("l")
    o = F.broadcast(offsets).alias("o")  # at most one row per segment
    ranks = local.join(o, _key_match(local, o, parts), "left").select(
        *[F.col(f"l.{p}").alias(f"_p{i}") for i, p in enumerate(parts)],
        F.col(f"l.{value}").alias("_v"),
        (F.lit(1) + F.coalesce(F.col("o._off"), F.lit(0)) + F.col("l._before")).cast("bigint").alias(out))
    # One row per distinct (group, value); a hot value on the left is split by AQE skew join.
    cond = df[value].eqNullSafe(ranks["_v"])
    for i, p in enumerate(parts):
        cond = cond & df[p].eqNullSafe(ranks[f"_p{i}"])
    joined = df.join(ranks, cond, "inner")
    return joined.drop("_v", *[f"_p{i}" for i in range(len(parts))])


def first_by_order(df: DataFrame, group: Sequence[str], order: Sequence[str],
                   take: Sequence[str]) -> DataFrame:
    """``SELECT TOP 1 take ... ORDER BY order`` for every group, as one aggregate.

    ``min_by`` over a struct of the order columns is a partial/final hash
    aggregate (no sort, no single-task window); NULL order values sort first,
    as in SQL Server, because struct comparison orders NULL fields first.
    """
    key = F.struct(*[F.col(c) for c in order])
    aggs = [F.min_by(F.col(c), key).alias(c) for c in take]
    return df.groupBy(*group).agg(*aggs)
