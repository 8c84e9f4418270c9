"""Sets of whole-number ids as bitmaps: one row of 4,096 bytes for each 32,768 ids (J6, B4's guard, B6).

An id set that would be shuffled or held as one row per id becomes one row per bucket
of neighbouring ids, at an eighth of a byte to 4,096 bytes an id, by how dense they are. A bucket is
the join key: at most 32,768 different ids meet in one, so none can be hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET, BITS, IDS = "_bucket", "_bits", "_ids"
# A bitmap takes the bytes of so many plain ids; with fewer ids of a bucket in a task, ids are shuffled instead.
DENSE = 512


def gathered(rows: DataFrame, id_col: str) -> bool:
    """Whether the tasks that read ``rows`` see at least ``DENSE`` ids of a bucket on average.

    One pass over the id column, two numbers back; an estimate is enough, as either way gives the same bitmaps.
    """
    places = rows.where(F.col(id_col).isNotNull()).select(F.struct(F.spark_partition_id(), F.bitmap_bucket_number(id_col)).alias("_place"))
    n, places = places.agg(F.count(F.lit(1)), F.approx_count_distinct("_place")).first()
    return n >= DENSE * places


def id_bitmaps(rows: DataFrame, id_col: str, dense: bool | None = None) -> DataFrame:
    """(_bucket, _bits, _ids): the bitmap of each bucket of ids and how many rows it stands for. NULL ids are left out.

    Where tasks hold many ids of a bucket (files written in order of id or time) they build
    bitmaps before the shuffle, and only bitmaps are shuffled. Where ids come
    in any order that would send a bitmap for every few ids, so the ids are dealt by bucket
    first. ``dense`` says which; by default it is measured (``gathered``).
    """
    ids = rows.where(F.col(id_col).isNotNull()).select(F.bitmap_bucket_number(id_col).alias(BUCKET), F.bitmap_bit_position(id_col).alias("_at"))
    if not (gathered(rows, id_col) if dense is None else dense):
        ids = ids.repartition(BUCKET)
    return ids.groupBy(BUCKET).agg(F.bitmap_construct_agg("_at").alias(BITS), F.count(F.lit(1)).alias(IDS))


def has_bit(bits: Column, id_col: Column | str) -> Column:
    """Whether a bucket's bitmap holds an id of that bucket (NULL without a bitmap or an id)."""
    at = F.bitmap_bit_position(id_col)
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (at % 8).cast("int")) == 1


def with_bit(left: DataFrame, id_col: str, bitmaps: DataFrame, flag: str) -> DataFrame:
    """``left`` with a boolean ``flag``: its id is in the set. A NULL id is in no set."""
    joined = left.withColumn(BUCKET, F.bitmap_bucket_number(id_col)).join(bitmaps.select(BUCKET, BITS), BUCKET, "left")
    return joined.withColumn(flag, F.coalesce(has_bit(F.col(BITS), id_col), F.lit(False))).select(*left.columns, flag)


def without_ids(left: DataFrame, id_col: str, bitmaps: DataFrame) -> DataFrame:
    """The rows whose id is not in the set (rows with a NULL id stay, as in an anti join)."""
    return with_bit(left, id_col, bitmaps, "_in").where(~F.col("_in")).drop("_in")


def repeated_ids(rows: DataFrame, id_col: str, dense: bool | None = None) -> DataFrame:
    """(id, count): the ids that come in more than one row.

    A bucket whose rows outnumber its bits holds a repeat. Only the rows of such buckets
    are counted by id; where nothing is repeated, no id is shuffled but for the bitmaps.
    """
    suspects = id_bitmaps(rows, id_col, dense).where(F.col(IDS) > F.bitmap_count(BITS)).select(BUCKET)
    ids = rows.where(F.col(id_col).isNotNull()).select(id_col, F.bitmap_bucket_number(id_col).alias(BUCKET))
    return (ids.join(suspects, BUCKET, "left_semi").groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"))
            .where("_n > 1").withColumnRenamed("_n", "count"))
