"""Placement of rows on shards by a permutation-filled lookup table (operator 2), in DataFrame functions only.

Each shard has its own order of preference over the slots of a table of prime size
(a start and a stride taken from hashes of its name). The shards take turns; at its
turn a shard claims the slot it prefers most among those still free, until no slot
is free. So all shards hold as many slots, give or take one, and when a shard goes,
few slots but its own change hands. A row's key is hashed to a slot; the table, whose
size is fixed, is broadcast, so placing a row takes constant time and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridbill.llm import common

#: A prime; about 100 slots or more for each shard keep the shards even.
SLOTS = 4099
SHARDS = tuple(f"shard-{i:02d}" for i in range(32))


def _hash(key: Column) -> Column:
    """60 bits of the key's MD5 as a number."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def lookup_table(spark: SparkSession, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(slot, shard): the owner of each slot; it depends on the names and their order alone."""
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime")
    if not 0 < len(shards) <= slots or len({*shards}) != len(shards):
        raise ValueError("from one shard to one for each slot, of distinct names")
    m = F.lit(slots).cast("long")
    names = F.array(*map(F.lit, shards))
    orders = F.transform(names, lambda s: F.struct((_hash(F.concat(s, F.lit(":start"))) % m).alias("start"), (_hash(F.concat(s, F.lit(":stride"))) % (m - 1) + 1).alias("stride")))
    # the stride's inverse modulo the prime gives a slot's place in the order of preference at once
    inverse = lambda stride: F.filter(F.sequence(F.lit(1).cast("long"), m - 1), lambda x: x * stride % m == 1)[0]
    orders = F.transform(orders, lambda o: F.struct(o["start"], inverse(o["stride"]).alias("inverse")))
    free = F.sequence(F.lit(0).cast("long"), m - 1)

    def claimed(free: Column, order: Column) -> Column:
        # of each free slot: its place in the order, then the slot itself
        return F.array_min(F.transform(free, lambda s: F.pmod((s - order["start"]) * order["inverse"], m) * m + s)) % m

    def fill(orders: Column) -> Column:
        def turn(state: Column, t: Column) -> Column:
            slot = common.bound(F.element_at(orders, (t % len(shards) + 1).cast("int")), lambda order: claimed(state["free"], order))
            return common.bound(slot, lambda c: F.struct(F.array_remove(state["free"], c).alias("free"), F.concat(state["claims"], F.array(c)).alias("claims")))

        start = F.struct(free.alias("free"), F.array().cast("array<long>").alias("claims"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(slots - 1)), start, turn, lambda s: s["claims"])

    claims = spark.range(1).select(common.bound(orders, fill).alias("claims"))
    return claims.select(F.posexplode("claims").alias("turn", "slot")).select("slot", F.element_at(names, (F.col("turn") % len(shards) + 1).cast("int")).alias("shard"))


def place(df: DataFrame, key: str, table: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(key, slot, shard) of every row; a null key counts as an empty one, equal keys meet on one shard."""
    keyed = df.select(key, (_hash(F.coalesce(F.col(key).cast("string"), F.lit(""))) % slots).alias("slot"))
    return keyed.join(F.broadcast(table), "slot").select(key, "slot", "shard")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its slot and shard."""
    return place(common.table(spark, sf_dir, "documents", "doc_id"), "doc_id", lookup_table(spark))


ORACLE = f"""
WITH RECURSIVE names AS (
  SELECT i, 'shard-' || lpad(i::VARCHAR, 2, '0') AS shard FROM range({len(SHARDS)}) r(i)
), orders AS (
  SELECT i, shard, ('0x' || substr(md5(shard || ':start'), 1, 15))::BIGINT % {SLOTS} AS start,
    ('0x' || substr(md5(shard || ':stride'), 1, 15))::BIGINT % {SLOTS - 1} + 1 AS stride FROM names
), inverted AS (
  SELECT i, shard, start, list_filter(range(1, {SLOTS}), lambda x: x * stride % {SLOTS} = 1)[1] AS inverse FROM orders
), turns AS (
  SELECT 0::BIGINT AS turn, -1::BIGINT AS slot, range({SLOTS}) AS free
  UNION ALL
  SELECT turn + 1, claimed, list_filter(free, lambda s: s <> claimed)
  FROM (SELECT turn, free, list_min(list_transform(free, lambda s: (((s - o.start) * o.inverse) % {SLOTS} + {SLOTS}) % {SLOTS} * {SLOTS} + s)) % {SLOTS} AS claimed
    FROM turns JOIN inverted o ON o.i = turn % {len(SHARDS)} WHERE turn < {SLOTS}) c
)
SELECT d.doc_id, t.slot, n.shard
FROM documents d
JOIN turns t ON t.turn > 0 AND t.slot = ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS}
JOIN names n ON n.i = (t.turn - 1) % {len(SHARDS)}
"""
