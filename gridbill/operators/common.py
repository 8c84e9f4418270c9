"""Shared helpers for the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import REPORT_MONEY

# A key is hot when it holds more than 1 / HOT_SHARE of the rows; each 1 / HOT_PARTS of all rows
# that it holds is a part of its own. So at most HOT_SHARE keys are hot, and their keys are copied
# at most HOT_PARTS + HOT_SHARE times together, whatever the size of the tables.
HOT_SHARE, HOT_PARTS = 256, 4096
# Keys that the heavy-hitter sketch tracks: a key above the share cannot fall out of it.
TRACKED = 16 * HOT_SHARE
# Below so many rows a key is never cut.
HOT_ROWS = 10_000
PART = "_part"
# Key sets up to this number of rows are sent to every task (some 100 bytes each); larger ones are shuffled.
FEW_KEYS = 2_000_000


def hot_keys(rows: DataFrame, key: str) -> Column:
    """The hot keys of ``rows`` as a map from key to its number of parts (2 or more); an empty map if none.

    One pass over the key column into a frequent-items sketch per task, merged to one row:
    no shuffle of rows or keys. It is an uncorrelated scalar subquery, so it runs with the
    query that uses it. The sketch's counts may be too high by a small share, which gives a
    key some more parts and changes no result; each key in the map does occur in ``rows``.
    """
    top = rows.agg(F.expr(f"approx_top_k(`{key}`, {HOT_SHARE}, {TRACKED})").alias("_top"), F.count(key).alias("_n"))
    hot = F.filter("_top", lambda x: x["item"].isNotNull() & (x["count"] * HOT_SHARE > F.col("_n")) & (x["count"] > HOT_ROWS))
    parts = F.transform(hot, lambda x: F.struct(x["item"], F.ceil(x["count"] * HOT_PARTS / F.col("_n")).cast("int")))
    return top.select(F.map_from_entries(F.coalesce(parts, F.array()))).scalar()


def parts_of(hot: Column, key: str) -> Column:
    """How many parts a key has: 1 unless it is hot."""
    return F.coalesce(F.try_element_at(hot, F.col(key)), F.lit(1))


def row_part(hot: Column, key: str, columns: list[str]) -> Column:
    """The part of a row by its content: 0 for a cold key; NULL keys, which match nothing, go anywhere."""
    parts = F.when(F.col(key).isNull(), F.lit(HOT_PARTS)).otherwise(parts_of(hot, key))
    return F.when(parts == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64(*columns), parts).cast("int"))


def key_parts(keys: DataFrame, hot: Column, key: str) -> DataFrame:
    """A frame with one row per key, each hot key's row once for each of its parts."""
    return keys.withColumn(PART, F.explode(F.sequence(F.lit(0), parts_of(hot, key) - 1)))


def key_join(left: DataFrame, keys: DataFrame, on: str, how: str = "left_semi", counted: DataFrame | None = None,
             unique: bool = False) -> DataFrame:
    """``left`` joined with a frame of distinct keys, safe for a key that holds a large share of ``left``.

    A distinct or grouped key set keeps its own partitioning, so such a join gets no
    exchange of its own and AQE cannot split a hot key. Here the hot keys of ``left`` are
    found by a sketch (``hot_keys``); each of their rows takes a part number from its content and
    their keys are copied once per part, in proportion to the rows they hold. Cold keys,
    which is all of them in most tables, are not copied, so the planner's estimate of the
    key set is the true one and it broadcasts a small set after its own size check.

    ``counted``: a frame with the same keys as ``left`` that is cheaper to count, such as the
    stored table that ``left`` comes from. ``unique``: no key comes twice in ``left``, so
    nothing can be hot and the join is a plain one. NULL keys match nothing. Rows that
    are equal in all columns share a part.
    """
    if unique:
        return left.join(keys, on, how)
    hot = hot_keys(left if counted is None else counted, on)
    return left.withColumn(PART, row_part(hot, on, left.columns)).join(key_parts(keys, hot, on), [on, PART], how).drop(PART)


def few(keys: DataFrame) -> bool:
    """Whether a frozen key set is small enough to be broadcast. It is counted: the planner
    knows no size of a frozen frame, and a join that only finds out when it runs has shuffled its other side by then."""
    return keys.limit(FEW_KEYS + 1).count() <= FEW_KEYS


def frozen_key_join(left: DataFrame, keys: DataFrame, on: str, how: str = "left_semi", counted: DataFrame | None = None) -> DataFrame:
    """``key_join`` with a frozen key set: ``left`` stays where it is if the keys are ``few``, and no key can be hot."""
    return left.join(F.broadcast(keys), on, how) if few(keys) else key_join(left, keys, on, how, counted)


def facts_of(rows: DataFrame, facts: DataFrame, on: str) -> DataFrame:
    """``rows LEFT JOIN facts`` where ``rows`` has one row per key and a key may have a huge number of facts.

    An outer join cannot be split on the side it does not preserve. Here the facts of a
    hot key are dealt to parts and its row is copied to each; a copy whose part got no fact is
    dropped, as a hot key has facts elsewhere. Both sides are read once by the join, and the
    facts' key column once more by the sketch.
    """
    hot = hot_keys(facts, on)
    other = [c for c in facts.columns if c != on]
    dealt = facts.where(F.col(on).isNotNull()).withColumn(PART, row_part(hot, on, facts.columns)).withColumn("_fact", F.lit(True))
    joined = key_parts(rows.withColumn("_hot", parts_of(hot, on) > 1), hot, on).join(dealt, [on, PART], "left")
    return joined.where(F.col("_fact") | ~F.col("_hot")).select(*rows.columns, *other)


def present_keys(table: DataFrame, key: str, probe: DataFrame, probe_key: str | None = None,
                 alias: str | None = None) -> DataFrame:
    """Distinct keys of ``probe`` that exist in ``table``.

    ``probe LEFT JOIN table`` cannot broadcast its left side, so a small batch
    checked against a large stored table would shuffle the whole table. A semi
    join of the table with the probe's distinct keys lets the planner broadcast
    the (small) key set and stream the table; the result is as small as the probe.
    The table is collapsed to distinct keys first (a partial aggregate shrinks a
    hot key where it is read), so no key weighs more than another in the join.
    """
    keys = probe.select(F.col(probe_key or key).alias(key)).where(F.col(key).isNotNull()).distinct()
    found = table.select(key).distinct().join(keys, key, "left_semi")
    return found.withColumnRenamed(key, alias) if alias else found


def flagged(left: DataFrame, keys: DataFrame, on: str, flag: str, counted: DataFrame | None = None) -> DataFrame:
    """``left`` with a boolean ``flag``: its key is in the frame of distinct keys (named like it)."""
    joined = key_join(left, keys.withColumn(flag, F.lit(True)), on, "left", counted)
    return joined.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def money(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(REPORT_MONEY)


def count_col(c: Column | str | None = None) -> Column:
    return F.count(F.lit(1) if c is None else (F.col(c) if isinstance(c, str) else c)).cast("bigint")
