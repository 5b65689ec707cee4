"""Places of rows within their keys, however many rows a key owns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import materialise

PART, POSITION = "__part", "__position"


def in_order(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows in ranges of keys and order, nulls first, stored with `PART` and `POSITION`.

    A range may begin and end within a key, so one key is spread over as many ranges as its rows ask for. Rows that are
    equal in keys and order should be equal in all that is read of them: they lie in one range, in no certain order.
    """
    by = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = ranged.withColumn(PART, F.spark_partition_id()).withColumn(POSITION, F.monotonically_increasing_id())
    return materialise(placed, "in-order")


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Equal in all of these columns, nulls included."""
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in names])


def numbered(
    rows: DataFrame, keys: list[str], order: list[str], at: str = "at", size: str | None = None
) -> DataFrame:
    """The rows with their place within their key, from 0, in ascending order with nulls first; `size`: the key's rows.

    Ranges of the sorted rows are counted by key, and a running sum over these counts (one row per range and key) tells
    where each range begins within the key. No task holds more rows than a range.
    """
    stored = in_order(rows, keys, order)
    counts = stored.groupBy(PART, *keys).agg(F.min(POSITION).alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        PART, *keys, "__first",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
        F.sum("__n").over(Window.partitionBy(*keys)).alias("__size"),
    )
    starts = materialise(starts, "range-starts")
    joined = stored.join(starts, same(stored, starts, [PART, *keys]))
    columns = [stored[f"`{c}`"] for c in rows.columns]
    place = (stored[POSITION] - starts["__first"] + starts["__before"]).alias(at)
    return joined.select(*columns, place, *([starts["__size"].alias(size)] if size else []))
