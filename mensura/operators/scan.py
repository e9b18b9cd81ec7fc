"""Running values over one long order, in parallel: ranges of rows, a carry for each, a second pass.

``ranged`` deals rows out by ranges of group and order and stores them, each with its range's
number. A running value is then a window inside a range and group, and what the ranges before leave to it:
``carried`` sums each range up and adds, for the groups that several ranges hold, the carry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mensura.sources.shared import stored

RANGE = "_range"


def ranged(df: DataFrame, order: list[str], by: list[str] = (), parts: int | None = None) -> DataFrame:
    """The rows by ranges of (by, order), stored, with their range's number; rows that are equal in all of these stay in one range."""
    keys = [*by, *order]
    dealt = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    return stored(dealt.withColumn(RANGE, F.spark_partition_id()), "ranges")


def inside(order: list[str], by: list[str] = ()) -> Window:
    """Rows of a range and group up to the current one."""
    return Window.partitionBy(RANGE, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(by: list[str] = ()) -> Window:
    """A group's ranges before the current one."""
    return Window.partitionBy(*(by or [F.lit(0)])).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)


def carried(rows: DataFrame, by: list[str], sums: dict[str, Column], carries: dict[str, Column]) -> DataFrame:
    """Adds to each row what the ranges before its own leave to its group, null for nothing.

    ``sums`` are aggregates of a range's rows of a group; ``carries`` are windows over these, made with
    ``before``, that may use _start, the group's rows in earlier ranges. Only groups that several
    ranges hold are looked at, so these tables have a row or two for each range, however many rows it has.
    """
    by = list(by)
    parts = rows.groupBy(RANGE, *by).agg(F.count(F.lit(1)).alias("_rows"), *[c.alias(n) for n, c in sums.items()])
    if by:
        parts = parts.join(parts.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*by), by, "left_semi")
    started = parts.withColumn("_start", F.coalesce(F.sum("_rows").over(before(by)), F.lit(0)))
    return rows.join(started.select(RANGE, *by, *[c.alias(n) for n, c in carries.items()]), [RANGE, *by], "left")
