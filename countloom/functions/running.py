"""Running numbers, sums and extremes over sorted families of any size.

A table is dealt to ranges of its sort order and written once; each range works on its own, and what a family has in
earlier (or later) ranges is carried to it from a table with a row for each family and range. No task holds a family,
so neither one family nor many of them is a limit. Sort keys should be unique within a family, or tied rows alike.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countloom.sources.shared import kept

PART, SEQ = "_part", "_seq"


def in_order(table: DataFrame, by: list[str], order: list[Column], select: list[Column] | None = None, coarse: list[Column] | None = None) -> DataFrame:
    """The table, or ``select`` of it, sorted by family and ``order``, with ``_part`` (its range) and ``_seq`` (rising
    along the whole order); nulls sort first. Ranges are of ``coarse``, if given: short values that rise with ``order``,
    as the ranges' bounds meet on the driver."""
    family = [F.col(c) for c in by]
    placed = table.repartitionByRange(*family, *(coarse or order)).sortWithinPartitions(*family, *order)
    out = [F.col(c) for c in table.columns] if select is None else select
    return kept(placed.select(*out, F.spark_partition_id().alias(PART), F.monotonically_increasing_id().alias(SEQ)), "ordered")


def with_carry(ordered: DataFrame, by: list[str], totals: dict[str, Column], carried: dict[str, Callable[[Window, Window], Column]]) -> DataFrame:
    """``ordered`` with columns from other ranges of each row's family. ``totals``: aggregates of a family's part of a
    range; ``carried``: by name, a column of these over the family's earlier and over all its ranges."""
    sums = ordered.groupBy(*by, PART).agg(*(c.alias(n) for n, c in totals.items()))
    ranges = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # a family has as many rows as ranges here
    earlier = ranges.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    later = ranges.orderBy(PART).rowsBetween(1, Window.unboundedFollowing)
    keys = [*by, PART]
    found = sums.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), *(f(earlier, later, ranges).alias(n) for n, f in carried.items()))
    same = reduce(lambda a, b: a & b, [ordered[k].eqNullSafe(found[f"_key{i}"]) for i, k in enumerate(keys)])
    return ordered.join(found, same).drop(*(f"_key{i}" for i in range(len(keys))))


def within(by: list[str]) -> Window:
    """A family's rows of one range, in order."""
    return Window.partitionBy(*by, PART).orderBy(SEQ)


def numbered(ordered: DataFrame, by: list[str], number: str = "_i", size: str | None = None) -> DataFrame:
    """Adds each row's number in its family, from 1, and with ``size`` the family's number of rows."""
    carried = {"_before": lambda earlier, later, ranges: F.coalesce(F.sum("_rows").over(earlier), F.lit(0))}
    if size:
        carried[size] = lambda earlier, later, ranges: F.sum("_rows").over(ranges)
    own = with_carry(ordered, by, {"_rows": F.count("*")}, carried)
    return own.withColumn(number, F.row_number().over(within(by)) + F.col("_before")).drop("_before")


def so_far(ordered: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Adds the greatest ``value`` of a family up to each row, nulls left out."""
    own = with_carry(ordered, by, {"_top": F.max(value)}, {"_carry": lambda earlier, later, ranges: F.max("_top").over(earlier)})
    here = F.max(value).over(within(by).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return own.withColumn(out, F.greatest(here, F.col("_carry"))).drop("_carry")


def onward(ordered: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Adds the least ``value`` of a family from each row on, nulls left out."""
    own = with_carry(ordered, by, {"_low": F.min(value)}, {"_carry": lambda earlier, later, ranges: F.min("_low").over(later)})
    here = F.min(value).over(within(by).rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return own.withColumn(out, F.least(here, F.col("_carry"))).drop("_carry")
