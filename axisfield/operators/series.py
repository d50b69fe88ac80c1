"""Rows in order within series, in blocks of time: a series of any length is split, and what a block needs from others is carried.

All rows are sorted by series and order across partitions, which cuts a long series at its times; a partition is a block. Windows run within
a block of a series; the last (or first) rows of the blocks beside it come as a small table with at most two rows a block, since
only a series that starts in one block goes on in the next. The sorted rows are written, so that blocks stay the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axisfield.plans.tables import written

BLOCK = "__block"


def blocked(rows: DataFrame, series: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows with the number of their block, which grows with series and order."""
    return written(rows.orderBy(*series, *order).withColumn(BLOCK, F.spark_partition_id()))


def _joined(rows: DataFrame, beside: DataFrame, series: Sequence[str]) -> DataFrame:
    """Left join on series (nulls alike) and block."""
    named = beside.select(*(F.col(s).alias(f"__s{k}") for k, s in enumerate(series)), F.col(BLOCK).alias("__at_block"), *(c for c in beside.columns if c not in (*series, BLOCK)))
    same = F.col(BLOCK) == F.col("__at_block")
    for k, s in enumerate(series):
        same = same & F.col(s).eqNullSafe(F.col(f"__s{k}"))
    return rows.join(F.broadcast(named), same, "left").drop("__at_block", *(f"__s{k}" for k in range(len(series))))


def adjacent(rows: DataFrame, series: Sequence[str], order: Sequence[str], what: Column, periodic: bool = False, back: str = "__back", ahead: str = "__ahead") -> DataFrame:
    """Blocked rows with a value of the row before and of the row after; beyond the ends null, or the other end's if periodic."""
    rows = rows.withColumn("__what", what)
    place = F.struct(*order)
    ends = rows.groupBy(*series, BLOCK).agg(F.min_by("__what", place).alias("__first"), F.max_by("__what", place).alias("__last"), F.lit(True).alias("__is"))
    line = Window.partitionBy(*series).orderBy(BLOCK)
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, after = F.lag(F.struct("__last")).over(line), F.lead(F.struct("__first")).over(line)
    if periodic:
        before, after = F.coalesce(before, F.struct(F.last("__last").over(whole).alias("__last"))), F.coalesce(after, F.struct(F.first("__first").over(whole).alias("__first")))
    beside = ends.select(*series, BLOCK, before.alias("__b"), after.alias("__a")).where("__b is not null or __a is not null")
    inner = Window.partitionBy(*series, BLOCK).orderBy(*order)
    own = lambda f: f(F.struct("__what")).over(inner)
    # periodic ends of every series would be many rows: they are joined by hash, without the hint
    met = _joined(rows, beside, series) if not periodic else rows.join(beside.withColumn("__same", F.lit(True)), [*series, BLOCK], "left").drop("__same")
    pair = met.withColumns({"__lag": own(F.lag), "__lead": own(F.lead)})
    return pair.withColumns({back: F.when(F.col("__lag").isNotNull(), F.col("__lag.__what")).otherwise(F.col("__b.__last")), ahead: F.when(F.col("__lead").isNotNull(), F.col("__lead.__what")).otherwise(F.col("__a.__first"))}).drop("__what", "__lag", "__lead", "__b", "__a")


def nearest_known(rows: DataFrame, series: Sequence[str], order: Sequence[str], value: str, last: str | None = None, first: str | None = None) -> DataFrame:
    """Blocked rows with the last known (non-null) value at or before them, and the first known at or after them."""
    # places of unknown values are null, which the least and the greatest leave out; a block may have none
    place = F.when(F.col(value).isNotNull(), F.struct(*order))
    all_ = rows.groupBy(*series, BLOCK).agg(F.max_by(value, place).alias("__last"), F.min_by(value, place).alias("__first"))
    line = Window.partitionBy(*series).orderBy(BLOCK)
    before = F.last("__last", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    # backwards, so that the window grows: one that shrinks is gone through anew for each row
    after = F.last("__first", ignorenulls=True).over(Window.partitionBy(*series).orderBy(F.col(BLOCK).desc()).rowsBetween(Window.unboundedPreceding, -1))
    beside = all_.select(*series, BLOCK, before.alias("__b"), after.alias("__a")).where("__b is not null or __a is not null")
    inner = Window.partitionBy(*series, BLOCK).orderBy(*order)
    out = _joined(rows, beside, series)
    if last:
        out = out.withColumn(last, F.coalesce(F.last(value, ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, 0)), F.col("__b")))
    if first:
        turned = Window.partitionBy(*series, BLOCK).orderBy(*(F.col(o).desc() for o in order))
        out = out.withColumn(first, F.coalesce(F.last(value, ignorenulls=True).over(turned.rowsBetween(Window.unboundedPreceding, 0)), F.col("__a")))
    return out.drop("__b", "__a")
