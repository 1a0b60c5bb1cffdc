"""Ranks without one sorting task: rows are dealt by ranges, ranked in their range, and moved up by the counts of the ranges before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import fresh, staged


def ranked(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """Add `out` (long): 0-based rank of each row within its group, ascending by `order`, nulls first; group may be empty.

    Rows that are equal in group and order are dealt apart too, so a group that holds any share of the table, or one value that does, is
    spread over tasks. Only a group that runs on from one range to the next has a count to add there: one row a range at most, which is
    what is broadcast. The table is staged once, with the range of each row.
    """
    part, tie, base = fresh(df, "range"), fresh(df, "tie"), fresh(df, "base")
    dealt = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*group, *order, tie).withColumn(part, F.spark_partition_id())
    dealt = staged(dealt, "ranked")
    counts = dealt.groupBy(*group, part).agg(F.count(F.lit(1)).alias(base))
    # Without groups: one row a range. With them: the window holds one group's ranges.
    w = (Window.partitionBy(*group) if group else Window).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    before = F.broadcast(counts.withColumn(base, F.sum(base).over(w)).where(F.col(base) > 0))
    cond: Column = F.col(f"l.{part}") == F.col(f"r.{part}")
    for c in group:
        cond = cond & F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`"))
    own = F.row_number().over(Window.partitionBy(*group, part).orderBy(*order, tie)) - 1
    rows = dealt.withColumn(tie, own).alias("l").join(before.alias("r"), cond, "left")
    return rows.select(*[F.col(f"l.`{c}`") for c in df.columns], (F.col(f"l.{tie}") + F.coalesce(F.col(f"r.{base}"), F.lit(0))).cast("long").alias(out))


def running(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """Add `out`: the sum of `value` up to and with each row, by `order` (distinct values); ranges are summed, then rows in their range."""
    part, base = fresh(df, "range"), fresh(df, "base")
    dealt = staged(df.repartitionByRange(order).withColumn(part, F.spark_partition_id()), "running")
    sums = dealt.groupBy(part).agg(F.sum(value).alias(base))  # one row a range
    before = sums.withColumn(base, F.coalesce(F.sum(base).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.sum(value).over(Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn(out, own).join(F.broadcast(before), part).withColumn(out, F.col(out) + F.col(base)).drop(part, base)
