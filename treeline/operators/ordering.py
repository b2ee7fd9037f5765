"""Total orders, running sums and pages without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.operators.scratch import settled


def running_sum(rows: DataFrame, order: list[str], value: Column, out: str) -> DataFrame:
    """``rows`` with the running sum of ``value`` along ``order``.

    Rows are range-partitioned on the order, summed inside each range, and shifted
    by the sum of the ranges before it; only one row per range meets in one task.
    The ranges are settled first, so sums and shifts see the same cuts and the rows
    are made once.
    """
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settled(rows.withColumn("_value", value).repartitionByRange(width, *order).withColumn("_range", F.spark_partition_id()))
    within = ranged.withColumn(out, F.sum("_value").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    totals = ranged.groupBy("_range").agg(F.sum("_value").alias("_total"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select("_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_shift"))
    return within.join(F.broadcast(shifts), "_range").withColumn(out, F.col(out) + F.col("_shift")).drop("_range", "_value", "_shift")


def ordinals(rows: DataFrame, order: list[str], out: str = "ordinal") -> DataFrame:
    """Dense positions from 0 along a total order."""
    return running_sum(rows, order, F.lit(1).cast("long"), out).withColumn(out, F.col(out) - 1)


def budget_prefix(rows: DataFrame, order: list[str], size: Column, budget: int, first_always: bool = False, out: str = "running") -> DataFrame:
    """The longest prefix whose sizes sum to at most ``budget``; with ``first_always`` the first row stays however large."""
    summed = running_sum(rows, order, size, out)
    keep = F.col(out) <= budget
    return summed.where(keep | (F.col(out) == size)) if first_always else summed.where(keep)


def keyset_page(rows: DataFrame, order: list[str], after: tuple | None, size: int) -> DataFrame:
    """At most ``size`` rows after a key in a total order; ask for one more to learn whether there is a next page."""
    if after is not None:
        later, equal = F.lit(False), F.lit(True)
        for name, bound in zip(order, after, strict=True):
            later = later | (equal & (F.col(name) > bound))
            equal = equal & (F.col(name) == bound)
        rows = rows.where(later)
    return rows.orderBy(*order).limit(size)


def islands(rows: DataFrame, partition: list[str], value: str, out: str = "island") -> DataFrame:
    """Marks runs of consecutive integers inside each partition: equal marks are one run."""
    return rows.withColumn(out, F.col(value) - F.row_number().over(Window.partitionBy(*partition).orderBy(value)))


def runs(rows: DataFrame, partition: list[str], order: list[str], label: str, out: str = "run") -> DataFrame:
    """Numbers runs of equal neighbouring labels from 1."""
    along = Window.partitionBy(*partition).orderBy(*order)
    changed = (~F.lag(label).over(along).eqNullSafe(F.col(label))).cast("int")
    return rows.withColumn("_changed", changed).withColumn(out, F.sum("_changed").over(along.rowsBetween(Window.unboundedPreceding, 0))).drop("_changed")
