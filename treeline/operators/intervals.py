"""Half-open interval operators, always inside a partition key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_length(rows: DataFrame, partition: list[str], start: str, end: str, out: str = "covered") -> DataFrame:
    """Length of the union of the intervals of each partition."""
    before = Window.partitionBy(*partition).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(end).over(before), F.col(start))
    added = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), reach))
    return rows.withColumn("_added", added).groupBy(*partition).agg(F.sum("_added").alias(out))


def overlaps(rows: DataFrame, partition: list[str], start: str, end: str, order: list[str] | None = None) -> DataFrame:
    """Rows that conflict with the one before: it ends later than they start, or is an insertion at their start."""
    along = Window.partitionBy(*partition).orderBy(start, end, *(order or []))
    held = rows.withColumn("previous_start", F.lag(start).over(along)).withColumn("previous_end", F.lag(end).over(along))
    insert = (F.col("previous_start") == F.col(start)) & (F.col("previous_start") == F.col("previous_end"))
    return held.where((F.col("previous_end") > F.col(start)) | insert)


def latest_before(rows: DataFrame, partition: list[str], order: list[str], marker, value: str, out: str) -> DataFrame:
    """Each row with ``value`` of the latest row at or before it that ``marker`` holds for (as-of, one sort, no join)."""
    along = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(F.when(marker, F.col(value)), ignorenulls=True).over(along))


def innermost(points: DataFrame, scopes: DataFrame, partition: list[str], point: str, order: list[Column], value: str, out: str) -> DataFrame:
    """``points`` with ``value`` of the innermost of the nested half-open ``scopes`` (at, until) around ``point``, null where there is none.

    Scopes of a partition must nest or be apart. Equal starts open by falling ``until``,
    then by ``order``; the one opened last is the innermost. Empty scopes hold nothing,
    and points whose key has a null meet none. One running sum gives the depth of every
    event; the last scope opened at a point's depth is the one around it, so the work is
    one sort by partition and one by depth, whatever the number of scopes or points of a key.
    """
    kept = scopes.where(F.col("at") < F.col("until"))
    rest = [c for c in points.columns if c not in partition]
    held = points.withColumn("_point", F.struct(F.lit(True).alias("_asked"), *rest))
    typed = {f.name: f.dataType for f in scopes.schema.fields}
    empty = F.lit(None).cast(typed[value])
    nothing = F.lit(None).cast(held.schema["_point"].dataType)
    event = lambda at, kind, turn, step, value: F.struct(F.col(at).alias("_at"), F.lit(kind).alias("_kind"), turn.alias("_turn"), F.lit(step).alias("_step"), value.alias("_value"))
    rank = F.row_number().over(Window.partitionBy(*partition).orderBy(F.col("at"), F.col("until").desc(), *order))
    # both ends of a scope come from one row, and keys keep their columns: what is dealt by the key before is not dealt again
    ends = F.array(event("at", 1, F.col("_turn"), 1, F.col(value)), event("until", 0, F.lit(0), -1, empty))
    sides = kept.withColumn("_turn", rank).select(*partition, F.explode(ends).alias("_e")).select(*partition, "_e.*", nothing.alias("_point"))
    asks = held.select(*partition, F.col(point).alias("_at"), F.lit(2).alias("_kind"), F.lit(0).alias("_turn"), F.lit(0).alias("_step"), empty.alias("_value"), "_point")
    along = ["_at", "_kind", "_turn"]
    before = (Window.unboundedPreceding, 0)
    events = sides.unionByName(asks)
    events = events.withColumn("_depth", F.sum("_step").over(Window.partitionBy(*partition).orderBy(*along).rowsBetween(*before)))
    # a scope that closes leaves a depth that it must not be looked up by
    lookup = Window.partitionBy(*partition, "_depth").orderBy(*along).rowsBetween(*before)
    events = events.where("_kind > 0").withColumn("_met", F.last(F.when(F.col("_kind") == 1, F.struct(F.col("_value").alias("v"))), ignorenulls=True).over(lookup))
    known = F.lit(True)
    for name in partition:
        known = known & F.col(name).isNotNull()
    own = [F.col(c) if c in partition else F.col("_point")[c].alias(c) for c in points.columns]
    return events.where("_kind = 2").select(*own, F.when((F.col("_depth") > 0) & known, F.col("_met.v")).alias(out))
