"""Exact dedup by sorting contents; DataFrame functions only.

Sampled splitters range-partition the rows on (leading characters, 64-bit hash,
identifier). Within a range Spark's external sort puts equal texts next to each
other and every row is compared with its neighbour in full. The identifier and the
row's place are part of the splitters, so one text that holds a third of all rows,
even with one identifier, is spread over as many ranges as it deserves; only the
first and last run of each range can continue next door, and those (two rows a
range at most) are merged by full text. Ranges follow the size of the texts.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut, shuffle_width

#: Leading characters that splitters carry, which bounds what the driver holds.
SPLITTER_CHARS = 48
#: Ranges for each shuffle partition, and sampled rows for each range.
RANGES_PER_PARTITION = 4
SAMPLED_PER_RANGE = 24
#: Bytes of texts for each shuffle partition; larger tables get more partitions than the session's.
PARTITION_BYTES = 256 << 20
_KEY = "array<struct<p:string,h:bigint,i:bigint,s:bigint>>"
_LEAST, _MOST = -(2**63), 2**63 - 1


def _splitters(keys: DataFrame, rows: int, ranges: int) -> list[tuple]:
    """Splitters from a sample bounded by ``ranges``; the result never depends on them."""
    if ranges < 2 or rows < 2 * ranges:
        return []
    share = min(1.0, SAMPLED_PER_RANGE * ranges / rows)
    sample = sorted(tuple(r) for r in keys.sample(fraction=share, seed=7).collect())
    picked = [sample[len(sample) * k // ranges] for k in range(1, ranges)] if sample else []
    return sorted(set(picked))


def _range_of(key: Column, splitters: list[tuple]) -> Column:
    """How many splitters are not above ``key``, by binary search."""
    if not splitters:
        return F.lit(0).cast("long")
    table = F.from_json(F.lit(json.dumps([{"p": p, "h": h, "i": i, "s": s} for p, h, i, s in splitters])), _KEY)
    start = F.struct(F.lit(0).cast("int").alias("lo"), F.lit(len(splitters)).cast("int").alias("hi"))

    def halve(span: Column, _: Column) -> Column:
        mid = F.floor((span["lo"] + span["hi"]) / 2).cast("int")
        low = F.when((span["lo"] < span["hi"]) & (F.get(table, mid) <= key), mid + 1).otherwise(span["lo"])
        high = F.when((span["lo"] < span["hi"]) & (F.get(table, mid) > key), mid).otherwise(span["hi"])
        return F.struct(low.cast("int").alias("lo"), high.cast("int").alias("hi"))

    steps = len(splitters).bit_length() + 1
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve)["lo"].cast("long")


def content_sort(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalise: Callable[[Column], Column] | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after ``normalise`` (none by default).
    ``keep`` says whether the smallest or the largest identifier of a group stays.
    A null text counts as empty. Rows repeated with one identifier count in
    group_size and exactly one of them is kept. A null identifier is kept only where
    its group has no other (then keep_id is null). Other columns
    of ``docs`` are ignored, whatever their names. An empty table gives no rows.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), (normalise(text) if normalise else text).alias("t"))
    smallest = keep == "smallest"
    worst = _MOST if smallest else _LEAST
    key = [F.substring("t", 1, SPLITTER_CHARS).alias("p"), F.xxhash64("t").alias("h"), F.coalesce("doc_id", F.lit(worst)).alias("i"), F.monotonically_increasing_id().alias("s")]
    count, size = rows.agg(F.count("*"), F.sum(F.octet_length("t"))).first()
    width = max(shuffle_width(spark), -(-(size or 0) // PARTITION_BYTES))
    splitters = _splitters(rows.select(*key), count, ranges or RANGES_PER_PARTITION * width)
    ranged = rows.select("doc_id", "t", *key).withColumn("b", _range_of(F.struct("p", "h", "i", "s"), splitters)).drop("s")
    if width > shuffle_width(spark):
        ranged = ranged.repartition(width, "b")

    sort = Window.partitionBy("b").orderBy("p", "h", "t", "i")
    beside = ranged.select("b", "p", "h", "t", "i", "doc_id", F.lag("t").over(sort).alias("before"), F.lead("t").over(sort).alias("after"))
    opens = F.col("before").isNull() | (F.col("before") != F.col("t"))
    closes = F.col("after").isNull() | (F.col("after") != F.col("t"))
    runs = beside.select(
        "b",
        "doc_id",
        F.sum(opens.cast("long")).over(sort.rowsBetween(Window.unboundedPreceding, 0)).alias("run"),
        (opens if smallest else closes).alias("at_end"),
        F.when(F.col("before").isNull() | F.col("after").isNull(), F.col("t")).alias("edge"),
        F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"),
    )
    best = F.min if smallest else F.max
    run = Window.partitionBy("b", "run")
    held = cut(runs.select("b", "run", "doc_id", "at_end", "edge", "text_sha256", F.count("*").over(run).alias("n"), best("doc_id").over(run).alias("best")))

    edges = held.where(F.col("edge").isNotNull()).groupBy("b", "run").agg(F.max("edge").alias("edge"), F.max("n").alias("n"), F.max("best").alias("best"))
    place = F.struct(F.coalesce("best", F.lit(worst)).alias("i"), "b")
    joined = edges.groupBy("edge").agg(F.count("*").alias("parts"), F.sum("n").alias("all_n"), best("best").alias("all_best"), best(place)["b"].alias("home")).where("parts > 1")
    over = edges.select("b", "run", "edge").join(joined, "edge").select("b", "run", "all_n", "all_best", "home")
    # at most two runs of each range are in it
    out = held.join(F.broadcast(over), ["b", "run"], "left")
    keep_id = F.coalesce("all_best", "best")
    # equal rows may lie in several ranges: only one of them has the row that stays
    here = F.coalesce(F.col("home") == F.col("b"), F.lit(True))
    return out.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("all_n", "n").alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep_id) & F.col("at_end") & here).alias("kept"),
        "text_sha256",
    )
