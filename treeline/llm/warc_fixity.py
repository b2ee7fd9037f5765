"""WARC fixity audits with Merkle trees.

Each archive's records are hashed, ranges of FANOUT neighbouring slots are hashed
over their children in order, and so on up to one root. Two replicas are compared
root by root; only below differing roots are the next levels compared, so what is
read and joined follows the damage and not the archive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut

#: Slots of an archive, and children of a tree node.
ARCHIVE_SLOTS, FANOUT = 1000, 16


def warc_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(page_id, record): each page as the text of a WARC/1.1 resource record. Null url and body count as empty."""
    body, url = F.coalesce(pages[body_col].cast("string"), F.lit("")), F.coalesce(pages[url_col].cast("string"), F.lit(""))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(pages[id_col].cast("long").cast("string"), F.lit("")),
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )
    return pages.select(pages[id_col].cast("long").alias("page_id"), record.alias("record"))


def levels(slots: int = ARCHIVE_SLOTS, fanout: int = FANOUT) -> int:
    """Levels above the records."""
    n, out = slots, 0
    while n > 1:
        n, out = -(-n // fanout), out + 1
    return out


def leaves(records: DataFrame, slots: int = ARCHIVE_SLOTS) -> DataFrame:
    """(archive, slot, page_id, offset, length, hash) of every record; offsets run within an archive in slot order.

    Archives are ranges of identifiers; null identifiers share one archive (null).
    Rows with one identifier share a slot and follow each other by hash.
    """
    rows = records.select(
        F.floor(F.col("page_id") / slots).alias("archive"),
        F.pmod("page_id", F.lit(slots)).alias("slot"),
        "page_id",
        F.octet_length("record").cast("long").alias("length"),
        F.sha2(F.col("record").cast("binary"), 256).alias("hash"),
    )
    order = Window.partitionBy("archive").orderBy("slot", "hash")
    offset = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("length")
    return rows.withColumn("offset", offset)


def _ordered(level: DataFrame, node: Column) -> DataFrame:
    """Parent nodes: a hash over (position, length, hash) of the children in order, and the byte range they cover."""
    kids = F.array_sort(F.collect_list(F.struct("node", "length", "hash")))
    said = F.concat_ws(",", F.transform(kids, lambda k: F.concat_ws(":", k["node"], k["length"], k["hash"])))
    return level.groupBy("archive", node.alias("up")).agg(
        F.sha2(said.cast("binary"), 256).alias("hash"), F.sum("length").alias("length"), F.min("offset").alias("offset"), F.sum("records").alias("records")
    ).withColumnRenamed("up", "node")


def tree(records: DataFrame, slots: int = ARCHIVE_SLOTS, fanout: int = FANOUT) -> DataFrame:
    """(archive, level, node, offset, length, records, hash): level 0 has the slots, the highest level one root an archive."""
    found = cut(leaves(records, slots))
    piece = lambda at: F.conv(F.substring("hash", at, 12), 16, 10).cast("decimal(38,0)")
    slot = found.groupBy("archive", F.col("slot").alias("node")).agg(
        # a hash of the multiset of its records, so however many rows repeat an identifier, none are gathered
        F.sha2(F.concat_ws(",", F.count("*"), F.min("hash"), F.max("hash"), F.sum(piece(1)), F.sum(piece(16)), F.sum(piece(31))).cast("binary"), 256).alias("hash"),
        F.sum("length").alias("length"), F.min("offset").alias("offset"), F.count("*").alias("records"),
    )
    out, level = [slot.withColumn("level", F.lit(0))], slot
    for n in range(1, levels(slots, fanout) + 1):
        level = _ordered(level, F.floor(F.col("node") / fanout))
        out.append(level.withColumn("level", F.lit(n)))
    columns = ["archive", "level", "node", "offset", "length", "records", "hash"]
    return cut(reduce(DataFrame.unionByName, [x.select(*columns) for x in out]))


def differing_slots(primary: DataFrame, replica: DataFrame, slots: int = ARCHIVE_SLOTS, fanout: int = FANOUT) -> DataFrame:
    """(archive, slot, status) where two trees differ, by descent from the roots; status: changed, missing or extra in the replica."""
    below = None
    for n in range(levels(slots, fanout), -1, -1):
        a, b = (t.where(F.col("level") == n).select("archive", "node", F.col("hash").alias(h)) for t, h in ((primary, "first"), (replica, "second")))
        if below is not None:
            up = lambda t: t.withColumn("up", F.floor(F.col("node") / fanout)).join(below, on=[t["archive"].eqNullSafe(below["of"]), F.col("up").eqNullSafe(below["at"])], how="left_semi").drop("up")  # noqa: B023, E731
            a, b = up(a), up(b)
        b = b.select(F.col("archive").alias("other"), F.col("node").alias("same"), "second")
        met = a.join(b, a["archive"].eqNullSafe(b["other"]) & a["node"].eqNullSafe(b["same"]), "full")
        kept = met.where(~F.col("first").eqNullSafe(F.col("second")))
        below = kept.select(F.coalesce("archive", "other").alias("of"), F.coalesce("node", "same").alias("at"), "first", "second")
    status = F.when(F.col("second").isNull(), "missing").when(F.col("first").isNull(), "extra").otherwise("changed")
    return below.select(F.col("of").alias("archive"), F.col("at").alias("slot"), status.alias("status"))


def audit(primary: DataFrame, replica: DataFrame, slots: int = ARCHIVE_SLOTS, fanout: int = FANOUT) -> DataFrame:
    """One row per primary record: page_id, archive, offset, length, record_sha256, status (ok, changed or missing).

    Both inputs are (page_id, record). An identifier with several records is one
    slot: if any of them differs, all are reported. Records only the replica has are
    in :func:`differing_slots` as ``extra``. Empty tables give no rows.
    """
    rows = cut(leaves(primary, slots))
    bad = cut(differing_slots(tree(primary, slots, fanout), tree(replica, slots, fanout), slots, fanout)).withColumnRenamed("archive", "of").withColumnRenamed("slot", "at")
    met = rows.join(bad, rows["archive"].eqNullSafe(bad["of"]) & rows["slot"].eqNullSafe(bad["at"]), "left")
    return met.select("page_id", "archive", "offset", "length", F.col("hash").alias("record_sha256"), F.coalesce("status", F.lit("ok")).alias("status"))
