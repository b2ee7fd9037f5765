"""Advice that is kept for a while: one record, a byte bound, a fixed lifetime, pages by collection, and spills to files."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class AdviceError(ValueError):
    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


# Lifetime in seconds, accounted bytes, and the limits of a page and of a list of ids.
LIFETIME, MOST_BYTES, MOST_PAGE, MOST_IDS = 900, 128 << 20, 1000, 1000


@dataclass
class Store:
    """Holds one record of collections (frames with an ``id``); reads never extend its life."""

    clock: object = time.monotonic
    handle: str | None = None
    snapshot: str | None = None
    until: float = 0.0
    collections: dict[str, DataFrame] = field(default_factory=dict)

    def publish(self, snapshot: str, collections: dict[str, DataFrame], size: int) -> str:
        if size > MOST_BYTES:
            raise AdviceError("record_too_large")
        if self.handle and self.until > self.clock():
            raise AdviceError("capacity")
        self.handle, self.snapshot, self.until = uuid.uuid4().hex, snapshot, self.clock() + LIFETIME
        self.collections = {k: v.cache() for k, v in collections.items()}
        return self.handle

    def _own(self, handle: str, snapshot: str, collection: str) -> DataFrame:
        if handle != self.handle:
            raise AdviceError("ADVICE_SNAPSHOT_UNKNOWN")
        if self.until <= self.clock():
            raise AdviceError("ADVICE_SNAPSHOT_EXPIRED")
        if snapshot != self.snapshot:
            raise AdviceError("ADVICE_SNAPSHOT_MISMATCH")
        if collection not in self.collections:
            raise AdviceError("INVALID_ADVICE_PAGE")
        return self.collections[collection]

    def page(self, handle: str, snapshot: str, collection: str, after: str | None = None, size: int = 100, **filters: str) -> DataFrame:
        """A page in id order; unknown filter columns are refused, a combination that meets nothing is empty."""
        rows = self._own(handle, snapshot, collection)
        if not 1 <= size <= MOST_PAGE or not set(filters) <= set(rows.columns):
            raise AdviceError("INVALID_ADVICE_PAGE")
        for name, value in filters.items():
            rows = rows.where(F.col(name) == value)
        return (rows if after is None else rows.where(F.col("id") > after)).orderBy("id").limit(size)

    def records(self, handle: str, snapshot: str, collection: str, ids: list[str]) -> DataFrame:
        """Records in the order of ``ids``; an unknown id refuses them all."""
        rows = self._own(handle, snapshot, collection)
        if not 1 <= len(ids) <= MOST_IDS or len(set(ids)) < len(ids):
            raise AdviceError("INVALID_ADVICE_PAGE")
        asked = rows.sparkSession.createDataFrame(list(enumerate(ids)), "position int, id string")
        if not asked.join(rows, "id", "left_anti").isEmpty():
            raise AdviceError("UNKNOWN_ADVICE_ID")
        return asked.join(rows, "id").orderBy("position").drop("position")

    def release(self, handle: str) -> None:
        if handle == self.handle:
            for rows in self.collections.values():
                rows.unpersist()
            self.handle, self.collections = None, {}


def spill(collections: dict[str, DataFrame], folder: str, snapshot: str) -> None:
    """One folder of JSON lines for each collection and an index, written aside and then published by one rename."""
    spark = next(iter(collections.values())).sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    aside = f"{folder}.{uuid.uuid4().hex}"
    for name, rows in collections.items():
        rows.write.json(f"{aside}/{name}")
    spark.createDataFrame([(json.dumps({"snapshot": snapshot, "collections": sorted(collections)}),)], "value string").coalesce(1).write.text(f"{aside}/index")
    path = jvm.org.apache.hadoop.fs.Path(aside)
    if not path.getFileSystem(conf).rename(path, jvm.org.apache.hadoop.fs.Path(folder)):
        raise AdviceError("spill")
