"""Tables in the shared folder that end a lineage, so later levels re-read files and lost executors cost no recomputation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder (single-machine runs).
_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="treeline-levels-"))
    return _OWN[0]


def settled(rows: DataFrame) -> DataFrame:
    """``rows`` written once and read back."""
    path = f"{shared_folder(rows.sparkSession)}/level-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    table = rows.sparkSession.read.schema(rows.schema).parquet(path)
    table._settled_at = path
    return table


def dropped(*tables: DataFrame | None) -> None:
    """Delete tables made by :func:`settled` that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_settled_at", None)
        if path:
            context = table.sparkSession.sparkContext
            target = context._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
