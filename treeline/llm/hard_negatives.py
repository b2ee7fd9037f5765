"""Hard-negative mining by a two-dimensional block matrix multiply.

Anchors and rows are sharded into blocks and their vectors into chunks of
dimensions. A task multiplies one anchor block with one row block over one chunk;
its partial int64 scores are shuffled by strips of anchors, added over the chunks,
and each strip of a tile is reduced at once to the few best rows of each window.
First the windows are "same label" (the positives); then, with the positives known,
"another label and a score between two shares of a positive's". What leaves a tile
is bounded by anchors times places, so the last merges are small.

Shards are dealt by row number, never by label or identifier, so a label or a vector
that a third of all rows share spreads like any other. The only quadratic cost is
the stated one: anchors times rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut, drop_cut

#: Components are floor(SCALE * x).
SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these per cent of the positive's.
LOW, HIGH = 50, 95
#: Anchors and rows of a block, dimensions of a chunk, anchors of a strip.
ANCHOR_BLOCK, ROW_BLOCK, CHUNK, STRIP = 512, 4096, 32, 64
_TILE = "strip int, part int, anchors binary, rows binary, scores binary"


def pack_scores(scores: np.ndarray) -> bytes:
    """Lossless bytes of int64 scores: one plane for each byte that any of them needs, signs folded into the lowest bit."""
    folded = ((scores << 1) ^ (scores >> 63)).view(np.uint64).ravel()
    planes = max(1, -(-int(folded.max(initial=0)).bit_length() // 8))
    return folded.view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()


def unpack_scores(data: bytes, count: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(-1, count)
    folded = np.zeros((count, 8), np.uint8)
    folded[:, : len(planes)] = planes.T
    folded = folded.view(np.uint64).ravel()
    return (folded >> np.uint64(1)).view(np.int64) ^ -(folded & np.uint64(1)).view(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; in doubles where none can exceed their 53 bits."""
    peak = lambda x: max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if a.shape[1] * peak(a) * peak(b) < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def _vectors(table: pa.Table) -> np.ndarray:
    lists = table.column("q").combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 0), np.int64)


def _facts(table: pa.Table) -> bytes:
    """Row numbers, identifiers, labels (and windows) of a block, as one Arrow stream."""
    sink = pa.BufferOutputStream()
    kept = table.select([c for c in ("row", "vec_id", "label", "windows") if c in table.column_names])
    with pa.ipc.new_stream(sink, kept.schema) as stream:
        stream.write_table(kept)
    return sink.getvalue().to_pybytes()


def _read(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _multiply(key, anchors: pa.Table, rows: pa.Table) -> pa.Table:
    out: dict[str, list] = {c.split()[0]: [] for c in _TILE.split(", ")}
    part = key[-1].as_py()
    if anchors.num_rows and rows.num_rows:
        anchors, rows = anchors.sort_by("row"), rows.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        a, b = _vectors(anchors), _vectors(rows)
        about = _facts(rows) if part == 0 else None
        for strip, lo in enumerate(range(0, len(a), STRIP)):
            values = (strip, part, _facts(anchors.slice(lo, STRIP)) if part == 0 else None, about, pack_scores(products(a[lo : lo + STRIP], b)))
            for column, value in zip(out.values(), values, strict=True):
                column.append(value)
    schema = pa.schema([("strip", pa.int32()), ("part", pa.int32()), ("anchors", pa.binary()), ("rows", pa.binary()), ("scores", pa.binary())])
    group = pa.schema([("grp", pa.int64()), ("ab", pa.int32()), ("rb", pa.int32())])
    keys = [pa.array([k.as_py()] * len(out["strip"]), f.type) for k, f in zip(key[:3], group, strict=True)]
    return pa.table([*keys, *(pa.array(out[f.name], f.type) for f in schema)], schema=pa.schema([*group, *schema]))


def _added(table: pa.Table) -> tuple[pa.Table, pa.Table, np.ndarray]:
    """Anchors, rows and whole scores of one strip of a tile."""
    parts = {p: k for k, p in enumerate(table.column("part").to_pylist())}
    anchors, rows = (_read(table.column(c)[parts[0]].as_py()) for c in ("anchors", "rows"))
    count = anchors.num_rows * rows.num_rows
    total = np.zeros(count, np.int64)
    for data in table.column("scores"):
        total += unpack_scores(data.as_py(), count)
    return anchors, rows, total.reshape(anchors.num_rows, rows.num_rows)


def first_places(scores: np.ndarray, allowed: np.ndarray, places: int) -> np.ndarray:
    """Indices of the highest allowed scores; rows come sorted by identifier, so ties go to the smaller one."""
    at = np.flatnonzero(allowed)
    if len(at) > places:
        own = scores[at]
        least = np.partition(own, -places)[-places]
        at = at[own >= least]
    return at[np.argsort(-scores[at], kind="stable")][:places]


def _positives(places: int):
    def run(table: pa.Table) -> pa.Table:
        anchors, rows, scores = _added(table)
        numbers, ids, labels = (rows.column(c).to_numpy() for c in ("row", "vec_id", "label"))
        out = []
        for k, (row, vec_id, label) in enumerate(zip(*(anchors.column(c).to_pylist() for c in ("row", "vec_id", "label")), strict=True)):
            for at in first_places(scores[k], (labels == label) & (numbers != row), places):
                out.append((row, vec_id, label, int(numbers[at]), int(ids[at]), int(scores[k, at])))
        columns = ("row", "vec_id", "label", "other", "other_id", "score")
        return pa.table({c: pa.array([r[n] for r in out], pa.int64()) for n, c in enumerate(columns)})

    return run


def _negatives(places: int, low: int, high: int):
    def run(table: pa.Table) -> pa.Table:
        anchors, rows, scores = _added(table)
        numbers, ids, labels = (rows.column(c).to_numpy() for c in ("row", "vec_id", "label"))
        out = []
        for k, (row, vec_id, label, windows) in enumerate(zip(*(anchors.column(c).to_pylist() for c in ("row", "vec_id", "label", "windows")), strict=True)):
            own, foreign = scores[k], labels != label
            for window in windows:
                least, most = -(-low * window["score"] // 100), high * window["score"] // 100
                for at in first_places(own, foreign & (own >= least) & (own <= most), places):
                    out.append((row, vec_id, window["place"], window["other_id"], window["score"], int(numbers[at]), int(ids[at]), int(own[at])))
        columns = ("row", "vec_id", "place", "positive_id", "positive_score", "other", "other_id", "score")
        return pa.table({c: pa.array([r[n] for r in out], pa.int64()) for n, c in enumerate(columns)})

    return run


def _tiles(anchors: DataFrame, rows: DataFrame, group: Column, blocks: DataFrame, chunk: int) -> DataFrame:
    """Partial scores of all anchors with all rows of their group, by strips.

    ``blocks`` has for each group how many blocks its anchors and rows make: at most one
    row for each group, and groups are dimensions or (dimension, label) pairs.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col("dim") / chunk)).cast("int")
    chunked = F.slice("q", F.col("part") * chunk + 1, F.lit(chunk)).alias("q")

    def dealt(side: DataFrame, own: str, own_n: str, other: str, other_n: str, extra: list[str]) -> DataFrame:
        keyed = side.withColumn("grp", group).join(blocks, "grp")
        keyed = keyed.withColumn(own, F.pmod(F.xxhash64("row", F.lit(own)), F.col(own_n)).cast("int"))
        keyed = keyed.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        named = [F.col(c).alias(c) for c in ("grp", own, other_n, "part", "row", "vec_id", "label")]  # both sides may come from one table
        keyed = keyed.select(*named, chunked, *(F.col(c).alias(c) for c in extra))
        return keyed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1))).drop(other_n)

    a = dealt(anchors, "ab", "a_blocks", "rb", "r_blocks", [c for c in ("windows",) if c in anchors.columns])
    r = dealt(rows, "rb", "r_blocks", "ab", "a_blocks", [])
    key = ["grp", "ab", "rb", "part"]
    return a.groupBy(*key).cogroup(r.groupBy(*key)).applyInArrow(_multiply, "grp long, ab int, rb int, " + _TILE)


def _blocks(anchors: DataFrame, rows: DataFrame, group: Column, anchor_block: int, row_block: int) -> DataFrame:
    """Blocks of each group that has anchors and rows."""
    counted = lambda side, size, name: side.groupBy(group.alias("grp")).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    return counted(anchors, anchor_block, "a_blocks").join(counted(rows, row_block, "r_blocks"), "grp")


def mine(
    table: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    scale: int = SCALE,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    chunk: int = CHUNK,
    anchor_block: int = ANCHOR_BLOCK,
    row_block: int = ROW_BLOCK,
) -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` is a condition on ``table``. Scores are inner products of floor(scale * x);
    higher ones come first, ties by smaller identifier. An anchor's positives are its
    first ``positives`` other rows of its label; for each of them the first ``negatives``
    rows of other labels are returned whose score lies between ``low`` and ``high`` per
    cent of the positive's. A positive without such a row gives nothing, so a negative
    positive score never does.

    Rows with a null identifier, label or vector or with null or non-finite components
    take no part. Vectors meet only those with as many components; empty ones score 0
    among themselves. Rows that repeat an identifier are rows of their own. Scores beyond
    64 bits wrap as sums of longs do. Other columns of ``table`` are ignored, whatever
    their names. An empty table, or one without anchors, gives no rows.
    """
    v = F.col("embedding")
    rows = table.select(
        table[id_col].cast("long").alias("vec_id"),
        table[label_col].cast("long").alias("label"),
        table[vector_col].cast("array<double>").alias("embedding"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
    )
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite)
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "anchor", F.size(v).alias("dim"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("q"))
    rows = cut(rows)  # rows are numbered once
    anchors = rows.where("anchor").drop("anchor")
    rows = rows.drop("anchor")

    labelled = F.xxhash64("dim", "label")
    tiles = _tiles(anchors, rows, labelled, _blocks(anchors, rows, labelled, anchor_block, row_block), chunk)
    best = tiles.groupBy("grp", "ab", "rb", "strip").applyInArrow(_positives(positives), "row long, vec_id long, label long, other long, other_id long, score long")
    of_anchor = Window.partitionBy("row").orderBy(F.desc("score"), "other_id", "other")
    best = best.withColumn("place", F.row_number().over(of_anchor)).where(F.col("place") <= positives)
    # at most `positives` entries
    windows = cut(best.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(F.col("place").cast("long").alias("place"), "other_id", "score"))).alias("windows")))

    whole = F.col("dim").cast("long")
    served = anchors.join(windows, "row")
    tiles = _tiles(served, rows, whole, _blocks(served, rows, whole, anchor_block, row_block), chunk)
    schema = "row long, vec_id long, place long, positive_id long, positive_score long, other long, other_id long, score long"
    found = tiles.groupBy("grp", "ab", "rb", "strip").applyInArrow(_negatives(negatives, low, high), schema)
    of_window = Window.partitionBy("row", "place").orderBy(F.desc("score"), "other_id", "other")
    found = found.withColumn("rank", F.row_number().over(of_window)).where(F.col("rank") <= negatives)
    out = cut(
        found.select(
            F.col("vec_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        )
    )
    for old in (rows, windows):
        drop_cut(old)
    return out
