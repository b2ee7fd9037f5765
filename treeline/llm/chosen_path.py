"""Set similarity join on word shingles by chosen paths.

Sets of five-word shingles are embedded in WIDTH min-hash tokens. A run splits the
embedded sets recursively: each bucket samples tokens, as many as keep a pair at
the threshold together in expectation, and sets that hold a sampled token go on
together; buckets that are still large after LEVELS are split further. Buckets at
the bottom are compared by brute force on the embedded tokens, and there are as
many runs as meet a pair at the threshold at the deepest level with the target
probability. Bucket mates that may be similar form coarse groups; inside each
coarse group every pair is then compared exactly on whole shingle sets, block by
block, so what a task emits is counts and a spanning forest, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import Union, components
from .runtime import cut, drop_cut

SHINGLE, THRESHOLD = 5, 0.8
#: Embedded tokens of a set, levels of splitting, further ones of large buckets, and the probability with which a pair at the threshold must share a bucket.
WIDTH, LEVELS, MORE_LEVELS, RECALL = 128, 2, 1, 0.999
#: Sets from which a bucket is split further.
SPLIT_ABOVE = 4096
#: Estimated similarity from which bucket mates join a coarse group, and the one beyond which a set needs no comparisons of its own.
COARSE, SAME = 0.6, 0.85
#: Sets of a block, in buckets and in coarse groups.
BUCKET_BLOCK, EXACT_BLOCK = 1024, 256
#: Small buckets and groups are dealt over this many tasks for each shuffle partition.
TASKS = 4
CACHE_WORDS, CACHE_CHARS = 300_000, 48
_SEED = 17
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _M1
    x ^= x >> np.uint64(31)
    x *= _M2
    x ^= x >> np.uint64(29)
    return x


def runs_for(recall: float = RECALL, levels: int = LEVELS) -> int:
    """Runs after which a pair at the threshold has shared a bucket with probability ``recall``.

    The tokens that both sets hold and a bucket samples number one in expectation,
    so a pair survives a level with the probability of a critical branching process.
    """
    alive = 1.0
    for _ in range(levels):
        alive = 1 - math.exp(-alive)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - alive)))


class Shingler:
    """Sets of hashed shingles of whole texts; words are lower case and separated by white space."""

    def __init__(self, words: int = SHINGLE):
        self.words, self.known = words, {}

    def _hash(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.lower())
        if len(self.known) < CACHE_WORDS and len(word) <= CACHE_CHARS:
            self.known[word] = h
        return h

    def set_of(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes; a text of fewer words is one shingle of them all, an empty one has none."""
        words = (text or "").split()
        if not words:
            return np.zeros(0, np.uint64)
        get, make = self.known.get, self._hash
        h = np.fromiter([get(w) or make(w) for w in words], np.uint64, len(words))
        n = min(self.words, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = _mix(out ^ h[k : len(h) - n + 1 + k])
        return np.unique(out)


_DRAW = np.random.default_rng(_SEED)
_FACTORS = _DRAW.integers(0, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def embed(tokens: np.ndarray) -> np.ndarray:
    """WIDTH min-hash tokens of a set that isn't empty."""
    low = np.full(WIDTH, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(tokens), 1024):
        part = tokens[lo : lo + 1024]
        np.minimum(low, (_FACTORS[:, None] * part).min(axis=1), out=low)
    return low


def _limit(threshold: float) -> np.uint64:
    return np.uint64(int((2**64 - 1) / (threshold * WIDTH)))


def paths(embedded: np.ndarray, runs: int, levels: int = LEVELS, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every chosen path of a (sets, WIDTH) block after ``levels`` splits in each of ``runs`` runs."""
    row = np.repeat(np.arange(len(embedded)), runs)
    state = np.tile(_mix(np.arange(1, runs + 1, dtype=np.uint64)), len(embedded))
    for _ in range(levels):
        row, state = _split(embedded, row, state, threshold)
    return row, state


def _split(embedded: np.ndarray, row: np.ndarray, state: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """One level: sets of buckets ``state`` go on with each of their tokens that the bucket samples."""
    tokens = _mix(embedded ^ np.arange(1, WIDTH + 1, dtype=np.uint64) * _M2)
    rows, states = [], []
    for lo in range(0, len(row), 8192):
        drawn = _mix(tokens[row[lo : lo + 8192]] ^ state[lo : lo + 8192, None])
        at, k = np.nonzero(drawn < _limit(threshold))
        rows.append(row[lo + at])
        states.append(_mix(drawn[at, k]))
    return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in ((rows, np.int64), (states, np.uint64)))


def _split_buckets(threshold: float):
    """One more level for rows of large buckets, by their marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                marks = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(-1, WIDTH).astype(np.uint64)
                row, state = _split(marks, np.arange(part.num_rows), part.column(1).to_numpy().view(np.uint64), threshold)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(state.view(np.int64))], ["cls", "bucket"])

    return run


def _signatures(words: int, runs: int, levels: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sets = [shingler.set_of(t) for t in part.column(1).to_pylist()]
                some = [k for k, s in enumerate(sets) if len(s)]
                block = np.array([embed(sets[k]) for k in some], np.uint64).reshape(-1, WIDTH)
                row, bucket = paths(block, runs, levels, threshold)
                bucket = np.unique(np.stack([row.astype(np.int64), bucket.view(np.int64)], 1), axis=0)
                stop = np.searchsorted(bucket[:, 0], np.arange(len(some) + 1))
                brief = (_mix(block) >> np.uint64(56)).astype(np.uint8)
                keys: list = [(None, None, 0, None, [])] * len(sets)
                for n, k in enumerate(some):
                    raw = sets[k].tobytes()
                    keys[k] = (xxhash.xxh64_intdigest(raw) - 2**63, xxhash.xxh64_intdigest(raw, 1) - 2**63, len(sets[k]), brief[n].tobytes(), bucket[stop[n] : stop[n + 1], 1].tolist())
                k1, k2, size, mark, buckets = zip(*keys, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(size, pa.int64()), pa.array(mark, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))],
                    ["doc_id", "sha", "k1", "k2", "shingles", "mark", "buckets"],
                )

    return run


def coarse_edges(marks: np.ndarray, coarse: float = COARSE, same: float = SAME) -> list[tuple[int, int]]:
    """Edges between sets of a bucket whose estimates reach ``coarse``, found in leader order.

    A set within ``same`` of a leader makes no comparisons of its own: whatever is
    similar to it is, by the triangle inequality of Jaccard distance, within
    ``coarse`` of that leader.
    """
    out, waiting = [], np.ones(len(marks), bool)
    for k in range(len(marks)):
        if not waiting[k]:
            continue
        estimate = (marks == marks[k]).mean(axis=1)
        estimate[k] = 0
        near = np.flatnonzero(estimate >= coarse)
        out += [(k, int(j)) for j in near]
        waiting[near[estimate[near] >= same]] = False
    return out


def _brute_force(coarse: float, same: float):
    def run(table: pa.Table) -> pa.Table:
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        bucket, cls, block = (table.column(c).to_numpy() for c in ("bucket", "cls", "block"))
        marks = np.frombuffer(b"".join(table.column("mark").to_pylist()), np.uint8).reshape(-1, WIDTH)
        order = np.lexsort((cls, block, bucket))
        bucket, cls, block, marks = bucket[order], cls[order], block[order], marks[order]
        a, b = [], []
        starts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
        for s, e in zip(starts.tolist(), starts[1:].tolist(), strict=False):
            if lo == hi:
                pairs = coarse_edges(marks[s:e], coarse, same)
            else:  # two blocks of one large bucket: leaders of each against all of the other
                first, second = np.flatnonzero(block[s:e] == lo), np.flatnonzero(block[s:e] == hi)
                pairs, waiting = [], np.ones(len(first), bool)
                for n, k in enumerate(first.tolist()):
                    if waiting[n]:
                        estimate = (marks[s:e][second] == marks[s + k]).mean(axis=1)
                        pairs += [(k, int(j)) for j in second[estimate >= coarse]]
                        own = (marks[s:e][first] == marks[s + k]).mean(axis=1)
                        waiting[own >= same] = False
            a += [cls[s + x] for x, _ in pairs]
            b += [cls[s + y] for _, y in pairs]
        # what a task found is sent as a forest: one edge for each set at most, however many pairs met
        ids = np.unique(cls)
        sets = Union(len(ids))
        if a:
            sets.join_all(np.searchsorted(ids, a), np.searchsorted(ids, b))
        root = ids[[sets.find(k) for k in range(len(ids))]] if len(ids) else ids
        on = root != ids
        return pa.table({"a": pa.array(ids[on].astype(np.int64)), "b": pa.array(root[on].astype(np.int64))})

    return run


def shared_counts(first: list[np.ndarray], second: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of two lists of sets."""
    if len(first) * len(second) <= 64:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in second] for x in first], np.int64).reshape(len(first), len(second))
    flat = np.concatenate([*first, *second])
    owner = np.repeat(np.arange(len(first) + len(second)), [len(s) for s in (*first, *second)])
    distinct, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    common = times[column] > 1  # what only one set holds is in no intersection
    owner, column = owner[common], np.unique(column[common], return_inverse=True)[1]
    total = np.zeros((len(first), len(second)), np.int64)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = int(column.max(initial=-1)) + 1
    for lo in range(0, width, 4096):
        s, e = np.searchsorted(column, [lo, lo + 4096])
        dense = np.zeros((len(first) + len(second), min(4096, width - lo)), np.float32)
        dense[owner[s:e], column[s:e] - lo] = 1
        total += np.rint(dense[: len(first)] @ dense[len(first) :].T).astype(np.int64)
    return total


def _verify(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        group, cls, size, block = (table.column(c).to_numpy() for c in ("coarse", "cls", "size", "block"))
        raw = table.column("tokens").to_pylist()
        order = np.lexsort((cls, group))
        links = np.zeros(len(cls), np.int64)
        root = cls.copy()
        starts = np.concatenate([[0], np.flatnonzero(np.diff(group[order])) + 1, [len(order)]])
        for s, e in zip(starts.tolist(), starts[1:].tolist(), strict=False):
            own = order[s:e]
            tokens = [np.frombuffer(raw[k], np.uint64) for k in own]
            lengths = np.array([len(t) for t in tokens])
            first, second = np.flatnonzero(block[own] == lo), np.flatnonzero(block[own] == hi)
            if not len(first) or not len(second):
                continue
            inter = shared_counts([tokens[k] for k in first], [tokens[k] for k in second])
            union = lengths[first][:, None] + lengths[second] - inter
            x, y = np.nonzero(inter >= threshold * union)
            x, y = first[x], second[y]
            if lo == hi:
                x, y = x[x < y], y[x < y]
            np.add.at(links, own[x], size[own[y]])
            np.add.at(links, own[y], size[own[x]])
            sets = Union(len(own))  # own is in the order of classes
            if len(x):
                sets.join_all(x, y)
            root[own] = cls[own][[sets.find(k) for k in range(len(own))]]
        on = links > 0
        return pa.table({"cls": pa.array(cls[on]), "links": pa.array(links[on]), "root": pa.array(root[on])})

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                tokens = [shingler.set_of(t).tobytes() for t in part.column(4).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(tokens, pa.binary())], ["cls", "size", "coarse", "blocks", "tokens"])

    return run


def _dealt(rows: DataFrame, key: str, count: str, block: int, tasks: int) -> DataFrame:
    """Rows with (task, lo, hi, block): large groups as pairs of blocks, small ones dealt over ``tasks`` by hash."""
    rows = rows.withColumn("blocks", F.ceil(F.col(count) / block).cast("int"))
    rows = rows.withColumn("task", F.when(F.col("blocks") > 1, F.xxhash64(key)).otherwise(F.pmod(F.xxhash64(key), F.lit(tasks))))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("cls", F.lit("block")), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other", "blocks")


def jaccard_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    words: int = SHINGLE,
    recall: float = RECALL,
    levels: int = LEVELS,
) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, n_links, component_id, kept, text_sha256.

    Documents with equal shingle sets are one class (class_id: its smallest
    identifier; it is null where no document of a class has one). n_links counts the
    other documents, copies included, whose exact Jaccard similarity reaches
    ``threshold``; component_id is the smallest identifier reachable by links. Of
    each component one document is kept: that with the smallest identifier (null:
    last) and of those the smallest hash of its text; rows that repeat both are kept
    or dropped together. A text of fewer words than a shingle is one shingle of all
    its words; null and empty texts have no shingle, link with nothing and are kept.
    Rows that repeat an identifier with other texts are documents of their own. Other
    columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    depth = levels + MORE_LEVELS
    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)).alias("sha"))
    signed = cut(rows.mapInArrow(_signatures(words, runs_for(recall, depth), levels, threshold), "doc_id long, sha binary, k1 long, k2 long, shingles long, mark binary, buckets array<long>"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha")).alias("first")
    classes = signed.where("shingles > 0").groupBy("k1", "k2").agg(first, F.count("*").alias("size"), F.min("mark").alias("mark"), F.min("buckets").alias("buckets"))
    # classes are named once, as they are written: different classes may have one smallest identifier
    classes = cut(classes.withColumn("cls", F.monotonically_increasing_id()))
    chosen = cut(classes.select("cls", F.explode("buckets").alias("bucket")))
    sizes = cut(chosen.groupBy("bucket").agg(F.count("*").alias("sets")).where("sets > 1"))
    for _ in range(levels, depth):
        large = cut(sizes.where(F.col("sets") > SPLIT_ABOVE).select("bucket"))
        if large.isEmpty():
            drop_cut(large)
            break
        more = chosen.join(large, "bucket").join(classes.select("cls", "mark"), "cls").select("cls", "bucket", "mark").mapInArrow(_split_buckets(threshold), "cls long, bucket long").distinct()
        split = cut(chosen.join(large, "bucket", "left_anti").select("cls", "bucket").unionByName(more))
        for old in (chosen, sizes, large):
            drop_cut(old)
        chosen = split
        sizes = cut(chosen.groupBy("bucket").agg(F.count("*").alias("sets")).where("sets > 1"))
    tasks = TASKS * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    mates = cut(chosen.join(sizes, "bucket"))
    marked = mates.join(classes.select("cls", "mark"), "cls")
    compared = _dealt(marked, "bucket", "sets", BUCKET_BLOCK, tasks).groupBy("task", "lo", "hi").applyInArrow(_brute_force(COARSE, SAME), "a long, b long")
    coarse = cut(components(compared).select(F.col("node").alias("cls"), F.col("component").alias("coarse")))
    counted = cut(coarse.groupBy("coarse").agg(F.count("*").alias("members")))
    members = cut(coarse.join(counted, "coarse").join(classes.select("cls", "size", "first.doc_id", "first.sha"), "cls").select("cls", "size", "coarse", F.col("members").alias("blocks"), "doc_id", "sha"))
    # one text of each class; rows that repeat an identifier and its text are the same one. The members
    # grow with the input, so both sides are shuffled at every size
    mine = rows.where("text is not null").alias("r").hint("merge").join(members.alias("m"), F.col("r.sha").eqNullSafe(F.col("m.sha")) & F.col("r.doc_id").eqNullSafe(F.col("m.doc_id")))
    texts = mine.groupBy("cls", "size", "coarse", "blocks").agg(F.min("text").alias("text"))
    sets = texts.mapInArrow(_sets(words), "cls long, size long, coarse long, blocks long, tokens binary").withColumnRenamed("blocks", "members")
    verified = cut(_dealt(sets, "coarse", "members", EXACT_BLOCK, tasks).groupBy("task", "lo", "hi").applyInArrow(_verify(threshold), "cls long, links long, root long"))
    links = verified.groupBy("cls").agg(F.sum("links").alias("links"))
    found = components(verified.select(F.col("cls").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cls")
    keepers = found.join(classes.select("cls", "first"), "cls").groupBy("component").agg(F.min("first").alias("keeper"))
    linked = found.join(keepers, "component").select("cls", "keeper")
    of_class = classes.select("k1", "k2", "cls", "size", "first").join(links, "cls", "left").join(linked, "cls", "left")
    of_class = cut(of_class.select("k1", "k2", "size", F.col("first.doc_id").alias("rep"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"), F.coalesce("keeper", "first").alias("keeper")))
    for old in (chosen, sizes, mates, coarse, counted, members, verified):
        drop_cut(old)
    some = F.col("keeper").isNotNull()
    return signed.select("doc_id", "sha", "k1", "k2").join(of_class, ["k1", "k2"], "left").select(
        "doc_id",
        F.when(some, F.col("rep")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.when(some, F.col("keeper.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(some, F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("sha") == F.col("keeper.sha"))).otherwise(True).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
