"""Embedding near-dedup with randomised-rotation binary codes.

Unit vectors are rotated by one random orthogonal matrix; the signs are a code of
one bit for each dimension and the stored factor says how well the code points at
its vector. From a code and another vector comes an unbiased estimate of the inner
product with a confidence interval of WIDTH standard deviations, and the
Cauchy-Schwarz limit that no inner product exceeds. Pairs whose interval or limit
ends below the threshold are settled by the codes; only the others are computed
exactly, in double precision. At the default width a link is lost with a
probability below 1e-13; without a width the limit alone decides and none can be.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from collections.abc import Iterator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import Union, components
from .runtime import cut, drop_cut

THRESHOLD, SEED = 0.93, 5
#: Vectors of a block; blocks of one label are compared pair by pair, so a hot label spreads over many tasks.
BLOCK = 2048
#: Width of the confidence interval in standard deviations of the code's error; None: the whole possible range.
WIDTH: float | None = 8.0


@lru_cache(maxsize=8)
def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign codes of rotated unit vectors, and the inner product of each with its own code."""
    dim = vectors.shape[1]
    turned = vectors @ rotation(dim)
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(dim)


def upper_bounds(codes: np.ndarray, factors: np.ndarray, turned: np.ndarray, width: float | None = WIDTH) -> np.ndarray:
    """The most that each coded vector's inner product with each rotated unit vector can be."""
    dim = turned.shape[1]
    signs = (np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))
    seen = signs @ turned.astype(np.float32).T
    f = factors.astype(np.float32)[:, None]
    off = np.sqrt(np.maximum(0, 1 - f * f))
    most = f * seen + off * np.sqrt(np.maximum(0, 1 - seen * seen))
    return most if width is None else np.minimum(most, estimates(f, seen) + width * off / f / np.sqrt(max(1, dim - 1)))


def estimates(factors: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Unbiased inner products, from those with the codes."""
    return seen / factors


def linked_pairs(a: np.ndarray, b: np.ndarray, codes: np.ndarray, factors: np.ndarray, threshold: float, width: float | None = WIDTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of unit vectors whose exact inner product reaches the threshold; codes and factors are those of ``a``."""
    turned = b @ rotation(b.shape[1])
    for lo in range(0, len(a), 512):
        near = upper_bounds(codes[lo : lo + 512], factors[lo : lo + 512], turned, width) >= threshold - 1e-4
        i, j = np.nonzero(near)
        for at in range(0, len(i), 100_000):
            x, y = i[at : at + 100_000] + lo, j[at : at + 100_000]
            exact = np.einsum("nd,nd->n", a[x], b[y]) >= threshold
            yield x[exact], y[exact]


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists, dims = batch.column(4).to_pylist(), batch.column(1).to_numpy()
        codes: list = [b""] * len(lists)
        factors = np.zeros(len(lists))
        for dim in np.unique(dims).tolist():
            own = np.flatnonzero(dims == dim)
            units = np.array([lists[k] for k in own], float)
            units /= np.linalg.norm(units, axis=1)[:, None]
            made, factors[own] = encode(units)
            for k, code in zip(own.tolist(), made, strict=True):
                codes[k] = code.tobytes()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary()), pa.array(factors, pa.float64())], ["label", "dim", "cls", "size", "embedding", "code", "factor"])


def _compare(threshold: float, width: float | None):
    def run(table: pa.Table) -> pa.Table:
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        block, cls, size = (table.column(c).to_numpy() for c in ("block", "cls", "size"))
        vectors = np.array(table.column("embedding").to_pylist(), float)
        vectors /= np.linalg.norm(vectors, axis=1)[:, None]
        codes = np.array([np.frombuffer(c, np.uint8) for c in table.column("code").to_pylist()])
        factors = table.column("factor").to_numpy()
        first, second = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        links, sets = np.zeros(len(cls), np.int64), Union(len(cls))
        order = np.argsort(cls, kind="stable")  # roots are smallest classes
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        if len(first) and len(second):
            for x, y in linked_pairs(vectors[first], vectors[second], codes[first], factors[first], threshold, width):
                x, y = first[x], second[y]
                if lo == hi:
                    x, y = x[x < y], y[x < y]
                np.add.at(links, x, size[y])
                np.add.at(links, y, size[x])
                sets.join_all(place[x], place[y])
        root = cls[order][[sets.find(k) for k in place.tolist()]]
        on = links > 0
        return pa.table({"cls": pa.array(cls[on]), "links": pa.array(links[on]), "root": pa.array(root[on])})

    return run


def near_duplicates(
    table: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK, width: float | None = WIDTH
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors are compared where their labels are equal and not null and they have as
    many components. Null, empty and zero vectors and those with null or non-finite
    components link with nothing, as does a null identifier (its component is null
    and it isn't kept). Equal vectors are one class with a count, so copies cost no
    pairs. Rows that repeat an identifier are vectors of their own: each counts as a
    link. Other columns are ignored; an empty table gives no rows.
    """
    v = F.col("embedding")
    ids = table.select(table[id_col].cast("long").alias("vec_id"), table[label_col].cast("long").alias("label"), table[vector_col].cast("array<double>").alias("embedding"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    good = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & some, F.lit(False))
    keyed = ids.withColumn("good", good).withColumn("embedding", F.when(good, F.transform(v, lambda x: x + F.lit(0.0))))
    keyed = keyed.select("vec_id", "good", F.when(good, F.col("label")).alias("label"), "embedding", F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2"))
    classes = keyed.where("good").groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.max("embedding").alias("embedding"))
    # classes are named once, as they are written: different vectors may share an identifier
    classes = cut(classes.withColumn("cls", F.monotonically_increasing_id()))
    indexed = cut(
        classes.select("label", F.size("embedding").alias("dim"), "cls", "size", "embedding").mapInArrow(_index, "label long, dim int, cls long, size long, embedding array<double>, code binary, factor double")
    )
    blocks = indexed.groupBy("label", "dim").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1")
    # at most one row for each `block` vectors
    dealt = indexed.join(blocks, ["label", "dim"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("cls", F.lit("block")), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", "dim", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "cls", "size", "embedding", "code", "factor")
    compared = cut(dealt.groupBy("label", "dim", "lo", "hi").applyInArrow(_compare(threshold, width), "cls long, links long, root long"))
    links = compared.groupBy("cls").agg(F.sum("links").alias("links"))
    found = components(compared.select(F.col("cls").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cls")
    smallest = found.join(classes.select("cls", "rep"), "cls").groupBy("component").agg(F.min("rep").alias("least"))
    of_class = classes.select("label", "k1", "k2", "cls", "rep", "size").join(links, "cls", "left").join(found.join(smallest, "component").select("cls", "least"), "cls", "left")
    of_class = cut(of_class.select("label", "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"), F.coalesce("least", "rep").alias("component")))
    rows = keyed.select("vec_id", "label", F.when(F.col("good"), F.col("k1")).alias("k1"), "k2").join(of_class, ["label", "k1", "k2"], "left")
    component = F.coalesce("component", "vec_id")
    for old in (classes, indexed, compared):
        drop_cut(old)
    return rows.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
