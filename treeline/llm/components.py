"""Connected components by contraction, and the local union-find that tasks use to send forests instead of pairs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut, drop_cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node long, component long) of every node that has an edge; the component is its smallest node.

    Each round points every node at the smallest of itself and its neighbours, follows
    these pointers to their ends by doubling, and contracts the edges. A node that
    neither moves nor is pointed at has only smaller neighbours in the next round, so
    the nodes left at least halve in two rounds, and a chain of n nodes ends in one
    round of log n doublings. Every table is cut into the shared folder; both sides of
    each join are shuffled from there, so adaptive execution can split the node that a
    third of all edges touch.
    """
    ends = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    left = cut(edges.select(*ends(F.col(a).cast("long"), F.col(b).cast("long"))).where("a < b").distinct())
    spark = edges.sparkSession
    found = None
    while not left.isEmpty():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).union(left.select(F.col("b").alias("node"), F.col("a").alias("other")))
        point = cut(both.groupBy("node").agg(F.min("other").alias("to")).select("node", F.least("node", "to").alias("to")))
        while True:
            jumped = cut(point.join(point.select(F.col("node").alias("to"), F.col("to").alias("label")), "to").select("node", F.col("label").alias("to"), (F.col("label") < F.col("to")).alias("moved")))
            moved = not jumped.where("moved").isEmpty()
            drop_cut(point)
            point = jumped
            if not moved:
                break
        if found is None:
            now = point.select("node", F.col("to").alias("component"))
        else:
            step = point.select(F.col("node").alias("component"), "to")
            now = found.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        now = cut(now)
        of = lambda end, to: point.select(F.col("node").alias(end), F.col("to").alias(to))  # noqa: B023, E731
        fewer = cut(left.join(of("a", "x"), "a").join(of("b", "y"), "b").select(*ends(F.col("x"), F.col("y"))).where("a < b").distinct())
        for old in (left, point, *([] if found is None else [found])):
            drop_cut(old)
        left, found = fewer, now
    drop_cut(left)
    return spark.createDataFrame([], "node long, component long") if found is None else found


class Union:
    """Union-find over 0..n-1; the smallest member of a set is its root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True

    def join_all(self, xs: np.ndarray, ys: np.ndarray) -> None:
        """Join many pairs at once, by spreading the smallest root until nothing changes."""
        root = np.array([self.find(k) for k in range(len(self.up))])
        while True:
            before = root.copy()
            low = np.minimum(root[xs], root[ys])
            np.minimum.at(root, root[xs], low)
            np.minimum.at(root, root[ys], low)
            root = root[root]
            if (root == before).all():
                break
        self.up = root.tolist()
