"""Reachability, components and strong components, written as one join for each round."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.operators.scratch import dropped, settled


def reach(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, depth) reachable from ``roots`` (node) over ``edges`` (parent, child), at the least depth; cycles end at nodes that were reached before.

    Each level is settled, so level n costs one join with the level before it and not n of them.
    """
    found = settled(roots.select("node", F.lit(0).alias("depth")).distinct())
    for depth in itertools.count(1):
        level = found.where(F.col("depth") == depth - 1).select("node").join(edges, F.col("node") == F.col("parent")).select(F.col("child").alias("node")).distinct()
        level = settled(level.join(found.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            dropped(level)
            return found
        both = settled(found.unionByName(level))  # one table, so a level reads what is known once
        dropped(found, level)
        found = both


#: Rows of a level up to which it is sent to the other side of a join, instead of both being shuffled.
FEW = 100_000


def _beside(few: DataFrame, n: int, many: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``few`` (``n`` of them) joined with ``many``; a side is sent whole only by its counted rows.

    Levels are small as Parquet and large as rows, so the size of their files must not make a broadcast.
    """
    return many.hint("merge").join(few, on) if n > FEW else many.join(F.broadcast(few), on)


def labelled_reach(edges: DataFrame, roots: DataFrame, through: DataFrame | None = None) -> DataFrame:
    """(label, node) reachable from ``roots`` (label, node) over ``edges`` (a, b), all labels at once, roots included.

    ``through`` (label, node, passable) says where a walk goes on: a node that isn't
    passable for a label is reached but not left. Roots are always left. Each round is
    one join of the newest pairs with the edges; large levels are shuffled on the node,
    small ones sent to the edges. ``edges`` is read once a round and best settled.
    """
    onward = edges.select(F.col("a").alias("node"), "b")
    level = settled(roots.select("label", "node").distinct())
    levels, n, turn = [level], level.count(), 0
    read = level.sparkSession.read.schema(level.schema)
    while n:
        turn += 1
        if through is not None and turn > 1:
            level = _beside(level, n, through.where("passable").select("label", "node"), ["label", "node"]).distinct()
        ahead = settled(_beside(level, n, onward, ["node"]).select("label", F.col("b").alias("node")).distinct())
        m = ahead.count()
        found = read.parquet(*(x._settled_at for x in levels))
        known = _beside(ahead, m, found, ["label", "node"])
        level = settled(ahead.join(known.hint("merge"), ["label", "node"], "left_anti"))
        levels.append(level)
        n = level.count()
        dropped(ahead)
    out = settled(read.parquet(*(x._settled_at for x in levels)))
    dropped(*levels)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (a, b), direction aside; the component is its smallest node.

    Every node points at the smallest node it has met; rounds alternate between a step
    over the edges and one over the pointers, so a chain of n nodes needs about log n.
    """
    both = settled(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    at = settled(both.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("node"), F.least("a", "to").alias("to")))
    while True:
        # the smallest pointer beside a node is offered to the node and to the one it points at
        seen = both.join(at.select(F.col("node").alias("b"), F.col("to").alias("offer")), "b").groupBy("a").agg(F.min("offer").alias("offer")).select(F.col("a").alias("node"), "offer")
        offers = at.join(seen, "node")
        pool = offers.select("node", "offer").unionByName(offers.select(F.col("to").alias("node"), "offer")).groupBy("node").agg(F.min("offer").alias("offer"))
        step = at.join(pool, "node", "left").select("node", "to", F.least("to", F.coalesce("offer", "to")).alias("next"))
        step = settled(step)
        jumped = step.join(step.select(F.col("node").alias("next"), F.col("next").alias("far")), "next").select("node", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved"))
        jumped = settled(jumped)
        dropped(at, step)
        at = jumped
        if at.where("moved").isEmpty():
            dropped(both)
            return at.select("node", F.col("to").alias("component"))


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that lies on a cycle with another; the component is its smallest node.

    Every node takes the smallest node that reaches it as its colour. The nodes of a
    colour that reach back to that node are one component. Edges between colours, and
    those of nodes that are settled or lie at an end, can be on no further cycle and
    leave; what remains is coloured again. All graphs of a table are worked on at once,
    so rounds follow the longest path of any of them, not their number.
    """
    left = settled(edges.select("a", "b").where("a <> b").distinct())
    done = None
    while not left.isEmpty():
        inner = left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        inner = settled(inner.select("a", "b"))
        dropped(left)
        colour = settled(inner.select(F.col("a").alias("node")).union(inner.select("b")).distinct().select("node", F.col("node").alias("colour")))
        while True:
            came = inner.join(colour.select(F.col("node").alias("a"), "colour"), "a").groupBy("b").agg(F.min("colour").alias("came")).withColumnRenamed("b", "node")
            step = colour.join(came, "node", "left").select("node", F.least("colour", F.coalesce("came", "colour")).alias("colour"), (F.col("came") < F.col("colour")).alias("moved"))
            step = settled(step)
            dropped(colour)
            colour = step
            if colour.where("moved").isEmpty():
                break
        of = lambda end, name: colour.select(F.col("node").alias(end), F.col("colour").alias(name))  # noqa: B023, E731
        within = settled(inner.join(of("a", "x"), "a").join(of("b", "y"), "b").where("x = y").select("a", "b", F.col("x").alias("colour")))
        back = labelled_reach(within.select(F.col("b").alias("a"), F.col("a").alias("b")), colour.where("node = colour").select(F.col("colour").alias("label"), "node"))
        found = settled(back.select("node", F.col("label").alias("component")))
        rest = within.join(found.select(F.col("node").alias("a")), "a", "left_anti").join(found.select(F.col("node").alias("b")), "b", "left_anti")
        left = settled(rest.select("a", "b"))
        dropped(back, inner, colour, within)
        whole = settled(found if done is None else done.unionByName(found))
        dropped(found, done)
        done = whole
    if done is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    size = done.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    return done.join(size, "component", "left_semi").select("node", "component")


def bounded_hops(links: DataFrame, hops: int = 8) -> DataFrame:
    """Follow unique (name, target) links for at most ``hops`` steps: (name, terminal, hops); cycles and longer chains are dropped."""
    unique = links.groupBy("name").agg(F.min("target").alias("target"), F.count("*").alias("n")).where("n = 1").drop("n")
    walk = unique.select("name", F.col("target").alias("at"), F.array("name", "target").alias("seen"))
    done = None
    for step in range(1, hops + 1):
        nxt = walk.join(unique.select(F.col("name").alias("at"), F.col("target").alias("to")), "at", "left")
        ended = nxt.where(F.col("to").isNull()).select("name", F.col("at").alias("terminal"), F.lit(step).alias("hops"))
        done = ended if done is None else done.unionByName(ended)
        walk = settled(nxt.where(F.col("to").isNotNull() & ~F.array_contains("seen", F.col("to"))).select("name", F.col("to").alias("at"), F.concat("seen", F.array("to")).alias("seen")))
        if walk.isEmpty():
            break
    return done
