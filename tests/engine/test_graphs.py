import random

import pytest

from treeline.functions import advice
from treeline.operators import graphs


def _edges(spark, pairs):
    return spark.createDataFrame([(f"{a:03}", f"{b:03}") for a, b in pairs], "a string, b string")


@pytest.mark.parametrize("seed", range(3))
def test_strong_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    pairs = [(base + rng.randrange(12), base + rng.randrange(12)) for base in range(0, 120, 12) for _ in range(14)]
    got = {}
    for r in graphs.strong_components(_edges(spark, pairs)).collect():
        got.setdefault(r.component, []).append(int(r.node))
    want = advice.strongly_connected(132, pairs)
    assert sorted(map(sorted, got.values())) == want and all(int(k) == min(v) for k, v in got.items())


def test_paths_and_empty_graphs_have_no_strong_component(spark):
    assert graphs.strong_components(_edges(spark, [(k, k + 1) for k in range(6)])).collect() == []
    assert graphs.strong_components(_edges(spark, [(1, 1)])).collect() == []
    assert graphs.strong_components(_edges(spark, [])).collect() == []


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    order = rng.sample(range(150), 60)  # one chain in no order
    pairs = [*zip(order, order[1:], strict=False), *[(200 + rng.randrange(60), 200 + rng.randrange(60)) for _ in range(35)]]
    up = {x: x for p in pairs for x in p}
    for _ in up:
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    assert {int(r.node): int(r.component) for r in graphs.components(_edges(spark, pairs)).collect()} == up


def test_labelled_reach_stops_where_it_may_not_pass(spark):
    edges = _edges(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 2), (9, 9)])
    roots = spark.createDataFrame([("x", "001"), ("y", "006"), ("z", "005")], "label string, node string")
    got = {(r.label, int(r.node)) for r in graphs.labelled_reach(edges, roots).collect()}
    assert got == {*(("x", k) for k in (1, 2, 3, 4, 5)), *(("y", k) for k in (6, 2, 3, 1, 4, 5)), ("z", 5)}
    through = spark.createDataFrame([(lab, f"{k:03}", (lab, k) not in {("x", 3), ("y", 4)}) for lab in "xyz" for k in range(1, 10)], "label string, node string, passable boolean")
    got = {(r.label, int(r.node)) for r in graphs.labelled_reach(edges, roots, through).collect()}
    assert got == {*(("x", k) for k in (1, 2, 3)), *(("y", k) for k in (6, 2, 3, 1, 4)), ("z", 5)}


def test_a_walk_sends_only_levels_that_it_counted(spark, monkeypatch):
    """Files of a level say nothing of its rows: with a threshold that all files meet, large levels are shuffled all the same."""
    pairs = [(k, k + 1) for k in range(5)]
    few, many = spark.createDataFrame([("x", "000")], "label string, node string"), _edges(spark, pairs).withColumnRenamed("a", "node")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        plan = lambda n: graphs._beside(few, n, many, ["node"])._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan(graphs.FEW + 1) and "Broadcast" in plan(graphs.FEW)
        monkeypatch.setattr(graphs, "FEW", 0)
        assert {(r.label, int(r.node)) for r in graphs.labelled_reach(_edges(spark, pairs), few).collect()} == {("x", k) for k in range(6)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
