import numpy as np
import pytest
from pyspark.sql import functions as F

from treeline.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, score string, row long"


def _brute(rows, anchor, positives=5, negatives=3, low=50, high=95):
    fit = []
    for vec_id, vector, label, *_ in rows:
        if vec_id is not None and label is not None and vector is not None and all(x is not None and np.isfinite(x) for x in vector):
            fit.append((vec_id, label, [int(np.floor(256 * float(np.float32(x)))) for x in vector]))
    out = []
    for a, (anchor_id, label, q) in enumerate(fit):
        if not anchor(anchor_id):
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, o, strict=True)), i, k, own) for k, (i, own, o) in enumerate(fit) if k != a and len(o) == len(q))
        for score, positive, _, _ in [s for s in scored if s[3] == label][:positives]:
            within = [(i, -s) for s, i, _, own in scored if own != label and -50 * score <= -100 * s <= -95 * score]
            out += [(anchor_id, positive, rank, i, -score, s) for rank, (i, s) in enumerate(within[:negatives], 1)]
    return sorted(out)


def _rows(n=260, dim=10, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((4, dim))
    rows = []
    for k in range(n):
        label = int(rng.integers(4)) if k % 3 else 0  # one label holds more than a third
        rows.append((k, (centre[label] * 0.4 + rng.standard_normal(dim) * 0.5 + 0.2).astype(np.float32).tolist(), label, "s", 1))
    rows += [(n + k, rows[6][1], k % 3, "s", 1) for k in range(40)]  # one vector many times, under several labels
    rows += [(None, rows[0][1], 1, None, None), (1001, None, 1, None, None), (1002, rows[0][1], None, None, None), (1003, [float("nan")] * dim, 1, None, None), (1004, [None] * dim, 1, None, None)]
    rows += [(1005, [float("inf")] * dim, 1, None, None), (1010, [], 1, None, None), (1020, [], 2, None, None), (1030, [0.5] * 3, 1, None, None), (1040, [0.5] * 3, 1, None, None), (1050, [0.4] * 3, 2, None, None)]
    return rows + [(20, rows[20][1], 2, "s", 1), (21, rows[21][1], rows[21][2], "s", 1)]  # identifiers again


@pytest.mark.parametrize("sizes", [{}, {"chunk": 3, "anchor_block": 4, "row_block": 50}, {"chunk": 64, "anchor_block": 100, "row_block": 7}])
def test_against_all_products(spark, sizes):
    rows = _rows()
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = H.mine(table, F.col("vec_id") % 10 == 0, **sizes).collect()
    got = sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in found)
    want = _brute(rows, lambda i: i % 10 == 0)
    assert got == want and len(want) > 100


def test_scores_survive_packing_and_large_components():
    rng = np.random.default_rng(2)
    for scale in (0, 1, 100, 2**31, 2**62):
        scores = rng.integers(-scale, scale + 1, (7, 33))
        assert (H.unpack_scores(H.pack_scores(scores), scores.size) == scores.ravel()).all()
    big = rng.integers(-(2**29), 2**29, (5, 8))
    assert H.products(big, big).tolist() == [[sum(int(x) * int(y) for x, y in zip(a, b, strict=True)) for b in big] for a in big]


def test_nothing_to_mine(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert H.mine(empty, F.col("vec_id") % 10 == 0).collect() == []
    assert H.mine(spark.createDataFrame(_rows(20), SCHEMA), F.lit(False)).collect() == []
