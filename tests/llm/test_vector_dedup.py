import numpy as np

from treeline.llm import vector_dedup as vd


def brute(rows):
    """(links, component) by identifier from all pairs in double precision."""
    good = [(i, lab, np.array(v, float)) for i, lab, v in rows if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i, _, _ in rows}
    for a in range(len(good)):
        for b in range(a):
            (i, x, u), (j, y, v) = good[a], good[b]
            if x == y and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.93:
                links[i].add(j)
                links[j].add(i)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(seen))
    return out


def test_against_brute_force(spark):
    draw = np.random.default_rng(3)
    rows, n = [], 0
    for label in (0, 1):
        for _ in range(12):
            centre = draw.standard_normal(16)
            for _ in range(int(draw.integers(1, 8))):
                v = centre + draw.standard_normal(16) * draw.uniform(0, 0.5)
                rows.append((n, label, [float(x) for x in v.astype(np.float32)]))
                n += 1
    rows += [(n + k, 1, rows[-1][2]) for k in range(5)]
    n += 5
    odd = [(n, None, [1.0] * 16), (n + 1, 1, None), (n + 2, 1, []), (n + 3, 1, [0.0] * 16), (n + 4, 1, [float("nan")] * 16), (n + 5, 1, [float("inf")] * 16), (n + 6, 1, [None] + [1.0] * 15), (n + 7, 1, [1.0, 2.0])]
    rows += odd
    table = spark.createDataFrame([(*r, 7, "z") for r in rows], "vec_id long, label int, embedding array<float>, size long, rep string")
    want = brute(rows)
    for block in (5, 2048):
        got = {r.vec_id: (r.n_links, r.component_id) for r in vd.near_duplicates(table, block=block).collect()}
        assert got == want
        assert all(r.kept == (r.vec_id == r.component_id) for r in vd.near_duplicates(table, block=block).collect())
    assert vd.near_duplicates(table.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0])], "vec_id long, label int, embedding array<float>")
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in vd.near_duplicates(nulls).collect()} == {(None, 0, None, False), (1, 0, 1, True)}


def test_bounds_hold_and_estimates_are_unbiased():
    draw = np.random.default_rng(1)
    x = draw.standard_normal((300, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    codes, factors = vd.encode(x)
    turned = x @ vd.rotation(32)
    for width in (None, vd.WIDTH):
        assert (vd.upper_bounds(codes, factors, turned, width) >= x @ x.T - 1e-4).all()
    assert (vd.upper_bounds(codes, factors, turned, 1.0) < vd.upper_bounds(codes, factors, turned, None)).any()
    signs = (np.unpackbits(codes, axis=1, count=32) * 2.0 - 1) / np.sqrt(32)
    estimate = vd.estimates(factors[:, None], signs @ turned.T)
    off = ~np.eye(300, dtype=bool)
    assert abs((estimate - x @ x.T)[off].mean()) < 0.005


def test_repeated_identifiers_are_vectors_of_their_own(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.999, 0.01, 0.0], [0.0, 0.0, 1.0]
    rows = [(3, 1, a), (7, 1, b), (7, 1, c), (9, 1, c), (3, 1, c)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vd.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")).collect())
    assert got == [(3, 1, 3, True), (3, 2, 3, True), (7, 1, 3, False), (7, 2, 3, False), (9, 2, 3, False)]
