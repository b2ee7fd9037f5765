import hashlib
import random
from collections import defaultdict

import numpy as np

from treeline.llm import chosen_path as cp
from treeline.llm import components as components_module
from treeline.llm.components import components
from treeline.llm.runtime import cut


def brute(rows):
    """(links, component) by identifier from exact Jaccard similarities of all pairs."""
    shingler = cp.Shingler()
    sets = {i: set(shingler.set_of(t).tolist()) for i, t in rows}
    links = defaultdict(set)
    ids = list(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and len(x & y) >= 0.8 * len(x | y):
                links[ids[a]].add(ids[b])
                links[ids[b]].add(ids[a])
    out = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(seen))
    return out


def test_against_brute_force(spark, monkeypatch):
    draw = random.Random(4)
    rows, n = [], 0
    for _ in range(25):
        words = [f"w{draw.randrange(500)}" for _ in range(draw.randrange(3, 120))]
        for _ in range(draw.randrange(1, 7)):
            own = list(words)
            for _ in range(draw.randrange(0, 4)):
                own[draw.randrange(len(own))] = f"v{draw.randrange(500)}"
            rows.append((n, " ".join(own)))
            n += 1
    rows += [(n, rows[0][1]), (n + 1, rows[0][1].upper() + "  "), (n + 2, ""), (n + 3, None), (n + 4, "a b"), (n + 5, "a  b")]
    want = brute(rows)
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, rep long, bucket long")
    for small in (False, True):
        if small:  # every group in several blocks
            monkeypatch.setattr(cp, "BUCKET_BLOCK", 2)
            monkeypatch.setattr(cp, "EXACT_BLOCK", 2)
        got = {r.doc_id: (r.n_links, r.component_id) for r in cp.jaccard_join(table).collect()}
        assert got == want


def test_repeated_identifiers(spark):
    """Rows are documents, whatever their identifiers: links, components and the one that is kept against brute force."""
    draw = random.Random(9)
    rows = []
    for _ in range(15):
        words = [f"w{draw.randrange(300)}" for _ in range(draw.randrange(3, 60))]
        for _ in range(draw.randrange(1, 6)):
            own = list(words)
            for _ in range(draw.randrange(0, 3)):
                own[draw.randrange(len(own))] = f"v{draw.randrange(500)}"
            rows.append((draw.choice([None, *range(12)]), " ".join(own)))
    rows = list({*rows, (3, "a b c"), (7, "a b c"), (7, "other words of its own")})
    want = brute(list(enumerate(t for _, t in rows)))
    got = cp.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {(r.doc_id, r.text_sha256): r for r in got}
    assert len(by) == len(got) == len(rows)
    kept = {}
    for k, (i, t) in enumerate(rows):
        r = by[i, hashlib.sha256(t.encode()).hexdigest()]
        mates = [rows[j] for j, (_, c) in want.items() if c == want[k][1]]
        first = min(mates, key=lambda m: (m[0] is None, m[0] or 0, hashlib.sha256(m[1].encode()).hexdigest()))
        assert (r.n_links, r.component_id, r.kept) == (want[k][0], first[0], (i, t) == first)
        kept[want[k][1]] = kept.get(want[k][1], 0) + r.kept
    assert set(kept.values()) == {1}


def test_recall_on_a_real_table(spark, monkeypatch):
    """Links of every document against all exact pairs, found by an inverted index; also with buckets split further."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    shingler, where, sets = cp.Shingler(), defaultdict(list), {}
    for i, t in rows:
        sets[i] = shingler.set_of(t)
        for x in sets[i].tolist():
            where[x].append(i)
    shared = defaultdict(int)
    for ids in where.values():
        for n, a in enumerate(ids):
            for b in ids[:n]:
                shared[a, b] += 1
    links = defaultdict(int)
    for (a, b), n in shared.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            links[a] += 1
            links[b] += 1
    for split in (cp.SPLIT_ABOVE, 1):
        monkeypatch.setattr(cp, "SPLIT_ABOVE", split)
        got = {r.doc_id: r.n_links for r in cp.jaccard_join(docs).collect()}
        assert sum(links.values()) > 150
        assert sum(min(got[i], n) for i, n in links.items()) >= 0.995 * sum(links.values())
        assert all(got[i] <= links[i] for i in got)


def test_odd_rows(odd_docs, no_docs):
    got = cp.jaccard_join(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got}
    assert (by[1].n_links, by[1].class_size, by[1].component_id) == (3, 3, 1)
    assert by[4].n_links == by[5].n_links == by[6].n_links == 0 and by[4].kept
    assert by[12].component_id == 11 and by[None].kept
    assert cp.jaccard_join(no_docs).count() == 0


def test_pairs_at_the_threshold_meet():
    draw = np.random.default_rng(0)
    met = 0
    for k in range(200):
        shared, own = draw.integers(0, 2**63, 400, dtype=np.uint64), draw.integers(0, 2**63, 100, dtype=np.uint64)
        a, b = np.concatenate([shared, own[:50]]), np.concatenate([shared, own[50:]])
        row, bucket = cp.paths(np.array([cp.embed(a), cp.embed(b)]), cp.runs_for())
        met += bool(set(bucket[row == 0].tolist()) & set(bucket[row == 1].tolist()))
    assert met >= 198


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 10), (3, 1), (20, 20)] + [(100 + k, 101 + k) for k in range(40)] + [(500, 600 + k) for k in range(200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 9, 10: 9} | {k: 100 for k in range(100, 141)} | {500: 500} | {600 + k: 500 for k in range(200)}


def test_components_of_a_chain_take_few_rounds(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(components_module, "cut", lambda df: tables.append(1) or cut(df))
    got = components(spark.range(10_000).selectExpr("id as a", "id + 1 as b")).collect()
    assert len(got) == 10_001 and {r.component for r in got} == {0}
    assert len(tables) <= 5 + 15  # one round: edges, pointers, 15 doublings, labels, edges that are left
