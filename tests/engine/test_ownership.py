import random

import pytest

from treeline.operators.scratch import settled
from treeline.plans import ownership


def _cores(spark, text):
    units = settled(ownership.unit_table(spark.createDataFrame([("a.rs", bytearray(text.encode()))], "path string, source binary")))
    names = {r.unit: r.name for r in units.collect()}
    members = ownership.cores(units)
    return [[names[u] for u in r.units] for r in sorted(ownership.ranked(units, members).collect(), key=lambda r: r.rank)], units, members


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("struct T; impl T { fn a(&self) { self.b() } fn b(&self) {} fn c(&self) { self.b() } }", []),  # two consumers
        ("struct T; impl T { fn a(&self) { self.b(); self.c() } fn b(&self) {} fn c(&self) {} }", []),  # two targets
        ("struct T; impl T { fn a(&self) { Self::b() } fn b() {} }", [["a", "b"]]),
        ("struct P; struct T; impl T { fn a(&self, p: P) {} fn b(&self) -> P { P } }", [["a", "b"]]),
        ("pub struct P; struct T; impl T { fn a(&self, p: P) {} fn b(&self) -> P { P } }", []),  # public payload
        ("struct P; impl P { fn n() {} } struct T; impl T { fn a(&self, p: P) {} fn b(&self) -> P { P } }", []),  # the payload has an impl
        ("struct P; struct T; impl T { fn a(&self, p: P) {} fn b(&self) -> P { P } } fn f() { P; }", []),  # another consumer
        ("struct P; struct T; struct U; impl T { fn a(&self, p: P) {} } impl U { fn b(&self) -> P { P } }", []),  # two owners
        # a payload joins members that the member rule alone leaves apart, and both rules grow one core
        ("struct P; struct T; impl T { fn a(&self, p: P) { self.b() } fn b(&self) {} fn c(&self) -> P { P } }", [["a", "b", "c"]]),
        ("fn a() { b() } fn b() { a(); c() } fn c() { d() } fn d() { c() }", [["a", "b"], ["c", "d"]]),
    ],
)
def test_seed_rules(spark, text, want):
    assert _cores(spark, text)[0] == want


def _by_hand(edges, nodes, members):
    """Each core by itself, on sets."""
    out = set()
    incoming, outgoing = {}, {}
    for a, b, uncertain in edges:
        if a != b:
            incoming.setdefault(b, set()).add((a, uncertain))
            outgoing.setdefault(a, set()).add(b)
    for core in {c for c, _ in members}:
        own = {n for c, n in members if c == core}

        def walk(ahead):
            seen, todo = set(own), list(own)  # noqa: B023
            while todo:
                for b in outgoing.get(todo.pop(), ()):
                    if b not in seen:
                        seen.add(b)
                        if ahead(b):
                            todo.append(b)
            return seen

        reach = walk(lambda b: True)

        def reasons(n):
            exposed, imported, unsupported = nodes[n]
            uncertain = any(u for a, u in incoming[n] if a in reach)  # noqa: B023
            shared = any(a not in reach for a, _ in incoming[n])  # noqa: B023
            found = {"public_or_exposed_boundary": exposed, "import_boundary": imported, "unsupported_context": unsupported, "uncertain_identity": uncertain, "observed_shared_node": shared}
            return sorted(k for k, v in found.items() if v)

        for n in walk(lambda b: not reasons(b)) - own:
            why = reasons(n)
            kind = "undetermined" if {"uncertain_identity", "unsupported_context"} & set(why) else "observed_shared" if "observed_shared_node" in why else "observed_exclusive"
            out.add((core, n, tuple(why), kind))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_companions_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    names = [f"{k:02}" for k in range(40)]
    pairs = {(rng.choice(names), rng.choice(names)) for _ in range(60)}
    edges = [(a, b, rng.random() < 0.08) for a, b in pairs]
    nodes = {n: tuple(rng.random() < 0.08 for _ in range(3)) for n in names}
    members = [(f"core{k}", n) for k in range(4) for n in rng.sample(names, 3)]
    found = ownership.companions(
        spark.createDataFrame(edges, "a string, b string, uncertain boolean"),
        spark.createDataFrame([(n, *f) for n, f in nodes.items()], "node string, exposed boolean, imported boolean, unsupported boolean"),
        spark.createDataFrame(members, "core string, node string"),
    )
    assert {(r.core, r.node, tuple(r.reasons), r.classification) for r in found.collect()} == _by_hand(edges, nodes, members)


def test_nothing_to_own(spark):
    found, units, members = _cores(spark, "")
    assert found == [] and units.count() == 0 and ownership.unit_companions(units, members).collect() == []
